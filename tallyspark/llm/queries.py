"""The registered queries of this package: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import align, chat, ctw, language, licenses, mixing, neardup, packing, rans, resample, secrets, topk
from tallyspark.llm.common import arm, table
from tallyspark.llm.quality import score_repetition


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", arm("doc_id", 4) == 2)
    model = language.train(docs.where("not held_out"))
    return language.identify(docs, model).withColumn("held_out", arm("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score", "proportions")


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_repetition(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors.where("vec_id % 100 = 0"), vectors)


def op3_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), inside=True)


def op5_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.digest(chat.format_chats(rows.withColumn("parts", chat.text_parts(F.col("text")))))


def op6_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).drop("row")


def op7_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.fit(secrets.windows(docs))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return secrets.scan(docs, model).withColumn("spans", spans)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.plan_mix(table(spark, sf_dir, "documents")))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = ctw.score_texts(docs, arm("doc_id", 5) != 1)
    return scored.select("doc_id", (arm("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Banding(words=3, percent=85))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


def op12_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rans.read_tokens(spark, rans.store(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_mixture, op2_repetition_coverage, op3_license_dice, op4_exact_topk, op5_chat_parts, op6_best_fit_pack, op7_secret_crf, op8_mix_sources, op9_context_tree, op10_tensored_minhash, op11_token_alignment, op12_rans_tokens, op13_importance_resample)}


def oracle_sql() -> dict[str, str]:
    return {"op2_repetition_coverage": OP2, "op4_exact_topk": OP4, "op5_chat_parts": OP5, "op10_tensored_minhash": OP10, "op13_importance_resample": OP13}


# The limits are those of RepetitionRules.
OP2 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d
), lines AS (
  SELECT doc_id, line, count(*) - 1 AS again FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
), dup AS (
  SELECT doc_id, CAST(sum(again) AS BIGINT) AS n_dup_lines, CAST(sum(again * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS BIGINT) AS dup_chars FROM lines GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM d
), near AS (
  SELECT doc_id, j, w, {LEADS} FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY j)
), grams AS (
  {GRAMS}
), often AS (
  SELECT doc_id, n, i FROM grams QUALIFY CASE WHEN n = 3 THEN count(*) OVER (PARTITION BY doc_id, n, g) ELSE row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) END > 1
), inside AS (
  SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS j FROM often
), cover AS (
  SELECT doc_id, n, count(*) AS words, sum(length(w)) AS chars FROM inside JOIN words USING (doc_id, j) GROUP BY ALL
), share AS (
  SELECT doc_id, max(CASE WHEN n = 3 THEN words END) AS repeated, max(CASE WHEN n > 3 THEN chars / word_chars END) AS top,
    bool_or(n > 3 AND chars / word_chars > [0.15, 0.14, 0.13, 0.12, 0.11, 0.10][n - 4]) AS bad FROM cover JOIN base USING (doc_id) GROUP BY doc_id
), every AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeat_words,
    coalesce(dup_chars / nullif(word_chars, 0), 0.0) AS line_share, coalesce(top, 0.0) AS ngram_share, coalesce(n_symbols / nullif(n_words, 0), 0.0) AS symbol_share, coalesce(bad, false) AS bad
  FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN share USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM every
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT bad AND line_share <= 0.15 AS kept, line_share, ngram_share, symbol_share FROM judged
""".replace("{LEADS}", ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, 10))).replace(
    "{GRAMS}", "\n  UNION ALL ".join(f"SELECT doc_id, {n} AS n, j AS i, concat_ws(' ', w, {', '.join(f'w{k}' for k in range(1, n))}) AS g FROM near WHERE w{n - 1} IS NOT NULL" for n in (3, 5, 6, 7, 8, 9, 10))
)

# All pairs that share a shingle, and what they reach.
OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) END AS s FROM d
), terms AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM terms a JOIN terms b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(u, v) AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least_of AS (
  SELECT u, min(v) AS m FROM reach GROUP BY u
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept FROM sets LEFT JOIN least_of ON u = doc_id
"""


OP4 = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
"""

# In its texts, "~" and the control strings of the template are two characters and two characters longer.
OP5 = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, (length(text) - length(replace(text, '~', ''))) + sum_marks AS extra FROM (
    SELECT *, list_sum(list_transform(['<|', '|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
      lambda c: 2 * ((length(text) - length(replace(text, c, ''))) // length(c)))) AS sum_marks FROM rows)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('<|role|>') + length('<|text|>') + length('<|end|>') + length(role) + length(text) + extra) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

# crc32 is folded over the bytes of each distinct feature, with the table of its polynomial.
OP13 = r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), every AS (
  SELECT 0 AS kind, doc_id, text, row_number() OVER () AS r FROM documents UNION ALL SELECT 1, item_id, text, row_number() OVER () FROM benchmark
), words AS (
  SELECT kind, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM every
), runs AS (
  SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM words
), counted AS (
  SELECT kind, r, g, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT g, xor(list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || h[2 * i - 1 : 2 * i] AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT g, hex(encode(g)) AS h FROM counted), crc
), buckets AS (
  SELECT b, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM counted JOIN hashed USING (g) GROUP BY b
), gains AS (
  SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM buckets
), weighed AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN hashed USING (g) JOIN gains USING (b) WHERE kind = 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weighed USING (r) WHERE kind = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, 5 * count(*) FILTER (able) OVER () // 100 AS most FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= most THEN place END AS rank FROM ranked
"""
