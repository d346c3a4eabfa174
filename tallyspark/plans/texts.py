"""Queries on retrieval, packing, catalogues, graphs and the bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators import bootstrap, catalog, graph, packing, retrieval
from tallyspark.sources.tables import load


def question_turns(spark: SparkSession, d: str) -> DataFrame:
    """A user's turn and the assistant's answer right after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(order), "answer": F.lead("text").over(order)})
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


PAIRS = """q AS (SELECT conv_id, turn, text AS question, a AS answer FROM (SELECT *, lead(role) OVER w r, lead(text) OVER w a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"""


def history_budget(spark: SparkSession, d: str) -> DataFrame:
    out = packing.history_budget(question_turns(spark, d), "conv_id", "turn", "question", "answer", budget=1500, digest_budget=500, always=1)
    return out.select("conv_id", "turn", "part")


def history_last_n(spark: SparkSession, d: str) -> DataFrame:
    return packing.last_n(load(spark, d, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "role")


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    chunks = F.posexplode(packing.chunk_lines(F.col("text"), 700)).alias("chunk", "body")
    return load(spark, d, "documents").select("doc_id", chunks).select("doc_id", "chunk", F.length("body").alias("n_chars"), F.sha2("body", 256).alias("sha256"))


def evidence_batches(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("size"))
    rows = packing.batch_rows(lines, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "size"], "size", 4, 90)
    return rows.groupBy("l_suppkey", "batch").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("bytes"))


def lexical_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    """Parts by their names' and kinds' words; every distinct name and kind asks."""
    commas = lambda c: F.replace(c, F.lit(" "), F.lit(", "))
    part = load(spark, d, "part")
    asked = F.concat_ws(", ", commas(F.col("p_name")), F.lower("p_type"))
    records = part.select(F.col("p_partkey").alias("record_id"), commas(F.col("p_name")).alias("title"), F.concat_ws(", ", "p_type", F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("body"), F.array(F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"))).alias("phrases"), (F.col("p_size") % 3).alias("modalities"))
    questions = part.select(asked.alias("question_id"), asked.alias("question")).distinct()
    return retrieval.rank(questions, records, 5)


def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    public = load(spark, d, "documents").select(F.col("doc_id").alias("public_id"), "text")
    private = load(spark, d, "benchmark").select(F.col("item_id").alias("private_id"), F.col("text").alias("value"))
    return retrieval.leaks(public, private, "text", "value")


def outcome_guard(spark: SparkSession, d: str) -> DataFrame:
    """All turns, and one sentence of each kind that the guard tells apart."""
    cases = spark.sql("SELECT conv_id, 0L AS turn, text FROM VALUES (-1L, 'Students solved the problem.'), (-2L, 'Ask the students to solve it.'), (-3L, '学生已经掌握了方法'), (-4L, '引导学生理解图像'), (-5L, 'The class may improve later.') AS v(conv_id, text)")
    rows = load(spark, d, "conversations").select("conv_id", "turn", "text").unionByName(cases)
    return retrieval.outcome_flags(rows, "text", "asserted").select("conv_id", "turn", "asserted")


def support_counts(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.support(load(spark, d, "conversations"), "conv_id", "turn", "text", {"thing": "thing", "ention": "ention", "never": "zzzz"})


def judge_answers(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 4).alias("a"), (F.col("l_tax") * 125).alias("b"))
    return retrieval.judge(li, ["l_orderkey"], "l_linenumber", "a", "b")


def search_list(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").where(retrieval.contains_text("000012", "c_name", "c_mktsegment")).select("c_custkey")


def soft_delete_antijoin(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").withColumn("deleted_at", F.when(F.col("doc_id") % 10 == 3, F.lit("2024-01-01")))
    rows = catalog.without_tombstones(docs, load(spark, d, "labels").where("toxic = 1"), ["doc_id"])
    return catalog.live(rows, "deleted_at", "doc_id").select("doc_id", "lang")


def project_rollup(spark: SparkSession, d: str) -> DataFrame:
    customers = load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return catalog.project_rollup(customers, orders, orders.where("o_orderstatus <> 'P'"), "k")


def conversation_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.conversation_summary(load(spark, d, "conversations"), "conv_id", "turn", "role", "text")


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Orders with an old shape (no failures column) and a new one."""
    li = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    old = li.where("l_orderkey % 2 = 0").withColumn("failed", F.lit(0).cast("long"))
    out = catalog.run_summary([old, li.where("l_orderkey % 2 = 1")], "total", "done", "failed")
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def released_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("source", F.sha2("text", 256).alias("path"), "n_chars")
    return catalog.distinct_bytes(rows, "path", "n_chars", ["source"])


def skill_rollup(spark: SparkSession, d: str) -> DataFrame:
    v = F.struct(F.array("l_shipflag").alias("targets"), F.array("l_partkey", "l_suppkey").alias("actions"))
    li = load(spark, d, "lineitem").withColumn("l_shipflag", F.concat("l_returnflag", "l_linestatus"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipflag", v.alias("v")))).alias("x")).select("l_orderkey", F.transform("x", lambda s: s["v"]).alias("variants"))
    out = catalog.skill_rollup(rows, "l_orderkey", "variants")
    return out.select("l_orderkey", F.array_join("render_targets", ",").alias("render_targets"), "n_actions")


def schedule_cross(spark: SparkSession, d: str) -> DataFrame:
    return catalog.schedule(load(spark, d, "supplier").select("s_suppkey"), [11, 23, 47], ["transcript", "final", "uniform", "oracle"], "s_suppkey", "schedule-v1")


def review_tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out = catalog.review_order(rows, [F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT"], "o_orderkey")
    return out.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_order"))


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations").withColumn("tokens", F.length("text").cast("long"))
    return catalog.token_totals(rows, "role", ["tokens"], ["conv_id"])


def delivery_audit(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    s = catalog.delivery_status(F.col("l_returnflag"), F.when(F.col("l_quantity") > 5, F.when(F.col("l_discount") > 0.05, "N").otherwise(F.col("l_returnflag"))))
    return li.groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


PARENTS = """SELECT (doc_id * 7 + 3) % n AS c, (doc_id * doc_id + 1) % n AS p FROM documents, (SELECT count(*) AS n FROM documents)"""


def cycle_check(spark: SparkSession, d: str) -> DataFrame:
    """A parent graph over documents, made of their ids."""
    docs = load(spark, d, "documents")
    n = docs.count()
    return graph.on_cycles(docs.select(((F.col("doc_id") * 7 + 3) % n).alias("c"), ((F.col("doc_id") * F.col("doc_id") + 1) % n).alias("p")), "c", "p")


def cycle_components(spark: SparkSession, d: str) -> DataFrame:
    """The same parent graph's cycles, each named by its largest node."""
    docs = load(spark, d, "documents")
    n = docs.count()
    return graph.cycle_components(docs.select(((F.col("doc_id") * 7 + 3) % n).alias("c"), ((F.col("doc_id") * F.col("doc_id") + 1) % n).alias("p")), "c", "p")


def topo_rank(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as a diagram; a line points to the later ones whose number its own divides."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    other = li.withColumnRenamed("l_linenumber", "target")
    edges = li.withColumnRenamed("l_linenumber", "source").join(other, "l_orderkey").where("source < target and target % source = 0")
    return graph.layout(li.select("l_orderkey", F.col("l_linenumber").alias("node"), F.col("l_linenumber").alias("place")), edges, "l_orderkey", 3)


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Region, nation, status and priority stand for teacher, video, case and seed; order years' parity for the arm."""
    o, c, n = (load(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    rows = rows.select(F.col("n_regionkey").alias("teacher"), F.col("n_nationkey").alias("video"), F.col("o_orderstatus").alias("case_id"), F.col("o_orderpriority").alias("seed"), F.when(F.year("o_orderdate") % 2 == 0, "oracle").otherwise("base").alias("arm"), (F.col("o_totalprice") / 1000).alias("f1"), (F.col("o_custkey") % 100).cast("double").alias("coverage"))
    levels = ["teacher", "video", "case_id", "seed"]
    rows = rows.groupBy(*levels, "arm").agg(F.avg("f1").alias("f1"), F.avg("coverage").alias("coverage"))
    boot = bootstrap.bootstrap_difference(rows, levels, "arm", "oracle", "base", ["f1", "coverage"], 20240731, 1000)
    out = bootstrap.intervals(boot, ["f1", "coverage"])
    return out.select("metric", *(F.round(x, 6).alias(x) for x in ("low95", "low80", "high80", "high95")))


def r7_quantiles(spark: SparkSession, d: str) -> DataFrame:
    out = bootstrap.intervals(load(spark, d, "orders").select("o_totalprice"), ["o_totalprice"])
    return out.select("metric", *(F.round(x, 4).alias(x) for x in ("low95", "low80", "high80", "high95")))


QUERIES = {f.__name__: f for f in (history_budget, history_last_n, chunk_pack, evidence_batches, lexical_rank_topk, leak_scan, outcome_guard, support_counts, judge_answers, search_list, soft_delete_antijoin, project_rollup, conversation_summary, run_summary, released_bytes, skill_rollup, schedule_cross, review_tiers, token_totals, delivery_audit, cycle_check, cycle_components, topo_rank, bootstrap_ci, r7_quantiles)}

SQL = {
    "history_budget": f"""
WITH {PAIRS}, c AS (SELECT conv_id, turn, left(trim(question), 3000) q, left(trim(answer), 6000) a FROM q), n AS (SELECT *, row_number() OVER w rn, sum(length(q) + length(a) + 64) OVER w s FROM c WHERE q <> '' AND a <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
r AS (SELECT *, min(CASE WHEN rn <= 1 OR s <= 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) rec FROM n),
o AS (SELECT *, row_number() OVER v o, sum(least(length(q), 180) + least(length(a), 360) + 9) OVER v ds FROM r WINDOW v AS (PARTITION BY conv_id, rec ORDER BY turn DESC)),
f AS (SELECT *, min(CASE WHEN o = 1 OR ds <= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, rec ORDER BY turn DESC) dig FROM o)
SELECT conv_id, turn, CASE WHEN rec = 1 THEN 'recent' WHEN dig = 1 THEN 'digest' ELSE 'omitted' END AS part FROM f""",
    "history_last_n": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) n FROM conversations) WHERE n <= 3",
    "lexical_rank_topk": """
WITH q AS (SELECT DISTINCT replace(p_name, ' ', ', ') || ', ' || lower(p_type) AS k FROM part),
qt AS (SELECT k, list_distinct(regexp_extract_all(regexp_replace(lower(k), '\\s+', '', 'g'), '[a-z0-9][a-z0-9_-]+')) t FROM q),
r AS (SELECT p_partkey, list_distinct(regexp_extract_all(regexp_replace(lower(replace(p_name, ' ', ', ')), '\\s+', '', 'g'), '[a-z0-9][a-z0-9_-]+')) ti,
  list_distinct(regexp_extract_all(regexp_replace(lower(p_type || ', ' || replace(p_brand, '#', '-')), '\\s+', '', 'g'), '[a-z0-9][a-z0-9_-]+')) bo,
  replace(lower(p_name || ', ' || p_type), ' ', '') ph, p_size % 3 m FROM part),
s AS (SELECT k, p_partkey, len(list_intersect(t, ti)) a, len(list_intersect(t, bo)) b, len(t) n, m, contains(replace(lower(k), ' ', ''), ph) OR contains(ph, replace(lower(k), ' ', '')) x FROM qt, r),
z AS (SELECT k, p_partkey, round(3.0 * a + b + (a + b) / greatest(n, 1) + CASE WHEN x THEN 2 ELSE 0 END + 0.08 * m, 9) w FROM s),
y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w DESC, p_partkey) place FROM z)
SELECT k AS question_id, p_partkey AS record_id, round(w, 4) AS score, CAST(place AS INTEGER) AS place FROM y WHERE place <= 5""",
    "leak_scan": """
WITH n AS (SELECT item_id, regexp_replace(lower(text), '[\\s_.:/-]+', '', 'g') v FROM benchmark), h AS (SELECT doc_id, regexp_replace(lower(text), '[\\s_.:/-]+', '', 'g') t FROM documents)
SELECT DISTINCT doc_id AS public_id, item_id AS private_id FROM h, n WHERE length(v) >= 4 AND contains(t, v)""",
    "outcome_guard": "SELECT conv_id, turn, false AS asserted FROM conversations UNION ALL VALUES (-1, 0, true), (-2, 0, false), (-3, 0, true), (-4, 0, false), (-5, 0, false)",
    "support_counts": """
WITH h AS (SELECT 'thing' k, conv_id, turn FROM conversations WHERE contains(text, 'thing') UNION ALL SELECT 'ention', conv_id, turn FROM conversations WHERE contains(text, 'ention')),
n AS (SELECT *, row_number() OVER (PARTITION BY k, conv_id ORDER BY turn) r FROM h)
SELECT k AS key, count(DISTINCT conv_id) AS support, count(*) AS hits, round(least(0.25 + count(DISTINCT conv_id) * 0.05, 0.5), 9) AS confidence FROM n WHERE r <= 3 GROUP BY ALL HAVING count(DISTINCT conv_id) >= 2""",
    "judge_answers": """
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(round(least(greatest(l_quantity / 4, 0), 10) * 10) AS BIGINT) a, CAST(round(least(greatest(l_tax * 125, 0), 10) * 10) AS BIGINT) b FROM lineitem),
g AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS axes, CAST((20 * sum(a) + count(*)) // (2 * count(*)) AS BIGINT) a, CAST((20 * sum(b) + count(*)) // (2 * count(*)) AS BIGINT) b FROM s GROUP BY ALL)
SELECT l_orderkey, axes, a / 100 AS mean_a, b / 100 AS mean_b, CASE WHEN abs(a - b) < 25 THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END AS winner FROM g""",
    "search_list": "SELECT c_custkey FROM customer WHERE contains(lower(c_name || chr(10) || c_mktsegment), '000012')",
    "soft_delete_antijoin": "SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 3 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "project_rollup": "SELECT c_custkey AS k, count(o_orderkey) AS videos, count(o_orderkey) FILTER (o_orderstatus <> 'P') AS skills FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "conversation_summary": "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, max_by(text, turn) FILTER (role = 'user') AS last_question FROM conversations GROUP BY ALL",
    "run_summary": """
WITH r AS (SELECT l_orderkey, count(*) t, count(*) FILTER (l_linestatus = 'F') d, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE count(*) FILTER (l_returnflag = 'R') END f FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN f >= t THEN 'failed' WHEN f > 0 OR d < t THEN 'partial' ELSE 'completed' END AS status, count(*) AS n FROM r GROUP BY ALL""",
    "released_bytes": "WITH p AS (SELECT source, text, max(n_chars) n FROM documents GROUP BY ALL) SELECT source, CAST(sum(n) AS BIGINT) AS bytes, count(*) AS paths FROM p GROUP BY ALL",
    "schedule_cross": """
WITH s AS (SELECT unnest([11, 23, 47]) seed), a AS (SELECT unnest(['transcript', 'final', 'uniform', 'oracle']) arm, unnest(range(4)) i)
SELECT s_suppkey, seed, arm, 'request-' || left(sha256('schedule-v1|' || s_suppkey || '|' || seed || '|' || arm), 24) AS request_id, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY seed, i) - 1 AS INTEGER) AS case_ordinal FROM supplier, s, a""",
    "review_tiers": "SELECT CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS tier, count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY ALL",
    "token_totals": "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS tokens FROM conversations WHERE role = 'assistant' GROUP BY ALL",
    "delivery_audit": "SELECT CASE WHEN l_quantity <= 5 THEN 'missing' WHEN l_discount > 0.05 AND l_returnflag <> 'N' THEN 'substituted' ELSE 'as_requested' END AS status, count(*) AS n FROM lineitem GROUP BY ALL",
    # Walks through each list of sizes and of lines, step by step.
    "evidence_batches": """
WITH RECURSIVE r AS (SELECT l_suppkey s, CAST(l_quantity AS INTEGER) q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)) n FROM lineitem),
w AS (SELECT s, n, q, 0 AS b, 1 AS items, q AS held FROM r WHERE n = 1 UNION ALL
  SELECT r.s, r.n, r.q, b + CAST(items >= 4 OR held + r.q > 90 AS INTEGER), CASE WHEN items >= 4 OR held + r.q > 90 THEN 1 ELSE items + 1 END, CASE WHEN items >= 4 OR held + r.q > 90 THEN r.q ELSE held + r.q END FROM w JOIN r ON r.s = w.s AND r.n = w.n + 1)
SELECT s AS l_suppkey, b AS batch, count(*) AS items, CAST(sum(q) AS BIGINT) AS bytes FROM w GROUP BY ALL""",
    "chunk_pack": """
WITH RECURSIVE l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, 1 AS i, 0 AS c, ls[1] || chr(10) AS body FROM l UNION ALL
  SELECT w.doc_id, i + 1, c + CAST(length(body) + length(ls[i + 1]) + 1 > 700 AS INTEGER), CASE WHEN length(body) + length(ls[i + 1]) + 1 > 700 THEN '' ELSE body END || ls[i + 1] || chr(10) FROM w JOIN l USING (doc_id) WHERE i < len(ls)),
k AS (SELECT doc_id, c AS chunk, max_by(body, i) AS body, c = max(c) OVER (PARTITION BY doc_id) AS final FROM w GROUP BY doc_id, c),
z AS (SELECT doc_id, chunk, body FROM k WHERE NOT final OR regexp_matches(body, '\\S') UNION ALL SELECT doc_id, 0, left(text, 700) FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = l.doc_id AND (NOT final OR regexp_matches(body, '\\S'))))
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(length(body) AS INTEGER) AS n_chars, sha256(body) AS sha256 FROM z""",
    "skill_rollup": """
WITH x AS (SELECT l_orderkey, l_returnflag || l_linestatus AS f, min(row(l_linenumber, l_partkey, l_suppkey)) AS a FROM lineitem GROUP BY ALL),
n AS (SELECT l_orderkey, count(*) * 2 AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(f, ',' ORDER BY a, f) AS render_targets, CAST(any_value(n) AS INTEGER) AS n_actions FROM x JOIN n USING (l_orderkey) GROUP BY l_orderkey""",
    "cycle_check": f"""
WITH RECURSIVE e AS (SELECT DISTINCT c, p FROM ({PARENTS})),
up(x, y) AS (SELECT c, p FROM e UNION SELECT up.x, e.p FROM up JOIN e ON e.c = up.y), loops AS (SELECT DISTINCT x FROM up WHERE x = y)
SELECT DISTINCT n AS node FROM (SELECT c AS n FROM e UNION SELECT p FROM e)
WHERE (n IN (SELECT x FROM loops) OR n IN (SELECT x FROM up WHERE y IN (SELECT x FROM loops))) AND (n IN (SELECT x FROM loops) OR n IN (SELECT y FROM up WHERE x IN (SELECT x FROM loops)))""",
    "cycle_components": f"""
WITH RECURSIVE e AS (SELECT DISTINCT c, p FROM ({PARENTS})), up(x, y) AS (SELECT c, p FROM e UNION SELECT up.x, e.p FROM up JOIN e ON e.c = up.y)
SELECT a.x AS node, max(a.y) AS component FROM up a JOIN up b ON b.x = a.y AND b.y = a.x GROUP BY a.x""",
    "r7_quantiles": "SELECT 'o_totalprice' AS metric, round(quantile_cont(o_totalprice, 0.025), 4) AS low95, round(quantile_cont(o_totalprice, 0.1), 4) AS low80, round(quantile_cont(o_totalprice, 0.9), 4) AS high80, round(quantile_cont(o_totalprice, 0.975), 4) AS high95 FROM orders",
}
