"""Queries on derived evidence: projections, blind packages, evidence units, rater views, packets, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import derive
from tallyspark.sources.tables import dealt, load

SECRET = b"blinding key"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """One row for each line of an order; an order's lines are in one task, so what is grouped by order is not shuffled again."""
    li = dealt(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"), "l_orderkey")
    named = {"part": "l_partkey", "supp": "l_suppkey", "flag": "l_returnflag", "st": "l_linestatus"}
    return li.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(*(F.min(c).alias(k) for k, c in named.items()), F.min("l_quantity").cast("int").alias("q"))


LINES = "li AS (SELECT l_orderkey o, l_linenumber n, min(l_partkey) part, min(l_suppkey) supp, min(l_returnflag) flag, min(l_linestatus) st, CAST(min(l_quantity) AS INTEGER) q FROM lineitem GROUP BY ALL)"


def ordered(rows: DataFrame, by: str, at: str, item: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, item.alias("item")))), lambda x: x["item"]).alias("items"))


def accepted_projection(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders of some customers as accepted transitions, their lines' small parts as the permitted changes."""
    o = load(spark, d, "orders")
    rows = o.join(ordered(lines(spark, d), "o", "n", F.col("part")), F.col("o") == F.col("o_orderkey")).select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("draft").alias("status"), "items")
    out = derive.accepted_projection(rows, "o_orderkey", "status", "items", o.where("o_custkey % 3 = 0").select("o_orderkey"), load(spark, d, "part").where("p_size < 25").select("p_partkey"))
    return out.select("o_orderkey", F.array_join("items", ",").alias("parts"))


def skill_listing(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").join(ordered(lines(spark, d), "o", "n", F.col("part")), F.col("o") == F.col("o_orderkey"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "distill").otherwise("compare")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), "o_custkey", kind.alias("kind"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), F.col("items").alias("skills"), F.col("o_totalprice").alias("updated_at"))
    gone = lines(spark, d).where("flag = 'R'").select(F.col("o").alias("job_id"), F.col("part").alias("skill"))
    return derive.skill_listing(jobs, F.col("o_custkey") % 5 == 0, gone).select("job_id", "skill")


def first_valid(spark: SparkSession, d: str) -> DataFrame:
    return derive.first_valid(load(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus") != "O"), 3).select("o_custkey", "o_orderkey")


def first_images(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered(lines(spark, d), "o", "n", F.col("part")).join(load(spark, d, "orders"), F.col("o") == F.col("o_orderkey"))
    return derive.first_items(rows, ["o_custkey"], ["o_orderkey"], "items", 4).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("item").alias("parts"))


def collated_order(spark: SparkSession, d: str) -> DataFrame:
    """Names in several cases within each part size."""
    from pyspark.sql import Window

    p = load(spark, d, "part").select("p_size", F.explode(F.array("p_name", F.upper("p_name"), F.initcap("p_name"))).alias("name")).distinct()
    order = Window.partitionBy("p_size").orderBy(*derive.by_collation("name"))
    return p.select("p_size", "name", F.row_number().over(order).alias("place"))


def natural_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = load(spark, d, "part").select("p_size", "p_brand").distinct()
    return p.select("p_size", "p_brand", F.row_number().over(Window.partitionBy("p_size").orderBy(derive.natural(F.col("p_brand")))).alias("place"))


def stable_unique(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).groupBy("o").agg(F.collect_list(F.col("supp").cast("string")).alias("x"))
    return rows.select("o", F.array_join(F.array_sort(F.array_distinct("x")), ",").alias("refs"))


def scenario_counts(spark: SparkSession, d: str) -> DataFrame:
    return ordered(lines(spark, d), "o", "n", F.col("part")).select("o", F.size("items").alias("n"))


def claim_projection(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as its board actions, its own fields as the capability."""
    action = F.struct(F.col("flag").alias("operation"), F.when(F.col("q") > 10, F.col("part").cast("string")).alias("content"), F.when(F.col("n") % 2 == 0, F.col("st")).alias("region"))
    rows = ordered(lines(spark, d), "o", "n", action).join(load(spark, d, "orders"), F.col("o") == F.col("o_orderkey"))
    found = derive.claims({"actions": F.col("items"), "name": F.col("o_orderpriority"), "mechanism": F.col("o_orderstatus"), "program": F.split("o_orderpriority", "-"), "claims": F.array(F.col("o_custkey").cast("string"))})
    return rows.select("o_orderkey", F.posexplode(found).alias("at", "c")).select("o_orderkey", "at", "c.pointer", "c.content")


def arm_evidence(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    arm = F.element_at(F.array(*map(F.lit, derive.ARMS)), F.col("n") % 4 + 1)
    shown = derive.arm_evidence(arm, F.concat(F.lit("final-"), "o"), F.concat(F.lit("frame-"), "n"), F.concat(F.lit("delta-"), "part"), F.col("flag"), F.col("st"))
    return li.select("o", "n", shown.alias("s")).select("o", "n", "s.mode", F.array_join("s.images", ",").alias("images"), "s.text")


def split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = load(spark, d, "orders")
    schedule = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("arm"), (F.col("o_orderkey") % 3).alias("seed"), F.col("o_custkey").alias("source_id"))
    responses = o.where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("request_id"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("response"))
    sources = load(spark, d, "customer").where("c_custkey % 40 <> 1").select(F.col("c_custkey").alias("source_id"), F.col("c_nationkey").alias("teacher_id"))
    return derive.blind_split(schedule, responses, sources, SECRET, "run-1")


def blind_public(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d)[0]


def blind_key(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d)[1]


def blind_unclosed(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d)[2]


def units(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "orders").select(F.concat(F.lit("B-"), "o_orderkey").alias("blind_id"), F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("speech"))
    return derive.evidence_units(items, lines(spark, d).select(F.col("o").alias("case_id"), F.col("n").alias("position"), F.concat_ws(":", "flag", "part").alias("content")))


def evidence_units(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d)


def evidence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return derive.unit_pairs(units(spark, d))


def evidence_denominators(spark: SparkSession, d: str) -> DataFrame:
    return derive.denominators(units(spark, d))


def applicable_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).groupBy("o").agg(F.count(F.lit(1)).alias("events"), F.avg("q").alias("fidelity")).join(load(spark, d, "orders"), F.col("o") == F.col("o_orderkey")).select("o_custkey", "o_orderstatus", "o", "events", "fidelity")
    out = derive.applicable_pairs(rows, ["o_custkey", "o_orderstatus"], "events", "fidelity")
    return out.groupBy("o_custkey", "o_orderstatus").agg(F.count("fidelity").alias("rated"), F.count(F.lit(1)).alias("n"), F.round(F.avg("fidelity"), 6).alias("fidelity"))


def rater_views(spark: SparkSession, d: str) -> DataFrame:
    return derive.rater_views(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", ["R1", "R2"], "rating-v1")


def item_roots(spark: SparkSession, d: str) -> DataFrame:
    return derive.root_hash(lines(spark, d), ["o"], F.concat_ws("|", "n", "part", "flag"))


def card_manifest(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    evidence = li.where("flag <> 'N'").select("o", F.concat(F.lit("frames/"), "part").alias("path"), F.sha2(F.col("supp").cast("string"), 256).alias("sha256"), F.col("q").cast("long").alias("bytes"))
    return derive.card_manifest(li.select("o"), evidence, li.where("st = 'O'"), "o")


def packet_issues(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    cards = li.where("part % 11 <> 0").select((F.col("o") * 10 + F.col("n")).alias("card"), F.col("n").alias("ordinal"))
    template = li.where("part % 13 <> 0").select((F.col("o") * 10 + F.col("n")).alias("card"), F.when(F.col("q") > 45, 0).otherwise(F.col("n")).alias("ordinal"))
    template = template.unionByName(template.where("card % 17 = 0"))
    return derive.packet_issues(template, cards, "card", "ordinal")


def extended_intakes(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    parents = li.where("n <= 3").groupBy("o").agg(F.array_sort(F.collect_set("q")).alias("frames"), F.max("q").alias("m"))
    parents = parents.select("o", "frames", F.when(F.col("o") % 3 != 0, F.col("m")).alias("censored_at"), F.lit(None).cast("string").alias("decision"))
    more = li.where("n > 3").groupBy("o", (F.col("n") % 2).alias("h")).agg(F.collect_list("q").alias("frames")).select("o", "frames")
    return derive.extend_intakes(parents, more, "o").select("o", F.array_join("frames", ",").alias("frames"), "censored_at")


def history_texts(spark: SparkSession, d: str) -> DataFrame:
    record = F.struct(F.col("flag").alias("kind"), F.col("part").cast("string").alias("title"), F.col("st").alias("summary"))
    rows = load(spark, d, "orders").join(ordered(lines(spark, d).where("q > 20"), "o", "n", record), F.col("o") == F.col("o_orderkey"), "left")
    empty = F.array().cast("array<struct<kind:string,title:string,summary:string>>")
    return rows.select("o_orderkey", derive.history_text(F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")), F.coalesce("items", empty)).alias("text"))


def visible_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").join(ordered(lines(spark, d).where("q > 30"), "o", "n", F.col("part").cast("string")), F.col("o") == F.col("o_orderkey"), "left")
    checks = F.coalesce("items", F.array().cast("array<string>"))
    shown = derive.visible_answer(F.concat(F.lit(" "), "o_orderpriority"), F.filter(F.array("o_orderstatus"), lambda s: s != "O"), checks, F.when(F.col("o_custkey") % 2 == 0, "seen").otherwise(" "), F.coalesce(F.get(checks, F.lit(1)), F.lit("go on")))
    return rows.select("o_orderkey", shown.alias("text"))


def assembled_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = load(spark, d, "conversations").where("length(text) % 19 <> 0").select("conv_id", "turn", F.left("text", F.lit(20)).alias("text"))
    out = derive.assembled(chunks.unionByName(chunks.where("turn % 3 = 1")), "conv_id", "turn", "text")
    return out.select("conv_id", F.sha2("text", 256).alias("sha256"), "chunks", "whole")


def renderer_words(spark: SparkSession, d: str) -> DataFrame:
    """Part names and sentences with and without renderers' words."""
    cases = spark.sql("SELECT * FROM VALUES (-1L, 'draw it with Ink'), (-2L, 'think again'), (-3L, 'as an SVG image'), (-4L, '用几何画板演示'), (-5L, 'canvases'), (-6L, 'the renderer') AS v(p_partkey, p_name)")
    rows = load(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit("small"), F.lit("html")).alias("p_name")).unionByName(cases)
    return rows.where(text.renderer_words(F.col("p_name"))).select("p_partkey")


def loose_json(spark: SparkSession, d: str) -> DataFrame:
    """Objects inside prose and fences."""
    said = F.element_at(F.array(F.col("props"), F.concat(F.lit("Sure {ok}: "), "props", F.lit(" } done")), F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.lit("no object {here")), (F.col("event_id") % 4 + 1).cast("int"))
    return load(spark, d, "events").select("event_id", F.get_json_object(text.loose_json(said), "$.k").alias("k"))


def canonical_events(spark: SparkSession, d: str) -> DataFrame:
    """Nested objects whose keys come in any order, hashed in one form."""
    inner = F.concat(F.lit('{"b": [1.0, {"z": null, "a": "é"}], "k": '), "props", F.lit(', "a": 2.50}'))
    return load(spark, d, "events").select("event_id", F.sha2(text.canonical_json(inner), 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (accepted_projection, skill_listing, first_valid, first_images, collated_order, natural_order, stable_unique, scenario_counts, claim_projection, arm_evidence, blind_public, blind_key, blind_unclosed, evidence_units, evidence_pairs, evidence_denominators, applicable_pairs, rater_views, item_roots, card_manifest, packet_issues, extended_intakes, history_texts, visible_answers, assembled_chunks, renderer_words, loose_json, canonical_events)}

PADS = [bytes(b ^ mask for b in SECRET.ljust(64, b"\0")).hex() for mask in (0x5C, 0x36)]
BLIND = f"'B-' || sha256(from_hex('{PADS[0]}') || from_hex(sha256(from_hex('{PADS[1]}') || encode('run-1|' || o_orderkey))))"
CLOSED = "FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 50 <> 0 AND c_custkey % 40 <> 1"
OPAQUE = "'{kind}-' || left(sha256({blind} || '|{kind}|' || {at}), 16)"
UNITS = f"""WITH {LINES}, u AS (SELECT 'B-' || o_orderkey AS blind_id, 'verified_speech_context' AS kind, 0 AS sequence_index, o_orderpriority AS content FROM orders UNION ALL
  SELECT 'B-' || o, 'signed_gold_board_event', CAST(row_number() OVER (PARTITION BY o ORDER BY n) AS INTEGER), flag || ':' || part FROM li WHERE o IN (SELECT o_orderkey FROM orders))"""
SQL = {
    "accepted_projection": f"WITH {LINES} SELECT o AS o_orderkey, string_agg(part, ',' ORDER BY n) AS parts FROM li JOIN orders ON o_orderkey = o JOIN part ON p_partkey = part WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0 AND p_size < 25 GROUP BY o",
    "skill_listing": f"WITH {LINES} SELECT o AS job_id, part AS skill FROM li JOIN orders ON o_orderkey = o WHERE o_custkey % 5 = 0 AND o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O' AND NOT EXISTS (SELECT 1 FROM li x WHERE x.o = li.o AND x.part = li.part AND x.flag = 'R')",
    "first_valid": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) n FROM orders WHERE o_orderkey % 7 = 0 OR o_orderstatus <> 'O') WHERE n <= 3",
    "first_images": f"WITH {LINES}, r AS (SELECT o_custkey, part, row_number() OVER (PARTITION BY o_custkey ORDER BY o, n) i FROM li JOIN orders ON o_orderkey = o) SELECT o_custkey, count(*) AS n, CAST(sum(part) AS BIGINT) AS parts FROM r WHERE i <= 4 GROUP BY ALL",
    "collated_order": """
WITH c AS (SELECT DISTINCT p_size, unnest([p_name, upper(p_name), array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')]) AS name FROM part)
SELECT p_size, name, CAST(row_number() OVER (PARTITION BY p_size ORDER BY lower(name), translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS INTEGER) AS place FROM c""",
    "natural_order": "SELECT p_size, p_brand, CAST(row_number() OVER (PARTITION BY p_size ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER)) AS INTEGER) AS place FROM (SELECT DISTINCT p_size, p_brand FROM part)",
    "stable_unique": f"WITH {LINES} SELECT o, array_to_string(list_sort(list(DISTINCT CAST(supp AS VARCHAR))), ',') AS refs FROM li GROUP BY o",
    "scenario_counts": f"WITH {LINES} SELECT o, CAST(count(*) AS INTEGER) AS n FROM li GROUP BY o",
    "claim_projection": f"""
WITH {LINES}, a AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n) - 1 AS i FROM li),
c AS (SELECT o, 0 g, i, 0 f, '/observed_board_actions/' || i || '/operation' p, flag v FROM a UNION ALL SELECT o, 0, i, 1, '/observed_board_actions/' || i || '/content', CASE WHEN q > 10 THEN CAST(part AS VARCHAR) END FROM a
  UNION ALL SELECT o, 0, i, 2, '/observed_board_actions/' || i || '/region', CASE WHEN n % 2 = 0 THEN st END FROM a
  UNION ALL SELECT o_orderkey, 1, 0, 0, '/generalized_teaching_capability/name', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 2, 0, 0, '/generalized_teaching_capability/mechanism', o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, 3, k, 0, '/generalized_teaching_capability/action_program/' || k, string_split(o_orderpriority, '-')[k + 1] FROM orders, range(5) t(k) UNION ALL SELECT o_orderkey, 4, 0, 0, '/evidence_claims/0/claim', CAST(o_custkey AS VARCHAR) FROM orders)
SELECT o AS o_orderkey, CAST(row_number() OVER (PARTITION BY o ORDER BY g, i, f) - 1 AS INTEGER) AS "at", p AS pointer, v AS content FROM c WHERE v IS NOT NULL AND o IN (SELECT o FROM li) AND o IN (SELECT o_orderkey FROM orders)""",
    "arm_evidence": f"""
WITH {LINES} SELECT o, n, CASE n % 4 WHEN 0 THEN 'text' WHEN 3 THEN 'temporal_board' ELSE 'static_frames' END AS mode, CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN 'final-' || o WHEN 2 THEN 'frame-' || n ELSE 'delta-' || part END AS images, CASE WHEN n % 4 = 3 THEN flag || ': ' || st ELSE '' END AS text FROM li""",
    "blind_public": f"SELECT {BLIND} AS blind_id, o_orderstatus || '/' || o_orderpriority AS response, sha256(o_orderstatus || '/' || o_orderpriority) AS response_sha256 {CLOSED}",
    "blind_key": f"SELECT {BLIND} AS blind_id, o_orderkey AS request_id, o_custkey AS case_id, o_orderpriority AS arm, o_orderkey % 3 AS seed, o_custkey AS source_id, c_nationkey AS teacher_id, sha256(o_orderstatus || '/' || o_orderpriority) AS response_sha256 {CLOSED}",
    "blind_unclosed": "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 50 = 0 THEN 'response.missing' ELSE 'source.missing' END AS code FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 40 <> 1 WHERE o_orderkey % 50 = 0 OR c_custkey IS NULL",
    "evidence_units": f"{UNITS} SELECT *, {OPAQUE.format(kind='evidence', blind='blind_id', at='sequence_index')} AS unit_id FROM u",
    "evidence_pairs": f"""{UNITS}, b AS (SELECT blind_id, sequence_index i, {OPAQUE.format(kind='evidence', blind='blind_id', at='sequence_index')} AS id FROM u WHERE sequence_index > 0),
p AS (SELECT a.blind_id, a.id AS before_unit_id, z.id AS after_unit_id, row_number() OVER (PARTITION BY a.blind_id ORDER BY a.i, z.i) - 1 AS k FROM b a JOIN b z ON a.blind_id = z.blind_id AND a.i < z.i)
SELECT blind_id, {OPAQUE.format(kind='pair', blind='blind_id', at='k')} AS pair_id, before_unit_id, after_unit_id FROM p""",
    "evidence_denominators": f"{UNITS} SELECT blind_id, sha256(string_agg(kind || '|' || sha256(content), chr(10) ORDER BY sequence_index)) AS denominator_sha256, CASE WHEN count(*) = 2 THEN 'not_applicable_single_event' ELSE 'eligible_multi_edit' END AS temporal_metric_status FROM u GROUP BY blind_id",
    "applicable_pairs": f"""
WITH {LINES}, r AS (SELECT o_custkey, o_orderstatus, count(*) AS e, avg(q) AS f FROM li JOIN orders ON o_orderkey = o GROUP BY o_custkey, o_orderstatus, o)
SELECT o_custkey, o_orderstatus, CASE WHEN min(e) <= 1 THEN 0 ELSE count(*) END AS rated, count(*) AS n, CASE WHEN min(e) > 1 THEN round(avg(f), 6) END AS fidelity FROM r GROUP BY ALL""",
    "rater_views": "SELECT rater, o_orderkey AS item, row_number() OVER (PARTITION BY rater ORDER BY sha256('rating-v1|' || rater || '|' || o_orderkey)) - 1 AS place FROM orders, (VALUES ('R1'), ('R2')) v(rater)",
    "item_roots": f"WITH {LINES}, h AS (SELECT o, sha256(n || '|' || part || '|' || flag) h FROM li) SELECT o, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS root FROM h GROUP BY o",
    "card_manifest": f"""
WITH {LINES}, e AS (SELECT o, 'frames/' || part || ':' || sha256(CAST(supp AS VARCHAR)) AS x, q FROM li WHERE flag <> 'N'),
h AS (SELECT o, count(*) n, CAST(sum(q) AS BIGINT) b FROM e GROUP BY o), s AS (SELECT o, sha256(string_agg(x, chr(10) ORDER BY x)) x FROM (SELECT DISTINCT o, x FROM e) GROUP BY o)
SELECT g.o, coalesce(h.n, 0) AS n_evidence, coalesce(b, 0) AS bytes, x AS evidence_sha256, (SELECT count(*) FROM li c WHERE c.o = g.o AND st = 'O') AS n_candidates FROM (SELECT DISTINCT o FROM li) g LEFT JOIN h ON h.o = g.o LEFT JOIN s ON s.o = g.o""",
    "packet_issues": f"""
WITH {LINES}, c AS (SELECT o * 10 + n AS card, n AS w FROM li WHERE part % 11 <> 0), t AS (SELECT o * 10 + n AS card, CASE WHEN q > 45 THEN 0 ELSE n END AS a, CASE WHEN (o * 10 + n) % 17 = 0 THEN 2 ELSE 1 END AS times FROM li WHERE part % 13 <> 0),
b AS (SELECT coalesce(c.card, t.card) AS card, w, a, times FROM c FULL JOIN t ON c.card = t.card)
SELECT card, 'card.missing' AS code FROM b WHERE times IS NULL UNION ALL SELECT card, 'card.unknown' FROM b WHERE w IS NULL UNION ALL SELECT card, 'card.repeated' FROM b WHERE times > 1 UNION ALL SELECT card, 'card.ordinal' FROM b WHERE a <> w""",
    "extended_intakes": f"""
WITH {LINES}, p AS (SELECT o, list_sort(list(DISTINCT q)) f, max(q) m FROM li WHERE n <= 3 GROUP BY o), x AS (SELECT o, list_sort(list(DISTINCT q)) f, max(q) m FROM li WHERE n > 3 GROUP BY o)
SELECT p.o, array_to_string(list_concat(p.f, list_filter(coalesce(x.f, []), lambda v: NOT list_contains(p.f, v))), ',') AS frames, CASE WHEN p.o % 3 <> 0 AND NOT coalesce(x.m > p.m, false) THEN p.m END AS censored_at FROM p LEFT JOIN x ON x.o = p.o""",
    "history_texts": f"""
WITH {LINES}, r AS (SELECT o, string_agg(flag || '「' || part || '」：' || st, chr(10) ORDER BY n) x FROM li WHERE q > 20 GROUP BY o)
SELECT o_orderkey, concat_ws(chr(10) || chr(10), CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, '[本轮黑板记录]' || chr(10) || x) AS text FROM orders LEFT JOIN r ON o = o_orderkey""",
    "visible_answers": f"""
WITH {LINES}, r AS (SELECT o, list(CAST(part AS VARCHAR) ORDER BY n) c FROM li WHERE q > 30 GROUP BY o), z AS (SELECT *, coalesce(c[2], 'go on') AS nx FROM orders LEFT JOIN r ON o = o_orderkey)
SELECT o_orderkey, concat_ws(chr(10) || chr(10), o_orderpriority, CASE WHEN o_orderstatus <> 'O' THEN '学习前提：' || chr(10) || '- ' || o_orderstatus END, CASE WHEN o_custkey % 2 = 0 THEN '对你刚才回答的反馈：' || chr(10) || 'seen' END,
  CASE WHEN c IS NOT NULL THEN '马上自检：' || chr(10) || array_to_string(list_transform(c, lambda v: '- ' || v), chr(10)) END, CASE WHEN NOT coalesce(list_contains(c, nx), false) THEN '下一步：' || chr(10) || nx END) AS text FROM z""",
    "assembled_chunks": "SELECT conv_id, sha256(string_agg(left(text, 20), '' ORDER BY turn)) AS sha256, count(*) AS chunks, max(turn) + 1 = count(*) AS whole FROM conversations WHERE length(text) % 19 <> 0 GROUP BY conv_id",
    "renderer_words": "SELECT p_partkey FROM part WHERE contains(p_name, 'small') UNION ALL VALUES (-1), (-3), (-4), (-6)",
    "loose_json": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events",
    "canonical_events": "SELECT event_id, sha256('{\"a\":2.5,\"b\":[1,{\"a\":\"é\",\"z\":null}],\"k\":{\"k\":' || json_extract_string(props, '$.k') || '}}') AS sha256 FROM events",
}
