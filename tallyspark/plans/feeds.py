"""Queries of event feeds, transcripts, manifests and policies on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import transcript
from tallyspark.operators import policy
from tallyspark.sources import files
from tallyspark.sources.tables import load
from tallyspark.streaming import events as feed


def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Users stand for runs, hours since 2024 for numbers, purchases for the end."""
    e = load(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "complete").otherwise("progress")
    return e.select(F.col("user_id").alias("run_id"), F.expr("unix_seconds(CAST(ts AS TIMESTAMP)) div 3600").alias("seq"), kind.alias("kind"), F.col("event_type").alias("stage"), F.col("value").alias("progress"))


def feed_issues(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each run's faults; repeated numbers have no order of their own, so rows are counted."""
    return feed.feed_issues(feed_rows(spark, d)).groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("n"))


def feed_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each run; event ids stand for numbers."""
    e = load(spark, d, "events")
    rows = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "complete").otherwise("progress").alias("kind"), F.col("event_type").alias("stage"), F.lit("running").alias("status"), F.col("value").alias("progress"))
    return feed.latest(rows)


def transcript_captions(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a transcript of ten-second segments."""
    c = load(spark, d, "conversations")
    one = F.struct((F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 7.25).alias("end"), F.col("text"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("own"))
    rows = rows.select("conv_id", transcript.segments(F.col("own")).alias("parts"))
    return rows.select("conv_id", F.sha2(transcript.captions(F.col("parts")), 256).alias("captions"), F.sha2(transcript.plain_text(F.col("parts")), 256).alias("told"), transcript.duration(F.lit(None).cast("double"), F.col("parts")).alias("seconds"))


def cited_spans(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as segments; each order cites the first three by index."""
    li = load(spark, d, "lineitem")
    segment = F.struct((F.col("l_linenumber") * 4.0).alias("start"), (F.col("l_linenumber") * 4.0 + 3).alias("end"), F.col("l_returnflag").alias("text"))
    held = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    asked = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("c").alias("citation"), F.array(F.lit(0), F.lit(2), F.lit(9)).alias("indexes"), F.lit(0.5).alias("shift"))
    return transcript.cited_span(asked, held, "l_orderkey", "indexes", "shift").drop("citation", "text")


def manifest_missing(spark: SparkSession, d: str) -> DataFrame:
    """Part keys that orders' lines name and a manifest of small parts lacks."""
    parts = load(spark, d, "part").where("p_size < 40")
    wanted = load(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return files.select_manifest(parts, "p_partkey", F.col("p_size") > 10, wanted)[1]


def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Customers stand for policy versions; their orders give metrics, families and gates."""
    o = load(spark, d, "orders")
    by = o.groupBy("o_custkey").agg(F.avg(F.col("o_totalprice") / 1e6).alias("gain"), F.min(F.col("o_totalprice") / 1e6 - 0.05).alias("worst"), F.collect_set("o_orderstatus").alias("families"), F.collect_set("o_orderpriority").alias("gates"), F.count(F.lit(1)).alias("n"))
    record = F.struct(
        F.lit("promote").alias("decision"),
        F.when(F.col("o_custkey") % 7 == 0, "test").otherwise("selection").alias("split"),
        F.col("gain").alias("selection_gain"),
        F.col("worst").alias("worst_group_delta"),
        F.lit(0.0).alias("unsupported_claim_rate_delta"),
        F.lit(0.0).alias("answer_leakage_rate_delta"),
        F.transform("families", lambda f: F.struct(f.alias("family_id"), F.lit(0.1).alias("episode_success_delta"))).alias("family_deltas"),
        F.transform("gates", lambda g: F.struct(g.alias("gate"), F.lit("pass").alias("status"))).alias("gate_results"),
        F.when(F.col("n") > 12, 1).otherwise(0).alias("critical_physics_errors"),
        F.lit(0).alias("critical_diagram_errors"),
    )
    return policy.promotion_issues(by.select("o_custkey", record.alias("promotion")), "o_custkey", "promotion")


def plan_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as actions; returned and shipped lines form an order's plans."""
    li = load(spark, d, "lineitem")
    actions = li.select("l_orderkey", F.col("l_linenumber").alias("action_id"))
    some = li.where("l_linenumber <> 3 or l_quantity > 25")
    plans = some.where("l_returnflag <> 'R'").unionByName(some.where("l_linestatus = 'F'")).groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("action_ids"))
    return policy.plan_issues(actions, plans, ["l_orderkey"])


def action_steps(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("step"))
    return policy.step_issues(li, ["l_orderkey"], "l_linenumber", "step")


def component_windows(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as windows of ten minutes."""
    e = load(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("a")).withColumn("b", F.col("a") + 600)
    return policy.component_windows(e, "user_id", "a", "b", 3600.0)


QUERIES = {f.__name__: f for f in (feed_issues, feed_latest, transcript_captions, cited_spans, manifest_missing, promotion_gate, plan_coverage, action_steps, component_windows)}

SQL = {
    "feed_issues": """
WITH e AS (SELECT user_id AS run_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) // 3600 AS seq, event_type = 'purchase' AS fin FROM events),
w AS (SELECT *, lag(seq) OVER (PARTITION BY run_id ORDER BY seq) AS b, coalesce(max(CAST(fin AS INT)) OVER (PARTITION BY run_id ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM e),
c AS (SELECT run_id, 'gap' AS code FROM w WHERE seq > b + 1 UNION ALL SELECT run_id, 'repeated' FROM w WHERE seq = b UNION ALL SELECT run_id, 'after_end' FROM w WHERE over_ = 1)
SELECT run_id, code, count(*) AS n FROM c GROUP BY ALL""",
    "feed_latest": """
SELECT user_id AS run_id, max(event_id) AS seq, max_by(event_type, event_id) AS stage, 'running' AS status,
  greatest(0.0, least(100.0, coalesce(max_by(coalesce(value, 0), event_id), 0))) AS progress, bool_or(event_type = 'purchase') AS ended FROM events GROUP BY user_id""",
    "transcript_captions": """
WITH s AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE trim(coalesce(text, '')) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, t) AS i, CAST(turn * 10000 AS BIGINT) AS a, CAST(turn * 10000 + 7250 AS BIGINT) AS b FROM s),
f AS (SELECT *, format('{:02d}:{:02d}:{:02d},{:03d}', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) AS x, format('{:02d}:{:02d}:{:02d},{:03d}', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) AS y FROM n)
SELECT conv_id, sha256(string_agg(i || chr(10) || x || ' --> ' || y || chr(10) || t, chr(10) || chr(10) ORDER BY i) || chr(10)) AS captions, sha256(string_agg(t, chr(10) ORDER BY i)) AS told, max_by(b, i) / 1000 AS seconds FROM f GROUP BY conv_id""",
    "cited_spans": """
WITH s AS (SELECT l_orderkey, l_linenumber * 4.0 AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS i FROM lineitem)
SELECT l_orderkey, CAST(min(a) + 0.5 AS DOUBLE) AS "start", CAST(max(a) + 3.5 AS DOUBLE) AS "end" FROM s JOIN orders ON o_orderkey = l_orderkey WHERE i IN (0, 2, 9) GROUP BY l_orderkey""",
    "manifest_missing": "SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)",
    "promotion_gate": """
WITH b AS (SELECT o_custkey, avg(o_totalprice / 1e6) AS gain, min(o_totalprice / 1e6 - 0.05) AS worst, count(DISTINCT o_orderstatus) AS fam, count(DISTINCT o_orderpriority) AS gates, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey, 'policy.test_leakage' AS code FROM b WHERE o_custkey % 7 = 0 UNION ALL SELECT o_custkey, 'policy.metric_threshold' FROM b WHERE NOT (gain >= 0.05 AND worst >= -0.02)
UNION ALL SELECT o_custkey, 'policy.gate_result' FROM b WHERE gates < 4 UNION ALL SELECT o_custkey, 'policy.family_gain' FROM b WHERE fam < 2 UNION ALL SELECT o_custkey, 'policy.critical_error' FROM b WHERE n > 12""",
    "plan_coverage": """
WITH s AS (SELECT * FROM lineitem WHERE l_linenumber <> 3 OR l_quantity > 25), u AS (SELECT l_orderkey, l_linenumber FROM s WHERE l_returnflag <> 'R' UNION ALL SELECT l_orderkey, l_linenumber FROM s WHERE l_linestatus = 'F'),
t AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM u GROUP BY ALL)
SELECT DISTINCT l.l_orderkey, l.l_linenumber AS action_id, 'render_plan.coverage' AS code FROM lineitem l LEFT JOIN t USING (l_orderkey, l_linenumber) WHERE coalesce(n, 0) <> 1""",
    "action_steps": """
SELECT l_orderkey, l_linenumber, 'action.step_order' AS code FROM (SELECT *, lag(step) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM (SELECT l_orderkey, l_linenumber, CAST(trunc(max(l_quantity)) AS INT) AS step FROM lineitem GROUP BY ALL)) WHERE step <= b""",
    "component_windows": """
WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS DOUBLE) AS a, CAST(floor(epoch(ts)) AS DOUBLE) + 600 AS b FROM events),
w AS (SELECT *, row_number() OVER o AS i, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e WINDOW o AS (PARTITION BY user_id ORDER BY a, b)),
s AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m + 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM w)
SELECT user_id, min(a) AS "start", max(b) AS "end", count(*) AS groups FROM s GROUP BY user_id, g""",
}
