"""Ratings, checkpoints and requests made of orders, lines and events, with faults that their values bring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators import closure, ledger
from tallyspark.sources.tables import dealt, load

STATES = ("view", "click", "purchase")
RUN = ("SEALED_READY", "RUNNING", "INTERRUPTED_SAFE", "BLOCKED_AMBIGUOUS", "FAILED_CLOSED", "EXECUTION_COMPLETE")


def rated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A plan a customer, its orders as items: assigned in order, answered with gaps, doubles and swaps, and sealed."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("item"), F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"), F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("sha"))
    o = dealt(o.withColumn("rater", F.when(F.col("item") % 2 == 0, "A").otherwise("B")), "plan", "rater").withColumn("n", F.row_number().over(Window.partitionBy("plan", "rater").orderBy("item")))
    plans = load(spark, d, "customer").where("c_custkey % 41 <> 0").select(F.col("c_custkey").alias("plan"), F.lit(10_000).alias("sealed_at"))
    assigned = o.where("item % 11 <> 0").select("plan", "rater", "item", F.col("n").alias("place"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("item") % 19 == 0, 2).otherwise(1)))
    answered = o.where("item % 13 <> 0").withColumn("_", twice).select("plan", "rater", "item", (F.col("n") + F.when(F.col("item") % 17 == 0, 1).otherwise(0)).alias("sequence"), F.col("day").alias("recorded_at"), "sha")
    kept = o.where("item % 23 <> 0").select("plan", "rater", "item", F.when(F.col("item") % 29 == 0, "other").otherwise(F.col("sha")).alias("sha"))
    return plans, assigned, answered, kept


def rating_closure(spark: SparkSession, d: str) -> DataFrame:
    return closure.rating_closure(*rated(spark, d))


def rating_report(spark: SparkSession, d: str) -> DataFrame:
    return closure.rating_report(*rated(spark, d))


def checkpoint_replay(spark: SparkSession, d: str) -> DataFrame:
    """Users as runs, five requests each; every seventh event seals a checkpoint."""
    e = load(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 5).alias("request_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("state"), F.when(F.col("event_id") % 3 > 0, F.col("event_id").cast("string")).alias("sha"))
    heads = e.where("seq % 7 = 0").select("run_id", F.col("seq").alias("generation"), F.col("at").alias("created_at"))
    return closure.replay(e, heads, STATES).withColumn("digest", F.col("digest").cast("string"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    return load(spark, d, "events").select("user_id", F.col("event_id").alias("e"), F.col("ts").alias("at"), F.row_number().over(order).alias("n"), F.lag("event_id").over(order).alias("b"))


def checkpoint_issues(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as checkpoints: the state follows from the event's number."""
    s = steps(spark, d)
    state = F.element_at(F.array(*map(F.lit, RUN)), F.when(F.col("n") == 1, 1).when(F.col("e") % 10 < 7, 2).otherwise(F.col("e") % 6 + 1).cast("int"))
    heads = s.select(F.col("user_id").alias("run_id"), (F.col("n") - 1 + F.when(F.col("e") % 37 == 0, 1000).otherwise(0)).alias("generation"), F.when(F.col("e") % 13 == 0, "x").otherwise(F.col("b").cast("string")).alias("previous_sha"), F.col("e").cast("string").alias("sha"), F.col("at").alias("created_at"), state.alias("run_state"), F.when(F.col("e") % 17 == 0, 6).otherwise(5).alias("request_count"))
    return ledger.checkpoint_issues(heads).groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("n"))


REQUEST = ("PENDING", "DISPATCH_INTENT_COMMITTED", "RECEIPT_COMMITTED", "RETRY_READY", "SCHEMA_VALIDATED_COMMITTED", "BLOCKED_AMBIGUOUS", "FAILED_CLOSED")


def entry_issues(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as entries of three requests each."""
    e = load(spark, d, "events").select("user_id", F.col("event_id").alias("e"))
    hashed = lambda m, prefix: F.when(F.col("e") % m > 0, F.concat(F.lit(prefix), (F.col("e") % m).cast("string")))
    rows = e.select(F.col("user_id").alias("run_id"), F.col("e").alias("generation"), (F.col("e") % 3).alias("request_id"), F.when(F.col("e") % 31 == 0, "k2").otherwise("k1").alias("idempotency_key"), F.element_at(F.array(*map(F.lit, REQUEST)), (F.expr("e div 3") % 7 + 1).cast("int")).alias("state"), F.when(F.col("e") % 29 == 0, 4).otherwise(3).alias("max_attempts"), F.expr("e div 6 % 4").alias("attempts_used"), hashed(4, "i").alias("intent_sha"), hashed(5, "a").alias("audit_sha"))
    return ledger.entry_issues(rows).groupBy("run_id", "request_id", "code").agg(F.count(F.lit(1)).alias("n"))


def public_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items, their lines as units of four arms; some orders publish too little, twice, or in another order."""
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("part"))
    arm = F.element_at(F.array(*map(F.lit, closure.ARMS)), (F.col("place") % 4 + 1).cast("int"))
    units = li.select("item", arm.alias("arm"), "place", F.sha2(F.concat_ws("-", "item", "part"), 256).alias("sha"), "part")
    turned = units.where("item % 13 <> 0 OR place <> 1").withColumn("place", F.when(F.col("item") % 7 == 0, -F.col("place")).otherwise(F.col("place")))
    named = closure.projection(turned).withColumn("arm", F.when((F.col("item") % 17 == 0) & (F.col("arm") == closure.ARMS[1]), "final").otherwise(F.col("arm")))
    shown = named.withColumn("_", F.explode(F.sequence(F.lit(1), F.when(F.col("item") % 19 == 0, 2).otherwise(1)))).drop("_")
    return closure.public_issues(units.drop("part"), shown.where("item % 23 <> 0"))


QUERIES = {f.__name__: f for f in (public_evidence, rating_closure, rating_report, checkpoint_replay, checkpoint_issues, entry_issues)}


def follows(before: str, after: str, allowed: dict[str, tuple[str, ...]]) -> str:
    """SQL: whether a state may follow another."""
    return "(" + " OR ".join(f"({before} = '{k}' AND {after} IN ({', '.join(repr(x) for x in v)}))" for k, v in allowed.items()) + ")"


RATED = """
o AS (SELECT o_custkey AS plan, o_orderkey AS item, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, o_orderstatus || '-' || o_orderpriority AS sha, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS rater FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY plan, rater ORDER BY item) AS n FROM o),
p AS (SELECT c_custkey AS plan FROM customer WHERE c_custkey % 41 <> 0),
l AS (SELECT *, n + CASE WHEN item % 17 = 0 THEN 1 ELSE 0 END AS seq FROM n, (SELECT unnest([1, 2]) AS c) WHERE item % 13 <> 0 AND (c = 1 OR item % 19 = 0)),
g AS (SELECT plan, rater, count(*) AS c, min(seq) AS lo, max(seq) AS hi, count(DISTINCT seq) AS u FROM l GROUP BY ALL),
i AS (SELECT plan, rater, item, unnest(list_filter([
  CASE WHEN item % 11 <> 0 AND item % 13 = 0 THEN 'entry.lost' END, CASE WHEN item % 11 = 0 AND item % 13 <> 0 THEN 'entry.foreign' END, CASE WHEN item % 13 <> 0 AND item % 19 = 0 THEN 'entry.repeated' END,
  CASE WHEN item % 11 <> 0 AND item % 13 <> 0 AND item % 17 = 0 THEN 'entry.order' END, CASE WHEN item % 13 <> 0 AND day > 10000 AND plan % 41 <> 0 THEN 'entry.late' END, CASE WHEN plan % 41 = 0 THEN 'plan.unknown' END,
  CASE WHEN item % 13 <> 0 AND item % 23 = 0 THEN 'rating.lost' END, CASE WHEN item % 13 = 0 AND item % 23 <> 0 THEN 'rating.foreign' END, CASE WHEN item % 13 <> 0 AND item % 23 <> 0 AND item % 29 = 0 THEN 'rating.changed' END], lambda x: x IS NOT NULL)) AS code
  FROM n WHERE item % 11 <> 0 OR item % 13 <> 0 OR item % 23 <> 0 UNION ALL SELECT plan, rater, NULL, 'sequence.holes' FROM g WHERE lo <> 1 OR hi <> c OR u <> c)"""
SQL = {
    "rating_closure": f"WITH {RATED} SELECT plan, rater, item, code FROM i",
    "rating_report": f"""WITH {RATED}
SELECT *, assigned > 0 AND issues = 0 AS closed FROM (SELECT plan, (SELECT count(*) FROM n WHERE n.plan = p.plan AND item % 11 <> 0) AS assigned, (SELECT count(*) FROM l WHERE l.plan = p.plan) AS answered, (SELECT count(*) FROM n WHERE n.plan = p.plan AND item % 23 <> 0) AS rated,
  (SELECT count(*) FROM i WHERE i.plan = p.plan) AS issues FROM p)""",
    "checkpoint_replay": """
WITH e AS (SELECT user_id AS run, event_id % 5 AS req, event_id AS seq, ts AS at_, event_type AS state, CASE WHEN event_id % 3 > 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS sha FROM events),
h AS (SELECT run, seq AS generation, at_ AS made FROM e WHERE seq % 7 = 0),
s AS (SELECT h.run, generation, req, max_by(row(state, sha), row(at_, seq)) AS x FROM h JOIN e ON e.run = h.run AND at_ <= made GROUP BY ALL)
SELECT run AS run_id, generation, count(*) FILTER (x[1] = 'view') AS view, count(*) FILTER (x[1] = 'click') AS click, count(*) FILTER (x[1] = 'purchase') AS purchase, count(*) AS requests,
  CAST(CAST(sum(CAST('0x' || sha256(req || '|' || x[1] || '|' || x[2])[1:12] AS BIGINT)) AS HUGEINT) AS VARCHAR) AS digest FROM s GROUP BY ALL""",
    "checkpoint_issues": f"""
WITH s AS (SELECT user_id AS r, event_id AS e, ts AS at_, row_number() OVER w AS n, lag(event_id) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT *, n - 1 + CASE WHEN e % 37 = 0 THEN 1000 ELSE 0 END AS g, CASE WHEN e % 13 = 0 THEN 'x' ELSE CAST(b AS VARCHAR) END AS p, [{', '.join(repr(x) for x in RUN)}][CASE WHEN n = 1 THEN 1 WHEN e % 10 < 7 THEN 2 ELSE e % 6 + 1 END] AS st, CASE WHEN e % 17 = 0 THEN 6 ELSE 5 END AS c FROM s),
k AS (SELECT *, lag(g) OVER w AS g0, lag(CAST(e AS VARCHAR)) OVER w AS e0, lag(at_) OVER w AS t0, lag(st) OVER w AS s0, lag(c) OVER w AS c0 FROM h WINDOW w AS (PARTITION BY r ORDER BY g))
SELECT r AS run_id, code, count(*) AS n FROM (SELECT r, unnest(list_filter([CASE WHEN g0 IS NULL AND (g <> 0 OR st <> 'SEALED_READY') THEN 'generation.first' END, CASE WHEN g <> g0 + 1 THEN 'generation.skipped' END, CASE WHEN g0 IS NOT NULL AND p IS DISTINCT FROM e0 THEN 'chain.previous' END,
  CASE WHEN at_ < t0 THEN 'time.backwards' END, CASE WHEN c <> c0 THEN 'request_count.drift' END, CASE WHEN g0 IS NOT NULL AND NOT {follows('s0', 'st', ledger.RUN_TRANSITIONS)} THEN 'run_state.transition' END], lambda x: x IS NOT NULL)) AS code FROM k) GROUP BY ALL""",
    "entry_issues": f"""
WITH e AS (SELECT user_id AS r, event_id AS g, event_id % 3 AS q, CASE WHEN event_id % 31 = 0 THEN 'k2' ELSE 'k1' END AS k, [{', '.join(repr(x) for x in REQUEST)}][event_id // 3 % 7 + 1] AS s, CASE WHEN event_id % 29 = 0 THEN 4 ELSE 3 END AS m, event_id // 6 % 4 AS u, CASE WHEN event_id % 4 > 0 THEN 'i' || event_id % 4 END AS i, CASE WHEN event_id % 5 > 0 THEN 'a' || event_id % 5 END AS a FROM events),
l AS (SELECT *, lag(g) OVER w AS g0, lag(k) OVER w AS k0, lag(s) OVER w AS s0, lag(m) OVER w AS m0, lag(u) OVER w AS u0, lag(i) OVER w AS i0, lag(a) OVER w AS a0 FROM e WINDOW w AS (PARTITION BY r, q ORDER BY g)),
t AS (SELECT *, i IS NOT DISTINCT FROM i0 AS si, a IS NOT DISTINCT FROM a0 AS sa, u = u0 AS su FROM l WHERE g0 IS NOT NULL)
SELECT r AS run_id, q AS request_id, code, count(*) AS n FROM (SELECT r, q, unnest(list_filter([
  CASE WHEN k <> k0 THEN 'idempotency_key.drift' END, CASE WHEN m <> m0 THEN 'max_attempts.drift' END, CASE WHEN NOT {follows('s0', 's', ledger.REQUEST_TRANSITIONS)} THEN 'state.transition' END, CASE WHEN u < u0 THEN 'attempts.backwards' END,
  CASE WHEN s = s0 AND NOT (k = k0 AND m = m0 AND su AND si AND sa) THEN 'provenance.rebound' END, CASE WHEN s0 = 'PENDING' AND s = 'DISPATCH_INTENT_COMMITTED' AND (u <> 0 OR a IS NOT NULL) THEN 'dispatch.unclean' END,
  CASE WHEN s0 = 'DISPATCH_INTENT_COMMITTED' AND s IN ('RECEIPT_COMMITTED', 'BLOCKED_AMBIGUOUS', 'FAILED_CLOSED') AND NOT (si AND a IS NOT NULL AND NOT sa AND u = u0 + 1) THEN 'attempt.unbound' END,
  CASE WHEN s0 = 'RECEIPT_COMMITTED' AND s IN ('RETRY_READY', 'SCHEMA_VALIDATED_COMMITTED') AND NOT (si AND sa AND su) THEN 'receipt.provenance' END, CASE WHEN s0 = 'RETRY_READY' AND s = 'DISPATCH_INTENT_COMMITTED' AND (NOT sa OR NOT su OR si) THEN 'retry.provenance' END,
  CASE WHEN s0 = 'PENDING' AND s = 'FAILED_CLOSED' AND (i IS NOT NULL OR a IS NOT NULL OR u <> 0) THEN 'fail_closed.unclean' END, CASE WHEN s = 'FAILED_CLOSED' AND s0 NOT IN ('PENDING', 'DISPATCH_INTENT_COMMITTED') AND NOT (si AND sa AND su) THEN 'fail_closed.provenance' END], lambda x: x IS NOT NULL)) AS code FROM t) GROUP BY ALL""",
    "public_evidence": f"""
WITH a AS (SELECT unnest([{', '.join(repr(x) for x in closure.ARMS)}]) AS arm), li AS (SELECT l_orderkey AS o, l_linenumber AS n, [{', '.join(repr(x) for x in closure.ARMS)}][l_linenumber % 4 + 1] AS arm, sha256(l_orderkey || '-' || l_partkey) AS h FROM lineitem),
p AS (SELECT o, arm, count(*) AS n, string_agg(h, chr(10) ORDER BY li.n, h) AS s FROM li GROUP BY o, arm),
s AS (SELECT o, CASE WHEN o % 17 = 0 AND arm = '{closure.ARMS[1]}' THEN 'final' ELSE arm END AS arm, count(*) AS n, CASE WHEN o % 7 = 0 THEN string_agg(h, chr(10) ORDER BY li.n DESC, h) ELSE string_agg(h, chr(10) ORDER BY li.n, h) END AS s FROM li WHERE (o % 13 <> 0 OR li.n <> 1) AND o % 23 <> 0 GROUP BY o, li.arm),
b AS (SELECT coalesce(p.o, s.o) AS o, coalesce(p.arm, s.arm) AS arm, p.n AS pn, s.n AS sn, p.s AS ps, s.s AS ss FROM p FULL JOIN s ON p.o = s.o AND p.arm = s.arm)
SELECT o AS item, arm, unnest(list_filter([CASE WHEN arm = 'final' THEN 'arm.unknown' END, CASE WHEN sn IS NULL THEN 'public.missing' END, CASE WHEN pn IS NULL THEN 'public.foreign' END, CASE WHEN sn IS NOT NULL AND o % 19 = 0 THEN 'public.repeated' END,
  CASE WHEN pn <> sn THEN 'units.count' END, CASE WHEN ps <> ss THEN 'projection.sha' END], lambda x: x IS NOT NULL)) AS code FROM b
UNION ALL SELECT o, arm, 'arm.missing' FROM (SELECT DISTINCT o FROM li), a WHERE (o, arm) NOT IN (SELECT (o, arm) FROM b)""",
}
