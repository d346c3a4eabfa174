"""Queries on intervals, order and references. Events per user stand for a video's observations; ship dates for lifetimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import integrity, temporal
from tallyspark.sources.tables import load

SECOND = 1_000_000


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def timed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return load(spark, d, "events").where(F.col("event_type") == kind).select("event_id", "user_id", micros("ts").alias("at"))


def spans(spark: SparkSession, d: str, kind: str, seconds: int, names: tuple[str, str, str]) -> DataFrame:
    return timed(spark, d, kind).select("user_id", F.col("event_id").alias(names[0]), F.col("at").alias(names[1]), (F.col("at") + seconds * SECOND).alias(names[2]))


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    clicks = spans(spark, d, "click", 60, ("click_id", "start", "end"))
    views = spans(spark, d, "view", 30, ("view_id", "span_start", "span_end"))
    return temporal.window_overlap_join(clicks, views, "user_id", 600 * SECOND, 600 * SECOND, bucket=3600 * SECOND).select("user_id", "click_id", "view_id")


def interval_intersects_closed(spark: SparkSession, d: str) -> DataFrame:
    """Line lifetimes of one order that meet in whole days, ends included."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.unix_date(F.to_date("l_shipdate")).alias("s"), (F.unix_date(F.to_date("l_shipdate")) + F.col("l_quantity").cast("int")).alias("e"))
    other = li.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return li.join(other, "l_orderkey").where(temporal.intersects(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")) & (F.col("l_linenumber") < F.col("other"))).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("meetings"))


def interval_contains(spark: SparkSession, d: str) -> DataFrame:
    days = lambda c: F.unix_date(F.to_date(c))
    inner = load(spark, d, "lineitem").select("l_orderkey", days("l_shipdate").alias("start"), (days("l_shipdate") + F.col("l_quantity").cast("int")).alias("end"))
    outer = load(spark, d, "orders").select("o_orderkey", days("o_orderdate").alias("outer_start"), (days("o_orderdate") + 1200).alias("outer_end"))
    return temporal.containment_issues(inner, outer, "l_orderkey", "o_orderkey", "object.lifetime").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_order"))


def nearest_event(spark: SparkSession, d: str) -> DataFrame:
    return temporal.nearest(timed(spark, d, "click"), timed(spark, d, "view").select("user_id", F.col("at").alias("t"), F.col("event_id").alias("id")), "user_id", "at", "t", "id", 86_400 * SECOND)


def near_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = spans(spark, d, "purchase", 45, ("event_id", "start", "end"))
    return temporal.near_semi_join(rows, timed(spark, d, "error"), "user_id", 1500 * SECOND, 86_400 * SECOND).select("event_id")


def order_violation_lag(spark: SparkSession, d: str) -> DataFrame:
    out = temporal.order_violations(load(spark, d, "events"), ["user_id"], "event_id", "value")
    return out.select("user_id", "event_id", "value", "previous")


def strict_steps(spark: SparkSession, d: str) -> DataFrame:
    out = temporal.order_violations(load(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day")), ["o_custkey"], "o_orderkey", "day", strict=True)
    return out.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def ordinal_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return temporal.ordinal_issues(rows, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "expected")


def adjacent_overlap(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.to_date("l_shipdate"))
    li = load(spark, d, "lineitem").select("l_suppkey", day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    li = li.groupBy("l_suppkey", "id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return temporal.adjacent_overlaps(li, ["l_suppkey"], "start", "end", "id").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("overlaps"), F.max("previous_end").alias("last_end"))


def all_pairs_ordered(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    return temporal.ordered_pairs(li, "l_orderkey", "l_linenumber", "part")


def state_chain(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.unix_date(F.to_date(c))
    states = load(spark, d, "orders").select(F.col("o_orderkey").alias("state_id"), day("o_orderdate").alias("start"), (day("o_orderdate") + 30).alias("end"))
    deltas = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(day("l_shipdate")).alias("start"), F.min(day("l_shipdate") + F.col("l_quantity").cast("int") - 1).alias("end"))
    deltas = deltas.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("delta_id"), F.col("l_orderkey").alias("before_id"), (F.col("l_orderkey") + 1).alias("after_id"), "start", "end")
    return temporal.chain_issues(deltas, states)


def frame_sampling(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    times = temporal.sample_times((F.col("last") - F.col("first")).cast("double"), 5)
    return rows.select("user_id", F.posexplode(times).alias("i", "at")).withColumn("at", F.round("at", 6))


def even_subsample(spark: SparkSession, d: str) -> DataFrame:
    return temporal.even_rows(load(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 6)


def fk_missing(spark: SparkSession, d: str) -> DataFrame:
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders").where("o_orderstatus <> 'P'")
    return integrity.missing_references(li.select("l_orderkey", "l_linenumber"), "l_orderkey", o, "o_orderkey")


def array_fk_missing(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return integrity.missing_array_references(rows, "l_orderkey", "parts", load(spark, d, "part").where("p_size < 40"), "p_partkey")


def polymorphic_fk(spark: SparkSession, d: str) -> DataFrame:
    """Each line points to its part, supplier or order by turns; some kinds' targets are cut."""
    li = load(spark, d, "lineitem")
    kind = F.element_at(F.array(F.lit("part"), F.lit("supplier"), F.lit("orders")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    target = F.when(kind == "part", F.col("l_partkey")).when(kind == "supplier", F.col("l_suppkey")).otherwise(F.col("l_orderkey"))
    rows = li.select("l_orderkey", "l_linenumber", kind.alias("kind"), target.alias("target"))
    to = integrity.union_targets(part=(load(spark, d, "part").where("p_size > 5"), "p_partkey"), supplier=(load(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey"), orders=(load(spark, d, "orders"), "o_orderkey"))
    return integrity.missing_polymorphic(rows, "kind", "target", to).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def scope_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = integrity.scope_mismatches(rows.select("l_orderkey", "l_linenumber", "s_nationkey", "o_custkey"), "o_custkey", "s_nationkey", load(spark, d, "customer"), "c_custkey", "c_nationkey")
    return out.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


def uncovered_required(spark: SparkSession, d: str) -> DataFrame:
    return integrity.uncovered(load(spark, d, "customer"), load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def id_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    out = integrity.duplicate_ids(supplier=(load(spark, d, "supplier"), "s_suppkey"), nation=(load(spark, d, "nation"), "n_nationkey"), region=(load(spark, d, "region"), "r_regionkey"))
    return out.select("id", F.array_join("kinds", ",").alias("kinds"), "n")


def set_equality(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("q"))
    return integrity.set_differences(a.where("l_linenumber = 1"), a.where("l_linenumber = 2")).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no line names: required minus present."""
    return load(spark, d, "part").select(F.col("p_partkey").alias("part")).subtract(load(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_partkey").alias("part")))


def first_match(spark: SparkSession, d: str) -> DataFrame:
    out = integrity.first_of_each(load(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


def merge_unique(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", "text")
    return integrity.merge_unique(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "doc_id").select("doc_id")


def json_key_set(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").withColumn("exact", integrity.exact_keys(F.col("props"), ["k"]))
    return rows.groupBy("exact").agg(F.count(F.lit(1)).alias("n"))


def subset_issues(spark: SparkSession, d: str) -> DataFrame:
    """Parts on returned lines that no shipped line of the order has."""
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("inner"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))).alias("outer"))
    return integrity.subset_issues(rows, ["l_orderkey"], "inner", "outer").select("l_orderkey", F.size("extra").alias("n_extra"))


def evidence_subgraph(spark: SparkSession, d: str) -> DataFrame:
    kept = load(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("refs"))
    return integrity.subgraph(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", kept, "refs")


def applicable_rows(spark: SparkSession, d: str) -> DataFrame:
    rule = integrity.applicable(all_=[("o_totalprice", "gte", 50_000.0), ("o_orderkey", "exists", True)], any_=[("o_orderstatus", "eq", "F"), ("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), ("o_orderpriority", "contains", "LOW")], abstain_when=[("o_custkey", "lte", 100)])
    return load(spark, d, "orders").where(rule).select("o_orderkey")


def montage_exact(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("target_id"), F.col("l_linestatus").alias("uri"), F.sha2(F.col("l_quantity").cast("int").cast("string"), 256).alias("sha256"), "l_linenumber", "l_orderkey")
    out = integrity.montage_matches(li.where("l_linenumber = 1"), li.where("l_linenumber <> 1"))
    return out.select("l_orderkey")


QUERIES = {f.__name__: f for f in (interval_overlap, interval_intersects_closed, interval_contains, nearest_event, near_frames, order_violation_lag, strict_steps, ordinal_issues, adjacent_overlap, all_pairs_ordered, state_chain, frame_sampling, even_subsample, fk_missing, array_fk_missing, polymorphic_fk, scope_mismatch, uncovered_required, id_uniqueness, set_equality, set_difference, first_match, merge_unique, json_key_set, subset_issues, evidence_subgraph, applicable_rows, montage_exact)}

DAY = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))"
SQL = {
    "interval_overlap": "SELECT a.user_id, a.event_id AS click_id, b.event_id AS view_id FROM events a JOIN events b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'view' AND greatest(epoch_us(a.ts) - 600000000, 0) < epoch_us(b.ts) + 30000000 AND epoch_us(b.ts) < epoch_us(a.ts) + 660000000",
    "interval_intersects_closed": f"WITH x AS (SELECT l_orderkey, l_linenumber, {DAY.format('l_shipdate')} s, {DAY.format('l_shipdate')} + CAST(l_quantity AS INTEGER) e FROM lineitem) SELECT l_orderkey, count(*) AS meetings FROM x a JOIN x b USING (l_orderkey) WHERE a.e >= b.s AND a.s <= b.e AND a.l_linenumber < b.l_linenumber GROUP BY ALL",
    "interval_contains": f"SELECT 'object.lifetime' AS code, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT ({DAY.format('o_orderdate')} <= {DAY.format('l_shipdate')} AND {DAY.format('l_shipdate')} + CAST(l_quantity AS INTEGER) <= {DAY.format('o_orderdate')} + 1200) HAVING count(*) > 0",
    "nearest_event": """
WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS "at" FROM events WHERE event_type = 'click'), v AS (SELECT event_id id, user_id, epoch_us(ts) t FROM events WHERE event_type = 'view'),
r AS (SELECT c.event_id, c.user_id, c."at", v.id AS nearest_id, abs(v.t - c."at") AS gap, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.t - c."at"), v.t, v.id) n FROM c LEFT JOIN v USING (user_id))
SELECT event_id, user_id, "at", nearest_id, gap FROM r WHERE n = 1""",
    "near_frames": "SELECT event_id FROM events a WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND epoch_us(a.ts) <= epoch_us(b.ts) + 1500000000 AND epoch_us(a.ts) + 45000000 >= epoch_us(b.ts) - 1500000000)",
    "order_violation_lag": "WITH x AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) SELECT * FROM x WHERE value < previous",
    "strict_steps": "WITH x AS (SELECT o_custkey, CAST(o_orderdate AS DATE) v, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) p FROM orders) SELECT o_custkey, count(*) AS n FROM x WHERE v <= p GROUP BY ALL",
    "ordinal_issues": "WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS expected FROM x) SELECT * FROM y WHERE l_linenumber <> expected",
    "adjacent_overlap": f"""
WITH x AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, min({DAY.format('l_shipdate')}) s, max({DAY.format('l_shipdate')} + CAST(l_quantity AS INTEGER)) e FROM lineitem GROUP BY ALL),
y AS (SELECT *, lag(e) OVER (PARTITION BY l_suppkey ORDER BY s, id) p FROM x) SELECT l_suppkey, count(*) AS overlaps, CAST(max(p) AS INTEGER) AS last_end FROM y WHERE p > s GROUP BY ALL""",
    "all_pairs_ordered": "WITH x AS (SELECT l_orderkey, l_linenumber, min(l_partkey) part FROM lineitem GROUP BY ALL) SELECT l_orderkey, a.part AS before, b.part AS after FROM x a JOIN x b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber",
    "state_chain": f"""
WITH s AS (SELECT o_orderkey id, {DAY.format('o_orderdate')} s, {DAY.format('o_orderdate')} + 30 e FROM orders),
d AS (SELECT l_orderkey * 10 + l_linenumber AS delta_id, l_orderkey b, l_orderkey + 1 a, min({DAY.format('l_shipdate')}) s, min({DAY.format('l_shipdate')} + CAST(l_quantity AS INTEGER) - 1) e FROM lineitem GROUP BY ALL),
j AS (SELECT delta_id, p.id AS pid, n.id AS nid, p.e <= d.s AND d.s < d.e AND d.e <= n.s AS ok FROM d LEFT JOIN s p ON p.id = d.b LEFT JOIN s n ON n.id = d.a)
SELECT delta_id, 'delta.before_ref' AS code FROM j WHERE pid IS NULL UNION ALL SELECT delta_id, 'delta.after_ref' FROM j WHERE nid IS NULL UNION ALL SELECT delta_id, 'delta.temporal_order' FROM j WHERE pid IS NOT NULL AND nid IS NOT NULL AND NOT ok""",
    "frame_sampling": "WITH x AS (SELECT user_id, CAST(max(event_id) - min(event_id) AS DOUBLE) t FROM events GROUP BY ALL) SELECT user_id, CAST(i AS INTEGER) AS i, round(least(greatest(t * (i + 1) / 6, 1.0), t - 1), 6) AS \"at\" FROM x, range(5) r(i)",
    "even_subsample": "WITH x AS (SELECT user_id, list(event_id ORDER BY event_id) ids FROM events GROUP BY ALL), y AS (SELECT user_id, ids, unnest(list_distinct([CAST(round_even(i * (len(ids) - 1) / 5, 0) AS INTEGER) FOR i IN range(6)])) k FROM x WHERE len(ids) > 6) SELECT user_id, ids[k + 1] AS event_id FROM y UNION ALL SELECT user_id, unnest(ids) FROM x WHERE len(ids) <= 6",
    "fk_missing": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
    "array_fk_missing": "SELECT DISTINCT l_orderkey, l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)",
    "polymorphic_fk": "WITH x AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'part' WHEN 1 THEN 'supplier' ELSE 'orders' END AS kind, l_partkey p, l_suppkey s, l_orderkey o FROM lineitem) SELECT kind, count(*) AS n FROM x WHERE (kind = 'part' AND p NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) OR (kind = 'supplier' AND s NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) OR (kind = 'orders' AND o NOT IN (SELECT o_orderkey FROM orders)) GROUP BY ALL",
    "scope_mismatch": "SELECT s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL",
    "uncovered_required": "SELECT c_custkey, count(o_orderkey) AS uses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL HAVING uses <> 1",
    "id_uniqueness": "WITH x AS (SELECT 'supplier' k, CAST(s_suppkey AS VARCHAR) id FROM supplier UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region) SELECT id, array_to_string(list_sort(list(DISTINCT k)), ',') AS kinds, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1",
    "set_equality": "WITH a AS (SELECT l_returnflag f, CAST(l_quantity AS INTEGER) q FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_returnflag f, CAST(l_quantity AS INTEGER) q FROM lineitem WHERE l_linenumber = 2) SELECT * FROM (SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) WHERE n > 0",
    "set_difference": "SELECT p_partkey AS part FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 10",
    "first_match": "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) n FROM orders) WHERE n = 1",
    "merge_unique": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id % 2, doc_id) n FROM documents) WHERE n = 1",
    "json_key_set": "SELECT coalesce(json_keys(props) = ['k'], false) AS exact, count(*) AS n FROM events GROUP BY ALL",
    "subset_issues": "WITH x AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R') SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_extra FROM x GROUP BY ALL",
    "evidence_subgraph": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
    "applicable_rows": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 50000 AND o_orderkey IS NOT NULL AND (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderpriority LIKE '%LOW%') AND NOT o_custkey <= 100",
    "montage_exact": "SELECT l_orderkey FROM lineitem a WHERE l_linenumber = 1 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber <> 1 AND b.l_returnflag = a.l_returnflag AND b.l_partkey = a.l_partkey AND b.l_linestatus = a.l_linestatus AND CAST(b.l_quantity AS INTEGER) = CAST(a.l_quantity AS INTEGER))",
}
