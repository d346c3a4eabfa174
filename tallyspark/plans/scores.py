"""Queries on scores and agreement. Orders stand for rated items: status is the arm, nation and region are teacher and video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import agreement, scoring
from tallyspark.sources.tables import load


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Orders with region, nation, customer and year: four nested levels."""
    o, c, n = (load(spark, d, t) for t in ("orders", "customer", "nation"))
    nations = n.select("n_nationkey", "n_regionkey", "n_name")
    return o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("year", F.year("o_orderdate"))


CELLS = """
cells AS (SELECT o.*, c_custkey, n_regionkey, n_nationkey, year(o_orderdate) AS "year"
  FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def macro_mean_nested(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.macro_mean(cells(spark, d), ["n_regionkey", "n_nationkey", "c_custkey", "year"], ["o_totalprice"], ["o_orderstatus"])
    return out.select(F.col("o_orderstatus").alias("arm"), F.round("o_totalprice", 4).alias("macro_mean"))


MACRO = """
m1 AS (SELECT o_orderstatus, n_regionkey, n_nationkey, c_custkey, "year", avg(o_totalprice) v FROM cells GROUP BY ALL),
m2 AS (SELECT o_orderstatus, n_regionkey, n_nationkey, c_custkey, avg(v) v FROM m1 GROUP BY ALL),
m3 AS (SELECT o_orderstatus, n_regionkey, n_nationkey, avg(v) v FROM m2 GROUP BY ALL),
m4 AS (SELECT o_orderstatus, n_regionkey, avg(v) v FROM m3 GROUP BY ALL),
m5 AS (SELECT o_orderstatus AS arm, avg(v) v FROM m4 GROUP BY ALL)"""


def baseline_argmax(spark: SparkSession, d: str) -> DataFrame:
    scores = scoring.macro_mean(cells(spark, d), ["n_regionkey", "n_nationkey", "c_custkey", "year"], ["o_totalprice"], ["o_orderstatus"])
    out = scoring.argmax_with_order(scores, "o_orderstatus", "o_totalprice", ["P", "O", "F"], within=1e-6)
    return out.select(F.col("o_orderstatus").alias("arm"), F.round("o_totalprice", 4).alias("score"))


def paired_arm_diff(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.paired_difference(cells(spark, d), ["o_custkey", "year"], "o_orderstatus", "o_totalprice", "O", "F")
    return out.select("o_custkey", "year", *(F.round(c, 4).alias(c) for c in ("left_value", "right_value", "difference")))


PAIRED = """
paired AS (SELECT o_custkey, "year", avg(o_totalprice) FILTER (o_orderstatus = 'O') AS left_value, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS right_value
  FROM cells GROUP BY ALL HAVING count(*) FILTER (o_orderstatus = 'O') > 0 AND count(*) FILTER (o_orderstatus = 'F') > 0)"""


def case_delta_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = scoring.paired_difference(cells(spark, d), ["n_nationkey", "o_custkey", "year"], "o_orderstatus", "o_totalprice", "O", "F")
    out = scoring.case_deltas(pairs, "n_nationkey")
    return out.withColumn("mean_delta", F.round("mean_delta", 4))


def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem")
    out = scoring.arm_summary(rows, "l_returnflag", ["l_quantity", "l_extendedprice"], F.col("l_discount") > 0.09, F.col("l_discount") - F.col("l_tax"))
    return out.select(F.col("l_returnflag").alias("arm"), "n", F.round("l_quantity", 6).alias("mean_quantity"), F.round("l_extendedprice", 4).alias("mean_price"), "hard_failures", F.round("mean_absolute_disagreement", 8).alias("mean_absolute_disagreement"))


def item_metrics_f1(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines are its claims (supported unless returned), its parts the evidence, its ship dates the temporal pairs."""
    li = load(spark, d, "lineitem")
    claims = li.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("claim"), (F.col("l_returnflag") == "N").alias("supported"), F.col("l_partkey").alias("unit"))
    by = li.groupBy(F.col("l_orderkey").alias("item"))
    eligible = by.agg(F.count_distinct("l_partkey").alias("n_units"))
    edits = by.agg(F.count_if(F.col("l_quantity") >= 25).alias("n_edits"), F.count_if((F.col("l_quantity") >= 25) & (F.col("l_linestatus") == "F")).alias("n_covered"))
    pairs = by.agg(F.count_if(F.col("l_linenumber") > 1).alias("n_pairs"), F.count_if((F.col("l_linenumber") > 1) & (F.col("l_tax") > 0.04)).alias("n_correct"))
    out = scoring.item_metrics(claims, eligible, edits, pairs)
    return out.select("item", *(F.round(c, 9).alias(c) for c in out.columns if c != "item"))


def rater_means(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem")
    out = scoring.rater_mean(rows, ["l_orderkey"], "l_linestatus", ["l_quantity", "l_discount"])
    return out.select("l_orderkey", "complete", F.round("l_quantity", 9).alias("l_quantity"), F.round("l_discount", 9).alias("l_discount"))


def rating_recheck(spark: SparkSession, d: str) -> DataFrame:
    """Counts and ratios made of line items, some of them wrong on purpose."""
    li = load(spark, d, "lineitem")
    tp, fp, fn = F.col("l_quantity").cast("int") % 7, F.col("l_linenumber") % 4, F.col("l_partkey").cast("int") % 5
    rows = li.select("l_orderkey", "l_linenumber", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.col("l_suppkey").cast("int").alias("s"))
    precision, recall, f1 = scoring.rating_counts_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    rows = rows.select(
        "*",
        (F.col("tp") + F.col("fn") + (F.col("s") % 11 == 0).cast("int")).alias("units"),
        (F.col("fp") + F.col("s") % 3 - 1).alias("evidence_claims"),
        (F.col("fp") + 1).alias("factual_claims"),
        (F.col("fp") + F.col("s") % 3).alias("unsupported"),
        (precision + (F.col("s") % 13 == 0).cast("int") * 0.01).alias("precision"),
        recall.alias("recall"),
        (f1 + (F.col("s") % 17 == 0).cast("int") * 1e-7).alias("f1"),
    )
    return scoring.rating_issues(rows, ["l_orderkey", "l_linenumber"]).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def matrix_completeness(spark: SparkSession, d: str) -> DataFrame:
    return scoring.matrix_issues(load(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O"], ["o_orderpriority"])


def denominator_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem")
    return scoring.denominator_drift(rows, ["l_orderkey"], F.concat_ws(":", F.col("l_returnflag"), F.col("l_linestatus")))


def coverage_profile(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    rows = e.select("event_id", F.concat_ws("-", "user_id", F.to_date("ts")).alias("window_id"), F.col("event_type").alias("operation"), F.col("user_id").alias("teacher"))
    return scoring.coverage_profile(rows, 30, 1_000_000_000)


def gates(spark: SparkSession, d: str) -> DataFrame:
    """Development, fix and diagnostic decisions of each nation, from ratios of its orders."""
    rows = cells(spark, d).groupBy("n_nationkey").agg(
        F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("f1"),
        F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("base"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"),
        F.count(F.lit(1)).alias("n"),
    )
    f1, base, urgent, low = (F.col(c) for c in ("f1", "base", "urgent", "low"))
    dev = scoring.development_gate(f1, base, urgent, low, low, urgent, F.when(f1 > base, 2).otherwise(1), urgent % 7, low % 3 % 2)
    fix = scoring.fix_gate(f1 / base, F.lit(1), F.lit(1), F.lit(0), F.lit(2), F.lit(4), low % 2)
    diag = scoring.paired_diagnostic(F.col("n") % 5 != 0, low % 4 == 0, urgent % 2 == 0, f1 / base - 1, F.lit(0.0), f1 / base - 1, F.lit(0.3))
    return rows.select("n_nationkey", dev.alias("development"), fix.alias("fix"), diag.alias("diagnostic"))


def kappa_labels(spark: SparkSession, d: str) -> DataFrame:
    out = agreement.kappa(load(spark, d, "labels"), F.col("quality"), F.col("toxic"))
    return out.select("items", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")), "status")


def kappa_operations(spark: SparkSession, d: str) -> DataFrame:
    """Operation sequences of neighbouring orders' lines as two raters' labels, by status."""
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    lines = lines.select("k", F.transform("x", lambda s: s["l_returnflag"]).alias("ops"))
    label = agreement.sequence_label(F.size("ops") <= 3, F.slice("ops", 1, 2))
    rows = lines.select("k", label.alias("label"))
    pairs = rows.where("k % 2 = 0").join(rows.where("k % 2 = 1").select((F.col("k") - 1).alias("k"), F.col("label").alias("other")), "k")
    out = agreement.kappa(pairs, F.col("label"), F.col("other"))
    return out.select("items", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")), "status")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return agreement.confusion(load(spark, d, "labels"), "quality", "toxic", ["0", "1", "unknown"])


def label_counts_domain(spark: SparkSession, d: str) -> DataFrame:
    return agreement.label_counts(load(spark, d, "labels"), {"visual": "quality", "physics": "toxic"}, ["0", "1", "unknown"])


def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    out = agreement.summary(load(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])
    return out.select("o_orderpriority", "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "maximum")))


def agreement_by_package(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    out = agreement.agreement_rate(rows, F.col("quality") == F.col("toxic"), ["source"])
    return out.withColumn("rate", F.round("rate", 9))


def reliability_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    k = agreement.kappa(rows, F.col("quality"), F.col("toxic"), ["lang"])
    decision = agreement.reliability_gate(F.col("kappa") + 0.75, F.col("kappa") + 0.85)
    return k.select("lang", decision.alias("decision")).withColumn("status", agreement.reconciliation_status(F.col("decision"), F.length("lang") % 2))


def reviewer_join(spark: SparkSession, d: str) -> DataFrame:
    """Two reviewers' decisions on orders: one misses every seventh, and differs where the customer's key is odd."""
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("disposition"), F.col("o_custkey").alias("candidate"))
    other = o.where("o_orderkey % 7 <> 0").withColumn("disposition", F.when(F.col("candidate") % 2 == 1, "X").otherwise(F.col("disposition")))
    return agreement.reviewer_join(o, other, "o_orderkey", ["disposition", "candidate"]).groupBy("agreed").agg(F.count(F.lit(1)).alias("n"))


def boundary_deltas(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_linenumber")).alias("end"), "l_returnflag")
    a = li.where("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    b = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    deltas = agreement.boundary_deltas(a, b, ["l_orderkey"])
    out = agreement.summary(deltas.withColumn("all", F.lit("pairs")), "start_delta", ["all"])
    return out.select("n", F.round("mean", 9).alias("mean"), "median", "maximum")


def value_gate(spark: SparkSession, d: str) -> DataFrame:
    """Four metrics from the orders' ratios, as a gate sees them."""
    o = load(spark, d, "orders")
    share = lambda c: F.avg(c.cast("double"))
    rows = o.agg(share(F.col("o_orderstatus") == "F").alias("evidence_f1"), share(F.col("o_orderpriority") < "3").alias("temporal_fidelity"), share(F.col("o_totalprice") > 1000).alias("edit_coverage"), (share(F.col("o_orderstatus") == "P") - 1).alias("unsupported_claim_rate"))
    long = rows.unpivot([], list(rows.columns), "metric", "difference").withColumn("low80", F.col("difference") - 0.01)
    return scoring.value_gate(long)


def value_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gate of each customer: its orders' shares as metrics; one of fewer than five orders is blocked."""
    o = load(spark, d, "orders")
    share = lambda c: F.avg(c.cast("double"))
    rows = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), share(F.col("o_orderstatus") == "F").alias("evidence_f1"), share(F.col("o_orderpriority") < "3").alias("temporal_fidelity"), share(F.col("o_totalprice") > 60000).alias("edit_coverage"), (share(F.col("o_orderpriority") > "5") - 0.25).alias("unsupported_claim_rate"))
    metrics = ["evidence_f1", "temporal_fidelity", "edit_coverage", "unsupported_claim_rate"]
    long = rows.unpivot(["o_custkey", "n"], metrics, "metric", "difference").withColumn("low80", F.col("difference") - 0.125)
    return scoring.value_gate(long, blocked=F.col("n") < 5, by=["o_custkey"])


QUERIES = {f.__name__: f for f in (macro_mean_nested, baseline_argmax, paired_arm_diff, case_delta_counts, arm_summary, item_metrics_f1, rater_means, rating_recheck, matrix_completeness, denominator_drift, coverage_profile, gates, value_gates, kappa_labels, kappa_operations, confusion_matrix, label_counts_domain, summary_stats, agreement_by_package, reliability_gate, reviewer_join, boundary_deltas, value_gate)}

KAPPA = """
m AS (SELECT g, l AS label, count(*) a, 0 b FROM p GROUP BY ALL UNION ALL SELECT g, r, 0, count(*) FROM p GROUP BY ALL),
mm AS (SELECT g, label, sum(a) a, sum(b) b FROM m GROUP BY ALL),
ch AS (SELECT g, sum(a * b) chance FROM mm GROUP BY ALL),
w AS (SELECT g, count(*) items, count(*) FILTER (l = r) same FROM p GROUP BY ALL),
k AS (SELECT g, items, same / items observed, chance / (items * items) expected,
  CASE WHEN chance = items * items THEN 'not_estimable' ELSE 'estimable' END status,
  CASE WHEN chance <> items * items THEN (same * items - chance) / (items * items - chance) END kappa FROM w JOIN ch USING (g))"""

SQL = {
    "macro_mean_nested": f"WITH {CELLS}, {MACRO} SELECT arm, round(v, 4) AS macro_mean FROM m5",
    "baseline_argmax": f"WITH {CELLS}, {MACRO} SELECT arm, round(v, 4) AS score FROM m5 WHERE v >= (SELECT max(v) FROM m5) - 1e-6 ORDER BY list_position(['P', 'O', 'F'], arm) LIMIT 1",
    "paired_arm_diff": f'WITH {CELLS}, {PAIRED} SELECT o_custkey, CAST("year" AS INTEGER) AS "year", round(left_value, 4) AS left_value, round(right_value, 4) AS right_value, round(left_value - right_value, 4) AS difference FROM paired',
    "case_delta_counts": f"WITH {CELLS}, {PAIRED} SELECT c_nationkey AS n_nationkey, round(avg(left_value - right_value), 4) AS mean_delta, count(*) FILTER (left_value > right_value) AS positive_pairs, count(*) AS pairs FROM paired JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "arm_summary": "SELECT l_returnflag AS arm, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, round(avg(l_extendedprice), 4) AS mean_price, count(*) FILTER (l_discount > 0.09) AS hard_failures, round(avg(abs(l_discount - l_tax)), 8) AS mean_absolute_disagreement FROM lineitem GROUP BY ALL",
    "item_metrics_f1": """
WITH a AS (SELECT l_orderkey AS item, count(DISTINCT l_linenumber) c, count(DISTINCT l_linenumber) FILTER (l_returnflag = 'N') s,
  count(DISTINCT l_partkey) FILTER (l_returnflag = 'N') u, count(DISTINCT l_partkey) n,
  count(*) FILTER (l_quantity >= 25) e, count(*) FILTER (l_quantity >= 25 AND l_linestatus = 'F') cov,
  count(*) FILTER (l_linenumber > 1) p, count(*) FILTER (l_linenumber > 1 AND l_tax > 0.04) ok FROM lineitem GROUP BY ALL),
b AS (SELECT *, s / c AS pr, u / n AS re FROM a)
SELECT item, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9) AS evidence_f1, round(cov / nullif(e, 0), 9) AS edit_coverage,
  round(ok / nullif(p, 0), 9) AS temporal_fidelity, round((c - s) / c, 9) AS unsupported_claim_rate FROM b""",
    "rater_means": "SELECT l_orderkey, count(DISTINCT l_linestatus) = 2 AS complete, CASE WHEN count(DISTINCT l_linestatus) = 2 THEN round(avg(l_quantity), 9) END AS l_quantity, CASE WHEN count(DISTINCT l_linestatus) = 2 THEN round(avg(l_discount), 9) END AS l_discount FROM lineitem GROUP BY ALL",
    "rating_recheck": """
WITH r AS (SELECT CAST(l_quantity AS INTEGER) % 7 tp, l_linenumber % 4 fp, CAST(l_partkey AS INTEGER) % 5 fn, CAST(l_suppkey AS INTEGER) s FROM lineitem),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END re FROM r),
c AS (SELECT unnest(list_filter([
  CASE WHEN fp + s % 3 - 1 < 0 THEN 'count.negative' END,
  CASE WHEN s % 11 = 0 THEN 'count.denominator' END,
  CASE WHEN fp + s % 3 - 1 > fp + 1 THEN 'count.claims' END,
  CASE WHEN fp > fp + s % 3 - 1 THEN 'count.false_positive' END,
  CASE WHEN fp + s % 3 > fp + 1 THEN 'count.unsupported' END,
  CASE WHEN s % 13 = 0 THEN 'value.precision' END], lambda x: x IS NOT NULL)) code FROM q)
SELECT code, count(*) AS n FROM c GROUP BY ALL""",
    "matrix_completeness": """
WITH g AS (SELECT o_custkey, count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END) a, count(*) FILTER (o_orderstatus IN ('F', 'O')) r,
  count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) f, count(DISTINCT o_orderpriority) p FROM orders GROUP BY ALL),
c AS (SELECT o_custkey, unnest(list_filter([CASE WHEN a < 2 THEN 'arm.missing' END, CASE WHEN r > a THEN 'arm.repeated' END, CASE WHEN f > 0 THEN 'arm.foreign' END, CASE WHEN p > 1 THEN 'o_orderpriority.varies' END], lambda x: x IS NOT NULL)) code FROM g)
SELECT * FROM c""",
    "denominator_drift": "SELECT l_orderkey, count(DISTINCT l_returnflag || ':' || l_linestatus) AS shapes FROM lineitem GROUP BY ALL HAVING shapes > 1",
    "coverage_profile": "WITH w AS (SELECT user_id || '-' || CAST(ts AS DATE) k, count(*) n FROM events GROUP BY ALL) SELECT count(*) AS events, count(DISTINCT event_type) AS operations, count(DISTINCT user_id) AS teachers, (SELECT count(*) FROM w WHERE n > 1) AS multi_edit_windows, count(*) BETWEEN 30 AND 1000000000 AND count(DISTINCT user_id) >= 2 AS ready FROM events",
    "gates": f"""
WITH {CELLS}, g AS (SELECT n_nationkey, avg(o_totalprice) FILTER (o_orderstatus = 'O') f, avg(o_totalprice) FILTER (o_orderstatus = 'F') b,
  count(*) FILTER (o_orderpriority = '1-URGENT') u, count(*) FILTER (o_orderpriority = '5-LOW') l, count(*) n FROM cells GROUP BY ALL)
SELECT n_nationkey,
  CASE WHEN f > b AND u % 7 >= 4 AND u > l AND l <= u AND l % 3 % 2 = 0 THEN 'GO' WHEN f > b AND l % 3 % 2 = 0 THEN 'FIX' ELSE 'PIVOT_STOP' END AS development,
  CASE WHEN f / b >= 0.9434523809523809 AND l % 2 = 0 THEN 'GO' ELSE 'FIX_STOP' END AS fix,
  CASE WHEN n % 5 = 0 THEN 'BLOCKED' WHEN l % 4 <> 0 AND u % 2 = 0 AND f / b - 1 >= -0.02 THEN 'REGION_FIX_RETAINED'
    WHEN l % 4 <> 0 AND f / b - 1 < -0.05 THEN 'ATOMIC_QUESTION_CONTRACT_NEEDED' ELSE 'REPRESENTATION_REDESIGN' END AS diagnostic FROM g""",
    "kappa_labels": f"WITH p AS (SELECT 0 AS g, quality AS l, toxic AS r FROM labels), {KAPPA} SELECT items, round(observed, 9) AS observed, round(expected, 9) AS expected, round(kappa, 9) AS kappa, status FROM k",
    "kappa_operations": f"""
WITH x AS (SELECT l_orderkey k, list(l_returnflag ORDER BY l_linenumber, l_returnflag) ops FROM lineitem GROUP BY ALL),
y AS (SELECT k, CASE WHEN len(ops) <= 3 THEN 'ACCEPT:' || array_to_string(ops[1:2], '>') ELSE 'NO_EVENT_ACCEPTED' END label FROM x),
p AS (SELECT 0 AS g, a.label AS l, b.label AS r FROM y a JOIN y b ON b.k = a.k + 1 WHERE a.k % 2 = 0), {KAPPA}
SELECT items, round(observed, 9) AS observed, round(expected, 9) AS expected, round(kappa, 9) AS kappa, status FROM k""",
    "confusion_matrix": "WITH d AS (SELECT unnest(['0', '1', 'unknown']) x) SELECT a.x AS left_label, b.x AS right_label, (SELECT count(*) FROM labels WHERE CAST(quality AS VARCHAR) = a.x AND CAST(toxic AS VARCHAR) = b.x) AS n FROM d a, d b",
    "label_counts_domain": "WITH d AS (SELECT unnest(['0', '1', 'unknown']) x) SELECT 'visual' AS rater, x AS label, (SELECT count(*) FROM labels WHERE CAST(quality AS VARCHAR) = x) AS n FROM d UNION ALL SELECT 'physics', x, (SELECT count(*) FROM labels WHERE CAST(toxic AS VARCHAR) = x) FROM d",
    "summary_stats": "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(max(o_totalprice), 4) AS maximum FROM orders GROUP BY ALL",
    "agreement_by_package": "SELECT source, count(*) AS items, count(*) FILTER (quality = toxic) AS agreed, round(count(*) FILTER (quality = toxic) / count(*), 9) AS rate, count(*) FILTER (quality <> toxic) AS conflicts FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
    "reliability_gate": f"""
WITH p AS (SELECT lang AS g, quality AS l, toxic AS r FROM labels JOIN documents USING (doc_id)), {KAPPA},
z AS (SELECT g AS lang, CASE WHEN kappa IS NULL THEN 'BLOCKED_PRIMARY_KAPPA_NOT_ESTIMABLE' WHEN kappa + 0.75 < 0.67 THEN 'RELABEL_PILOT_REQUIRED' WHEN kappa + 0.75 < 0.8 THEN 'CONTINUE_FULL_CONFLICT_ADJUDICATION' ELSE 'TARGET_RELIABILITY_MET' END AS decision FROM k)
SELECT lang, decision, CASE WHEN decision LIKE 'BLOCKED%' THEN 'reliability_gate_blocked_no_gold_written' WHEN decision LIKE 'RELABEL%' THEN 'relabel_pilot_required_no_gold_written' WHEN length(lang) % 2 > 0 THEN 'joint_human_resolution_required_no_gold_written' ELSE 'ready_for_joint_human_confirmation_no_gold_written' END AS status FROM z""",
    "reviewer_join": "SELECT o_orderkey % 7 <> 0 AND o_custkey % 2 = 0 AS agreed, count(*) AS n FROM orders GROUP BY ALL",
    "boundary_deltas": """
WITH x AS (SELECT l_orderkey, l_returnflag, min(l_quantity) s FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY ALL),
y AS (SELECT abs(a.s - b.s) v FROM x a JOIN x b USING (l_orderkey) WHERE a.l_returnflag = 'N' AND b.l_returnflag = 'R')
SELECT count(*) AS n, round(avg(v), 9) AS mean, median(v) AS median, max(v) AS maximum FROM y HAVING count(*) > 0""",
    "value_gate": "WITH r AS (SELECT avg((o_orderstatus = 'F')::INT) a, avg((o_orderpriority < '3')::INT) b, avg((o_totalprice > 1000)::INT) c FROM orders) SELECT CASE WHEN least(a, b, c) >= 0.05 THEN 'GO' ELSE 'STOP' END AS decision FROM r",
    "value_gates": """
WITH r AS (SELECT o_custkey, count(*) n, avg((o_orderstatus = 'F')::INT) a, avg((o_orderpriority < '3')::INT) b, avg((o_totalprice > 60000)::INT) c, avg((o_orderpriority > '5')::INT) - 0.25 u FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n < 5 THEN 'BLOCKED' WHEN least(a, b, c) > 0.125 AND u <= 0 THEN 'GO' ELSE 'STOP' END AS decision FROM r""",
}
