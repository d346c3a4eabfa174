"""Decisions compiled into bundles: customers' bundles, their orders as transcript and as what was decided."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators import gold
from tallyspark.plans.bundles import unknown, valid
from tallyspark.sources.schemas import BUNDLE
from tallyspark.sources.tables import load, materialise


def drafts() -> dict:
    """The valid bundle as a draft: nobody has spoken yet, and everything waits for review."""
    out = valid()
    out |= {"speech": [], "evidence": out["evidence"][:3], "warnings": ["No independent ASR/transcript exists yet", "kept"]}
    for part in ("surfaces", "states", "deltas", "transitions"):
        for row in out[part]:
            row["status"] = "needs_review"
    out["deltas"][0]["uncertainty_codes"] = ["no_independent_asr", "other"]
    out["transitions"][0] |= {"speech_ids": [], "evidence_refs": ["e3"], "teaching_action": unknown(), "pedagogical_role": unknown()}
    return out


def inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A draft a customer; segments and decisions from its orders, some of which cannot stand."""
    who = load(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_acctbal").cast("double").alias("bal"), "c_mktsegment").withColumn("bundle_id", F.col("k").cast("string"))
    body = F.replace(F.lit(json.dumps(drafts())), F.lit('"bundle_id": "b"'), F.concat(F.lit('"bundle_id": "'), F.col("bundle_id"), F.lit('"')))
    bundles = who.where("k % 4 <> 0").select(F.from_json(body, BUNDLE).alias("b")).select("b.*")
    ledgers = who.where("k % 4 <> 0").select("bundle_id", F.concat(F.lit("gold-"), "bundle_id").alias("adjudication_id"), F.lit("2024-06-01T00:00:00.000Z").alias("created_at"), (F.col("k") % 5).cast("double").alias("offset"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = load(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("bundle_id"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey"), (F.row_number().over(order) - 1).alias("index"))
    segments = orders.select("bundle_id", "index", (10.0 + 2 * F.col("index")).alias("start"), (11.5 + 2 * F.col("index")).alias("end"), "text")
    n = F.when(F.col("k") % 5 == 0, 2).otherwise(1)
    rows = who.where("k % 7 <> 0").select("*", F.explode(F.sequence(F.lit(1), n)).alias("ordinal"))
    delta = F.when(F.col("k") % 23 == 0, "d9").otherwise("d1")
    sha = F.sha2(F.when(F.col("k") % 3 == 0, "same").otherwise(F.concat(F.lit("f"), F.col("ordinal").cast("string"))), 256)
    frame = F.struct(F.when(F.col("k") % 11 == 0, "f1").otherwise(F.concat(F.lit("u"), F.col("ordinal").cast("string"))).alias("frame_id"), (14 + F.col("k") % 24).cast("double").alias("timestamp"), F.lit("u/x.PNG").alias("asset_uri"), sha.alias("sha256"))
    decisions = rows.select(
        "bundle_id", "ordinal", delta.alias("delta_id"), F.lit("t1").alias("transition_id"), F.concat_ws(" ", "c_mktsegment", "ordinal").alias("semantic_label"), F.lit("said").alias("normalized_speech"), F.lit("names it").alias("teaching_action"),
        (F.col("bal") / 10_000).alias("registration"), F.array(F.col("ordinal") - 1, (F.col("k") % 9).cast("int") + F.col("ordinal")).alias("segments"), F.when(F.col("k") % 2 == 0, frame).alias("frame"),
    )
    return bundles, ledgers, decisions, segments


def gold_faults(spark: SparkSession, d: str) -> DataFrame:
    return gold.judged(*inputs(spark, d))[2]


def gold_bundles(spark: SparkSession, d: str) -> DataFrame:
    """The compiled rows that decisions change: speech, transition, delta and frames of each bundle."""
    made, _ = gold.compile_gold(*inputs(spark, d))
    made = materialise(made, "gold")
    t, x = F.col("transitions")[0], F.col("deltas")[0]
    return made.select(
        "source_bundle_id", "bundle_id", F.size("speech").alias("n_speech"), F.size("evidence").alias("n_evidence"), F.array_join(F.transform("frames", lambda f: f["frame_id"]), ",").alias("frames"), F.array_join(F.transform("speech", lambda s: F.concat(s["speech_id"], F.lit("@"), s["time"]["start"].cast("string"), F.lit("-"), s["time"]["end"].cast("string"), F.lit(":"), s["raw_text"])), ";").alias("speech"),
        t["time"]["start"].alias("start"), t["time"]["end"].alias("end"), F.array_join(t["evidence_refs"], ",").alias("refs"), F.array_join(t["speech_ids"], ",").alias("speech_ids"), x["semantic_label"].alias("label"), F.round(x["confidence"]["registration"], 9).alias("registration"), F.array_join(x["uncertainty_codes"], ",").alias("codes"),
        F.concat_ws(",", x["status"], t["status"], F.col("states")[0]["status"], F.col("surfaces")[0]["status"]).alias("statuses"), F.array_join("warnings", ",").alias("warnings"),
    )


QUERIES = {"gold_faults": gold_faults, "gold_bundles": gold_bundles}

BASE = """
o AS (SELECT o_custkey k, o_orderpriority text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
x AS (SELECT c_custkey k, CAST(c_acctbal AS DOUBLE) / 10000 AS reg, c_mktsegment seg, unnest(range(1, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 2 END)) AS n FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 4 <> 0),
f AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'f1' ELSE 'u' || n END AS frame, 14 + k % 24 AS t FROM x WHERE k % 2 = 0),
faults AS (SELECT k, n, 'reference.delta' AS code FROM x WHERE k % 23 = 0 UNION ALL SELECT k, n, 'registration.range' FROM x WHERE reg NOT BETWEEN 0 AND 1
  UNION ALL SELECT k, n, 'segment.missing' FROM x WHERE (SELECT count(*) FROM o WHERE o.k = x.k) <= k % 9 + n
  UNION ALL SELECT k, n, 'frame.duplicate' FROM f WHERE k % 11 = 0 UNION ALL SELECT k, n, 'frame.window' FROM f WHERE t NOT BETWEEN 16 AND 34 AND k % 23 <> 0 UNION ALL SELECT k, n, 'frame.reused' FROM f WHERE n = 2 AND k % 3 = 0)"""
SQL = {
    "gold_faults": f"WITH {BASE} SELECT CAST(k AS VARCHAR) AS bundle_id, n AS ordinal, code FROM faults",
    "gold_bundles": f"""WITH {BASE},
s AS (SELECT x.*, 10.0 + 2 * (n - 1) + k % 5 AS a, 11.5 + 2 * (k % 9 + n) + k % 5 AS b, (SELECT text FROM o WHERE o.k = x.k AND i = n - 1) || ' ' || (SELECT text FROM o WHERE o.k = x.k AND i = x.k % 9 + n) AS raw FROM x WHERE k NOT IN (SELECT k FROM faults)),
g AS (SELECT k, count(*) AS c, string_agg('GOLD-SPEECH-0' || n || '@' || CAST(CAST(a AS DOUBLE) AS VARCHAR) || '-' || CAST(CAST(b AS DOUBLE) AS VARCHAR) || ':' || raw, ';' ORDER BY a, n) AS speech, least(20.0, min(a)) AS lo, greatest(30.0, max(b)) AS hi, string_agg('GOLD-EV-SPEECH-0' || n, ',' ORDER BY n) AS refs, max(n) AS last, max(seg) AS seg, max(reg) AS reg FROM s GROUP BY k),
w AS (SELECT k, string_agg(id, ',' ORDER BY t, id) AS frames FROM (SELECT k, frame AS id, t FROM f UNION ALL SELECT c_custkey, 'f1', 10 FROM customer UNION ALL SELECT c_custkey, 'f2', 40 FROM customer) GROUP BY k)
SELECT CAST(c_custkey AS VARCHAR) AS source_bundle_id, 'gold-' || c_custkey AS bundle_id, CAST(coalesce(c, 0) AS INT) AS n_speech, CAST(3 + coalesce(c, 0) AS INT) AS n_evidence, CASE WHEN c IS NULL THEN 'f1,f2' ELSE frames END AS frames, coalesce(speech, '') AS speech, CAST(coalesce(lo, 20) AS DOUBLE) AS start, CAST(coalesce(hi, 30) AS DOUBLE) AS "end",
  'e3' || coalesce(',' || refs, '') AS refs, CASE WHEN c IS NULL THEN '' ELSE 'GOLD-SPEECH-0' || last END AS speech_ids, CASE WHEN c IS NULL THEN 'a box' ELSE seg || ' ' || last END AS label, round(coalesce(reg, 1.0), 9) AS registration, CASE WHEN c IS NULL THEN 'no_independent_asr,other' ELSE 'other' END AS codes,
  CASE WHEN c IS NULL THEN 'needs_review,needs_review,needs_review,needs_review' ELSE 'accepted,accepted,accepted,accepted' END AS statuses, 'kept,engineering_gold_dev_not_paper_gold,agent_assisted_adjudication_requires_human_signoff' AS warnings
FROM customer LEFT JOIN g ON g.k = c_custkey LEFT JOIN w ON w.k = c_custkey WHERE c_custkey % 4 <> 0 AND c_custkey NOT IN (SELECT k FROM faults)""",
}
