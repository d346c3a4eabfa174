"""Model answers made of orders and their lines, as texts, some of them broken by what the rows hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import response
from tallyspark.plans.reviews import LINES, lines
from tallyspark.sources.tables import load


def answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer an order, an action a line."""
    q, n, o = F.col("q"), F.col("n"), F.col("o")
    li = lines(spark, d)
    seq = F.when(q == 7, "0").when(q == 8, "1.5").otherwise(n.cast("string"))
    op = F.when(q == 9, "draw").when(F.col("flag") == "R", "add").when(F.col("flag") == "A", "erase").otherwise("connect")
    content = F.when(q == 10, "5").when(q == 13, '"Students solved it"').when(q == 14, "null").otherwise('"x"')
    rest = F.when(q == 11, ',"region":null,"no/te":1').when(q == 12, "").otherwise(',"region":"r"')
    action = F.concat(F.lit('{"sequence_index":'), seq, F.lit(',"operation":"'), op, F.lit('","content":'), content, rest, F.lit("}"))
    actions = li.groupBy("o").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n", action.alias("a"))))["a"], ",").alias("actions"))
    case = lambda m, bad, good: F.when(o % m == 0, F.lit(bad)).otherwise(F.lit(good))
    text = F.concat(
        F.lit('{"schema_version":"teacher-evidence-response-'), case(23, "v0", "v1"), F.lit('","observed_board_actions":['), "actions", F.lit('],"generalized_teaching_capability":{"name":"n","mechanism":"m","action_program":'), case(17, "[]", '["a"]'),
        F.lit('},"evidence_claims":[{"claim":"'), case(13, " ", "c"), F.lit('","evidence_slot":"'), case(2, "visual-1", "transcript"), F.lit('"}],"uncertainties":'), case(19, '["",1,"students may differ","students: unknown"]', "[]"), case(37, ',"uncertainties":[]', ""), F.lit("}"), case(29, " x", " "),
    )
    return load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o")).join(actions, "o").select(F.col("o").alias("id"), F.when(o % 4 == 0, "transcript_only").otherwise("oracle_delta").alias("arm"), text.alias("text"))


def response_issues(spark: SparkSession, d: str) -> DataFrame:
    return response.schema_issues(answers(spark, d))


def response_lint(spark: SparkSession, d: str) -> DataFrame:
    return response.lint(answers(spark, d))


QUERIES = {"response_issues": response_issues, "response_lint": response_lint}

BASE = f"""{LINES}, w AS (SELECT o_orderkey AS o FROM orders WHERE o_orderkey IN (SELECT o FROM li)), good AS (SELECT o FROM w WHERE o % 29 <> 0 AND o % 37 <> 0),
a AS (SELECT o, n, q, '/observed_board_actions/' || (row_number() OVER (PARTITION BY o ORDER BY n) - 1) AS ptr, CASE WHEN q = 7 THEN 0 WHEN q <> 8 THEN n END AS seq FROM li WHERE o IN (FROM good)),
s AS (SELECT o, ptr, seq, lag(seq, 1, 0) OVER (PARTITION BY o ORDER BY n) AS b FROM a WHERE seq IS NOT NULL)"""
SQL = {
    "response_issues": f"""WITH {BASE}
SELECT o AS id, '' AS pointer, 'json.invalid' AS code FROM w WHERE o NOT IN (FROM good) UNION ALL SELECT o, '/schema_version', 'value' FROM good WHERE o % 23 = 0
UNION ALL SELECT o, '/generalized_teaching_capability/action_program', 'empty' FROM good WHERE o % 17 = 0 UNION ALL SELECT o, '/evidence_claims/0/claim', 'blank' FROM good WHERE o % 13 = 0 UNION ALL SELECT o, '/evidence_claims/0/evidence_slot', 'value' FROM good WHERE o % 4 = 0
UNION ALL SELECT o, '/uncertainties/0', 'blank' FROM good WHERE o % 19 = 0 UNION ALL SELECT o, '/uncertainties/1', 'type' FROM good WHERE o % 19 = 0
UNION ALL SELECT o, ptr || '/sequence_index', 'type' FROM a WHERE q = 8 UNION ALL SELECT o, ptr || '/operation', 'value' FROM a WHERE q = 9 UNION ALL SELECT o, ptr || '/content', 'type' FROM a WHERE q = 10 UNION ALL SELECT o, ptr || '/no~1te', 'key.unknown' FROM a WHERE q = 11
UNION ALL SELECT o, ptr, 'key.missing:region' FROM a WHERE q = 12 UNION ALL SELECT o, ptr || '/sequence_index', 'order' FROM s WHERE seq <= b""",
    "response_lint": f"""WITH {BASE}
SELECT o AS id, ptr || '/content' AS pointer, unnest(['lint.learner', 'lint.outcome']) AS code FROM a WHERE q = 13 UNION ALL SELECT o, '/uncertainties/2', 'lint.uncertainty' FROM good WHERE o % 19 = 0""",
}
