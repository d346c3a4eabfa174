"""Model answers against a schema that is given as rows, and warnings that never filter.

An answer is parsed into a variant and walked level by level in the engine: each node is a row with its JSON pointer and the
pattern that the schema knows it by, so shapes that nobody foresaw are rows like others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.retrieval import MAY_ASSERT, fabricated_outcome

SAFE = 9_007_199_254_740_991


@dataclass(frozen=True)
class Node:
    """What may stand at a pattern: a JSON pointer whose list items are ``*``.

    kinds: of OBJECT, ARRAY, STRING, BIGINT, VOID (null); keys: exactly those of an object; values: of a text; arms: values by arm, where they differ;
    filled: texts are not blank, lists not empty; rising: whole numbers that begin above 0 and grow through the answer."""

    pattern: str
    kinds: tuple[str, ...]
    keys: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    arms: tuple[tuple[str, tuple[str, ...]], ...] = ()
    filled: bool = False
    rising: bool = False


# The answer's schema.
ACTION, CAPABILITY, CLAIM = "/observed_board_actions", "/generalized_teaching_capability", "/evidence_claims"
RESPONSE = (
    Node("", ("OBJECT",), keys=("schema_version", "observed_board_actions", "generalized_teaching_capability", "evidence_claims", "uncertainties")),
    Node("/schema_version", ("STRING",), values=("teacher-evidence-response-v1",)),
    Node(ACTION, ("ARRAY",)),
    Node(f"{ACTION}/*", ("OBJECT",), keys=("sequence_index", "operation", "content", "region")),
    Node(f"{ACTION}/*/sequence_index", ("BIGINT",), rising=True),
    Node(f"{ACTION}/*/operation", ("STRING",), values=("add", "erase", "modify", "connect", "unknown")),
    Node(f"{ACTION}/*/content", ("STRING", "VOID")),
    Node(f"{ACTION}/*/region", ("STRING", "VOID")),
    Node(CAPABILITY, ("OBJECT",), keys=("name", "mechanism", "action_program")),
    Node(f"{CAPABILITY}/name", ("STRING",), filled=True),
    Node(f"{CAPABILITY}/mechanism", ("STRING",), filled=True),
    Node(f"{CAPABILITY}/action_program", ("ARRAY",), filled=True),
    Node(f"{CAPABILITY}/action_program/*", ("STRING",), filled=True),
    Node(CLAIM, ("ARRAY",)),
    Node(f"{CLAIM}/*", ("OBJECT",), keys=("claim", "evidence_slot")),
    Node(f"{CLAIM}/*/claim", ("STRING",), filled=True),
    Node(f"{CLAIM}/*/evidence_slot", ("STRING",), values=("transcript", "visual-1", "uncertain"), arms=(("transcript_only", ("transcript", "uncertain")),)),
    Node("/uncertainties", ("ARRAY",)),
    Node("/uncertainties/*", ("STRING",), filled=True),
)
# Words of the warnings.
LEARNER = r"(?i)(?:学生|学员|同学们?|孩子|儿童|班级|全班|大家|人人|\b(?:students?|learners?|pupils?|the\s+class|class)\b)"
PRONOUN = r"(?i)(?:他们|她们|其|人人|大家|\b(?:they|them|their|theirs)\b)"
BOUNDARY = r"(?i)(?:[，,；;。.!?！？]|但是|然而|随后|后来|最后|最终|但|却|\b(?:but|however|then|later|afterwards|eventually)\b)"
UNSURE = r"(?i)(?:未知|不确定|未观察|没有观察|未见|无法判断|不能判断|无法确定|不能确定|待验证|待确认|证据不足|不可判定|\bunknown\b|\buncertain\b|not\s+observed|not\s+visible|cannot\s+determine|can't\s+determine|unable\s+to\s+determine|insufficient\s+evidence|not\s+enough\s+evidence|to\s+be\s+verified|requires?\s+verification)"
SHOWN = (f"{ACTION}/*/content", f"{ACTION}/*/region", f"{CLAIM}/*/claim")
TAUGHT = (f"{CAPABILITY}/name", f"{CAPABILITY}/mechanism", f"{CAPABILITY}/action_program/*")


def parsed(answers: DataFrame) -> DataFrame:
    """``answers`` with value: the one JSON value of text as a variant; null for what is no JSON, repeats a key, nests too deep or goes on after the value.

    Each step is a column of its own, so that a text is parsed once."""
    inside = answers.withColumn("_in", F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))))
    one = F.try_variant_get("_in", "$[1]", "variant").isNull() & ~F.col("text").startswith("﻿")
    return inside.withColumn("value", F.when(one, F.try_variant_get("_in", "$[0]", "variant"))).drop("_in")


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY or the type of a scalar. ``schema_of_variant`` reads all that lies below a node, so only scalars and empty lists are asked for it."""
    scalar = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    opened = lambda at, kind: F.try_variant_get(value, at, kind).isNotNull()
    return F.when(opened("$[0]", "variant"), "ARRAY").when(opened("$", "map<string,variant>"), "OBJECT").otherwise(scalar)


def nodes(answers: DataFrame, known: Sequence[str], more: bool = False) -> DataFrame:
    """(id, arm, pattern, above, pointer, kind, value) of the nodes of ``answers`` (id, arm, text) that stand at ``known`` patterns or above them.

    ``more``: also what else lies directly below such a node. A text that is no JSON is one node without kind. The texts are parsed once and
    walked in one pass: at each level a node that goes on is taken twice, as itself and to be opened, all others once."""
    c = F.col
    ways = sorted({"/".join(steps[:i]) for steps in (p.split("/") for p in known) for i in range(1, len(steps) + 1)})
    deep = lambda n: [w for w in ways if w.count("/") == n]
    kind = kind_of(c("value"))
    key = F.replace(F.replace(c("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    tvf = answers.sparkSession.tvf
    rows = parsed(answers).select("id", "arm", F.lit("").alias("pattern"), F.lit(None).cast("string").alias("above"), F.lit("").alias("pointer"), "value").withColumn("kind", kind)
    for depth in range(max(w.count("/") for w in ways) + more):
        below = deep(depth + 1)
        goes_on = c("kind").isin("OBJECT", "ARRAY") & c("pattern").isin(*(w for w in deep(depth) if more or any(v.startswith(f"{w}/") for v in below)))
        twice = rows.withColumn("_open", F.explode(F.when(goes_on, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        twice = twice.withColumns({"_v": F.when(c("_open"), c("value")), "_self": F.when(~c("_open"), c("value"))}).drop("value")
        each = twice.lateralJoin(tvf.variant_explode_outer(c("_v").outer())).where(~c("_open") | c("value").isNotNull())
        step, at = F.when(c("key").isNull(), "*").otherwise(key), F.when(c("key").isNull(), c("pos").cast("string")).otherwise(key)
        child = lambda name, x: F.when(c("_open"), x).otherwise(c(name)).alias(name)
        rows = each.select("id", "arm", child("pattern", F.concat_ws("/", "pattern", step)), child("above", c("pattern")), child("pointer", F.concat_ws("/", "pointer", at)), F.coalesce("_self", "value").alias("value"), F.when(~c("_open"), c("kind")).alias("_kind"))
        if not more:
            rows = rows.where(c("pattern").isin(*ways))
        rows = rows.withColumn("kind", F.coalesce("_kind", kind)).drop("_kind")
    return rows


def schema_issues(answers: DataFrame, schema: Sequence[Node] = RESPONSE) -> DataFrame:
    """(id, pointer, code) where an answer (id, arm, text) is not as ``schema`` says; one that is has no row.

    json.invalid stands alone: a text that is null, no JSON, or has more behind its value, a key twice or a byte order mark. key.missing is said of the
    object, key.unknown of the key; nothing is said of what stands below a node of the wrong kind or an unknown key. The schema is a few rows that all
    tasks get; one walk gives all codes but those of the numbers that must rise, which take a walk to them alone and meet by answer."""
    spark = answers.sparkSession
    known = F.broadcast(spark.createDataFrame([(n.pattern, list(n.kinds), list(n.values), {k: list(v) for k, v in n.arms}, n.filled, n.rising, list(n.keys)) for n in schema], "pattern string, kinds array<string>, texts array<string>, arms map<string,array<string>>, filled boolean, rising boolean, asked array<string>"))
    c = F.col
    number = F.when(c("kind") == "BIGINT", F.try_variant_get("value", "$", "long"))
    rows = nodes(answers, [n.pattern for n in schema], more=True).join(known, "pattern", "left")
    rows = rows.withColumn("_text", F.when(c("kind") == "STRING", F.try_variant_get("value", "$", "string"))).withColumn("_number", number)
    fits = F.array_contains("kinds", c("kind"))
    permitted = F.coalesce(F.try_element_at("arms", c("arm")), c("texts"))
    blank = F.regexp_replace("_text", r"[\s﻿]+", "") == ""
    empty = (c("kind") == "ARRAY") & F.try_variant_get("value", "$[0]", "variant").isNull()
    objects = [n.pattern for n in schema if n.keys]
    checks = {
        "json.invalid": (c("pattern") == "") & c("kind").isNull(),
        "type": ~fits,
        "number.unsafe": c("kinds").isNotNull() & (F.abs("_number") > SAFE),
        "value": fits & (F.size("texts") > 0) & ~F.array_contains(permitted, c("_text")),
        "blank": fits & c("filled") & blank,
        "empty": fits & c("filled") & empty,
        "key.unknown": c("kinds").isNull() & c("above").isin(*objects) & ~c("pattern").endswith("/*"),
    }
    lacks = F.when((c("kind") == "OBJECT") & (F.size("asked") > 0), F.array_except("asked", F.map_keys(F.try_variant_get("value", "$", "map<string,variant>"))))
    rows = rows.withColumn("_codes", F.array_remove(F.array(*(F.when(bad, F.lit(code)).otherwise(F.lit("")) for code, bad in checks.items())), "")).withColumn("_lacks", lacks)
    codes = F.when(F.size("_lacks") > 0, F.concat("_codes", F.transform("_lacks", lambda k: F.concat(F.lit("key.missing:"), k)))).otherwise(c("_codes"))
    order = Window.partitionBy("id", "pattern").orderBy(F.expr("CAST(split(pointer, '/')[2] AS INT)"), "pointer")
    rising = [n.pattern for n in schema if n.rising]
    found = rows.select("id", "pointer", F.explode(codes).alias("code"))
    if not rising:
        return found
    numbers = nodes(answers, rising).where(c("pattern").isin(*rising)).select("id", "pattern", "pointer", number.alias("n")).where("n IS NOT NULL").withColumn("_before", F.lag("n", 1, 0).over(order))
    return found.unionByName(numbers.where("n <= _before").select("id", "pointer", F.lit("order").alias("code")))


# Of these strings one is, in small letters, in all that LEARNER, PRONOUN or MAY_ASSERT finds. The last three are letters that a pattern may take for s or i.
HINTS = ("student", "learner", "pupil", "class", "the")
WIDE_HINTS = ("学生", "学员", "同学", "孩子", "儿童", "班级", "全班", "大家", "人人", "他们", "她们", "其", "作答", "答对", "做对", "ſ", "ı", "i̇")


def hinted(text: Column) -> Column:
    """Whether an answer may hold a text that gets a code; one with a backslash may. Plain searches, as patterns over whole answers cost more than
    parsing them, in one expression that works the answer out once."""
    among = lambda t, hints: reduce(Column.__or__, (F.contains(t, F.lit(h)) for h in hints))
    return F.exists(F.array(F.lower(text)), lambda t: among(t, ("\\", *HINTS)) | ((F.octet_length(t) > F.char_length(t)) & among(t, WIDE_HINTS)))


def said(text: Column) -> Column:
    """Whether a text has words without which no warning is given."""
    return text.rlike(LEARNER) | text.rlike(PRONOUN) | text.rlike(MAY_ASSERT)


def lint(answers: DataFrame) -> DataFrame:
    """(id, pointer, code) of texts that may claim what learners did: advice for readers, which filters nothing.

    lint.learner: what is shown or claimed names learners; lint.outcome: a text asserts that they achieved something; lint.uncertainty: in an
    uncertainty, a clause from the first that names learners on says nothing of not knowing.

    Only answers that may hold such a text are parsed: one without a backslash has its texts as they stand, between quotes, so words that
    are not in the answer are in none of them."""
    patterns = (*SHOWN, *TAUGHT, "/uncertainties/*")
    answers = answers.where(hinted(F.col("text")))
    texts = nodes(answers, patterns).where((F.col("kind") == "STRING") & F.col("pattern").isin(*patterns)).select("id", "pattern", "pointer", F.try_variant_get("value", "$", "string").alias("text"))
    named, shown = F.col("text").rlike(LEARNER) | F.col("text").rlike(PRONOUN), F.col("pattern").isin(*SHOWN)
    texts = texts.where(said(F.col("text")))  # no other text can get a code
    clauses = F.filter(F.split("text", BOUNDARY), lambda x: F.trim(x) != "")
    from_first = F.slice(clauses, F.greatest(F.array_position(F.transform(clauses, lambda x: x.rlike(LEARNER)), True), F.lit(1)), F.greatest(F.size(clauses), F.lit(1)))
    unmarked = F.exists(clauses, lambda x: x.rlike(LEARNER)) & F.exists(from_first, lambda x: ~x.rlike(UNSURE))
    codes = F.array_compact(F.array(F.when(shown & named, "lint.learner"), F.when(F.col("asserted") & (F.col("pattern") != "/uncertainties/*"), "lint.outcome"), F.when((F.col("pattern") == "/uncertainties/*") & unmarked, "lint.uncertainty")))
    return texts.withColumn("asserted", fabricated_outcome("text")).select("id", "pointer", F.explode(codes).alias("code"))
