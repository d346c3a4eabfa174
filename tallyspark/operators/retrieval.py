"""Lexical retrieval, text guards and scans."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from tallyspark.functions.text import search_tokens
from tallyspark.operators import matching
from tallyspark.sources.tables import materialise


@pandas_udf(T.ArrayType(T.StringType()))
def cut(text: pd.Series, n: pd.Series) -> pd.Series:
    """Distinct pieces of n characters (by position this is linear, where substrings of a column are not)."""
    return pd.Series([list({t[i : i + k] for i in range(len(t) - k + 1)}) for t, k in zip(text, n, strict=True)])


#: Distinct heads of needles up to this many are broadcast (some 50 MB); beyond it the join shuffles.
BROADCAST_HEADS = 500_000


def substring_pairs(hays: DataFrame, needles: DataFrame, gram: int = 12) -> DataFrame:
    """Distinct (hay_id, needle_id) where a needle (needle_id, needle) lies inside a hay (hay_id, hay); empty needles do not count.

    Needles that are few enough go to every task, which looks for all of them at once (``matching``). Beyond that they are joined:
    they are keyed by their first ``gram`` (or all their) characters. Hays are cut into the pieces of the lengths that occur; pieces
    that begin some needle give candidate pairs of ids, an equality join without the texts. Then texts meet their candidates and whole
    needles are compared."""
    needles = needles.where("needle <> ''")
    if matching.fits(needles):
        return matching.match_all(hays, needles, gram).distinct()
    return joined_pairs(hays, needles, gram)


def joined_pairs(hays: DataFrame, needles: DataFrame, gram: int = 12) -> DataFrame:
    """``substring_pairs`` for needles of any number: equality joins on their heads."""
    needles = needles.withColumn("n", F.least(F.length("needle"), F.lit(gram))).withColumn("head", F.left("needle", F.col("n")))
    heads = needles.select("n", "head").distinct()
    found = heads.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()  # at most ``gram`` rows
    hays = hays.where("hay is not null")
    pieces = hays.select("hay_id", "hay", F.explode(F.array(*(F.lit(r["n"]) for r in found)) if found else F.array().cast("array<int>")).alias("n"))
    pieces = pieces.where(F.length("hay") >= F.col("n")).select("hay_id", "n", F.explode(cut("hay", "n")).alias("head"))
    if sum(r["c"] for r in found) <= BROADCAST_HEADS:
        heads = F.broadcast(heads)
    pairs = pieces.join(heads, ["n", "head"], "left_semi").join(needles.select("n", "head", "needle_id", "needle"), ["n", "head"]).select("hay_id", "needle_id", "needle")
    return pairs.join(hays, "hay_id").where(F.contains("hay", "needle")).select("hay_id", "needle_id").distinct()


#: Records of one token that one task takes.
RECORDS_A_TASK = 100_000
#: Records of a token, at most about, that are scored to learn what a question's best ones reach at least.
TRIALS = 64


def rank(questions: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """The k best records of each question: question_id, record_id, score, place.

    questions: question_id, question; records: record_id, title, body, phrases (array), modalities (count). The score is
    three points a title token, one a body token, their sum over the question's tokens, two where a phrase and the
    question contain each other (blanks apart), and 0.08 a modality; ties go to the smaller id.

    First some records of a question's two rarest tokens, and the k best by modalities alone, are scored; the k-th best of them is a
    floor. A record that has none of a question's tokens but the most frequent ones can reach no more than those are worth: where that
    lies below the floor, these tokens call up no candidates. So common words are joined only for questions that have nothing rarer,
    and their records are dealt to several tasks. Records with a matching phrase are candidates in any case. All candidates are scored
    in full; of each block of a question's candidates k stay before the last comparison.

    Records of equal contents have equal scores, so one of them, that with the smallest id, stands for all: the k best contents by score
    and smallest id hold the k best records. Their k smallest ids take part in the last comparison, and no more of them can have a place.
    The two tables that many steps read, distinct contents and questions, are written once."""
    k = max(1, k)
    contents = ["title", "body", "phrases", "modalities"]
    alike = records.where("record_id is not null").select("record_id", *contents)
    alike = alike.withColumn("_nth", F.row_number().over(Window.partitionBy(*contents).orderBy("record_id"))).where(F.col("_nth") <= k)
    alike = alike.groupBy(*contents).agg(F.array_sort(F.collect_list("record_id")).alias("ids"))
    records = materialise(alike.withColumn("record_id", F.col("ids")[0]), "rank-contents")
    questions = materialise(questions.select("question_id", "question"), "rank-questions")
    compact = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    q = questions.select("question_id", search_tokens(F.col("question")).alias("tokens"), compact(F.col("question")).alias("asked")).withColumn("n_tokens", F.greatest(F.size("tokens"), F.lit(1)))
    r = records.select("record_id", search_tokens(F.col("title")).alias("title"), search_tokens(F.col("body")).alias("body"), "modalities", "ids")
    posted = r.select("record_id", F.explode(F.array_union("title", "body")).alias("token"))
    often = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    phrases = records.select("record_id", F.explode("phrases").alias("p")).select("record_id", compact(F.col("p")).alias("p")).where("p <> ''").distinct()
    inside = substring_pairs(q.select(F.col("question_id").alias("hay_id"), F.col("asked").alias("hay")), phrases.select(F.col("record_id").alias("needle_id"), F.col("p").alias("needle")))
    around = substring_pairs(phrases.select(F.col("record_id").alias("hay_id"), F.col("p").alias("hay")), q.select(F.col("question_id").alias("needle_id"), F.col("asked").alias("needle")))
    boosts = inside.select(F.col("hay_id").alias("question_id"), F.col("needle_id").alias("record_id")).unionByName(around.select(F.col("needle_id").alias("question_id"), F.col("hay_id").alias("record_id"))).distinct()
    spare = F.broadcast(records.orderBy(F.desc("modalities"), "record_id").limit(k).select("record_id"))  # at most k rows
    least = q.select("question_id").join(spare)

    def scored(pairs: DataFrame, *keep: str) -> DataFrame:
        both = pairs.join(q, "question_id").join(r, "record_id")
        title, body = F.size(F.array_intersect("tokens", "title")), F.size(F.array_intersect("tokens", "body"))
        score = 3.0 * title + body + (title + body) / F.col("n_tokens") + F.when(F.col("boost"), 2.0).otherwise(0.0) + 0.08 * F.col("modalities")
        return both.select("question_id", "record_id", F.round(score, 9).alias("raw"), *keep)

    def best(rows: DataFrame) -> DataFrame:
        order = [F.desc("raw"), F.col("record_id")]
        block = F.pmod(F.xxhash64("record_id"), F.lit(64))
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("question_id", block).orderBy(*order))).where(F.col("place") <= k)
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("place") <= k)

    rising = Window.partitionBy("question_id").orderBy("df", "token")
    asked = q.select("question_id", "n_tokens", F.explode("tokens").alias("token")).join(often, "token").withColumn("nth", F.row_number().over(rising))
    few = often.where(F.col("df") > TRIALS)
    sample = posted.join(few, "token", "left").where(F.col("df").isNull() | (F.pmod(F.xxhash64("record_id", "token"), F.expr(f"df div {TRIALS} + 1")) == 0)).select("record_id", "token")
    trials = asked.where("nth <= 2").select("question_id", "token").join(sample, "token").select("question_id", "record_id").unionByName(least).distinct()
    floor = best(scored(trials.withColumn("boost", F.lit(False)))).where(F.col("place") == k).select("question_id", F.col("raw").alias("floor"))

    # What the tokens from one on, the frequent ones last, can add up to, in titles and bodies, with all modalities.
    top = r.agg(F.coalesce(F.max("modalities"), F.lit(0)).alias("top"))
    rest = F.sum(F.lit(4.0) + 2.0 / F.col("n_tokens")).over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    asked = asked.withColumn("rest", rest).join(floor, "question_id", "left").join(F.broadcast(top))
    needed = asked.where(F.col("floor").isNull() | (F.col("rest") + 0.08 * F.col("top") >= F.col("floor") - 1e-6)).select("question_id", "token", "df")
    hot = F.broadcast(often.where(F.col("df") > RECORDS_A_TASK).select("token", F.expr(f"df div {RECORDS_A_TASK}").alias("more")))  # one of every RECORDS_A_TASK postings at most
    spread = posted.join(hot, "token", "left").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.coalesce(F.col("more"), F.lit(0)) + 1)).select("token", "salt", "record_id")
    needed = needed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("df") > RECORDS_A_TASK, F.expr(f"df div {RECORDS_A_TASK}")).otherwise(0))))
    hits = needed.join(spread, ["token", "salt"]).select("question_id", "record_id")
    pairs = hits.unionByName(least).withColumn("boost", F.lit(False)).unionByName(boosts.withColumn("boost", F.lit(True)))
    pairs = pairs.groupBy("question_id", "record_id").agg(F.bool_or("boost").alias("boost"))
    copies = best(scored(pairs, "ids")).select("question_id", "raw", F.explode("ids").alias("record_id"))  # k contents of k ids at most
    order = Window.partitionBy("question_id").orderBy(F.desc("raw"), "record_id")
    placed = copies.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed.select("question_id", "record_id", F.round("raw", 4).alias("score"), "place")


#: Texts of a batch that are made Python's at a time.
FEW = 256
#: Characters that do not count besides white space, zero-width ones first.
UNSEEN = ("\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "_", ".", ":", "/", "-")


def leak_form(t: str | None) -> str | None:
    if t is None:
        return None
    t = "".join((t if t.isascii() else unicodedata.normalize("NFKC", t)).split())
    for c in UNSEEN:
        t = t.replace(c, "")
    return t.lower()


@arrow_udf(T.StringType())
def leak_normal(text: pa.Array) -> pa.Array:
    """Compatibility form, lower case, without blanks, zero-width characters and _ . : / -

    Few texts of a batch are Python's at a time."""
    parts = [pa.array([leak_form(t) for t in text.slice(i, FEW).to_pylist()], pa.string()) for i in range(0, len(text), FEW)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def leaks(public: DataFrame, private: DataFrame, text: str, value: str, least: int = 4) -> DataFrame:
    """Distinct (public_id, private_id) where a normalised private value of ``least`` characters or more lies inside a normalised public text."""
    hays = public.select(F.col("public_id").alias("hay_id"), F.col(text).alias("hay"))
    needles = private.select(F.col("private_id").alias("needle_id"), leak_normal(value).alias("needle")).where((F.length("needle") >= least) & (F.col("needle") != ""))
    if matching.fits(needles):  # texts are normalised where they are matched: one Python worker a task
        found = matching.match_all(hays, needles, 12, leak_form).distinct()
    else:
        found = joined_pairs(hays.withColumn("hay", leak_normal("hay")), needles)
    return found.select(F.col("hay_id").alias("public_id"), F.col("needle_id").alias("private_id"))


# Words of the guard against asserted learner outcomes.
ZH_SUBJECT = r"(?:学生|学员|同学|孩子|儿童|班级|全班|大家)"
ZH_OUTCOME = r"(?:听懂|理解|明白|掌握|熟悉|学会|会做|作答|答对|做对|解出|解答|算出|独立完成|正确完成|顺利完成|不再犯错|进步|提高|提升|改善|下降|正确率|错误率|成绩|学习效果|学习增益|教学效果|(?:均|都|已经|已|现在|目前)*\s*(?:能|会|能够|可以)(?:\s*(?:了|独立|正确|顺利|完成|解出|解答|做对|答对))*)"
ZH_PREFIX = r"(?:引导|指导|帮助|协助|使|让|鼓励|支持|训练|要求|提示|请|询问|安排|邀请|以便|为了|旨在|希望|期望|预期|若|如果|假如)\s*$"
ZH_MODAL = r"(?:将|应该|应当|可能|或许|预计|预期|需要|需|尝试|练习)"
ZH_NAMED = r"(?:^|[，。；：,:;\s])(?!(?:老师|教师|教员))[⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-龎𠀀-𲎯]{2,4}(?:已经|已|正在|独立|正确|顺利)*\s*(?:作答|答对|做对)"
ZH_CLAUSE = r"(?:[，,；;。.!?！？]|但是|然而|随后|后来|最后|最终|但|却)"
EN_SUBJECT = r"\b(?:students?|learners?|pupils?|the\s+class|class)\b"
EN_OUTCOME = r"\b(?:understand|understood|master(?:ed|y)?|learned|familiar|improv\w*|performed\s+better|solv(?:e|es|ed|ing)|can\s+(?:now\s+)?solve|(?:is|are|was|were)\s+able\s+to|complet(?:e|es|ed|ing)|answer(?:ed)?\s+correctly|responded\s+correctly|got\s+(?:it|the\s+(?:answer|problem))\s+right|fewer\s+errors|reduced\s+errors|accuracy|scores?|learning\s+(?:outcome|gain)|teaching\s+effect)\b"
EN_PREFIX = r"\b(?:help|enable|allow|guide|encourage|support|teach|ask|prompt|train|require|instruct|invite|have|expect|hope|if|when|unless|let)\s+(?:the\s+)?$"
EN_MODAL = r"\b(?:should|would|could|may|might|will|expected|asked|need|needs|practice)\b"
EN_CLAUSE = r"(?:[,;.!?]|\b(?:but|however|then|later|afterwards|eventually)\b)"


class OutcomeGuard:
    """Finds a subject followed, within a reach, by an outcome that is neither asked for nor hypothetical."""

    def __init__(self, subject: str, outcome: str, prefix: str, modal: str, clause: str, before: int, after: int):
        flags = re.IGNORECASE
        self.subject, self.outcome, self.prefix, self.modal, self.clause = (re.compile(p, flags) for p in (subject, outcome, prefix, modal, clause))
        self.before, self.after = before, after

    def asserted(self, text: str) -> bool:
        for m in self.subject.finditer(text):
            reach = text[m.end() : m.end() + self.after]
            found = self.outcome.search(reach)
            if not found:
                continue
            clauses = self.clause.split(reach[: found.start()])
            wished = len(clauses) == 1 and self.prefix.search(text[max(0, m.start() - self.before) : m.start()])
            if not wished and not self.modal.search(clauses[-1]):
                return True
        return False


ZH = OutcomeGuard(ZH_SUBJECT, ZH_OUTCOME, ZH_PREFIX, ZH_MODAL, ZH_CLAUSE, 16, 48)
EN = OutcomeGuard(EN_SUBJECT, EN_OUTCOME, EN_PREFIX, EN_MODAL, EN_CLAUSE, 32, 80)
NAMED = re.compile(ZH_NAMED)
#: What every text that asserts an outcome has, as a pattern of SQL.
MAY_ASSERT = f"(?iu){ZH_SUBJECT}|{EN_SUBJECT}|作答|答对|做对"


def asserts_outcome(text: str) -> bool:
    return ZH.asserted(text) or bool(NAMED.search(text) and not ZH.prefix.search(text[:16])) or EN.asserted(text)


@pandas_udf(T.BooleanType())
def fabricated_outcome(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a text asserts that learners achieved something; null for null."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else asserts_outcome(t)).astype("object")


def outcome_flags(rows: DataFrame, text: str, flag: str) -> DataFrame:
    """``rows`` with ``fabricated_outcome`` of a text as ``flag``. Only texts that name a subject, or an answer given, are looked at in Python."""
    may = F.col(text).rlike(MAY_ASSERT)
    return rows.where(may).withColumn(flag, fabricated_outcome(text)).unionByName(rows.where(F.coalesce(~may, F.lit(True))).withColumn(flag, F.when(F.col(text).isNotNull(), F.lit(False))))


def support(rows: DataFrame, lesson: str, order: str, text: str, patterns: dict[str, str], a_lesson: int = 3, least: int = 2) -> DataFrame:
    """(key, support, hits, confidence) of patterns: at most ``a_lesson`` first hits a lesson; kept with ``least`` lessons or more."""
    found = F.explode(F.filter(F.array(*(F.when(F.col(text).rlike(p), F.lit(k)) for k, p in patterns.items())), lambda k: k.isNotNull())).alias("key")
    hits = rows.select(lesson, order, found)
    hits = hits.withColumn("_n", F.row_number().over(Window.partitionBy("key", lesson).orderBy(order))).where(F.col("_n") <= a_lesson)
    out = hits.groupBy("key").agg(F.count_distinct(lesson).alias("support"), F.count(F.lit(1)).alias("hits"))
    return out.where(F.col("support") >= least).withColumn("confidence", F.round(F.least(0.25 + F.col("support") * 0.05, F.lit(0.5)), 9))


def judge(scores: DataFrame, key: Sequence[str], axis: str, a: str, b: str, margin: float = 0.25) -> DataFrame:
    """Mean of clamped axis scores (0 to 10, one digit; what is no number counts 0) of two answers, and the winner beyond ``margin``."""
    tenths = lambda c: F.coalesce(F.round(F.least(F.greatest(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(10.0)) * 10).cast("long"), F.lit(0))
    # Hundredths, halves up, in whole numbers.
    out = scores.groupBy(*key).agg(F.count_distinct(axis).alias("axes"), F.count(F.lit(1)).alias("n"), F.sum(tenths(a)).alias("a"), F.sum(tenths(b)).alias("b"))
    out = out.withColumns({c: F.expr(f"(20 * {c} + n) div (2 * n)") for c in ("a", "b")})
    gap = F.col("a") - F.col("b")
    winner = F.when(F.abs(gap) < round(margin * 100), "tie").when(gap > 0, "A").otherwise("B")
    return out.select(*key, "axes", (F.col("a") / 100).alias("mean_a"), (F.col("b") / 100).alias("mean_b"), winner.alias("winner"))


def contains_text(query: str, *columns: str) -> Column:
    """Case-insensitive substring search over several columns."""
    return F.contains(F.lower(F.concat_ws("\n", *columns)), F.lit(query.lower()))
