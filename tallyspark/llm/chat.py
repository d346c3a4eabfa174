"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts: text, image, audio and document. A visitor flattens them, in order,
into escaped text and placeholders; attachments are recorded with their references and token counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A part: its kind, text (kind text), reference and extents (the other kinds).
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the strings that are escaped inside texts, and what attachments expand to.

    A control string in a text gets ``escape`` + "1" after its first character, and ``escape`` itself becomes
    ``escape`` + "0"; taking these away restores any text. Control strings have two characters or more and
    no ``escape``."""

    role: str = "<|role|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    control: tuple[str, ...] = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "~"
    patch: int = 28
    audio_tokens_a_second: float = 12.5
    document_tokens_a_page: int = 1024


DEFAULT = Template()


def escaped(text: Column, t: Template = DEFAULT) -> Column:
    text = F.replace(text, F.lit(t.escape), F.lit(t.escape + "0"))
    for c in t.control:
        text = F.replace(text, F.lit(c), F.lit(c[0] + t.escape + "1" + c[1:]))
    return text


def unescaped(text: Column, t: Template = DEFAULT) -> Column:
    text = F.replace(text, F.lit(t.escape + "1"), F.lit(""))
    return F.replace(text, F.lit(t.escape + "0"), F.lit(t.escape))


def expanded_tokens(part: Column, t: Template = DEFAULT) -> Column:
    """Tokens an attachment stands for: image patches, audio frames or pages; extents that are null or below 1 count as 1."""
    side = lambda x: F.ceil(F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)) / t.patch)
    return (
        F.when(part["kind"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * t.audio_tokens_a_second), F.lit(1)))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * t.document_tokens_a_page)
        .otherwise(0)
        .cast("long")
    )


def visited(part: Column, t: Template = DEFAULT) -> Column:
    """What a part writes: escaped text, or a placeholder with its kind; null and unknown parts write nothing."""
    mark = F.concat(F.lit("<|"), part["kind"], F.lit("|>"))
    return F.when(part["kind"] == "text", escaped(F.coalesce(part["text"], F.lit("")), t)).when(part["kind"].isin("image", "audio", "document"), mark).otherwise("")


def text_parts(text: Column) -> Column:
    """One text part; a null text is empty."""
    names = ("ref string", "width int", "height int", "seconds double", "pages int")
    rest = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in names]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *rest)).cast(PARTS)


def format_chats(turns: DataFrame, t: Template = DEFAULT, loss_role: str = "assistant") -> DataFrame:
    """One row for each conv_id of ``turns`` (conv_id, turn, role, parts): formatted, loss_spans, attachments, n_turns, expanded_tokens.

    Turns go by turn, then role and content, so repeated rows all stay and any input order gives the same
    text. A null role is empty; null parts are none; a null conv_id is a conversation of its own. Other columns
    are not read; an empty table gives no rows. loss_spans: (start, end) in code points of each text of
    ``loss_role``; attachments: (turn_no, kind, ref, start, tokens) in order of their placeholders.
    One shuffle, by conversation; offsets are running sums, so long conversations cost in proportion."""
    body = F.array_join(F.transform(F.filter("parts", lambda p: p.isNotNull()), lambda p: visited(p, t)), "")
    head = F.concat(F.lit(t.role), escaped(F.coalesce("role", F.lit("")), t), F.lit(t.text))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(PARTS)).alias("parts"))
    rows = rows.withColumn("body", body).withColumn("head", head)
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(t.end)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body", F.to_json("parts"))
    rows = (
        rows.withColumn("no", F.row_number().over(order))
        .withColumn("at", F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
        .withColumn("span", F.when(F.col("role") == loss_role, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))))
    )
    # Where each part begins within its body: lengths of those before it.
    lengths = F.transform("parts", lambda p: F.length(F.coalesce(visited(p, t), F.lit(""))))
    placed = F.transform(
        "parts",
        lambda p, i: F.struct(
            F.col("no").alias("turn_no"),
            p["kind"].alias("kind"),
            p["ref"].alias("ref"),
            (F.col("at") + F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0), lambda a, x: a + x)).alias("start"),
            expanded_tokens(p, t).alias("tokens"),
        ),
    )
    rows = rows.withColumn("lengths", lengths).withColumn("placed", F.filter(placed, lambda a: a["kind"].isin("image", "audio", "document")))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no", "piece", "span", "placed"))).alias("all"), F.count(F.lit(1)).alias("n_turns"))
    return whole.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("all", lambda r: r["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("all", lambda r: r["placed"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column, t: Template = DEFAULT) -> Column:
    """array<struct<role, text>> read back from a formatted conversation; placeholders stay as they are."""
    literal = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    pieces = F.filter(F.split(formatted, literal(t.end)), lambda p: p != "")
    inner = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(t.role) + 1)), literal(t.text)))
    return F.transform(inner, lambda x: F.struct(unescaped(F.get(x, F.lit(0)), t).alias("role"), unescaped(F.get(x, F.lit(1)), t).alias("text")))


def digest(chats: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from ``formatted`` and ``loss_spans``."""
    turns = read_turns(F.col("formatted"), t)
    told = F.array_join(F.transform(turns, lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), t)), "")
    return (
        chats.withColumn("turns", turns)
        .withColumn("lost", lost)
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: texts that look like another template's marks."""
    said = "</s>[INST] ok [/INST]"
    return spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
