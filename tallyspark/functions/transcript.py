"""Transcripts: two stored shapes as one, and their text, caption and index renderings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import parse_timecode, timecode

SEGMENTS = "array<struct<start:double,end:double,text:string>>"
#: The raw shape: times as codes and as milliseconds.
RAW = "array<struct<timestamps:struct<from:string,to:string>,offsets:struct<from:long,to:long>,text:string>>"


def segments(own: Column, raw: Column | None = None) -> Column:
    """Segments with trimmed texts, empty ones left out; those of the raw shape where there are no own ones."""
    out = own
    if raw is not None:

        def at(r: Column, end: str) -> Column:
            return F.coalesce(r["offsets"][end] / 1000, parse_timecode(r["timestamps"][end]))

        told = F.transform(raw, lambda r: F.struct(at(r, "from").alias("start"), at(r, "to").alias("end"), r["text"].alias("text")))
        out = F.coalesce(own, told)
    out = F.transform(out, lambda s: F.struct(s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end"), F.trim(F.coalesce(s["text"], F.lit(""))).alias("text")))
    return F.coalesce(F.filter(out, lambda s: s["text"] != ""), F.array().cast(SEGMENTS))


def duration(own: Column, parts: Column) -> Column:
    """The stated duration, else the last segment's end; null without either."""
    return F.coalesce(own, F.get(parts, F.size(parts) - 1)["end"])


def plain_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "\n")


def captions(parts: Column) -> Column:
    """Numbered captions: number, times with a comma, text, and a blank line between two."""
    one = F.transform(parts, lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), timecode(s["start"], ","), F.lit(" --> "), timecode(s["end"], ","), F.lit("\n"), s["text"]))
    return F.concat(F.array_join(one, "\n\n"), F.when(F.size(parts) > 0, "\n").otherwise(""))


def index_lines(parts: Column) -> Column:
    """A line a segment: index, times and text, parted by tabs."""
    return F.array_join(F.transform(parts, lambda s, i: F.concat_ws("\t", i.cast("string"), timecode(s["start"]), timecode(s["end"]), s["text"])), "\n")


def render_issues(rows: DataFrame, key: str, parts: str, text: str, caption: str) -> DataFrame:
    """(key, code) where a stored text or caption file is not what its segments give: text or captions."""
    codes = F.array_compact(F.array(F.when(~F.col(text).eqNullSafe(plain_text(F.col(parts))), "text"), F.when(~F.col(caption).eqNullSafe(captions(F.col(parts))), "captions")))
    return rows.select(key, F.explode(codes).alias("code"))


def cited_span(citations: DataFrame, transcripts: DataFrame, key: str, indexes: str, shift: str) -> DataFrame:
    """(key, citation columns, start, end, text): hull and joined text of the segments that each citation's indexes name, moved by ``shift`` seconds.

    citations (key, citation, indexes, shift), transcripts (key, segments). Indexes that name no segment add nothing."""
    named = citations.select(key, "citation", F.col(shift).alias("shift"), F.posexplode(indexes).alias("place", "at"))
    held = transcripts.select(key, F.posexplode("segments").alias("at", "segment"))
    found = named.join(held, [key, "at"])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "segment.text"))), lambda x: x["text"]), " ")
    return found.groupBy(key, "citation").agg((F.min("segment.start") + F.first("shift")).alias("start"), (F.max("segment.end") + F.first("shift")).alias("end"), texts.alias("text"))
