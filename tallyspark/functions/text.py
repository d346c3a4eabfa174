"""Column functions on text, numbers, times, hashes and JSON."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(value: Column, fallback: str) -> Column:
    """Lower case, runs of other characters as one dash, no dash at the ends, 63 characters at most.

    Only what these come from is looked at: 66 characters that stay (in lower case the two beyond ASCII hold one that does) or runs of others, however long."""
    stays = r"A-Za-z0-9\x{130}\x{212A}"
    head = F.regexp_extract(F.coalesce(value, F.lit("")), rf"^(?:[{stays}]|[^{stays}]++){{0,66}}", 0)
    out = F.regexp_replace(F.lower(head), r"[^a-z0-9-]+", "-")
    out = F.regexp_replace(F.regexp_replace(out, r"-{2,}", "-"), r"^-|-$", "")
    return F.regexp_replace(F.left(F.when(out == "", fallback).otherwise(out), F.lit(63)), r"-$", "")


def stem(index: Column, id_: Column) -> Column:
    """Zero-padded index and the id's safe characters, 80 at most."""
    return F.concat(F.lpad(index.cast("string"), 3, "0"), F.lit("-"), F.left(F.regexp_replace(id_, r"[^A-Za-z0-9_-]+", "-"), F.lit(80)))


def safe_name(name: Column) -> Column:
    """A file name of letters, numbers and . _ - blank only."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._ -]+", "-")


def clock(seconds: Column) -> Column:
    """MM:SS; minutes grow past 99."""
    whole = F.floor(seconds).cast("long")
    return F.concat(_two(F.expr("1") * F.floor(whole / 60)), F.lit(":"), _two(whole % 60))


def _two(n: Column, width: int = 2) -> Column:
    text = n.cast("long").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def timecode(seconds: Column, mark: str = ".") -> Column:
    """HH:MM:SS and milliseconds after ``mark`` (a comma in subtitles); negative times are 0."""
    ms = F.greatest(F.floor(seconds * 1000 + 0.5), F.lit(0)).cast("long")
    part = lambda per, mod: F.floor(ms / per) % mod
    return F.concat(_two(F.floor(ms / 3_600_000)), F.lit(":"), _two(part(60_000, 60)), F.lit(":"), _two(part(1000, 60)), F.lit(mark), _two(ms % 1000, 3))


def parse_timecode(text: Column) -> Column:
    """Seconds of the first HH:MM:SS.mmm (or comma) in a text; 0 without one."""
    p = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"
    g = lambda i: F.regexp_extract(text, p, i)
    number = lambda c: F.coalesce(F.try_to_number(c, F.lit("99")).cast("double"), F.lit(0.0))
    thousandths = F.coalesce(F.try_to_number(F.rpad(g(4), 3, "0"), F.lit("999")).cast("double"), F.lit(0.0)) / 1000
    return F.when(F.coalesce(text.rlike(p), F.lit(False)), number(g(1)) * 3600 + number(g(2)) * 60 + number(g(3)) + thousandths).otherwise(0.0)


def auto_title(question: Column, width: int = 28) -> Column:
    """At most ``width`` characters of a text whose runs of white space are single blanks; what lies behind them is not looked at."""
    short = squeeze(F.regexp_extract(question, rf"^(?:\S|\s++){{0,{width + 3}}}", 0))
    return F.when(F.length(short) > width, F.concat(F.left(short, F.lit(width)), F.lit("…"))).otherwise(short)


def shorten(text: Column, width: int) -> Column:
    """At most ``width`` characters, the last an ellipsis where something is cut."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def js_number(n: Column) -> Column:
    """A number as JSON prints it in JavaScript: no fraction where it is whole; null where it is not finite."""
    x = n.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), F.lit("null")).when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def js_string(text: Column) -> Column:
    """A quoted JSON string, other than ASCII kept; null as null."""
    return F.when(text.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.struct(text.alias("t"))), r'^\{"t":|\}$', ""))


def canonical_object(**fields: Column) -> Column:
    """A JSON object of already printed values, keys in code point order."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))


def derived_id(prefix: str, content: Column, width: int) -> Column:
    """Prefix and the first characters of the content's SHA-256."""
    return F.concat(F.lit(prefix), F.left(F.sha2(content, 256), F.lit(width)))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex, from two nested digests."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), inner), 256)


def even_side(id_: Column, even: str, odd: str) -> Column:
    """Which of two sides an id falls on, by the parity of its digest's last digit."""
    return F.when(F.conv(F.right(F.sha2(id_, 256), F.lit(1)), 16, 10).cast("int") % 2 == 0, even).otherwise(odd)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def mulberry32(seed: int, draw: Column) -> Column:
    """The draw-th number (from 1) of the 32-bit generator, in [0, 1): its state has a closed form, so draws need no order."""
    m = 0xFFFFFFFF
    low = lambda c: c.bitwiseAND(m)
    shift = lambda c, n: F.shiftrightunsigned(c, n)

    def times(a: Column, b: Column) -> Column:  # 32-bit product from 16-bit halves: no overflow
        return low(low(shift(a, 16) * low(b)).bitwiseAND(0xFFFF) * 65536 + a.bitwiseAND(0xFFFF) * low(b))

    a = low(F.lit(seed & m).cast("long") + times(low(draw.cast("long")), F.lit(0x6D2B79F5).cast("long")))
    t = times(a.bitwiseXOR(shift(a, 15)), a.bitwiseOR(1))
    t = t.bitwiseXOR(low(t + times(t.bitwiseXOR(shift(t, 7)), t.bitwiseOR(61))))
    return t.bitwiseXOR(shift(t, 14)) / 4294967296.0


MARKUP = r"(?i)</?[a-z][^>]*>"


def has_markup(text: Column) -> Column:
    return text.rlike(MARKUP)


def safe_relative_uri(uri: Column, rounds: int = 16) -> Column:
    """Whether an address is a relative path below its base however often it is percent-decoded.

    Decoding goes on until nothing changes; what needs more than ``rounds``, or cannot be decoded, is refused.
    Plus signs stay (they are no blanks in paths)."""
    decode = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    plain = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), uri, lambda c, _: F.when(F.contains(c, F.lit("%")), decode(c)).otherwise(c))
    stable = F.when(F.contains(plain, F.lit("%")), decode(plain) == plain).otherwise(plain.isNotNull())
    parts_ok = ~F.exists(F.split(plain, "/"), lambda p: p.isin("", ".", ".."))
    whole = (uri != "") & (F.regexp_replace(uri, r"^[\s﻿]+|[\s﻿]+$", "") == uri) & ~uri.rlike(r"[\\\x00]")
    shape = ~plain.rlike(r"[\\\x00?#]") & ~plain.rlike(r"^[/~]") & ~plain.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    return F.coalesce(whole & stable & shape & parts_ok, F.lit(False))


def learning_check_parts(text: Column, marker: str) -> Column:
    """struct(prompt, criterion): a check split at its answer marker (a pattern); without one all is prompt."""
    source = F.trim(text)
    at = F.regexp_instr(source, F.lit(marker))
    found = F.regexp_substr(source, F.lit(marker))
    before = F.trim(F.regexp_replace(F.trim(F.left(source, at - 1)), r"[（(【\[\s—-]+$", ""))
    after = F.trim(F.substring(source, at + F.length(found), F.length(source)))
    return F.when(at > 0, F.struct(before.alias("prompt"), after.alias("criterion"))).otherwise(F.struct(source.alias("prompt"), F.lit("").alias("criterion")))


def masked_key(key: Column, head: int = 4, tail: int = 4) -> Column:
    """First and last characters of a secret; dots for a short one."""
    return F.when(F.length(key) <= head + tail, "••••").otherwise(F.concat(F.left(key, F.lit(head)), F.lit("…"), F.right(key, F.lit(tail))))


def setting(saved: Column, environment: Column, default: str) -> Column:
    """The saved value, else the environment's, else the default; blanks count as unset."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(some(saved), some(environment), F.lit(default))


def search_tokens(text: Column) -> Column:
    """Distinct tokens for lexical search: blanks removed first, then runs of two or more Latin characters, and
    the two- and three-character pieces of CJK runs (a run of one character is itself)."""
    squeezed = F.regexp_replace(F.lower(text), r"\s+", "")
    latin = F.regexp_extract_all(squeezed, F.lit(r"[a-z0-9][a-z0-9_-]+"), F.lit(0))
    runs = F.regexp_extract_all(squeezed, F.lit(r"[㐀-鿿]+"), F.lit(0))

    def pieces(run: Column, n: int) -> Column:
        return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    cjk = F.flatten(F.transform(runs, lambda r: F.concat(F.when(F.length(r) == 1, F.array(r)).otherwise(F.array().cast("array<string>")), pieces(r, 2), pieces(r, 3))))
    return F.array_distinct(F.concat(latin, cjk))


#: Words that name a renderer.
RENDERERS = r"(?i)\b(?:html|svg|canvas|renderer|ink)\b|渲染器|几何画板"


def renderer_words(value: Column) -> Column:
    """Whether a text names a renderer."""
    return value.rlike(RENDERERS)


def _no_constant(name: str):
    raise ValueError(name)


def first_object(text: str | None) -> str | None:
    """The JSON of a model's answer: the whole text without its fence if that is JSON, else the first place where an object stands; null without one.

    A value that nests too deep to be read is none, and ends the search: what stands inside it is no answer of its own."""
    if text is None:
        return None
    read = json.JSONDecoder(parse_constant=_no_constant)
    body = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text.strip(), flags=re.IGNORECASE))
    try:
        json.loads(body, parse_constant=_no_constant)
        return body
    except RecursionError:
        return None
    except ValueError:
        pass
    at = body.find("{")
    while at >= 0:
        try:
            return body[at : read.raw_decode(body, at)[1]]
        except RecursionError:
            return None
        except ValueError:
            at = body.find("{", at + 1)
    return None


@pandas_udf(T.StringType())
def loose_json(values: pd.Series) -> pd.Series:
    return values.map(first_object)


def number_text(x: float) -> str:
    """A number as JavaScript prints it: no fraction where there is none."""
    if isinstance(x, int) or (x.is_integer() and abs(x) < 1e21):
        return str(int(x))
    if 1e-6 <= abs(x) < 1e21:  # Python turns to exponents earlier
        return f"{Decimal(repr(x)):f}"
    return re.sub(r"e([+-])0*", r"e\1", repr(x))


def one_form(value) -> str:
    """Canonical JSON: keys in order of their UTF-16 units, no blanks, numbers as JavaScript prints them."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{one_form(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(one_form, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return number_text(value)
    return json.dumps(value, ensure_ascii=False)


@pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """Nested JSON in its one form; null for null, for what is no JSON, and for what nests too deep to be read."""

    def form(text: str | None) -> str | None:
        try:
            return None if text is None else one_form(json.loads(text, parse_constant=_no_constant))
        except (ValueError, RecursionError):
            return None

    return values.map(form)
