"""Quality rules by repetition coverage."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm.common import CONTINUATION, map_batches, text_bytes

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: An odd multiplier for hashes modulo 2**64.
ROLL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class RepetitionRules:
    """Shares of a text's word characters (code points in words) above which a text is rejected.

    ngram_limits: n words, 3 at least -> share inside n-grams that occurred before (each character once). What occurs first does
    not count, so a line that is said twice in a long text costs its own length once.
    line_limit: share inside lines that repeat an earlier line.
    symbol_limit: symbols ``#*$%&|<>`` a word; no part of the verdict unless given.
    min_words, repeat_percent: the base rule."""

    ngram_limits: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    line_limit: float = 0.15
    symbol_limit: float | None = None
    min_words: int = 50
    repeat_percent: int = 50

    def __post_init__(self):
        if any(n < 3 for n in self.ngram_limits):
            raise ValueError("n-gram limits begin at 3 words: single words and pairs repeat in any text")


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    return np.isin(keys, twice) if len(twice) else np.zeros(len(keys), bool)


def again(keys: np.ndarray) -> np.ndarray:
    """True where a key occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    return out


def covered(hits: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words that lie in a marked window of n words."""
    edge = np.zeros(size + 1, np.int64)
    at = np.flatnonzero(hits)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def trigram_keys(ids: np.ndarray) -> np.ndarray:
    """Exact keys of 3-word windows."""
    pair = ids[:-1] * (ids.max() + 1) + ids[1:]
    if ids.max() >= 1 << 20:  # three ids would not fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    return pair[:-1] * (ids.max() + 1) + ids[2:]


def measure(text: bytes | None, rules: RepetitionRules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, line_share, top_share, symbol_share)."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, CONTINUATION + BLANKS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += len(line.translate(None, CONTINUATION + BLANKS))
        elif not line.isspace() and line:
            seen.add(line)
    repeat_words, shares = 0, {}
    if n >= 3:
        ids = word_ids(words)
        hits = repeated(trigram_keys(ids))
        if hits.any():
            repeat_words = int(covered(hits, 3, n).sum())
            lengths = np.fromiter((len(w.translate(None, CONTINUATION)) for w in words), np.int64, n)
            value = (ids.astype(np.uint64) + np.uint64(1)) * ROLL
            value ^= value >> np.uint64(29)
            rolled, length = value.copy(), 1
            for want in sorted(rules.ngram_limits):
                while length < want and len(rolled) > 1:
                    rolled = rolled[:-1] * ROLL + value[length : length + len(rolled) - 1]
                    length += 1
                if length < want:
                    break
                hits = again(rolled)
                if not hits.any():  # longer n-grams repeat only where shorter ones do
                    break
                shares[want] = int(lengths[covered(hits, want, n)].sum()) / chars
    base_failed = n < rules.min_words or 100 * repeat_words > rules.repeat_percent * n
    line_share = dup_chars / chars if chars else 0.0
    symbol_share = symbols / n if n else 0.0
    good = line_share <= rules.line_limit and (rules.symbol_limit is None or symbol_share <= rules.symbol_limit) and all(s <= rules.ngram_limits[k] for k, s in shares.items())
    return n, chars, symbols, dup_lines, repeat_words, base_failed, good and not base_failed, line_share, max(shares.values(), default=0.0), symbol_share


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_share", "ngram_share", "symbol_share")
TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3


def score_repetition(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): its measures and ``kept``.

    A null or empty text has no words and fails the base rule. Repeated rows are measured each by
    itself; other columns are left out, so none can clash. No shuffle: rows do not meet.
    Repeats are found within a text: word ids are exact, 3-word windows have exact keys, and
    longer windows have 64-bit rolling hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(measure(t, rules) for t in batch.column("text").to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(rows, TYPES, strict=True))], ["doc_id", *COLUMNS]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        text_bytes(docs, "doc_id"),
        run,
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double, ngram_share double, symbol_share double",
    )


def keep_good(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text ``score_repetition`` keeps."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        return batch.filter(pa.array([measure(t, rules)[6] for t in texts], pa.bool_()))

    return map_batches(docs, run, docs.schema)
