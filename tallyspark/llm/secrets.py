"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags each token as outside, begin or inside of a secret from the token's shape, its neighbours (their shapes,
words, beginnings and ends) and features of the whole file; the best tagging comes from Viterbi decoding. It learns from
windows around what the fixed patterns find (their values are the labels) and from windows without."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, map_batches, materialise

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as long runs of [0-9a-f]+: a run is taken whole
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[^\W_]+(?:[+/_.-]+[^\W_]+)*|[^\w\s]|_")
KEYWORDS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "private_key", "credential", "credentials", "auth", "bearer", "authorization")
O, B, I = range(3)  # noqa: E741
#: Whose features a token sees, by distance.
ROLES = {"self": 0, "prev": -1, "next": 1, "prev2": -2, "next2": 2, "prev3": -3}

Span = tuple[str, int, int, int, int]  # kind, start, end, start and end of the value


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those too short are dropped."""
    found: list[Span] = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def token_features(token: str) -> tuple[str, ...]:
    """What the field knows of a token. Words, and the first and last three letters of longer ones, are features of their own."""
    low = token.lower()
    if low in KEYWORDS:
        return ("word", f"key={low}", f"w={low}")
    if token.isalpha():
        size = len(low)
        if size > 24:
            return ("word", "long")
        return ("word", f"w={low}", f"p={low[:3]}", f"s={low[-3:]}") if size > 4 else ("word", f"w={low}")
    if len(token) == 1:
        return ("mark", f"is={token}" if token in "=:\"'`" else "other")
    kinds = "".join("d" if c.isdigit() else "U" if c.isupper() else "l" if c.isalpha() else "s" for c in token)
    switches = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    out = ["shape=" + "".join(sorted(set(kinds))), f"len={min(6, len(token).bit_length())}", f"switch={min(8, switches * 8 // len(token))}"]
    if kinds.strip("d") == "":
        out.append("digits")
    if all(c in "0123456789abcdef" for c in token):
        out.append("hex")
    if len(token) >= 8 and "s" not in kinds:
        out.append("solid8" if len(token) < 16 else "solid16" if len(token) < 32 else "solid32")
    return tuple(out)


def file_features(codes: np.ndarray, plain: np.ndarray, keyed: bool) -> tuple[str, ...]:
    share = 1.0 - plain.mean() if len(codes) else 0.0
    return (f"odd={min(5, int(share * 10))}", "keyed" if keyed else "unkeyed")


@dataclass
class Field:
    """weights: (role, feature) -> scores of O, B and I; role is one of ROLES or file. step: transition scores.

    What a token adds to each role is remembered while tokens are few; features without weights add nothing."""

    weights: dict[tuple[str, str], np.ndarray]
    step: np.ndarray
    most: int = 200_000

    def __post_init__(self):
        self.of_feature: dict[str, np.ndarray] = {}
        for (role, f), w in self.weights.items():
            if role != "file":
                self.of_feature.setdefault(f, np.zeros((len(ROLES), 3)))[list(ROLES).index(role)] = w
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.table, self.plain, self.keyed = np.zeros((1024, len(ROLES), 3)), np.zeros(1024, bool), np.zeros(1024, bool)

    def __reduce__(self):
        return Field, (self.weights, self.step)

    def code(self, token: str) -> int:
        c = self.cache[token] = len(self.cache)
        if c == len(self.table):
            self.table, self.plain, self.keyed = (np.concatenate((x, np.zeros_like(x))) for x in (self.table, self.plain, self.keyed))
        found = token_features(token)
        for f in found:
            if (w := self.of_feature.get(f)) is not None:
                self.table[c] += w
        self.plain[c], self.keyed[c] = found[0] == "word", found[0] == "word" and len(found) > 1 and found[1].startswith("key=")
        return c

    def emissions(self, tokens: list[str]) -> np.ndarray:
        if len(self.cache) > self.most:
            self.forget()
        get = self.cache.get
        codes = np.fromiter((c if (c := get(t)) is not None else self.code(t) for t in tokens), np.int64, len(tokens))
        out = self.table[codes, 0]
        for role, d in enumerate(list(ROLES.values())[1:], 1):
            if d < 0:
                out[-d:] += self.table[codes[:d], role]
            else:
                out[:-d] += self.table[codes[d:], role]
        for f in file_features(codes, self.plain[codes], bool(self.keyed[codes].any())):
            out += self.weights.get(("file", f), 0.0)
        return out

    def tags(self, tokens: list[str]) -> np.ndarray:
        """The best tagging. A token is outside in every best tagging where that leads by more than all
        transitions around it can make up; between such tokens the chain is decoded by Viterbi."""
        best = np.zeros(len(tokens), np.int8)
        if not tokens:
            return best
        score = self.emissions(tokens)
        open_ = np.flatnonzero(score[:, O] - score[:, 1:].max(1) <= 2 * (self.step.max() - self.step.min()) + 1e-9)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            if len(run):
                best[run] = viterbi(score[run], self.step, run[-1] + 1 < len(tokens))
        return best


def viterbi(score: np.ndarray, step: np.ndarray, closed: bool) -> np.ndarray:
    """The best tags of a run that follows an outside token (or the start) and, if closed, precedes one."""
    back, at = [], score[0] + step[O]
    for s in score[1:]:
        ways = at[:, None] + step
        back.append(ways.argmax(0))
        at = ways.max(0) + s
    tags = [int((at + step[:, O] if closed else at).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return np.array(tags[::-1], np.int8)


def crf_spans(text: str, model: Field, least: int = 8) -> list[Span]:
    """Spans of tokens tagged begin or inside; an inside after an outside begins a span as well.

    A secret has ``least`` characters or more, as the values of the fixed patterns have; shorter spans are none."""
    tokens = TOKEN.findall(text)
    tags = model.tags(tokens)
    hit = np.flatnonzero(tags)
    if not len(hit):
        return []
    wanted, places = set(hit.tolist()), {}
    for i, m in enumerate(TOKEN.finditer(text)):
        if i in wanted:
            places[i] = m.span()
    spans: list[list[int]] = []
    for i in hit.tolist():
        if spans and tags[i] == I and i - 1 in wanted:
            spans[-1][1] = places[i][1]
        else:
            spans.append(list(places[i]))
    return [("crf", a, b, a, b) for a, b in spans if b - a >= least]


def beside(spans: list[Span], base: list[Span], text: str) -> list[Span]:
    """The parts of ``spans`` outside ``base``, both by start, that hold a letter or digit: one pass over both."""
    out, i = [], 0
    for kind, a, b, *_ in spans:
        while i < len(base) and base[i][2] <= a:
            i += 1
        j = i
        while a < b:
            while j < len(base) and base[j][2] <= a:
                j += 1
            stop = min(b, base[j][1]) if j < len(base) else b
            if any(c.isalnum() for c in text[a:stop]):
                out.append((kind, a, stop, a, stop))
            a = max(a, base[j][2]) if j < len(base) else b
    return out


def joined(spans: list[Span]) -> list[Span]:
    """Spans by start, overlapping ones as one."""
    out: list[list] = []
    for kind, a, b, *_ in spans:
        if out and a < out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([kind, a, b, a, b])
    return [tuple(x) for x in out]


def find_spans(text: str | None, model: Field | None) -> list[Span]:
    """Base spans, and what the field's spans add to them; by start, then kind."""
    text = text or ""
    found = base_spans(text)
    if model is not None:
        found += beside(crf_spans(text, model), joined(found), text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def windows(labelled: DataFrame, documents: int = 20_000, keep: int = 2_000, reach: int = 240) -> list[str]:
    """At most ``keep`` windows of text, half around base spans and half away from them, from about
    ``documents`` rows chosen by a hash of their ids. Only this sample is bounded; scans cover every row.

    A window reaches ``reach`` characters, and on to the next blanks, but no further than twice that, before and behind a
    secret's first character (or, in a text without, a place given by the hash). Texts are read once."""
    rows = labelled.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h"))
    part = max(1, labelled.count() // documents)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, parts, keys = [], [], []
        for text, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True):
            found = base_spans(text)
            middle = found[h % len(found)][3] if found else (h % len(text) if text else 0)
            lo, hi = max(0, middle - reach), text.find(" ", middle + reach, middle + 2 * reach)
            if lo:
                lo = max(text.rfind(" ", 0, lo) + 1, middle - 2 * reach, 0)
            kinds.append(bool(found))
            parts.append(text[lo : hi if hi >= 0 else middle + 2 * reach])
            keys.append(h)
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(parts, pa.string()), pa.array(keys, pa.int64())], ["hit", "part", "h"])

    found = materialise(map_batches(rows.where(F.pmod("h", F.lit(part)) == 0), cut, "hit boolean, part string, h long"), "windows")
    out = [r.part for hit in (True, False) for r in found.where(F.col("hit") == hit).orderBy("h", "part").limit(keep // 2).collect()]
    discard(found)
    return out


@dataclass
class Sequences:
    """Tagged windows, their tokens one after another. names: (role, feature) of each weight, the features of ROLES in turn, then those of
    files. of: the number of each token's text; text, feature: which text has which feature; window, tag: of each token; files: which
    window has which file feature; groups: windows of about one length as rows of token numbers, filled up with ``len(tag)``."""

    names: list[tuple[str, str]]
    n_features: int
    of: np.ndarray
    text: np.ndarray
    feature: np.ndarray
    window: np.ndarray
    tag: np.ndarray
    files: tuple[np.ndarray, np.ndarray]
    groups: list[np.ndarray]
    n: int

    def near(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that have one at distance ``d`` in their window, and those."""
        at = np.arange(max(0, -d), len(self.tag) - max(0, d))
        at = at[self.window[at] == self.window[at + d]]
        return at, at + d

    def scores(self, w: np.ndarray) -> np.ndarray:
        """Scores of O, B and I of each token, and a row of zeros."""
        n, texts = len(self.tag), int(self.of.max()) + 1
        out = np.zeros((n + 1, 3))
        for r, d in enumerate(ROLES.values()):
            own = w[r * self.n_features : (r + 1) * self.n_features]
            of_text = np.stack([np.bincount(self.text, own[self.feature, c], texts) for c in range(3)], 1)
            at, other = self.near(d)
            out[at] += of_text[self.of[other]]
        file = w[len(ROLES) * self.n_features :]
        of_window = np.stack([np.bincount(self.files[0], file[self.files[1], c], self.n) for c in range(3)], 1)
        out[:n] += of_window[self.window]
        return out

    def gradient(self, d_e: np.ndarray) -> np.ndarray:
        """The gradient by the weights of one by the scores."""
        n, texts = len(self.tag), int(self.of.max()) + 1
        out = np.zeros((len(self.names), 3))
        for r, d in enumerate(ROLES.values()):
            at, other = self.near(d)
            for c in range(3):
                of_text = np.bincount(self.of[other], d_e[at, c], texts)
                out[r * self.n_features : (r + 1) * self.n_features, c] = np.bincount(self.feature, of_text[self.text], self.n_features)
        for c in range(3):
            of_window = np.bincount(self.window, d_e[:n, c], self.n)
            out[len(ROLES) * self.n_features :, c] = np.bincount(self.files[1], of_window[self.files[0]], len(self.names) - len(ROLES) * self.n_features)
        return out


#: Windows of about one length whose sums are made at once: a few MB.
TOGETHER = 64


def sequences(texts: list[str], seldom: int) -> Sequences:
    numbers: dict[str, int] = {}
    kinds: list[tuple[str, ...]] = []
    of, window, tag, by_size, file_of, often = [], [], [], {}, [], {}
    for body in texts:
        values = [(s[3], s[4]) for s in base_spans(body)]
        first, last, seen = len(tag), None, set()
        for m in TOKEN.finditer(body):
            inside = next((v for v in values if m.start() < v[1] and m.end() > v[0]), None)
            tag.append(O if inside is None else I if inside == last else B)
            last = inside
            if (i := numbers.setdefault(m.group(), len(numbers))) == len(kinds):
                kinds.append(token_features(m.group()))
            of.append(i)
            window.append(len(file_of))
            seen.update(kinds[i])
        if size := len(tag) - first:
            by_size.setdefault(max(16, 1 << (size - 1).bit_length()), []).append(range(first, len(tag)))
            plain = np.array([kinds[i][0] == "word" for i in of[first:]])
            file_of.append(file_features(plain, plain, any(f.startswith("key=") for f in seen)))
            for f in sorted(seen):
                often[f] = often.get(f, 0) + 1
    features = {f: i for i, f in enumerate(f for f in often if f[:2] not in ("w=", "p=", "s=") or often[f] >= seldom)}
    pairs = [(i, features[f]) for i, kind in enumerate(kinds) for f in kind if f in features]
    files = {f: i for i, f in enumerate(sorted({f for x in file_of for f in x}))}
    file_pairs = [(i, files[f]) for i, x in enumerate(file_of) for f in x]
    groups = []
    parts = [rows[a : a + TOGETHER] for rows in by_size.values() for a in range(0, len(rows), TOGETHER)]
    for rows in parts:
        group = np.full((len(rows), max(map(len, rows))), len(tag))
        for i, row in enumerate(rows):
            group[i, : len(row)] = row
        groups.append(group)
    array = lambda x: np.array(x, np.int64)
    columns = lambda x: tuple(array(x).reshape(-1, 2).T)
    names = [(role, f) for role in ROLES for f in features] + [("file", f) for f in files]
    return Sequences(names, len(features), array(of), *columns(pairs), array(window), array(tag), columns(file_pairs), groups, len(file_of))


def likelihood(s: Sequences, w: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the tags, and its gradients by ``w`` and ``step``, from forward and backward sums; a window follows an outside token."""
    n = len(s.tag)
    e = s.scores(w)
    gold = np.zeros((n + 1, 3))
    gold[np.arange(n), s.tag] = 1.0
    value, d_e, d_step, p_step = float((e * gold).sum()), gold, np.zeros((3, 3)), np.exp(step)
    for group in s.groups:
        real, pairs, t_max = group < n, group[:, 1:] < n, group.shape[1]
        own, top = gold[group], e[group].max(2)
        p = np.exp(e[group] - top[:, :, None])
        a, b, total = np.zeros_like(p), np.ones_like(p), np.ones((len(group), t_max))
        for t in range(t_max):  # filling repeats the last sums
            x = (p_step[O] if t == 0 else a[:, t - 1] @ p_step) * p[:, t]
            total[:, t] = np.where(real[:, t], x.sum(1), 1.0)
            a[:, t] = np.where(real[:, t, None], x / total[:, t, None], a[:, t - 1])
        for t in range(t_max - 2, -1, -1):
            x = (p[:, t + 1] * b[:, t + 1]) @ p_step.T
            b[:, t] = np.where(real[:, t + 1, None], x / x.sum(1, keepdims=True), 1.0)
        g = a * b
        g = g / g.sum(2, keepdims=True) * real[:, :, None]
        x = a[:, :-1, :, None] * p_step[None, None] * (p[:, 1:] * b[:, 1:])[:, :, None, :]
        x = x / x.sum((2, 3), keepdims=True) * pairs[:, :, None, None]
        seen = np.einsum("nta,ntb,nt->ab", own[:, :-1], own[:, 1:], pairs.astype(float))
        seen[O] += own[:, 0].sum(0)
        value += float((seen * step).sum() - np.log(total).sum() - top[real].sum())
        d_step += seen - x.sum((0, 1))
        d_step[O] -= g[:, 0].sum(0)
        d_e[group[real]] -= g[real]
    return value, s.gradient(d_e), d_step


def give_back() -> None:
    """Memory that the sums have freed goes back to the system, where the C library can tell: the driver runs on for long."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fit(texts: list[str], rounds: int = 120, rate: float = 0.15, ridge: float = 2e-4, seldom: int = 3) -> Field | None:
    """Maximises the penalised conditional likelihood of the windows' tags; None if no window has a secret.

    Whole windows count. A word, beginning or end is a feature if ``seldom`` windows or more have it."""
    s = sequences(texts, seldom)
    if not s.tag.any():
        return None
    w, step = np.zeros((len(s.names), 3)), np.zeros((3, 3))
    seen_w, seen_s = np.full(w.shape, 1e-8), np.full(step.shape, 1e-8)
    for _ in range(rounds):
        _, d_w, d_step = likelihood(s, w, step)
        d_w, d_step = d_w / s.n - ridge * w, d_step / s.n - ridge * step
        seen_w = 0.9 * seen_w + 0.1 * d_w**2
        seen_s = 0.9 * seen_s + 0.1 * d_step**2
        w += rate * d_w / np.sqrt(seen_w + 1e-10)
        step += rate * d_step / np.sqrt(seen_s + 1e-10)
        rate *= 0.985
    found = Field(dict(zip(s.names, w, strict=True)), step)
    del s, w, seen_w, d_w
    give_back()
    return found


def scan(docs: DataFrame, model: Field | None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts of the base kinds and all spans, in code points, ends exclusive.

    A null text is empty and has none. Whole texts are scanned; repeated rows are scanned each by itself;
    other columns are not read. Without a model only the fixed patterns run. No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of the windows' features

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find_spans(t, sent.value) for t in batch.column("text").to_pylist()]
        counts = [[sum(s[0] == k for s in f) for f in found] for k in KINDS]
        spans = [[dict(zip(("kind", "start", "end", "value_start", "value_end"), s, strict=True)) for s in f] for f in found]
        shape = pa.list_(pa.struct([("kind", pa.string()), *((x, pa.int64()) for x in ("start", "end", "value_start", "value_end"))]))
        digest = [hashlib.sha256(",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in f if s[0] != "crf").encode()).hexdigest() for f in found]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(spans, shape)],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"],
        )

    shape = "array<struct<kind:string,start:long,end:long,value_start:long,value_end:long>>"
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans {shape}")


def redact(docs: DataFrame, model: Field | None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret value replaced by ``mark``; all other columns stay (n_chars, where there is one, is counted anew)."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, end = [], 0
        for a, b in sorted((s[3], s[4]) for s in find_spans(text, sent.value)):
            if b > end:
                if a > end or not out:  # what touches the value before has its mark already
                    out += [text[end:a], mark]
                end = b
        return "".join([*out, text[end:]]) if out else text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
        return batch.set_column(at, batch.schema.field(at), texts)

    out = map_batches(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
