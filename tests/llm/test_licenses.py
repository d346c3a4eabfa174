"""Licence scans against Dice coefficients of every passage with every template, unpruned."""

from __future__ import annotations

import random
import re

import regex
from cases import SCHEMA, documents, empty, rows, told
from tallyspark.llm import licenses


def normal(text: str) -> str:
    return " ".join(regex.sub(r"[^\p{L}\p{N}.]+|\.(?![\p{L}\p{N}])", " ", text.lower()).split())


def pairs(text: str) -> set[tuple]:
    words = text.split(" ")
    return set(zip(words, words[1:], strict=False))


def plain(text: str | None, similarity: float) -> list[tuple]:
    text = text or ""
    passages = {normal(p) for p in [*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text]}
    out = []
    for p in passages:
        for name, template in licenses.TEMPLATES.items():
            a, b = pairs(p), pairs(normal(template))
            dice = 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0
            if dice >= similarity:
                out.append((-dice, name, p))
    return [(name, -d, p) for d, name, p in sorted(out)]


def texts() -> list[str | None]:
    r = random.Random(2)
    out: list[str | None] = [None, "", "\n\n", "no licence here at all\nnor here"]
    for name, t in licenses.TEMPLATES.items():
        words = t.split()
        out += [t, t.upper(), f"Intro line.\n\n{t}\n\nMore.", "// " + "\n// ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))]
        for drop in (0.03, 0.1, 0.3):
            out.append(" ".join(w for w in words if r.random() > drop))
            out.append(" ".join("other" if r.random() < drop else w for w in words))
        out.append(f"{t}\n{t}\n\nand {name}")
    return out


def test_every_match_and_no_other(spark):
    asked = texts()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(asked)], SCHEMA)
    for similarity in (0.8, 0.65):
        for row in licenses.scan_licenses(df, similarity).collect():
            want = plain(asked[row.doc_id], similarity)
            got = [(m.license, m.dice, m.passage) for m in row.matches]
            assert [(a, round(b, 9), c) for a, b, c in got] == [(a, round(b, 9), c) for a, b, c in want], asked[row.doc_id]
            assert (row.license, row.n_matches) == (want[0][0] if want else None, len(want))


def test_table(spark):
    found = licenses.scan_licenses(documents(spark))
    assert found.count() == len(rows()) and found.where("license is not null").count() == 0
    assert told(found) == told(licenses.scan_licenses(documents(spark, clash=True)))
    assert licenses.scan_licenses(empty(spark)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


LAYOUTS = {
    "MIT": ("to deal", "THE SOFTWARE IS", "The above copyright"),
    "GPL-3.0-notice": ("This program is distributed",),
    "BSD-3-Clause": ("1. Redistributions", "2. Redistributions", "3. Neither", "THIS SOFTWARE IS"),
    "Apache-2.0-notice": ("You may obtain", "Unless required"),
}


def laid_out(name: str) -> str:
    """A template as files have it: paragraphs, lines of nine words, each with a comment sign."""
    text = licenses.TEMPLATES[name]
    for start in LAYOUTS[name]:
        text = text.replace(f" {start}", f"\n\n{start}")
    return "\n\n".join("\n".join(" * " + " ".join(w[i : i + 9]) for i in range(0, len(w), 9)) for w in (p.split() for p in text.split("\n\n")))


def best_run(text: str, name: str) -> float:
    """The best coefficient of any run of words with the template."""
    words, b = normal(text).split(" "), pairs(normal(licenses.TEMPLATES[name]))
    best, most = 0.0, int(len(normal(licenses.TEMPLATES[name]).split()) * 1.5)
    for i in range(len(words)):
        a: set = set()
        for pair in zip(words[i : i + most - 1], words[i + 1 : i + most], strict=False):
            a.add(pair)
            best = max(best, 2 * len(a & b) / (len(a) + len(b)))
    return best


def test_notices_inside_long_documents(spark):
    r = random.Random(5)
    around = lambda n: " ".join(f"word{r.randrange(300)}" for _ in range(n))
    asked = [(name, f"{around(900)}\n\n{laid_out(name)}\n\n{around(900)}") for name in LAYOUTS]
    asked += [(name, f"{around(400)} {licenses.TEMPLATES[name]} {around(400)}\n{around(30)}") for name in licenses.TEMPLATES]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, (_, t) in enumerate(asked)], SCHEMA)
    missed = {row.doc_id for row in licenses.scan_licenses(docs).collect() if row.license is None}
    assert set(range(len(LAYOUTS))) - {3} <= missed
    for row in licenses.scan_licenses(docs, inside=True).collect():
        assert asked[row.doc_id][0] in [m.license for m in row.matches if m.dice == 1.0]
        assert row.dice == 1.0
    plan = licenses.scan_licenses(docs, inside=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_best_run_of_all(spark):
    """Edited notices in other words, against every run of words; two copies are two matches."""
    r = random.Random(6)
    asked = [(None, None), (None, ""), (None, "license"), (None, "no licence here at all\nnor here")]
    for name in ("MIT-line", "GPL-3.0-notice", "MPL-2.0-notice", "ISC", "CC0-1.0-line"):
        for drop in (0.0, 0.03, 0.08, 0.12, 0.3):
            words = [w if r.random() > drop else r.choice(("", "other words", "the")) for w in licenses.TEMPLATES[name].split()]
            asked.append((name, f"the {' '.join(r.choices(('this', 'program', 'other', 'the', 'of'), k=40))} {' '.join(words)} and the rest of it"))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, (_, t) in enumerate(asked)], SCHEMA)
    for row in licenses.scan_licenses(docs, inside=True).collect():
        name, text = asked[row.doc_id]
        want = best_run(text, name) if name else 0.0
        got = max((m.dice for m in row.matches if m.license == name), default=0.0)
        assert round(got, 9) == (round(want, 9) if want >= 0.8 else 0.0), text
    one = licenses.TEMPLATES["GPL-3.0-notice"]
    twice = spark.createDataFrame([(0, f"{' '.join(map(str, range(500)))} {one} {one.replace('useful', 'handy')} {' '.join(map(str, range(500)))}", None, None, None)], SCHEMA)
    assert len([m for m in licenses.scan_licenses(twice, inside=True).first().matches if m.license == "GPL-3.0-notice"]) == 2
