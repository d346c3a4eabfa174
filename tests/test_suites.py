"""Suites against their sources, beside a walk over every action."""

from __future__ import annotations

import random

from tallyspark.operators import review

KINDS = ("cap string, transitions array<string>, evidence array<string>", "cap string, action int, origin string, transitions array<string>, deltas array<string>, evidence array<string>")


def walk(caps, actions, sources, visuals, submitted) -> set[tuple]:
    """(cap, action, ref, code) of the same rules, one reference at a time."""
    out = set()
    has = {t: (set(d or ()), set(e or ())) for t, d, e in sources}
    known = {x for _, e in has.values() for x in e}
    rows = [(c, None, None, t or [], [], e or []) for c, t, e in caps] + [(c, a, o, t or [], d or [], e or []) for c, a, o, t, d, e in actions]
    listed = {c: (set(t or ()), set(e or ())) for c, t, e in caps}
    for c, a, origin, ts, ds, es in rows:
        out |= {(c, a, t, "source.transition_ref") for t in ts if t not in has}
        out |= {(c, a, x, "source.evidence_ref") for x in es if x not in known}
        out |= {(c, a, x, "source.evidence_scope") for x in es if x in known and not any(x in has.get(t, ((), ()))[1] for t in ts)}
        if a is None:
            used = {t for cc, _, _, t2, _, _ in actions if cc == c for t in t2 or ()}
            out |= {(c, a, t, "capability.unused_transition") for t in ts if t not in used}
            continue
        out |= {(c, a, t, "action.capability_transition") for t in ts if t not in listed.get(c, ((), ()))[0]}
        out |= {(c, a, x, "action.capability_evidence") for x in es if x not in listed.get(c, ((), ()))[1]}
        out |= {(c, a, d, "source.delta_ref") for d in ds if not any(d in has.get(t, ((), ()))[0] for t in ts)}
        if origin in review.REPLAYS:
            out |= {(c, a, None, "action.replay_delta")} if not ds else set()
            for d in ds:
                pictures = {x for t, dd, x in visuals if t in ts and dd == d}
                code = "source.delta_visual_missing" if not pictures else "action.delta_visual_ref" if not pictures & set(es) else "action.delta_visual_not_submitted" if not pictures & submitted else None
                out |= {(c, a, d, code)} if code else set()
    return out


def tables(seed: int):
    r = random.Random(seed)
    some = lambda kind, n, most: r.choice([None, *[[f"{kind}{r.randrange(n)}" for _ in range(r.randrange(most))] for _ in range(9)]])
    caps = [(f"c{i}", some("t", 12, 5), some("e", 15, 6)) for i in range(40)]
    origins = ("teacher_replay", "merged", "repair", None)
    actions = [(f"c{r.randrange(44)}", i, r.choice(origins), some("t", 12, 4), [f"d{r.randrange(9)}" for _ in range(r.randrange(3))], some("e", 15, 5)) for i in range(150)]
    sources = [(f"t{i}", some("d", 8, 7), some("e", 12, 9)) for i in range(10)]
    visuals = [(f"t{r.randrange(11)}", f"d{r.randrange(8)}", f"e{r.randrange(14)}") for _ in range(60)]
    return caps, actions, sources, visuals, {f"e{i}" for i in range(0, 14, 3)}


def frames(spark, caps, actions, sources, visuals, submitted):
    return (
        spark.createDataFrame(caps, KINDS[0]), spark.createDataFrame(actions, KINDS[1]), spark.createDataFrame(sources, "transition string, deltas array<string>, evidence array<string>"),
        spark.createDataFrame(visuals, "transition string, delta string, evidence string"), spark.createDataFrame([(x,) for x in sorted(submitted)], "evidence string"),
    )


def test_issues_are_those_of_a_walk(spark, monkeypatch):
    monkeypatch.setattr(review, "REFERENCES_A_TASK", 100, raising=False)
    for seed, most in ((1, 500_000), (2, 3)):
        monkeypatch.setattr(review, "BROADCAST_TRANSITIONS", most, raising=False)
        given = tables(seed)
        found = [(x.cap, x.action, x.ref, x.code) for x in review.suite_issues(*frames(spark, *given)).collect()]
        assert len(found) == len(set(found)) and set(found) == walk(*given)
        assert len({x[3] for x in found}) == 11


def test_references_are_shuffled_once_a_kind(spark):
    """Each reference goes once to where its kind is told: two exchanges of references, two for pictures and one or none for transitions."""
    plan = review.suite_issues(*frames(spark, *tables(1)))._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert sum("Exchange " in line and "Broadcast" not in line for line in initial.splitlines()) <= 6


def test_references_that_are_asked_often_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(review, "REFERENCES_A_TASK", 10)
    monkeypatch.setattr(review, "HOT", 2)
    asked = spark.range(300).selectExpr("CASE WHEN id % 3 = 0 THEN concat('x', id) WHEN id < 290 THEN 'hot' END AS k", "id AS cap", "1 AS action", "false AS mark")
    rows, by = review.beside(asked, spark.createDataFrame([("hot", None, None, True), ("x0", None, None, True)], "k string, cap long, action int, mark boolean"), 8)
    found = rows.collect()
    assert by == ["k", "salt"] and sum(not r.mark for r in found) == 300
    salts = {r.salt for r in found if r.k == "hot" and not r.mark}
    assert len(salts) > 10 and salts <= {r.salt for r in found if r.k == "hot" and r.mark} and {r.salt for r in found if r.k != "hot"} == {0}
    given = tables(3)
    assert {(x.cap, x.action, x.ref, x.code) for x in review.suite_issues(*frames(spark, *given)).collect()} == walk(*given)


def test_empty_suites(spark):
    given = [df.limit(0) for df in frames(spark, *tables(1))]
    assert review.suite_issues(*given).count() == 0
    one = spark.createDataFrame([("c", ["t"], ["e"])], KINDS[0])
    assert {(x.action, x.ref, x.code) for x in review.suite_issues(one, *given[1:]).collect()} == {(None, "t", "source.transition_ref"), (None, "t", "capability.unused_transition"), (None, "e", "source.evidence_ref")}
