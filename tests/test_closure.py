"""Exact covers and replays against plain versions."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tallyspark.operators import closure

A, L, R = "plan string, rater string, item int, place int", "plan string, rater string, item int, sequence int, recorded_at int, sha string", "plan string, rater string, item int, sha string"


def sets(spark, assigned, told, kept, plans=(("p", 100),)):
    return [spark.createDataFrame(list(rows), schema) for rows, schema in ((plans, "plan string, sealed_at int"), (assigned, A), (told, L), (kept, R))]


def codes(spark, *rows, **more) -> set:
    return {(r.rater, r.item, r.code) for r in closure.rating_closure(*sets(spark, *rows, **more)).collect()}


def test_each_kind_of_gap(spark):
    a = [("p", "x", i, i) for i in (1, 2, 3)]
    told = [("p", "x", i, i, 50 + i, f"s{i}") for i in (1, 2, 3)]
    kept = [("p", "x", i, f"s{i}") for i in (1, 2, 3)]
    assert codes(spark, a, told, kept) == set()
    assert codes(spark, a + a[:1], told, kept) == {("x", 1, "assignment.repeated")}
    assert codes(spark, a, told[:2], kept) == {("x", 3, "entry.lost"), ("x", 3, "rating.foreign")}
    assert codes(spark, a[:2], told, kept) == {("x", 3, "entry.foreign")}
    assert codes(spark, a, told + [("p", "x", 3, 4, 60, "s3")], kept) == {("x", 3, "entry.repeated")}
    swapped = [told[0], ("p", "x", 2, 3, 52, "s2"), ("p", "x", 3, 2, 53, "s3")]
    assert codes(spark, a, swapped, kept) == {("x", 2, "entry.order"), ("x", 3, "entry.order")}
    assert codes(spark, a, [*told[:2], ("p", "x", 3, 5, 53, "s3")], kept) == {("x", 3, "entry.order"), ("x", None, "sequence.holes")}
    assert codes(spark, a, [*told[:2], ("p", "x", 3, 3, 101, "s3")], kept) == {("x", 3, "entry.late")}
    assert codes(spark, a, told, kept[:2]) == {("x", 3, "rating.lost")}
    assert codes(spark, a, told, kept + kept[:1]) == {("x", 1, "rating.repeated")}
    assert codes(spark, a, told, [*kept[:2], ("p", "x", 3, None)]) == {("x", 3, "rating.changed")}
    assert codes(spark, a[:1], told[:1], kept[:1], plans=(("other", 1),)) == {("x", 1, "plan.unknown")}
    assert codes(spark, [], [], []) == set()


def test_report_closes_what_has_no_issue(spark):
    plans = (("p", 100), ("q", 100), ("empty", 1))
    a = [(p, "x", 1, 1) for p in "pq"]
    told, kept = [(p, "x", 1, 1, 5, "s") for p in "pq"], [("p", "x", 1, "s")]
    found = {r["plan"]: tuple(r)[1:] for r in closure.rating_report(*sets(spark, a, told, kept, plans)).collect()}
    assert found == {"p": (1, 1, 1, 0, True), "q": (1, 1, 0, 1, False), "empty": (0, 0, 0, 0, False)}


STATES = ("on", "off")


def digest(request, state, sha) -> int:
    return int(hashlib.sha256(f"{request}|{state}|{sha or ''}".encode()).hexdigest()[:12], 16)


def plain(events: list[tuple], heads: list[tuple]) -> set[tuple]:
    out = set()
    for run, generation, made in heads:
        last: dict = {}
        for r, request, seq, at, state, sha in sorted(events, key=lambda e: (e[3], e[2])):
            if r == run and at <= made:
                last[request] = (state, sha)
        values = [s for s, _ in last.values()]
        out.add((run, generation, *(values.count(s) for s in STATES), len(last), sum(digest(q, *x) for q, x in last.items())))
    return out


def test_replay_gives_each_snapshot(spark):
    r = random.Random(4)
    events = [(run, r.randrange(4), i, r.randrange(40), r.choice(("on", "off", "lost")), r.choice((None, "a", "b"))) for i in range(300) for run in ("u", "v")]
    heads = [(run, g, at) for run in ("u", "v", "none") for g, at in enumerate([0, 5, 5, 17, 39, 60])]
    e = spark.createDataFrame(events, "run_id string, request_id int, seq int, at int, state string, sha string")
    h = spark.createDataFrame(heads, "run_id string, generation int, created_at int")
    told = closure.replay(e, h, STATES)
    assert {(*tuple(x)[:-1], int(x.digest)) for x in told.collect()} == plain(events, heads)

    claimed = h.join(told, ["run_id", "generation"])
    assert closure.replay_issues(e, claimed, STATES).count() == 0
    wrong = claimed.withColumn("on", F.col("on") + F.when((F.col("run_id") == "u") & (F.col("generation") == 3), 1).otherwise(0)).withColumn("digest", F.when(F.col("generation") == 4, F.lit(0)).otherwise(F.col("digest")))
    assert {tuple(x) for x in closure.replay_issues(e, wrong, STATES).where("run_id <> 'none'").collect()} == {("u", 3, "snapshot.on"), ("u", 4, "snapshot.digest"), ("v", 4, "snapshot.digest")}


def test_published_arms_against_their_units(spark):
    units = [(i, arm, n, f"{i}{arm}{n}") for i in (1, 2) for arm in closure.ARMS for n in range(3)]
    private = spark.createDataFrame(units, "item int, arm string, place int, sha string")
    public = closure.projection(private)
    found = lambda p: {tuple(r) for r in closure.public_issues(private, p).collect()}
    assert found(public) == set()
    assert found(public.where("item = 1 OR arm <> 'oracle_delta'")) == {(2, "oracle_delta", "public.missing")}
    assert found(public.unionByName(public.where("item = 2 AND arm = 'uniform_frame'"))) == {(2, "uniform_frame", "public.repeated")}
    turned = closure.projection(private.withColumn("place", F.when(F.col("item") == 1, -F.col("place")).otherwise(F.col("place"))))
    assert found(turned) == {(1, arm, "projection.sha") for arm in closure.ARMS}
    fewer = closure.projection(private.where("item = 2 OR place > 0"))
    assert found(fewer) == {(1, arm, code) for arm in closure.ARMS for code in ("units.count", "projection.sha")}
    more = spark.createDataFrame([(3, "other", 1, "x")], "item int, arm string, n_units long, sha string")
    assert found(public.unionByName(more)) == {(3, "other", "arm.unknown"), (3, "other", "public.foreign")} | {(3, arm, "arm.missing") for arm in closure.ARMS}


def test_tasks_grow_in_number_with_the_ratings(spark, monkeypatch):
    from tallyspark.plans import closures, derivations
    from tallyspark.sources import tables

    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    orders = tables.load(spark, "/root/testdata/sf0.001", "orders").count()
    plan = closures.rating_closure(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert f", {orders // 100 + 1}), REPARTITION_BY_NUM" in plan
    plan = derivations.lines(spark, "/root/testdata/sf0.001").groupBy("o").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
