"""The pipeline's stages each against what they must keep, and the whole on the smallest tables."""

from __future__ import annotations

import re

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
from cases import documents, empty, rows, told
from tallyspark.llm import mixing, neardup, packing, quality, secrets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_keep_columns_and_bear_empty_tables(spark):
    docs = none = None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, documents(spark) if docs is None else docs, SF)
        none = stage(spark, empty(spark) if none is None else none, SF)
        assert none.count() == 0
        if name != "best_fit_packing":
            assert docs.columns == documents(spark).columns and none.columns == docs.columns


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality.RepetitionRules(symbol_limit=0.5)  # the stage asks for few symbols besides
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if quality.measure((r.text or "").encode(), rules)[6]}
    one = neardup.keep_one(kept)
    sets = {r.doc_id: set(neardup.shingles(r.text.encode(), 5, neardup.Words()).tolist()) for r in one.collect()}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    safe = secrets.redact(one, secrets.fit(secrets.windows(one)))
    assert not any(secrets.base_spans(r.text) for r in safe.collect() if "[SECRET]" not in r.text)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(mixing.plan_mix(safe)).collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {i for i, n in taken.items() if n}
    end: dict[int, int] = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 1024
    assert len(end) <= 1.02 * np.ceil(sum(r.length for r in out) / 1024) + 1
    assert told(corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32")) == sorted(((r.doc_id, r.ids_crc32, r.length, r.piece) for r in out), key=repr)


def test_every_query_is_registered_with_its_columns(spark):
    named = entry.queries()
    want = {
        "op1": {"doc_id", "held_out", "lang_pred", "score"},
        "op2": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op4": {"query_id", "rank", "vec_id", "score"},
        "op5": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
        "op7": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
        "op8": {"doc_id", "size", "source_size", "target", "taken"},
        "op11": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
        "op12": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op13": {"doc_id", "n_features", "weight", "score", "rank"},
    }
    for op, columns in want.items():
        (name,) = [n for n in named if n.startswith(op + "_")]
        found = named[name](spark, SF)
        assert columns <= set(found.columns)
    assert {f"op{i}" for i in range(1, 14)} <= {n.split("_")[0] for n in named} and "pipeline" in named


def test_packing_takes_all_rows_of_its_stage(spark):
    assert packing.token_pieces(documents(spark)).select("doc_id").distinct().count() == len({r[0] for r in rows()})
