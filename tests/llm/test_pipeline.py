from __future__ import annotations

import random
import struct
from collections import Counter

import pytest

import corpus_pipeline
from inkwell.llm import bpe, mixing, pii, quality
from inkwell.session import table
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small documents table with prose, copies, junk, personal data and nulls, and labels for some of it."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "ru", "sol"]) for _ in range(rng.randint(1, 4)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(14)).capitalize() + "." for _ in range(8))
    rows = [(i, prose() + (f"\nmail me at {word()}.{i}@mail.example.com now please" if i % 7 == 0 else "")) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200 + i, rows[20 + i][1] + " extra") for i in range(10)]
    rows += [(300 + i, " | ".join(word() for _ in range(90))) for i in range(10)] + [(400, None), (401, ""), (402, "too short")]
    top = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows], SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(d, int(d < 300)) for d, _ in rows if d % 2 == 0], "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages_against_plain_versions(spark, folder):
    docs = table(spark, folder, "documents")
    chain = quality.fit(docs, table(spark, folder, "labels"))
    first = corpus_pipeline.keep_quality(spark, docs, folder)
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(docs, chain).collect()}
    kept = {r["doc_id"]: r for r in first.collect()}
    assert set(kept) == {d for d, k in verdict.items() if k} == {d for d in verdict if d < 300}

    second = corpus_pipeline.drop_near_duplicates(spark, first, folder)
    groups = brute.op5([(d, r["text"]) for d, r in kept.items()])
    left = {r["doc_id"]: r for r in second.collect()}
    assert set(left) == {c for _, _, c in groups} and all(left[d] == kept[d] for d in left)

    third = corpus_pipeline.cover_pii(spark, second, folder)
    clean = {r["doc_id"]: r for r in third.collect()}
    tagger = pii.train()
    for d, r in clean.items():
        (base, added) = pii.find([left[d]["text"]], tagger)[0]
        assert r["text"] == pii.cover(left[d]["text"], base + added) and r["n_chars"] == len(r["text"])
    assert all("@" not in r["text"] for r in clean.values()) and any("<EMAIL>" in r["text"] for r in clean.values())

    fourth = corpus_pipeline.mix_sources(spark, third, folder)
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan(third).collect()}
    taken = Counter()
    mixed = fourth.collect()
    for r in mixed:
        taken[r["doc_id"]] += len(brute.WORD.findall(r["text"]))
        assert clean[r["doc_id"]]["text"].startswith(r["text"])
    assert dict(taken) == {d: n for d, n in plan.items() if n}

    for stage in (first, second, third, fourth):
        assert stage.columns == docs.columns
    last = corpus_pipeline.encode_tokens(spark, fourth, folder).collect()
    lib = bpe.Automaton(open(bpe.default_path(), encoding="utf-8").read())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in last) == sorted((r["doc_id"], brute.sha(lib.encode(r["text"]))) for r in mixed)
    assert all(r["n_tokens"] == len(lib.encode(m["text"])) // struct.calcsize("<I") for r, m in zip(sorted(last, key=lambda r: (r["doc_id"], r["n_tokens"])), sorted(mixed, key=lambda m: (m["doc_id"], len(lib.encode(m["text"]))))))


def test_run_equals_the_stages(spark, folder):
    whole = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(tuple, docs.collect())) == whole and len(corpus_pipeline.STAGES) == 5
