from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from inkwell.llm import jaccard, suffixes, superkmer, urls
from tests.llm import brute

TEXT = "doc_id long, text string"


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def same(got, want):
    return sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def near_documents():
    rng = random.Random(5)
    out = []
    for g in range(20):
        n = rng.randint(3, 200)
        base = [f"t{g}_{rng.randint(0, 50 * n)}" for _ in range(n)]
        for _ in range(rng.randint(2, 9)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, n // 18))):
                words[rng.randrange(n)] = f"z{rng.random()}"
            out.append((len(out) + 100, " ".join(words)))
    return out


@pytest.fixture(params=["odd", "near"])
def docs(request):
    return brute.odd_documents() if request.param == "odd" else near_documents()


def test_jaccard_components(spark, docs):
    df = spark.createDataFrame([("x", d, t, 1) for d, t in docs], "class string, doc_id long, text string, size int")
    got = jaccard.linked(df).select("doc_id", "n_shingles", "component_id").collect()
    want = brute.op5(docs)
    assert same(got, want)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    lone = sum(n == 0 for _, n, _ in want)
    groups = {c for _, n, c in want if n and c is not None}
    assert kept.count() == lone + len(groups) + len({t for (d, t), (_, n, c) in zip(docs, want) if n and c is None})


def test_keep_one_by_component_not_by_id(spark):
    base = [f"w{i}" for i in range(80)]
    near = [" ".join(base), " ".join([*base[:-1], "other"])]
    docs = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (None, near[0]), (None, near[1]), (None, "k l m n o p q r"), (2, "k l m n o p q r")]
    kept = jaccard.keep_one(spark.createDataFrame(docs, TEXT)).collect()
    assert len(kept) == 4 and {docs[0], docs[1], docs[5]} < {tuple(r) for r in kept}


def test_large_clusters_agree_with_small_ones(spark):
    df = spark.createDataFrame(near_documents(), TEXT)
    found = jaccard.settle(jaccard.classes(df))
    one = {tuple(r) for r in jaccard.links(df, found).collect()}
    two = {tuple(r) for r in jaccard.links(df, found, most=10).collect()}
    parts = lambda rows: {frozenset(n for n, c in rows if c == x) for x in {c for _, c in rows}}
    assert {p for p in parts(one) if len(p) > 1} == {p for p in parts(two) if len(p) > 1}


def test_sketches_bound_differences():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 120).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(20, 110)], rng.integers(0, 1 << 63, 40).astype(np.uint64)]))
        words, start = jaccard._sketch(np.zeros(2), np.concatenate([a, b]), np.zeros(0), np.array([len(a), len(b)]))
        bits = jaccard._fold(words, start)
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def test_empty_tables(spark):
    none = spark.createDataFrame([], TEXT)
    assert jaccard.linked(none).count() == 0 and superkmer.dedup(none).count() == 0 and suffixes.dedup(none).count() == 0


def test_superkmers(spark, docs):
    df = spark.createDataFrame(docs, TEXT)
    assert same(superkmer.dedup(df).drop("kept").collect(), brute.op10(docs))
    by_span = {r["doc_id"]: sum(b - a for a, b in zip(r["starts"], r["ends"])) for r in superkmer.spans(df).collect() if r["doc_id"] is not None}
    assert all(by_span[d] == n for d, _, n, _ in brute.op10(docs) if d is not None)


def test_suffix_dedup(spark, docs):
    df = spark.createDataFrame(docs, TEXT)
    assert same(suffixes.dedup(df, keep_first=False).drop("kept").collect(), brute.op8(docs))
    assert same(suffixes.dedup(df).drop("kept").collect(), brute.op8(docs, keep_first=True))


def test_longest_previous_factor():
    rng = random.Random(9)
    for _ in range(60):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60)))
        n = len(text)

        def match(i, j):
            k = 0
            while max(i, j) + k < n and text[i + k] == text[j + k]:
                k += 1
            return k

        earlier, later = suffixes.longest_factors(np.frombuffer(text, np.uint8), 64)
        assert earlier.tolist() == [max((match(i, j) for j in range(i)), default=0) for i in range(n)]
        assert later.tolist() == [max((match(i, j) for j in range(i + 1, n)), default=0) for i in range(n)]


def test_url_rules_and_templates(spark):
    rows = [(1, "https://A.Example.ORG/es/x"), (2, "http://example.org/en/1?q"), (3, "http://example.org/en/2"), (4, "http://x.com/fr/"), (5, "http://x.com/de/9"), (6, None), (7, "no scheme"), (8, "http://org"), (9, "http://notexample.org/es/1"), (9, "http://notexample.org/es/1"), (None, "http://x.net/a")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    rules = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(rows)
    assert rules[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and rules[2][2] == "example.org/en/1"
    assert rules[3][2:] == ("org/", "allow") and rules[4][2:] == ("com/fr/", "allow") and rules[5][2:] == ("com/de/", "block")
    assert rules[6] == ("", "", None, "allow") and rules[7][:2] == ("", "") and rules[8] == ("org", "", None, "allow") and rules[9][2] == "org/"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_learn_from_labels(spark):
    pages = [(i, f"http://h.net/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(200)], "page_id long, blocked boolean")
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), labels=labels).collect()
    assert all((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got) and {r["template"] for r in got} == {"/spam/*", "/news/*"}


def test_urls_learn_below_the_third_segment(spark):
    names = ["".join(x) for x in itertools.product("abcdef", repeat=2)]
    pages = [(i, f"http://x.net/a/b/c/{kind}/{n}/{n}") for i, (kind, n) in enumerate(itertools.product(("good", "bad"), names))]
    labels = spark.createDataFrame([(i, "/bad/" in u) for i, u in pages if i % 6], "page_id long, blocked boolean")
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), labels=labels).collect()}
    assert all(got[i]["verdict"] == ("block" if "/bad/" in u else "allow") for i, u in pages) and len(got) == len(pages)
    assert {r["template"] for r in got.values()} == {"/*/*/*/good/*/*", "/*/*/*/bad/*/*"}


def test_chunks_of_a_bucket_connect_what_one_task_would(spark):
    """Buckets of several groups, one of them a chain, whatever the chunks are."""
    rng = random.Random(7)
    common = " ".join(f"c{i}" for i in range(40))  # all share it, so they meet in buckets, but it isn't enough for a link
    docs = []
    for g in range(6):
        words = [f"g{g}_{i}" for i in range(60)]
        for _ in range(12):
            docs.append((len(docs), common + " " + " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = f"n{rng.random()}"
    df = spark.createDataFrame(docs, TEXT)
    found = jaccard.settle(jaccard.classes(df))
    rows = jaccard.settle(jaccard.buckets(df, np.zeros(0, np.uint64)))
    assert rows.agg({"members": "max"}).first()[0] > 8

    def groups(spread, heads):
        return {tuple(r) for r in jaccard.components(jaccard.possible_links(rows, found, 4, 80, spread, heads)).collect()}

    want = groups(10_000, 1)
    assert all(groups(spread, heads) == want for spread, heads in ((2, 1), (5, 2), (3, 8)))
    assert same(jaccard.linked(df).select("doc_id", "n_shingles", "component_id").collect(), brute.op5(docs))


def test_frequent_minimisers_are_split_by_context(spark):
    """One phrase in every document, in different surroundings and in some that repeat, with tiny arrays."""
    rng = random.Random(13)
    phrase = "this very phrase is in every one of them and so on"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    contexts = [(prose(40), prose(40)) for _ in range(4)]
    docs = []
    for i in range(40):
        a, b = rng.choice(contexts) if i % 2 else (prose(40), prose(40))
        docs.append((i, f"{prose(5)} {a} {phrase} {b} {prose(5)}" + (f" {a} {phrase} {b}" if i % 7 == 1 else "")))
    df = spark.createDataFrame(docs, TEXT)
    for batch in (1 << 20, 700):
        assert same(suffixes.dedup(df, keep_first=False, batch=batch).drop("kept").collect(), brute.op8(docs))
        assert same(suffixes.dedup(df, batch=batch).drop("kept").collect(), brute.op8(docs, keep_first=True))


def test_one_passage_in_every_document(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(80))
    docs = [(i, " ".join(f"d{i}_{rng.randint(0, 99)}" for _ in range(30)) + " " + passage) for i in range(300)]
    df = spark.createDataFrame(docs, TEXT).repartition(8)
    assert same(superkmer.dedup(df).drop("kept").collect(), brute.op10(docs))
    assert same(suffixes.dedup(df, keep_first=False).drop("kept").collect(), brute.op8(docs))
    assert same(jaccard.linked(df).select("doc_id", "n_shingles", "component_id").collect(), brute.op5(docs))
