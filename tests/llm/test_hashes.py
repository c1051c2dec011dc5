"""Texts on which linear hashes collide, and hashes that collide by force: results stay those of the plain versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import jaccard, quality, suffixes, superkmer, textbuf
from tests.llm import brute
from tests.llm.test_repeats import TEXT, same


def thue_morse(n: int) -> str:
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def other(text: str) -> str:
    return text.translate({97: 98, 98: 97})


def tricky() -> list[tuple]:
    t = thue_morse(1024)
    lead = " ".join(f"w{i}" for i in range(6))
    out = [(1, f"{lead} {t} {lead}"), (2, f"{lead} {other(t)} {lead}"), (3, t), (4, other(t)), (5, f"{t}\n{other(t)}\n{t}"), (6, f"{other(t)}\n{t} {t}\n{other(t)} {t}")]
    words = " ".join(thue_morse(64))
    out += [(7, words), (8, " ".join(other(thue_morse(64)))), (9, "ab" * 700), (10, "ba" * 700), (11, "a" * 1400), (12, "\0" * 700 + " " + "\0" * 900), (13, "\0 " * 300), (14, "\0\0 " * 300)]
    return out


def test_results_on_constructed_texts(spark):
    docs = tricky()
    df = spark.createDataFrame(docs, TEXT)
    assert same(jaccard.linked(df).select("doc_id", "n_shingles", "component_id").collect(), brute.op5(docs))
    assert same(superkmer.dedup(df).drop("kept").collect(), brute.op10(docs))
    assert same(suffixes.dedup(df, keep_first=False).drop("kept").collect(), brute.op8(docs))
    got = quality.judge(df, quality.fit(df, None)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert same(got, [(d, *brute.op4(t)) for d, t in docs])


def coarse(buf, starts, ends, seed=0):
    """A hash of which most ranges have an equal one."""
    return (ends - starts).astype(np.uint64) % np.uint64(2)


def test_line_table_survives_collisions(monkeypatch):
    texts = [t or "" for _, t in brute.odd_documents() + tricky()]
    want = [brute.op4(t)[:5] for t in texts]
    buf, off = textbuf.utf8(pa.array(texts))
    assert [tuple(r) for r in quality.line_table(buf, off)[2].tolist()] == want
    monkeypatch.setattr(quality, "byte_hashes", coarse)
    assert [tuple(r) for r in quality.line_table(buf, off)[2].tolist()] == want


@pytest.mark.parametrize("forced", [False, True])
def test_windows_survive_collisions(monkeypatch, forced):
    if forced:
        monkeypatch.setattr(superkmer, "byte_hashes", coarse)
    strings = [" ".join(["x", "yy", "zzz", "x", "yy", "a", "b"][i % 7] for i in range(k, k + 20 + k % 9)) for k in range(40)]
    ids = np.array([k % 11 for k in range(40)])
    parts = []
    for s in strings:
        buf, off = textbuf.utf8(pa.array([s]))
        parts.append(superkmer.joined(buf, *textbuf.cut_words(buf, off)[:2])[0])
    string, place, gone = superkmer._removed(np.concatenate(parts), np.array([len(p) for p in parts]), ids, 13)
    least: dict = {}
    for s, i in zip(strings, ids.tolist()):
        w = s.split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, i), i)
    want = {(j, k): least[tuple(s.split()[k : k + 13])] < int(ids[j]) for j, s in enumerate(strings) for k in range(len(s.split()) - 12)}
    assert dict(zip(zip(string.tolist(), place.tolist()), gone.tolist())) == want


def test_equal_names_of_unequal_sets_are_told_apart(spark):
    flat, off = np.arange(1, 9, dtype=np.uint64), np.array([0, 3, 3, 8])
    name = jaccard.set_class(flat, off)
    twins = np.sort(name[[0, 2]])
    again = jaccard.set_class(flat, off, twins)
    assert name[1] == again[1] == 0 and len({*name[[0, 2]].tolist(), *again[[0, 2]].tolist()}) == 4
    found = spark.createDataFrame([(1, 5, 7), (2, 5, 7), (3, 6, 7), (4, 6, 8), (5, None, 9)], "doc_id long, class long, check long")
    assert jaccard.twin_names(found).tolist() == [6]


def test_byte_hashes_and_same_bytes():
    texts = [thue_morse(1 << k) for k in range(12)] + [other(thue_morse(1 << k)) for k in range(12)] + ["\0" * k for k in range(1, 40)] + ["a" * 600, "a" * 601, "é" * 400]
    buf, off = textbuf.utf8(pa.array(texts))
    assert len(set(textbuf.byte_hashes(buf, off[:-1], off[1:]).tolist())) == len(set(texts))
    a, b = np.meshgrid(np.arange(len(texts)), np.arange(len(texts)))
    a, b = a.ravel(), b.ravel()
    size = np.minimum(np.diff(off)[a], np.diff(off)[b])
    raw = [t.encode() for t in texts]
    assert textbuf.same_bytes(buf, off[a], off[b], size).tolist() == [raw[i][:n] == raw[j][:n] for i, j, n in zip(a.tolist(), b.tolist(), size.tolist())]
