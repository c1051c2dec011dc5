from __future__ import annotations

import pytest

from inkwell.llm import mixing
from tests.llm.brute import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)


def rows():
    out = [(i, " ".join(["w"] * (i % 37 + 1)), "abc"[i % 3]) for i in range(300)]
    out += [(1000 + i, "one two", "d") for i in range(3)] + [(2000, None, None), (2001, "a b c", None), (2002, "", "a"), (5, "w " * 6, "a")]
    return out


def plain_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] for s in capped} | share
        capped |= over


def test_targets_and_taken(spark):
    data = rows()
    got = mixing.plan(frame(spark, data)).collect()
    sizes: dict = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    taken: dict = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(taken[s] == int(want[s] + 0.5) for s in want) and len(got) == len(data)


def test_stream_is_sorted_and_cut_exactly(spark):
    df = frame(spark, rows())
    plan = mixing.plan(df).collect()
    stream = mixing.mix(df)
    assert stream.columns == df.columns
    out = stream.collect()
    assert sum(len(WORD.findall(r["text"])) for r in out) == sum(r["taken"] for r in plan)
    assert [tuple(r) for r in mixing.mix(df).collect()] == [tuple(r) for r in out]


def test_empty_table(spark):
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(frame(spark, [(1, None, None), (2, "", "x")])).count() == 0


def test_due_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    for schedule in mixing.SCHEDULES:
        shares = [i / 20 for i in range(21)]
        got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.due(F.col("s"), schedule)).collect()]
        assert got == sorted(got) and got[0] == 0.0 and got[-1] == pytest.approx(1.0)
        area = lambda u: sum((min(u, t1) - t0) * (r0 + r0 + (r1 - r0) * (min(u, t1) - t0) / (t1 - t0)) / 2 for (t0, r0), (t1, r1) in zip(schedule, schedule[1:]) if u > t0)
        assert [area(u) / area(1.0) for u in got] == pytest.approx(shares, abs=1e-9)
