"""Every pair of texts that share enough of the smaller one's n-grams, with the grams they share counted.

Texts of equal grams are one class, named by its smallest key; the others of a class are set aside, so that grams are
counted between classes, and each pair of classes becomes the pairs of its members only as it is returned.

* Grams meet by hash, as in ``shared_grams``; what a single class has goes no further.
* The classes that share grams enough to be the smaller of a pair are dealt into blocks. A block gets, of each gram that
  one of its classes has, all the classes that have it, so that one task counts a pair to its end. Pairs are never
  shuffled. Classes stand in the order of their least scrambled gram, which keeps those that share much together.
* A block's frequent grams are counted like any other: a pair that shares nothing else is found as well.

Broadcast are 24 bytes of each text that repeats an earlier one's grams, and 12 of each class that could be the smaller.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import shared_grams as S
from inkwell.session import settle, ship

#: Classes of a gram from which its list counts as long.
WIDE = 256
#: List entries that a block's classes go through, and those of grams that aren't long, at most (unless one class has more).
COUNTED, NARROW = 100_000_000, 8_000_000
#: Entries of all long lists up to which any block may hold them.
HELD = 32_000_000
#: Pairs of an Arrow batch, and pairs of copies of a task.
BATCH, COPIES = 1 << 17, 1 << 20
#: Parts of a task that deals out lists, and bytes that it gathers before.
TOGETHER, GATHERED = 8, 128_000_000

LISTS = "block int, degree binary, owner binary, name binary, size binary"
PAIRS = "a long, b long, containment double"


def packets(docs: DataFrame, key: str, n: int, parts: int, aside) -> DataFrame:
    """Grams of all texts but those of the sorted keys in ``aside``, by key, dealt out by hash (shared_grams.PACKET)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        for batch, own in S._sets(batches, n):
            name = batch.column(0).to_numpy()
            for k, s, out in zip(name.tolist(), own, S._within(aside.value, name).tolist()):
                if len(s) and not out:
                    held[k] = s
                    total += len(s)
            if total >= S.GATHERED or len(held) > S.NUMBERED - 8192:
                yield from S.deal(held, parts)
                held, total = {}, 0
        if held:
            yield from S.deal(held, parts)

    return docs.select(F.col(key).cast("long"), F.lower("text").alias("_t")).mapInArrow(run, S.PACKET)


def merged_sets(docs: DataFrame, key: str, n: int) -> DataFrame:
    """key and distinct grams of keys with several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in S._sets(batches, n):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], [key, "grams"])

    sets = docs.select(F.col(key).cast("long").alias(key), F.lower("text").alias("_t")).mapInArrow(run, f"`{key}` long, grams array<long>")
    return sets.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for k, s in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield k, np.sort(np.asarray(s.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64))


def merged_named(sets: DataFrame, key: str) -> DataFrame:
    """key, class and size of such sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, s in _merged(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([S._name(s) if len(s) else None], pa.int64()), pa.array([len(s)], pa.int32())], [key, "class", "size"])

    return sets.mapInArrow(run, f"`{key}` long, class long, size int")


def merged_packets(sets: DataFrame, parts: int, aside) -> DataFrame:
    """Such sets, dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, s in _merged(batches):
            if len(s) and not S._within(aside.value, np.array([k]))[0]:
                yield from S.deal({k: s}, parts)

    return sets.mapInArrow(run, S.PACKET)


def smaller(shared: DataFrame, parts: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the classes that share grams enough to be the smaller of a pair: names, least scrambled gram, and entries of
    the lists they are in, of long ones and of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, degree, owner, name, size in S._parts(batches):
            order = np.argsort(owner, kind="stable")
            start = np.flatnonzero(np.append(True, np.diff(owner[order]) != 0))
            low = (S.mix(gram) >> np.uint64(1)).astype(np.int64)
            wide = np.where(degree > WIDE, degree, 0).astype(np.int64)
            each = lambda x: np.repeat(x, degree)[order]
            sums = [np.diff(np.append(start, len(owner))), np.minimum.reduceat(each(low), start), np.add.reduceat(each(wide), start), np.add.reduceat(each(degree - wide), start)]
            for a in range(0, len(name), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 65536].astype(np.int64)) for x in (name, size, *sums)], ["class", "size", "n", "low", "wide", "narrow"])

    per = shared.coalesce(max(1, parts // TOGETHER)).mapInArrow(run, "class long, size long, n long, low long, wide long, narrow long").groupBy("class")
    per = per.agg(F.max("size").alias("size"), F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("wide").alias("wide"), F.sum("narrow").alias("narrow"))
    found = per.where(F.col("n") / F.col("size") > threshold).select("class", "low", "wide", "narrow").toPandas()
    return tuple(found[c].to_numpy(np.int64) for c in ("class", "low", "wide", "narrow"))


def blocks(name: np.ndarray, low: np.ndarray, wide: np.ndarray, narrow: np.ndarray, long_lists: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names and the block of each; some ``least`` blocks or more."""
    order = np.lexsort((name, low))
    name, wide, narrow = name[order], wide[order], narrow[order]
    counted = min(COUNTED, int((wide + narrow).sum()) // least + 1)
    limit = counted if long_lists <= HELD else min(counted, HELD)
    block = np.zeros(len(name), np.int32)
    at = a = b = 0
    for i, (x, y) in enumerate(zip((wide + narrow).tolist(), narrow.tolist())):
        if (a + x > limit or b + y > NARROW) and a:
            at, a, b = at + 1, 0, 0
        a, b, block[i] = a + x, b + y, at
    order = np.argsort(name)
    return name[order], block[order]


def _find(names: np.ndarray, x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values where ``x`` is in sorted ``names``, else -1."""
    return np.where(S._within(names, x), values[np.minimum(np.searchsorted(names, x), max(0, len(names) - 1))], -1) if len(names) else np.full(len(x), -1)


def _together(rows: list[tuple[np.ndarray, ...]], block: int) -> Iterator[pa.RecordBatch]:
    """The lists of a block from several parts as one row, or as a few whose classes are numbered in 16 bits."""
    name, first, number = np.unique(np.concatenate([r[2] for r in rows]), return_index=True, return_inverse=True)
    if len(name) > S.NUMBERED and len(rows) > 1:
        yield from _together(rows[: len(rows) // 2], block)
        yield from _together(rows[len(rows) // 2 :], block)
        return
    base = np.append(0, np.cumsum([len(r[2]) for r in rows])).tolist()
    number = number.astype(np.uint16 if len(name) <= S.NUMBERED else np.uint32)
    who = np.concatenate([number[a : a + len(r[2])][r[1]] for a, r in zip(base, rows)])
    degree, size = np.concatenate([r[0] for r in rows]), np.concatenate([r[3] for r in rows])[first]
    yield S._rows([(block, degree.tobytes(), who.tobytes(), name.tobytes(), size.tobytes())], LISTS)


def lists(shared: DataFrame, parts: int, dealt) -> DataFrame:
    """The lists of a part's grams for each block with a class in them (LISTS), each by size and name of the classes."""

    def pieces(degree: np.ndarray, owner: np.ndarray, name: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        names, block = dealt.value
        order = np.lexsort((name, size))
        name, size = name[order], size[order]
        place = np.empty(len(name), np.int64)
        place[order] = np.arange(len(name))
        gram = np.repeat(np.arange(len(degree)), degree)
        owner = np.sort(gram * len(name) + place[owner]) % len(name)
        start = np.append(0, np.cumsum(degree, dtype=np.int64))
        at = _find(names, name, block).astype(np.int64)[owner]
        code = np.unique(at[at >= 0] * len(degree) + gram[at >= 0])
        to, of = code // len(degree), code % len(degree)
        ends = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)) if len(to) else [0]
        for a, b in zip(ends, ends[1:]):
            own = of[a:b]
            d = degree[own].astype(np.int64)
            there, who = np.unique(owner[np.repeat(start[own] - np.cumsum(d) + d, d) + np.arange(d.sum())], return_inverse=True)
            yield int(to[a]), (d.astype(np.uint32), who.astype(np.uint32), name[there], size[there])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        total = 0
        for _, degree, owner, name, size in S._parts(batches):
            for block, piece in pieces(degree, owner, name, size) if len(name) else ():
                held.setdefault(block, []).append(piece)
                total += sum(x.nbytes for x in piece)
                if total > GATHERED:
                    for k, rows in held.items():
                        yield from _together(rows, k)
                    held, total = {}, 0
        for k, rows in held.items():
            yield from _together(rows, k)

    return shared.coalesce(max(1, parts // TOGETHER)).mapInArrow(run, LISTS)


def _counted(rank: np.ndarray, after: np.ndarray, entries: np.ndarray, classes: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes that follow in lists, from ``rank`` on to the end of each, at least ``need`` times, and how often."""
    far = after > 64
    near, count = rank[~far], after[~far]
    own = [entries[np.repeat(near - np.cumsum(count) + count, count) + np.arange(count.sum())]]
    own += [entries[a : a + n] for a, n in zip(rank[far].tolist(), after[far].tolist())]
    own = np.concatenate(own)
    if len(own) > classes // 8:
        n = np.bincount(own, minlength=classes)
        found = np.flatnonzero(n >= need)
        return found, n[found]
    found, n = np.unique(own, return_counts=True)
    return found[n >= need], n[n >= need]


@lru_cache(1 << 16)
def rounded(x: float, digits: int) -> float:
    """As Spark rounds: the shortest decimal form, half up."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _containment(shared: np.ndarray, size: int, digits: int | None) -> np.ndarray:
    if digits is None:
        return shared / size
    there = np.flatnonzero(np.bincount(shared))
    value = np.zeros(int(there[-1]) + 1)
    value[there] = [rounded(x, digits) for x in (there / size).tolist()]
    return value[shared]


def _batches(a: int, b: np.ndarray, containment: np.ndarray) -> Iterator[list[np.ndarray]]:
    for i in range(0, len(b), BATCH):
        other = b[i : i + BATCH]
        yield [np.minimum(a, other), np.maximum(a, other), containment[i : i + BATCH]]


def _gathered(pairs: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pairs in batches of a fair size."""
    held, total = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], [x.split()[0] for x in PAIRS.split(", ")])

    for columns in pairs:
        held.append(columns)
        total += len(columns[0])
        if total >= BATCH or len(held) >= 8192:
            yield out()
            held, total = [], 0
    if total:
        yield out()


def _members(copies: tuple[np.ndarray, np.ndarray], head: int) -> np.ndarray:
    """Keys of a class; copies: sorted by head, then key."""
    heads, keys = copies
    a, b = np.searchsorted(heads, [head, head + 1]) if head < np.iinfo(np.int64).max else (np.searchsorted(heads, head), len(heads))
    return np.append(head, keys[a:b])


def block_pairs(dealt_lists: DataFrame, dealt, copies, threshold: float, digits: int | None) -> DataFrame:
    """PAIRS of members of different classes whose smaller class is of the block."""

    def pairs(rows: list[tuple[np.ndarray, ...]], block: int) -> Iterator[list[np.ndarray]]:
        name, first, number = np.unique(np.concatenate([r[2] for r in rows]), return_index=True, return_inverse=True)
        size = np.concatenate([r[3] for r in rows])[first]
        order = np.lexsort((name, size))
        place = np.empty(len(name), np.int64)
        place[order] = np.arange(len(name))
        name, size, number = name[order], size[order], place[number]
        base = np.append(0, np.cumsum([len(r[2]) for r in rows]))
        entries = np.concatenate([number[a : a + len(r[2])][r[1]].astype(np.int32) for a, r in zip(base.tolist(), rows)])
        degree = np.concatenate([r[0] for r in rows]).astype(np.int64)
        last = np.cumsum(degree)
        mine = _find(dealt.value[0], name, dealt.value[1]) == block
        at = np.flatnonzero(mine[entries])
        at = at[np.argsort(entries[at], kind="stable")]
        after = np.repeat(last, degree)[at] - at - 1
        who, starts = np.unique(entries[at], return_index=True)
        need = S.least_shared(size.astype(np.int64), threshold)
        heads = np.unique(copies.value[0])
        several = S._within(heads, name)
        times = np.ones(len(name), np.int64)
        times[several] += np.searchsorted(copies.value[0], name[several], "right") - np.searchsorted(copies.value[0], name[several])
        for c, x, y in zip(who.tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)]):
            found, shared = _counted(at[x:y] + 1, after[x:y], entries, len(name), int(need[c]))
            if not len(found):
                continue
            other, many, share = name[found], times[found], _containment(shared, int(size[c]), digits)
            if many.max() > 1:
                other = np.concatenate([_members(copies.value, h) if k > 1 else [h] for h, k in zip(other.tolist(), many.tolist())]).astype(np.int64)
                share = np.repeat(share, many)
            for k in _members(copies.value, int(name[c])).tolist() if several[c] else [int(name[c])]:
                yield from _batches(k, other, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, block = [], -1
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch["block"][i].as_py()
                who, name = batch["owner"][i].as_buffer(), S._array(batch["name"][i], "i8")
                rows.append((S._array(batch["degree"][i], "u4").copy(), np.frombuffer(who, "u2" if len(name) <= S.NUMBERED else "u4").copy(), name.copy(), S._array(batch["size"][i], "i4").copy()))
        yield from _gathered(pairs(rows, block))

    return dealt_lists.groupBy("block").applyInArrow(run, PAIRS)


def copy_pairs(extra: DataFrame, copies, tasks: int) -> DataFrame:
    """PAIRS of one class: each copy with all members before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for k, head in zip(*(c.to_pylist() for c in batch.columns)):
                    before = _members(copies.value, head)
                    before = before[: np.searchsorted(before, k)]
                    yield from _batches(k, before, np.ones(len(before)))

        yield from _gathered(pairs())

    return extra.repartition(tasks).mapInArrow(run, PAIRS)


def pairs(docs: DataFrame, key: str, threshold: float, n: int, digits: int | None = None) -> DataFrame:
    """PAIRS a < b of integer keys that share over ``threshold`` of the smaller set, with that share, rounded to ``digits`` if any.

    Grams of rows of one key are one set; rows without key take no part.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    ship(spark)
    docs = docs.where(F.col(key).isNotNull()).select(key, "text")
    named = settle(S.named(docs, key, n).select(F.col(key).cast("long").alias(key), "class", "size"))
    twice = named.groupBy(key).agg(F.count("*").alias("_c")).where("_c > 1").select(key)
    repeated = np.sort(twice.toPandas()[key].to_numpy(np.int64))
    merged = None
    if len(repeated):
        merged = settle(merged_sets(docs.join(twice, key, "left_semi"), key, n))
        named = settle(named.join(twice, key, "left_anti").select(key, "class", "size").unionByName(merged_named(merged, key)))
    lead = named.where("class IS NOT NULL").groupBy("class").agg(F.min(key).alias("head"), F.count("*").alias("_c")).where("_c > 1")
    extra = settle(named.join(lead.select("class", "head"), "class").where(F.col(key) != F.col("head")).select(key, "head"))
    own = extra.toPandas()
    keys, heads = own[key].to_numpy(np.int64), own["head"].to_numpy(np.int64)
    order = np.lexsort((keys, heads))
    copies = sc.broadcast((heads[order], keys[order]))
    aside = sc.broadcast(np.sort(np.append(keys, repeated)))
    total = named.agg(F.sum("size").alias("s")).first()["s"] or 0
    parts = max(1, math.ceil(total / S.PART))
    dealt = packets(docs, key, n, parts, aside)
    if merged is not None:
        dealt = dealt.unionByName(merged_packets(merged, parts, sc.broadcast(np.sort(keys))))
    shared = settle(dealt.groupBy("part").applyInArrow(S._meet, S.SHARED))
    name, low, wide, narrow = smaller(shared, parts, threshold)
    long_lists = shared.mapInArrow(_long_entries, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    spread = sc.broadcast(blocks(name, low, wide, narrow, long_lists, 3 * sc.defaultParallelism))
    _, each = np.unique(heads, return_counts=True)
    tasks = max(1, math.ceil(int((each * (each + 1) // 2).sum()) / COPIES))
    found = block_pairs(lists(shared, parts, spread), spread, copies, threshold, digits)
    return found.unionByName(copy_pairs(extra, copies, tasks))


def _long_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, degree, *_ in S._parts(batches):
        yield pa.RecordBatch.from_arrays([pa.array([int(degree[degree > WIDE].sum(dtype=np.int64))])], ["n"])
