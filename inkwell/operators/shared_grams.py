"""Links between texts by the n-grams they share, with grams as packed arrays.

Texts with equal sets of grams are one class, named by 64 bits of its set; copies never meet. Two classes link when the
grams they share exceed a share of the smaller set. Grams (64-bit hashes) travel as arrays, one per task and part of
the hash range, some 10 bytes each; what a single class has goes no further.

* A class whose grams are too rarely shared cannot be the smaller of any pair, which leaves out most texts that merely
  have a phrase in common.
* Grams of up to RARE classes are counted pair by pair.
* The others are a class' frequent set. Classes of equal frequent sets stand together: by frequent grams alone all of
  F and all of G link through whichever member is small enough for the overlap of F and G, so one comparison of the
  sets decides for all their members, and no pairs are listed. Pairs that also share rare grams are settled by both.
  Frequent sets are compared in one task, which keeps each distinct set once.

The links hold the components exactly; they are not all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import settle, ship

#: Classes up to which a gram is counted pair by pair.
RARE = 32
#: Grams that a task gathers before it deals them out, classes it may number in 16 bits, and grams of a part.
GATHERED, NUMBERED, PART = 4_000_000, 1 << 16, 4_000_000
#: Text bytes hashed at a time, and bytes from which a token is hashed by itself.
BLOCK, LONG = 1 << 20, 512

_STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_TOKEN = np.zeros(256, bool)
_TOKEN[97:123] = _TOKEN[39] = True
PACKET = "part int, high binary, mid binary, low binary, owner binary, name binary, size binary"
SHARED = "part int, gram binary, degree binary, owner binary, name binary, size binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every token, eight bytes a round, each round scrambled."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _STEP)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    lanes = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero(size <= LONG)
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix(out[live] * _BASE ^ (lanes[at] & _LOW[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def gram_sets(buf: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each row of lower-cased texts."""
    solid = np.zeros(len(buf) + 2, bool)
    solid[1:-1] = _TOKEN[buf]
    first, last = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    begins, stops = off[:-1][off[:-1] < len(buf)], off[1:][off[1:] > 0] - 1
    first[begins], last[stops] = solid[1:-1][begins], solid[1:-1][stops]  # no token crosses rows
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    base = np.searchsorted(starts, off).tolist()
    words = token_hashes(buf, starts, ends)
    count = max(0, len(words) - n + 1)
    grams = np.full(count, n, np.uint64)
    for i in range(n):
        grams = mix(grams * _BASE ^ words[i : i + count])
    return [np.unique(grams[a : b - n + 1]) if b - a >= n else grams[:0] for a, b in zip(base, base[1:])]


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Pieces of the batches with the sets of their last column."""
    for batch in batches:
        column = pc.fill_null(batch.column(batch.num_columns - 1).cast(pa.large_string()), "")
        if not len(column):
            continue
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK, "right")) - 1)
            yield batch.slice(at, to - at), gram_sets(buf[off[at] : off[to]], off[at : to + 1] - off[at], n)
            at = to


def _name(grams: np.ndarray) -> int:
    """A set's name, as Spark's long."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def named(docs: DataFrame, key: str, n: int) -> DataFrame:
    """key, class (null without grams) and size of every text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in _sets(batches, n):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_name(s) if len(s) else None for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int32())], [key, "class", "size"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, F.lower("text").alias("_t")).mapInArrow(run, f"`{key}` {kind}, class long, size int")


def least_shared(size: np.ndarray, threshold: float) -> np.ndarray:
    """The fewest shared grams that exceed the threshold of a set of this size."""
    low = np.floor(size * threshold).astype(np.int64)
    return low + ~(low / np.maximum(size, 1) > threshold)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(zip(*rows), kinds)], list(names)) if rows else pa.RecordBatch.from_pylist([], pa.schema([(a, of[k]) for a, k in zip(names, kinds)]))


def deal(held: dict[int, np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Sets by name, dealt out by the hash of their grams (PACKET)."""
    sets = list(held.values())
    size = np.array([len(s) for s in sets])
    name = np.fromiter(held, np.int64, len(held))
    grams = np.concatenate(sets)
    order = np.argsort(grams)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16 if len(sets) <= NUMBERED else np.uint32), size)[order]
    grams = grams[order]
    ends = np.searchsorted((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
    for p, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        if b > a:
            g, (there, own) = grams[a:b], np.unique(owner[a:b], return_inverse=True)
            yield _rows([(p, (g >> np.uint64(48)).astype(np.uint16).tobytes(), (g >> np.uint64(32)).astype(np.uint16).tobytes(), g.astype(np.uint32).tobytes(), own.astype(owner.dtype).tobytes(), name[there].tobytes(), size[there].astype(np.int32).tobytes())], PACKET)


def packets(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """Grams of every class a task sees, dealt out by hash (PACKET)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        for _, own in _sets(batches, n):
            for s in own:
                if len(s) and (name := _name(s)) not in held:
                    held[name] = s
                    total += len(s)
            if total >= GATHERED or len(held) > NUMBERED - 8192:
                yield from deal(held, parts)
                held, total = {}, 0
        if held:
            yield from deal(held, parts)

    return docs.select(F.lower("text").alias("_t")).mapInArrow(run, PACKET)


def _array(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _meet(table: pa.Table) -> pa.Table:
    """The grams of a part that several classes have (SHARED)."""
    grams, owners, names, sizes, ahead = [], [], [], [], 0
    for i in range(table.num_rows):
        high, mid, low = (_array(table[c][i], k).astype(np.uint64) for c, k in (("high", "u2"), ("mid", "u2"), ("low", "u4")))
        grams.append(high << np.uint64(48) | mid << np.uint64(32) | low)
        name = _array(table["name"][i], "i8")
        own = table["owner"][i].as_buffer()
        owners.append(np.frombuffer(own, "u2" if own.size == 2 * len(low) else "u4").astype(np.int64) + ahead)
        names.append(name)
        sizes.append(_array(table["size"][i], "i4"))
        ahead += len(name)
    name, at, number = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    size = np.concatenate(sizes)[at]
    gram, owner = np.concatenate(grams), number[np.concatenate(owners)].astype(np.uint32)
    del grams, owners
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    new = np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))  # a class may come from several tasks
    gram, owner = gram[new], owner[new]
    start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    degree = np.diff(np.append(start, len(gram)))
    many = degree > 1
    there, owner = np.unique(owner[np.repeat(many, degree)], return_inverse=True)
    row = (table["part"][0].as_py(), gram[start[many]].tobytes(), degree[many].astype(np.uint32).tobytes(), owner.astype(np.uint32).tobytes(), name[there].tobytes(), size[there].tobytes())
    return pa.Table.from_batches([_rows([row] if many.any() else [], SHARED)])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [_array(batch[c][i], k) for c, k in (("gram", "u8"), ("degree", "u4"), ("owner", "u4"), ("name", "i8"), ("size", "i4"))]


def able(shared: DataFrame, parts: int, threshold: float) -> np.ndarray:
    """Sorted names of the classes that share grams enough to be the smaller of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, count, size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for _, _, owner, own, sizes in _parts(batches):
            every, at, number = np.unique(np.append(name, own), return_index=True, return_inverse=True)
            size = np.append(size, sizes)[at]
            count = np.bincount(number, np.append(count, np.bincount(owner, minlength=len(own)))).astype(np.int64)
            name = every
        for a in range(0, len(name), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 65536], k) for x, k in ((name, pa.int64()), (count, pa.int64()), (size, pa.int32()))], ["class", "n", "size"])

    per = shared.coalesce(max(1, parts // 8)).mapInArrow(run, "class long, n long, size int").groupBy("class").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    return np.sort(per.where(F.col("n") / F.col("size") > threshold).select("class").toPandas()["class"].to_numpy(np.int64))


def _within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def rare_pairs(shared: DataFrame, small, rare: int) -> DataFrame:
    """a, b, n (shared rare grams) and size (of the smaller) of pairs whose smaller class is in ``small``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, degree, owner, name, size in _parts(batches):
            fit = _within(small.value, name)
            start = np.append(0, np.cumsum(degree, dtype=np.int64))[:-1]
            found = []
            for d in range(2, rare + 1):
                at = start[degree == d]
                x, y = np.triu_indices(d, 1)
                step = max(1, 1_000_000 // len(x))
                for i in range(0, len(at), step):
                    rows = owner[at[i : i + step, None] + np.arange(d)].astype(np.int64)
                    a, b = rows[:, x].ravel(), rows[:, y].ravel()
                    keep = fit[np.where(size[a] <= size[b], a, b)]
                    found.append(np.unique(a[keep] * len(name) + b[keep], return_counts=True))
            if not found:
                continue
            pair, number = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
            count = np.bincount(number, np.concatenate([c for _, c in found]), len(pair)).astype(np.int32)
            a, b = pair // len(name), pair % len(name)
            for i in range(0, len(pair), 65536):
                p, q = a[i : i + 65536], b[i : i + 65536]
                columns = (np.minimum(name[p], name[q]), np.maximum(name[p], name[q]), count[i : i + 65536], np.minimum(size[p], size[q]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n", "size"])

    return shared.mapInArrow(run, "a long, b long, n int, size int").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("size").alias("size"))


def frequent_sets(shared: DataFrame, rare: int) -> DataFrame:
    """class, size and sorted grams that more than ``rare`` classes have, of every class with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, degree, owner, name, size in _parts(batches):
            keep = np.repeat(degree > rare, degree)
            own, g = owner[keep], np.repeat(gram, degree)[keep].view(np.int64)
            order = np.argsort(own, kind="stable")
            own, g = own[order], g[order]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(own)), pa.int32()), pa.array(g, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(name[own[begin]], pa.int64()), pa.array(size[own[begin]], pa.int32()), lists], ["class", "size", "grams"])

    return shared.mapInArrow(run, "class long, size int, grams array<long>").groupBy("class").agg(F.max("size").alias("size"), F.sort_array(F.flatten(F.collect_list("grams"))).alias("grams"))


def joined_sets(sets: list[np.ndarray], size: np.ndarray, threshold: float) -> np.ndarray:
    """For each distinct frequent set, with the size of its smallest class, the set it is joined to (-1: to none, not
    even its own classes to each other). Sets in one component carry the same number."""
    length = np.array([len(s) for s in sets], np.int64)
    need = least_shared(size.astype(np.int64), threshold)
    owner = np.repeat(np.arange(len(sets)), length)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    base = np.append(0, np.cumsum(length))
    order = np.argsort(flat, kind="stable")
    held, ends = owner[order], np.append(0, np.cumsum(np.bincount(flat)))
    label = np.arange(len(sets))
    inside = np.zeros(len(sets), bool)
    members = {i: [i] for i in range(len(sets))}
    for f in np.lexsort((-length, need)).tolist():
        if need[f] > length[f]:
            continue
        inside[f] = True
        own = flat[base[f] : base[f + 1]]
        others = np.concatenate([held[ends[w] : ends[w + 1]] for w in own.tolist()])
        others = others[(label[others] != label[f]) | ~inside[others]]
        for g in np.flatnonzero(np.bincount(others) >= need[f]).tolist() if len(others) else ():
            inside[g] = True
            x, y = int(label[f]), int(label[g])
            if x != y:
                x, y = (x, y) if len(members[x]) >= len(members[y]) else (y, x)
                label[members[y]] = x
                members[x] += members.pop(y)
    return np.where(inside, label, -1)


def frequent_links(sets: DataFrame, threshold: float) -> DataFrame:
    """u, v: links that connect the classes which frequent grams alone link."""
    distinct = sets.groupBy("grams").agg(F.min("size").alias("size"), F.min("class").alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        own = pa.Table.from_batches(held)
        flat, lengths = pc.list_flatten(own["grams"]).to_numpy(), pc.list_value_length(own["grams"]).to_numpy()
        head = own["head"].to_numpy()
        to = joined_sets(np.split(flat, np.cumsum(lengths)[:-1]), own["size"].to_numpy(), threshold)
        keep = to >= 0
        yield pa.RecordBatch.from_arrays([pa.array(head[keep]), pa.array(head[to[keep]])], ["u", "v"])

    heads = settle(distinct.select("grams", "size", "head").coalesce(1).mapInArrow(run, "u long, v long"))
    lead = distinct.select("grams", "head").join(heads.select(F.col("u").alias("head")), "head", "left_semi")
    members = sets.join(lead, "grams").select(F.col("class").alias("u"), F.col("head").alias("v"))
    return heads.unionByName(members)


def links(docs: DataFrame, classes: DataFrame, threshold: float, n: int, rare: int = RARE) -> DataFrame:
    """u, v: links between classes that connect those of every pair above the threshold; a class may link to itself."""
    spark = docs.sparkSession
    ship(spark)
    total = classes.agg(F.sum("size").alias("s")).first()["s"] or 0
    parts = max(1, math.ceil(total / PART))
    shared = settle(packets(docs, n, parts).groupBy("part").applyInArrow(_meet, SHARED))
    small = spark.sparkContext.broadcast(able(shared, parts, threshold))
    sets = settle(frequent_sets(shared, rare))
    pairs = rare_pairs(shared, small, rare)
    of = lambda c: sets.select(F.col("class").alias(c), F.size("grams").alias(f"_{c}"))
    most = F.col("n") + F.least(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)))
    open_pairs = settle(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(most / F.col("size") > threshold).select("a", "b", "n", "size"))
    sure = open_pairs.where(F.col("n") / F.col("size") > threshold)
    both = open_pairs.where(~(F.col("n") / F.col("size") > threshold))
    both = both.join(sets.select(F.col("class").alias("a"), F.col("grams").alias("_ga")), "a").join(sets.select(F.col("class").alias("b"), F.col("grams").alias("_gb")), "b")
    both = both.where((F.col("n") + F.size(F.array_intersect("_ga", "_gb"))) / F.col("size") > threshold)
    found = sure.select("a", "b").unionByName(both.select("a", "b")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return found.unionByName(frequent_links(sets, threshold))
