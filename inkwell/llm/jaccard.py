"""N-gram Jaccard join by vertical partitioning.

The global order of word 5-grams (by 64-bit hash) is cut into fragments, so a document becomes one segment
per fragment. Two sets that reach the threshold differ in at most k grams, so with k + 1 or more segments
that aren't empty one is equal in both: documents meet in buckets of equal segments. The overlap of a pair
is then counted fragment by fragment and summed.

* Sizes fall into intervals whose ends lie a factor 1 / threshold apart; a set joins the buckets of its own
  interval and of the next, so that every pair within reach meets in one. k follows from the interval.
* A set with too few filled segments (a matter of chance) also joins by its shortest sufficient prefix in
  the global order; two such sets meet there. No pair at or above the threshold is missed.
* Sets that are equal form a class, found by their own hash, and a class joins once. Buckets with the same
  members are one bucket.
* Buckets connect classes into clusters; a large bucket is cut into chunks that share a few of its classes. A
  cluster of bounded size goes to one task, which counts overlaps exactly and skips classes that are linked already.
  In a larger one, members of a bucket are compared with its first member, then with the next seven, and so on,
  eight times as many each round; sketches of the sets come first, then overlaps fragment by fragment. Members of one
  component need no comparison.

Scale: segments travel as arrays, one per task and vertical partition (12 bytes a segment); partitions
follow the input's size. The grams themselves travel only for classes that share a bucket: a bitmap of
fixed size, 2**27 bits at most, keeps the others back. Sets are taken for equal by 128 bits; grams by 64,
and only within a pair that is compared.

Defined results: null or empty text has no grams and links with nothing; a null doc_id never names a
component (a component of such rows only has a null one); repeated rows are linked; texts of any length are read
whole; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm import runs
from inkwell.llm.superkmer import _spread
from inkwell.llm.textbuf import LOWER, blocks, byte_hashes, cut_words, gram_hashes, mix, ship
from inkwell.operators.graph import components
from inkwell.session import settle

NONE = np.zeros(0, np.uint64)
N = 5
PERCENT = 80
#: Parts that verification cuts a set into.
FRAGMENTS = 4
FILTER_BITS = 1 << 27
#: Grams of a cluster that one task compares (64 MB).
CLUSTER = 8 << 20
#: Bytes of text that a vertical partition stands for: a class names itself once in each that it has segments in.
SHARE = 16 << 20
#: Classes of a bucket that one chunk holds, and those that every chunk of a larger bucket holds besides.
SPREAD, HEADS = 256, 8
#: Homes of the small buckets with one first class.
HOMES = 8
#: A gram is counted where a task's gathering of COUNTED grams has it LOCAL times; of the frequent ones so many are
#: listed (16 MB).
COUNTED, LOCAL, LISTED = 4_000_000, 3, 1 << 21


def doc_sets(buf: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of each row, joined, and the offsets of the rows."""
    low = LOWER[buf]
    starts, ends, row = cut_words(low, off)
    hashes = byte_hashes(low, starts, ends)
    rows = len(off) - 1
    words = np.bincount(row, minlength=rows)
    base = np.append(0, np.cumsum(words))
    grams = gram_hashes(hashes, n)
    out = []
    for i, (a, b) in enumerate(zip(base[:-1].tolist(), base[1:].tolist())):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(gram_hashes(hashes[a:b], b - a))
        else:
            out.append(grams[:0])
    return np.concatenate(out) if out else grams[:0], np.append(0, np.cumsum([len(x) for x in out])).astype(np.int64)


def _set_hash(flat: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(mix(flat ^ np.uint64(seed))))
    return mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64))


def set_class(flat: np.ndarray, off: np.ndarray, twins: np.ndarray = NONE) -> np.ndarray:
    """A 64-bit name of each set (0 for empty ones, which have none). Names among the sorted ``twins`` stand for
    unequal sets; these are named by their check as well."""
    name = _set_hash(flat, off, 0x6A09E667F3BCC909)
    if len(twins):
        two = np.flatnonzero(twins[np.minimum(np.searchsorted(twins, name), len(twins) - 1)] == name)
        name[two] = mix(name[two] ^ mix(set_check(flat, off)[two]))
    return np.where(np.diff(off) > 0, name, np.uint64(0))


def set_check(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64 further bits of each set."""
    return _set_hash(flat, off, 0x510E527FADE682D1)


def twin_names(found: DataFrame) -> np.ndarray:
    """Sorted names that unequal sets share, by their checks: of n sets some n * n / 2**65, so next to none."""
    own = found.where("class IS NOT NULL").groupBy("class").agg(F.min("check").alias("_lo"), F.max("check").alias("_hi"))
    rows = own.where("_lo <> _hi").select("class").toPandas()["class"].to_numpy()
    return np.sort(rows.astype(np.int64).view(np.uint64))


def intervals(percent: int, most: int) -> np.ndarray:
    """Last sizes of the intervals, up to one past that of ``most``."""
    out, low = [], 1
    while not out or len(out) < 2 or out[-2] < most:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return np.array(out, np.int64)


def segments(flat: np.ndarray, off: np.ndarray, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every segment that a set joins by; ``frequent`` grams, sorted, stay out of segments.

    Two sets within reach differ in at most k grams, frequent or not, so k + 1 filled segments of the others are
    enough whatever the list holds. The prefix that serves sets with fewer takes frequent grams last.
    """
    size = np.diff(off)
    last = intervals(percent, int(size.max()) if len(size) else 1)
    own = np.searchsorted(last, size)
    common = np.zeros(len(flat), bool)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)] == flat
    scrambled = mix(flat ^ np.uint64(0xBB67AE8584CAA73B))
    rows_out, sigs_out = [], []
    row = np.repeat(np.arange(len(size)), size)
    for step in (0, 1):
        level = own + step
        k = 2 * last[level] * (100 - percent) // (100 + percent)
        count = (115 * (k + 1) + 99) // 100 + 4
        live = (k > 0)[row] & ~common  # with k = 0 only equal sets link
        filled = np.zeros(len(size), np.int64)
        if live.any():
            h, r, s = flat[live], row[live], scrambled[live]
            part = (h >> np.uint64(32)) * count[r].astype(np.uint64) >> np.uint64(32)
            new = np.ones(len(h), bool)
            new[1:] = (part[1:] != part[:-1]) | (r[1:] != r[:-1])
            at = np.flatnonzero(new)
            many = np.diff(np.append(at, len(h))).astype(np.uint64)
            name = part[at] * np.uint64(0x9E3779B97F4A7C15) + level[r[at]].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + many
            rows_out.append(r[at])
            sigs_out.append(mix(np.add.reduceat(s, at) + mix(name)))
            filled = np.bincount(r[at], minlength=len(size))
        for i in np.flatnonzero((filled < k + 1) & (k > 0) & (size > 0)).tolist():
            n = int(size[i])
            prefix = n - -(-n * percent // 100) + 1
            values, rare = flat[off[i] : off[i + 1]], ~common[off[i] : off[i + 1]]
            first = np.concatenate([values[rare], values[~rare]])[:prefix]
            sigs_out.append(mix(first + mix(np.array([level[i] + 1], np.uint64) * np.uint64(0x165667B19E3779F9))))
            rows_out.append(np.full(prefix, i))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(sigs_out)


def _sketch(name: np.ndarray, flat: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bitmaps of sets: every gram flips one of as many bits as the power of two from the set's size on, 64 at
    least; the bitmaps' Hamming distance never exceeds the sets' difference. Offsets in words come along."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    start = np.append(0, np.cumsum(bits >> 6))
    row = np.repeat(np.arange(len(size)), size)
    at = (flat & (bits[row] - 1).astype(np.uint64)).astype(np.int64) + start[row] * 64
    odd = np.bincount(at, minlength=int(start[-1]) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8"), start


def classes(docs: DataFrame, n: int = N, twins: np.ndarray = NONE) -> DataFrame:
    """doc_id, n_shingles, class (null without words) and check of every document; a class' first row in a task has
    its bitmap. Rows with ``counts`` instead hold grams that several classes of a task share, with their number."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_shingles long, class long, check long, bitmap array<long>, counts binary"
    names = ["doc_id", "n_shingles", "class", "check", "bitmap", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        many = 0

        def counted() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held))
            at = runs.group_starts(values)
            times = np.diff(np.append(at, len(values)))
            often = times >= LOCAL
            data = values[at][often].tobytes() + times[often].astype("<i8").tobytes()
            null = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*null, pa.array([data], pa.binary())], names)

        for batch, buf, off in blocks(batches, "text"):
            flat, own = doc_sets(buf, off, n)
            name, size = set_class(flat, own, twins), np.diff(own)
            fresh = np.zeros(len(name), bool)
            for i, x in enumerate(name.tolist()):
                if x and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            grams = flat[np.repeat(fresh, size)]
            words, start = _sketch(name[fresh], grams, own, size[fresh])
            maps = iter(np.split(words.view(np.int64), start[1:-1]))
            bitmaps = [next(maps) if f else None for f in fresh.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(size), pa.array(name.view(np.int64), mask=size == 0), pa.array(set_check(flat, own).view(np.int64)), pa.array(bitmaps, pa.list_(pa.int64())), pa.nulls(len(size), pa.binary())], names
            )
            held.append(grams)
            many += len(grams)
            if many >= COUNTED:
                yield counted()
                held, many = [], 0
        if many:
            yield counted()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def frequent_grams(found: DataFrame, most: int = LISTED) -> np.ndarray:
    """Sorted grams that several classes hold, as counted by the tasks that met them repeatedly: at most ``most``,
    those of the highest powers of two if there are more.

    Which grams it holds only steers where sets meet, never the result.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                n = len(data) // 16
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, "<i8", n)), pa.array(np.frombuffer(data, "<i8", n, n * 8))], ["gram", "n"])

    counts = found.where("counts IS NOT NULL").select("counts").mapInArrow(spread, "gram long, n long")
    often = settle(counts.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= 2 * LOCAL))
    level = F.floor(F.log2("n"))
    least, listed = 64, 0
    for r in often.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # at most 64 rows
        listed += r["n"]
        if listed > most:
            break
        least = r["level"]
    rows = often.where(level >= least).select("gram").toPandas()["gram"].to_numpy()
    return np.sort(rows.astype(np.int64).view(np.uint64))


def buckets(docs: DataFrame, frequent: np.ndarray, n: int = N, percent: int = PERCENT, twins: np.ndarray = NONE, parts: int | None = None) -> DataFrame:
    """(bucket, node, size, place, lead, members): classes that share a segment, in order of their name, with the
    bucket's first class and its number of classes."""
    parts = parts or runs.partitions_for(docs, SHARE)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, many = [], 0

        def packets() -> pa.RecordBatch:
            sig, name, size = (np.concatenate(x) for x in zip(*held))
            rows = []
            for p, own in runs.split((sig >> np.uint64(33)).astype(np.int64) % parts):
                nodes, first, index = np.unique(name[own], return_index=True, return_inverse=True)
                rows.append((p, 0, (sig[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (sig[own] >> np.uint64(32)).astype(np.uint16), index.astype(np.uint32 if len(nodes) > 65535 else np.uint16), nodes, size[own][first].astype(np.int32)))
            return runs.packets(rows)

        for _, buf, off in blocks(batches, "text"):
            flat, own = doc_sets(buf, off, n)
            name = set_class(flat, own, twins)
            fresh = np.zeros(len(name), bool)
            for i, x in enumerate(name.tolist()):
                if x and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            keep = np.repeat(fresh, np.diff(own))
            own = np.append(0, np.cumsum(np.diff(own)[fresh]))
            row, sig = segments(flat[keep], own, percent, shared.value)
            name = name[fresh]
            held.append((sig, name[row], np.diff(own)[row]))
            many += len(sig)
            if many >= runs.GATHER:
                yield packets()
                held.clear()
                many = 0
        if many:
            yield packets()

    def meet(table: pa.Table) -> pa.Table:
        sig, name, size = [], [], []
        for i in range(table.num_rows):
            lo, hi, index, nodes, own = (table.column(c)[i].as_py() for c in "abcde")
            lo, hi, nodes, own = np.frombuffer(lo, "<u4"), np.frombuffer(hi, "<u2"), np.frombuffer(nodes, "<u8"), np.frombuffer(own, "<i4")
            at = np.frombuffer(index, "<u4" if len(nodes) > 65535 else "<u2")
            sig.append(lo.astype(np.uint64) | hi.astype(np.uint64) << np.uint64(32))
            name.append(nodes[at])
            size.append(own[at])
        sig, name, size = np.concatenate(sig), np.concatenate(name), np.concatenate(size)
        order = np.argsort(sig)  # groups of one, by far the most, go first
        at = runs.group_starts(sig[order])
        count = np.diff(np.append(at, len(sig)))
        order = order[np.repeat(count > 1, count)]
        order = order[np.lexsort((name[order], sig[order]))]
        s, v = sig[order], name[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])  # copies of a class from several tasks
        order, s = order[new], s[new]
        at = runs.group_starts(s)
        count = np.diff(np.append(at, len(s)))
        order = order[np.repeat(count > 1, count)]
        count = count[count > 1]
        at = np.cumsum(count) - count
        v = name[order]
        bucket = mix(np.add.reduceat(mix(v), at) + count.astype(np.uint64)) if len(at) else v[:0]
        _, once = np.unique(bucket, return_index=True)
        pick = np.zeros(len(at), bool)
        pick[once] = True
        place = np.arange(len(v)) - np.repeat(at, count)
        own = np.repeat(pick, count)
        each = lambda x: np.repeat(x, count)[own]
        return pa.table({"bucket": each(bucket).view(np.int64), "node": v[own].view(np.int64), "size": size[order][own].astype(np.int64), "place": place[own].astype(np.int32), "lead": each(v[at]).view(np.int64), "members": each(count).astype(np.int32)})

    found = docs.select("text").mapInArrow(emit, runs.PACKETS).groupBy("part").applyInArrow(meet, "bucket long, node long, size long, place int, lead long, members int")
    return found.dropDuplicates(["bucket", "node"])


def _bitmap(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the nodes' low bits, of bounded size."""
    count = nodes.count()
    bits = 1 << 15
    while bits < min(16 * count, FILTER_BITS):
        bits *= 2

    def slices(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << 15, bool)
        own[table.column("bit").to_numpy() & 32767] = True
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int64()), "data": pa.array([np.packbits(own).tobytes()], pa.binary())})

    bit = F.col("node").bitwiseAND(F.lit(bits - 1))
    rows = nodes.select(F.shiftright(bit, 15).alias("slice"), bit.alias("bit")).distinct().groupBy("slice").applyInArrow(slices, "slice long, data binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["slice"] * 4096 : (r["slice"] + 1) * 4096] = np.frombuffer(bytes(r["data"]), np.uint8)
    return out, bits


def fragments(docs: DataFrame, nodes: DataFrame, n: int = N, whole: bool = False, twins: np.ndarray = NONE) -> DataFrame:
    """(node, fragment, grams) of the classes among ``nodes`` and of few others; ``whole``: in one fragment, and
    once for each task that met the class."""
    bitmap, bits = _bitmap(nodes)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, set()
        for _, buf, off in blocks(batches, "text"):
            flat, own = doc_sets(buf, off, n)
            name = set_class(flat, own, twins)
            low = (name & np.uint64(bits - 1)).astype(np.int64)
            hit = (name != 0) & (wanted[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1 > 0)
            node, part, grams = [], [], []
            for i in np.flatnonzero(hit).tolist():
                if int(name[i]) in seen:
                    continue
                seen.add(int(name[i]))
                values = flat[own[i] : own[i + 1]]
                cuts = [] if whole else np.searchsorted(values, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(62))
                for f, piece in enumerate(np.split(values, cuts)):
                    node.append(int(name[i : i + 1].view(np.int64)[0]))
                    part.append(f)
                    grams.append(piece.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(part, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], ["node", "fragment", "grams"])

    found = docs.select("text").mapInArrow(run, "node long, fragment int, grams array<long>")
    if whole:
        return found
    return found.groupBy("node", "fragment").agg(F.first("grams").alias("grams"))  # a class may come from several tasks


def _fold(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bitmaps as rows of one width, longer ones folded to the shortest."""
    sizes = np.diff(offsets)
    least = int(sizes.min())
    out = np.zeros((len(sizes), least), np.uint64)
    for width in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == width)
        out[own] = np.bitwise_xor.reduce(words[_spread(offsets[own], np.full(len(own), width))].reshape(len(own), width // least, least), axis=1)
    return out


def possible_links(rows: DataFrame, found: DataFrame, parts: int, percent: int, spread: int = SPREAD, heads: int = HEADS) -> DataFrame:
    """(u, v) edges that connect classes of a bucket whose sketches allow a link; a task leaves out those that join
    what it has joined, so m classes give it fewer than m.

    A bucket of more than ``spread`` classes is cut into chunks, each with the bucket's first ``heads`` classes. That
    connects most of a group of near copies. What stays apart from the bucket's largest component then meets every
    chunk in blocks of as many, so that a task never holds more than two chunks' worth of a bucket.
    """
    maps = found.where("bitmap IS NOT NULL").select(F.col("class").alias("node"), "bitmap")
    maps = settle(maps.join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("bitmap").alias("bitmap")))
    chunk, chunks = F.floor(F.col("place") / spread), F.floor((F.col("members") - 1) / spread)
    large = F.col("members") > spread
    # buckets of one group mostly share their first class, so these go together, in a few homes for large groups
    small = rows.where(~large).select(F.xxhash64("lead", F.pmod("bucket", F.lit(HOMES))).alias("_home"), F.col("bucket").alias("tile"), F.lit(True).alias("asks"), F.col("node").alias("root"), "node", "size")
    own = rows.where(large).withColumn("_chunk", chunk)
    head = rows.where(large & (F.col("place") < heads)).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks)))
    tile = F.xxhash64("bucket", "_chunk")
    cut = own.unionByName(head).select(tile.alias("_home"), tile.alias("tile"), F.lit(True).alias("asks"), F.col("node").alias("root"), "node", "size").distinct()
    edges = _connected(small.unionByName(cut), maps, parts, percent)
    if rows.where(large).isEmpty():
        return edges
    stars = settle(components(edges))
    apart = settle(own.join(stars, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component"))
    per = apart.groupBy("bucket", "root").agg(F.count("*").alias("_n"))
    most = per.groupBy("bucket").agg(F.max_by("root", F.struct("_n", "root")).alias("_most"), F.sum("_n").alias("_all"), F.max("_n").alias("_in"))
    open_ = apart.join(most.where("_all > _in"), "bucket").withColumn("_blocks", F.floor((F.col("_all") - F.col("_in") - 1) / spread))
    asking = open_.where(F.col("root") != F.col("_most")).withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks") + 1))
    asking = asking.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks))).withColumn("asks", F.lit(True))
    asked = open_.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks")))).withColumn("asks", F.lit(False))
    tile = F.xxhash64("bucket", "_chunk", "_block")
    both = [x.select(tile.alias("_home"), tile.alias("tile"), "asks", "root", "node", "size") for x in (asking, asked)]
    return stars.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(_connected(both[0].unionByName(both[1]), maps, parts, percent))


def _connected(rows: DataFrame, maps: DataFrame, parts: int, percent: int) -> DataFrame:
    """(u, v) of nodes with one tile and different roots whose sketches allow a link; one of them asks."""
    placed = rows.join(maps, "node").select(F.pmod("_home", F.lit(parts)).alias("part"), "tile", "asks", "root", "node", "size", "bitmap")

    def connect(table: pa.Table) -> pa.Table:
        tile = table.column("tile").to_numpy()
        asks = table.column("asks").to_numpy()
        order = np.lexsort((table.column("node").to_numpy(), ~asks, tile))  # the same edges whatever order rows come in
        node, size = table.column("node").to_numpy()[order], table.column("size").to_numpy()[order]
        offsets, words = _lists(table.column("bitmap").take(pa.array(order)))
        words = words.view(np.uint64)
        at = runs.group_starts(tile[order])
        many = np.add.reduceat(asks[order].astype(np.int64), at)
        ids = np.unique(table.column("root").to_numpy()[order], return_inverse=True)[1]
        parent = np.arange(len(node))

        def tops(x: np.ndarray) -> np.ndarray:
            top = parent[x]
            while (parent[top] != top).any():
                top = parent[top]
            parent[x] = top
            return top

        u, v = [], []
        for a, b, asking in zip(at.tolist(), [*at[1:].tolist(), len(order)], many.tolist()):
            root = tops(ids[a:b])
            if (root == root[0]).all():
                continue
            bits, own = _fold(words, offsets[a : b + 1]), size[a:b]
            for i in range(min(asking, b - a - 1)):
                later = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
                later = later[np.minimum(own[i], own[later]) * 100 >= np.maximum(own[i], own[later]) * percent]
                if not len(later):
                    continue
                differ = np.bitwise_count(bits[later] ^ bits[i]).sum(1, dtype=np.int64)
                hit = later[differ * (100 + percent) <= (own[i] + own[later]) * (100 - percent)]
                if len(hit):
                    new = np.unique(root[hit], return_index=True)[1]
                    u += node[a + hit[new]].tolist()
                    v += [int(node[a + i])] * len(new)
                    parent[root[hit]] = root[i]
                    root = tops(ids[a:b])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return placed.groupBy("part").applyInArrow(connect, "u long, v long").distinct()


def near_sketches(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps differ in no more bits than sets within reach may."""
    left = maps.select(F.col("class").alias("a"), F.col("bitmap").alias("_a"))
    right = maps.select(F.col("class").alias("b"), F.col("bitmap").alias("_b"))
    both = pairs.join(left, "a").join(right, "b")

    def xor(x, y):
        return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def folded(long, short):  # twice as many bits fold into as many
        half = F.size(short)
        return xor(F.slice(long, F.lit(1), half), F.slice(long, half + 1, half))

    x, y = F.col("_a"), F.col("_b")
    mine = F.when(F.size(x) > F.size(y), folded(x, y)).otherwise(x)
    other = F.when(F.size(y) > F.size(x), folded(y, x)).otherwise(y)
    differ = F.aggregate(xor(mine, other), F.lit(0), lambda s, w: s + F.bit_count(w))
    return both.where(differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b", "na", "nb")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) with ``both``: partial overlaps counted per fragment, summed per pair."""
    left = sets.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("_a"))
    right = sets.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("_b"))
    cut = pairs.withColumn("fragment", F.explode(F.array(*[F.lit(f) for f in range(FRAGMENTS)])))
    partial = cut.join(left, ["a", "fragment"]).join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("_a", "_b")).cast("long").alias("part"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))


def cluster_links(table: pa.Table, percent: int) -> pa.Table:
    """(node, component) of whole clusters (node, cluster, grams), by exact overlaps.

    Every set marks its grams in turn; the marks in each fragment of a later set are their partial overlap, and
    the sum over the fragments is the pair's. Sets that are linked already, or whose sizes lie too far apart, aren't
    compared.
    """
    nodes, roots = [], []
    names = table.column("node").to_numpy()
    cluster = table.column("cluster").to_numpy()
    offsets, flat = _lists(table.column("grams"))
    for _, own in runs.split(np.unique(cluster, return_inverse=True)[1]):
        own = own[np.unique(names[own], return_index=True)[1]]  # a class may come from several tasks
        size = offsets[own + 1] - offsets[own]
        grams = flat[_spread(offsets[own], size)]
        universe, ids = np.unique(grams, return_inverse=True)
        base = np.append(0, np.cumsum(size))
        piece = (grams.view(np.uint64) >> np.uint64(62)).astype(np.int64)  # fragments of the global order
        cuts = np.stack([np.bincount(np.repeat(np.arange(len(own)), size)[piece == f], minlength=len(own)) for f in range(FRAGMENTS)], 1)
        root = np.arange(len(own))
        mark = np.zeros(len(universe), np.int64)
        for i in range(len(own) - 1):
            later = np.arange(i + 1, len(own))
            later = later[(root[later] != root[i]) & (np.minimum(size[later], size[i]) * 100 >= np.maximum(size[later], size[i]) * percent)]
            if not len(later):
                continue
            mine = ids[base[i] : base[i + 1]]
            mark[mine] = 1
            part = size[later]
            seen = np.append(0, np.cumsum(mark[ids[_spread(base[later], part)]]))
            ends = np.cumsum(cuts[later].ravel())
            partial = np.diff(np.append(0, seen[ends])).reshape(len(later), FRAGMENTS)
            both = partial.sum(1)
            mark[mine] = 0
            hit = later[both * 100 >= (size[i] + part - both) * percent]
            if len(hit):
                joined = np.unique(np.append(root[hit], root[i]))
                root[np.isin(root, joined)] = joined[0]
        nodes.append(names[own])
        roots.append(names[own][root])
    return pa.table({"node": np.concatenate(nodes), "component": np.concatenate(roots)})


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    offsets = whole.offsets.to_numpy().astype(np.int64)
    return offsets, whole.values.to_numpy()


def links(docs: DataFrame, found: DataFrame, n: int = N, percent: int = PERCENT, most: int = CLUSTER, twins: np.ndarray = NONE) -> DataFrame | None:
    """(node, component) of every class that shares a bucket, given ``classes``; None if none does.

    Classes of a bucket whose sketches allow a link are connected; outside the clusters that they form nothing can
    link. A cluster of up to ``most`` grams is
    settled by one task; the classes of larger ones are compared pair by pair in ``rounds_of``.
    """
    parts = runs.partitions_for(docs, SHARE)
    rows = settle(buckets(docs, frequent_grams(found), n, percent, twins, parts))
    if rows.isEmpty():
        return None
    cluster = components(possible_links(rows, found, parts, percent)).withColumnRenamed("component", "cluster")
    sized = settle(rows.select("node", "size").distinct().join(cluster, "node"))
    sums = sized.groupBy("cluster").agg(F.sum("size").alias("_grams"))
    large = settle(sums.where(F.col("_grams") > most).select("cluster"))
    small = sized.join(large, "cluster", "left_anti").select("node", "cluster")
    sets = fragments(docs, sized.select("node"), n, True, twins).join(small, "node")
    placed = sets.withColumn("part", F.pmod(F.xxhash64("cluster"), F.lit(parts)))
    out = placed.groupBy("part").applyInArrow(lambda t: cluster_links(t, percent), "node long, component long")
    if not large.isEmpty():
        rest = rounds_of(docs, found, settle(rows.join(sized.join(large, "cluster", "left_semi").select("node"), "node", "left_semi")), n, percent, twins)
        out = out if rest is None else out.unionByName(rest)
    return settle(out)


def rounds_of(docs: DataFrame, found: DataFrame, rows: DataFrame, n: int, percent: int, twins: np.ndarray = NONE) -> DataFrame | None:
    """(node, component) of linked classes in buckets of any size, members against one, eight, 64 ... leaders."""
    maps = found.where("bitmap IS NOT NULL").select("class", "bitmap").join(rows.select(F.col("node").alias("class")), "class", "left_semi")
    maps = settle(maps.groupBy("class").agg(F.first("bitmap").alias("bitmap")))
    tested = edges = group = None
    low, high = 0, 1
    while True:
        now = rows.withColumn("component", F.col("node")) if group is None else rows.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = now.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.max("place").alias("_last")).where((F.col("_lo") < F.col("_hi")) & (F.col("_last") > low))
        now = now.join(open_.select("bucket"), "bucket", "left_semi")
        # a large bucket's members are dealt by a salt, and its leaders go to all of them
        salts = F.floor((F.col("members") - 1) / SPREAD) + 1
        now = now.withColumn("_salt", F.pmod(F.xxhash64("node"), salts))
        lead = now.where((F.col("place") >= low) & (F.col("place") < high)).select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("_salt"), F.col("node").alias("_n"), F.col("size").alias("_s"), F.col("place").alias("_p"), F.col("component").alias("_c"))
        near = (F.least("_s", "size") * 100 >= F.greatest("_s", "size") * percent) & (F.col("place") > F.col("_p")) & (F.col("component") != F.col("_c"))
        first = F.col("_n") < F.col("node")
        pairs = (
            now.join(lead, ["bucket", "_salt"])
            .where(near)
            .select(F.least("_n", "node").alias("a"), F.greatest("_n", "node").alias("b"), F.when(first, F.col("_s")).otherwise(F.col("size")).alias("na"), F.when(first, F.col("size")).otherwise(F.col("_s")).alias("nb"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = settle(pairs)
        if not pairs.isEmpty():
            own = pairs.select("a", "b")
            tested = own if tested is None else tested.unionByName(own)
            likely = settle(near_sketches(pairs, maps, percent))
            if not likely.isEmpty():
                nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                good = overlaps(likely, fragments(docs, nodes, n, False, twins)).where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent)
                linked_now = settle(good.select(F.col("a").alias("u"), F.col("b").alias("v")))
                if not linked_now.isEmpty():
                    edges = linked_now if edges is None else edges.unionByName(linked_now)
                    group = settle(components(edges))
        elif open_.isEmpty():
            return group
        low, high = high, high * 8


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class and component_id (the smallest doc_id reachable by links) of every document."""
    return grouped(docs, n, percent)[0].drop("component")


def grouped(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, np.ndarray]:
    """As ``linked``, with the component by the name of one of its classes, which no other component has; and the
    names that need a check (``twin_names``)."""
    docs = docs.select("doc_id", "text")
    found = settle(classes(docs, n))
    twins = twin_names(found)
    if len(twins):
        found = settle(classes(docs, n, twins))
    group = links(docs, found, n, percent, twins=twins)
    own = found.where("counts IS NULL").select("doc_id", "n_shingles", "class")
    named = own.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("_least"))
    if group is None:
        top = named.select("class", F.col("class").alias("component"), F.col("_least").alias("component_id"))
    else:
        joined = named.join(group.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        least = joined.groupBy("component").agg(F.min("_least").alias("component_id"))
        top = joined.select("class", "component").join(least, "component").select("class", "component", "component_id")
    out = own.join(top, "class", "left")
    return out.select("doc_id", "n_shingles", "class", "component", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), twins


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns, whatever their names."""
    ship(docs.sparkSession)
    groups, twins = grouped(docs, n, percent)
    # the component's own row: that of the smallest id, nulls last, of the smallest class among equal ids
    first = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "class")
    chosen = groups.where("class IS NOT NULL").groupBy("component").agg(F.min(first).alias("_first"))
    keep = chosen.select(F.col("_first.doc_id").alias("id"), F.col("_first.class").alias("class"))
    row = T.StructType([T.StructField("class", T.LongType()), T.StructField("doc", docs.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in blocks(batches, "text"):
            flat, own = doc_sets(buf, off, n)
            name = pa.array(set_class(flat, own, twins).view(np.int64), mask=np.diff(own) == 0)
            yield pa.RecordBatch.from_arrays([name, pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))], ["class", "doc"])

    named = docs.mapInArrow(run, row)  # the document as one struct, so that no name can clash
    none = named.where("class IS NULL").select("doc")
    best = named.where("class IS NOT NULL").select(F.col("class").alias("own"), F.col("doc.doc_id").alias("own_id"), "doc")
    hit = best.join(keep, (F.col("own") == F.col("class")) & F.col("own_id").eqNullSafe(F.col("id")), "left_semi")
    return hit.dropDuplicates(["own_id", "own"]).select("doc").unionByName(none).select("doc.*")


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    """Contract query: set size and component of every document."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' ')))) WHEN len(ws) > 0 THEN [md5(array_to_string(ws, ' '))] ELSE [] END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS gram FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.g) + len(y.g) - c)),
n AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS root, a AS node FROM (SELECT DISTINCT a FROM n) UNION SELECT r.root, n.b FROM r JOIN n ON n.a = r.node)
SELECT s.doc_id, any_value(len(g))::BIGINT AS n_shingles, coalesce(min(root), s.doc_id) AS component_id FROM s LEFT JOIN r ON r.node = s.doc_id GROUP BY s.doc_id
"""
