"""Repeated passages across a corpus: the exchange that the two substring operators share.

A window of fixed length takes the smallest hash among its k-grams as its minimiser; consecutive windows
with the same minimiser form a run. Equal windows have equal minimisers, so a run whose minimiser
occurs nowhere else holds no repeat. Three exchanges follow from that:

1. runs -> vertical partition of the minimiser: which minimisers occur twice (hashes only);
2. documents with such runs cut them out and send each as one packed string to its minimiser's
   partition, where an operator decides window by window;
3. the decided ranges return to the document's home partition.

Rows between steps are binary arrays, one per task and partition, so that Spark moves a few large rows
instead of one per run. Skew: a task sends a minimiser that it has seen in several documents once, and
settles those documents itself, so a passage held by a third of all rows reaches its partition once per
task. Partitions follow the input's size, so a task holds a bounded share of it.

A document is named by its home partition and a key within it, two independent hashes of its doc_id and text; rows
equal in both are the same to every step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.textbuf import blocks, ship, tidy

#: Bytes of text a partition stands for, and runs a task gathers before it sends them.
SHARE = 7 << 20
GATHER = 1_000_000

PACKETS = "part long, kind int, a binary, b binary, c binary, d binary, e binary"
LAST = np.iinfo(np.int64).max


def partitions_for(docs: DataFrame, share: int = SHARE) -> int:
    """Vertical partitions for documents: the session's shuffle partitions, or as many as the bytes of their texts,
    counted in one pass, need."""
    session = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(session, min(size // share, 1 << 20))


def keyed(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, the document's key and its home partition."""
    home = F.pmod(F.xxhash64(F.lit("home"), F.coalesce("doc_id", F.lit(0)), "text"), F.lit(parts))
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), home.alias("part"))


def packets(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (part, kind, array...) as a batch of PACKETS; arrays travel as their bytes."""
    arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())]
    for i in range(5):
        arrays.append(pa.array([x[2 + i] if isinstance(x[2 + i], bytes) else np.ascontiguousarray(x[2 + i]).tobytes() if len(x) > 2 + i else None for x in ([*r, *[b""] * 5] for r in rows)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["part", "kind", "a", "b", "c", "d", "e"])


def split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions) of each value of ``part``."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 65536 else part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(part[own[0]]), own


def gather(table: pa.Table, kind: int, dtypes: list[str]) -> list[np.ndarray]:
    """The arrays of all packets of a kind, joined."""
    rows = np.flatnonzero(table.column("kind").to_numpy() == kind)
    out = []
    for name, dtype in zip("abcde", dtypes):
        values = table.column(name)
        out.append(np.frombuffer(b"".join(values[int(i)].as_py() or b"" for i in rows), dtype))
    return out


def group_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


@dataclass(frozen=True)
class Finder:
    """find(buf, off) -> row, ordinal in the row, minimiser and whether the run repeats within itself,
    for every run; ``within``: a repeat inside one document counts too."""

    find: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    within: bool


def _shared(value: np.ndarray, key: np.ndarray, home: np.ndarray, order: np.ndarray, mark: np.ndarray, within: bool) -> np.ndarray:
    """For sorted rows, whether each one's minimiser occurs elsewhere (``mark``: known to)."""
    v, k, h = value[order], key[order], home[order]
    at = group_starts(v)
    size = np.diff(np.append(at, len(v)))
    if within:
        found = size > 1
    else:
        found = (np.maximum.reduceat(k, at) != np.minimum.reduceat(k, at)) | (np.maximum.reduceat(h, at) != np.minimum.reduceat(h, at))
    # a marked row stands for several documents of its task: with it, one more row is enough
    found |= (np.add.reduceat(mark[order].astype(np.int64), at) > 0) & (size > 1)
    return np.repeat(found, size)


def shared_runs(docs: DataFrame, parts: int, finder: Finder) -> DataFrame:
    """Packets of kind 1 at home: document keys (a) and ordinals (b) of runs whose minimiser recurs."""

    def results(key: np.ndarray, home: np.ndarray, ordinal: np.ndarray) -> list[tuple]:
        return [(p, 1, key[own], ordinal[own].astype(np.int32)) for p, own in split(home)] if len(key) else []

    def send(value: np.ndarray, key: np.ndarray, home: np.ndarray, ordinal: np.ndarray, inner: np.ndarray) -> list[tuple]:
        order = np.argsort(value)
        shared = np.zeros(len(value), bool)
        shared[order] = _shared(value, key, home, order, np.zeros(len(value), bool), finder.within)
        rows = results(key[shared | inner], home[shared | inner], ordinal[shared | inner])
        first = np.zeros(len(value), bool)
        first[order[group_starts(value[order])]] = True
        out = np.flatnonzero(~shared | first)
        for p, own in split((value[out] >> np.uint64(33)).astype(np.int64) % parts):
            own = out[own]
            by = np.lexsort((home[own], key[own]))
            new = np.ones(len(own), bool)
            new[1:] = (np.diff(key[own][by]) != 0) | (np.diff(home[own][by]) != 0)
            index = np.empty(len(own), np.uint32)
            index[by] = np.cumsum(new) - 1
            docs_of = np.stack([key[own][by][new], home[own][by][new]], 1)
            rows.append((p, 0, value[own], docs_of, index, ordinal[own].astype(np.uint32), shared[own].astype(np.uint8)))
        return rows

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch, buf, off in blocks(batches, "text"):
            row, ordinal, value, inner = finder.find(buf, off)
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            homes = batch.column(batch.schema.get_field_index("part")).to_numpy(zero_copy_only=False)
            held.append((value, keys[row], homes[row], ordinal, inner))
            n += len(value)
            if n >= GATHER:
                yield packets(send(*(np.concatenate(x) for x in zip(*held))))
                held, n = [], 0
        if n:
            yield packets(send(*(np.concatenate(x) for x in zip(*held))))

    def decide(table: pa.Table) -> pa.Table:
        tidy()
        kinds = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kinds == 1))]
        mine = table.filter(pa.array(kinds == 0))
        if mine.num_rows:
            each = [gather(mine.slice(i, 1), 0, ["<u8", "<i8", "<u4", "<u4", "u1"]) for i in range(mine.num_rows)]
            value, key, home, ordinal, mark = (np.concatenate(x) for x in zip(*((v, d[0::2][i], d[1::2][i], o, m) for v, d, i, o, m in each)))
            order = np.argsort(value)
            hit = np.zeros(len(value), bool)
            hit[order] = _shared(value, key, home, order, mark > 0, finder.within)
            hit &= mark == 0
            if rows := results(key[hit], home[hit], ordinal[hit]):
                out.append(pa.Table.from_batches([packets(rows)]).cast(table.schema))
        return pa.concat_tables(out)

    ship(docs.sparkSession)
    return docs.select("text", "key", "part").mapInArrow(emit, PACKETS).groupBy("part").applyInArrow(decide, PACKETS)


def at_home(docs: DataFrame, found: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Bring packets to their documents: work(documents, packets) for each home partition."""

    def run(mine: pa.Table, named: pa.Table) -> pa.Table:
        tidy()
        return work(mine, named)

    return docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, schema)


def empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


def pieces(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of the documents of a home partition."""
    yield from blocks(table.to_batches(), "text")
