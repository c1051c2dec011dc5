"""Substring dedup by super-k-mer partitioning: windows of 13 words that a smaller doc_id also has.

Consecutive windows that share a minimiser (the smallest hash of their runs of 5 words) travel as one
packed string to the minimiser's partition, where the windows are sorted by a 128-bit hash, compared byte by
byte and counted exactly; every window of a document other than the smallest is removed. ``runs`` has the exchange.

Defined results: null text has no words; a null doc_id counts as larger than any other; rows with the
same doc_id are not smaller than each other, so repeated rows keep the same words; texts of any length are read
whole; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm import runs
from inkwell.llm.textbuf import byte_hashes, cut_words, gram_hashes, mix, same_bytes, tidy

WINDOW = 13
GRAM = 5
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SPANS = "doc_id long, n_words long, starts array<int>, ends array<int>"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def word_runs(buf: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Words (starts, ends, row, first word of each row) and runs (row, first window, windows, minimiser)."""
    starts, ends, row = cut_words(buf, off)
    base = np.searchsorted(row, np.arange(len(off) - 1))
    hashes = byte_hashes(buf, starts, ends)
    n = len(starts) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return (starts, ends, row, base), (none, none, none, np.zeros(0, np.uint64))
    least = sliding_min(gram_hashes(hashes, gram), window - gram + 1)
    valid = row[:n] == row[window - 1 :]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1]) | ~valid[:-1]
    at = np.flatnonzero(new)
    stop = np.append(at[1:], n)
    count = np.add.reduceat(valid.astype(np.int64), at) if len(at) else stop[:0]
    return (starts, ends, row, base), (row[at], at, count, least[at])


def _ordinals(row: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each row; rows ascend."""
    at = runs.group_starts(row)
    return np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row))))


def _find(buf: np.ndarray, off: np.ndarray):
    _, (row, _, _, value) = word_runs(buf, off)
    return row, _ordinals(row), value, np.zeros(len(row), bool)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for count[i] values, joined."""
    total = np.cumsum(count)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - count, count) + np.repeat(first, count)


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as bytes with one space after each, and where each begins."""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    text = np.full(int(size.sum()), 32, np.uint8)
    text[_spread(at, size - 1)] = buf[_spread(starts, size - 1)]
    return text, at


def _removed(text: np.ndarray, size: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of packed strings (words ``joined``, ``size`` bytes each): its string, its place there, and
    whether a string of a smaller id has it too.

    Windows meet by 128 bits; every one is then compared with the first of its group byte by byte, and a
    group of unequal windows is settled by the bytes themselves.
    """
    starts, ends, row = cut_words(text, np.append(0, np.cumsum(size)))
    base = np.searchsorted(row, np.arange(len(size)))
    at = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    one = gram_hashes(byte_hashes(text, starts, ends, 1), window)[at]
    two = gram_hashes(byte_hashes(text, starts, ends, 2), window)[at]
    lo, hi, doc = starts[at], ends[at + window - 1], ids[row[at]]
    order = np.argsort(one)
    a, b = one[order], two[order]
    if ((b[1:] != b[:-1]) & (a[1:] == a[:-1])).any():  # the first hash alone isn't enough
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(a)))
    group = np.repeat(np.arange(len(first)), many)
    least = np.minimum.reduceat(doc[order], first)
    gone = np.zeros(len(at), bool)
    gone[order] = doc[order] > least[group]
    other = np.flatnonzero(~new)
    mine, lead = order[other], order[first[group[other]]]
    width = hi - lo
    equal = width[mine] == width[lead]
    equal[equal] = same_bytes(text, lo[mine[equal]], lo[lead[equal]], width[mine[equal]])
    for g in np.unique(group[other[~equal]]).tolist():
        low: dict[bytes, int] = {}
        own = order[first[g] : first[g] + many[g]].tolist()
        for i in own:
            piece = text[lo[i] : hi[i]].tobytes()
            low[piece] = min(low.get(piece, int(doc[i])), int(doc[i]))
        for i in own:
            gone[i] = doc[i] > low[text[lo[i] : hi[i]].tobytes()]
    return row[at], at - base[row[at]], gone


def _survivors(row, ordinal, keys, packets_table):
    """Positions of the runs that ``packets_table`` names by document key and ordinal."""
    key, ord_ = runs.gather(packets_table, 1, ["<i8", "<i4"])
    if not len(key) or not len(row):
        return np.zeros(0, np.int64)
    named = np.unique(np.stack([key, ord_.astype(np.int64)], 1), axis=0)
    wanted = mix(named[:, 0].view(np.uint64) if named[:, 0].flags.c_contiguous else np.ascontiguousarray(named[:, 0]).view(np.uint64)) + named[:, 1].astype(np.uint64)
    mine = mix(np.ascontiguousarray(keys[row]).view(np.uint64)) + ordinal.astype(np.uint64)
    return np.flatnonzero(np.isin(mine, wanted))


def repeated(docs: DataFrame, parts: int, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and packets of kind 3 at home: key (a), first and last word + 1 (b, c) of ranges
    covered by windows that a smaller document has."""
    own = runs.keyed(docs, parts)
    found = runs.shared_runs(own, parts, runs.Finder(_find, within=False))
    schema = pa.schema([("part", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcde")])

    def ranges(key: np.ndarray, home: np.ndarray, first: np.ndarray) -> list[tuple]:
        """Covered word ranges of removed windows, by document, as packets."""
        order = np.lexsort((first, key, home))
        key, home, first = key[order], home[order], first[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (home[1:] != home[:-1]) | (first[1:] > first[:-1] + window)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(key)) - 1
        return [(p, 3, key[at][i], first[at][i].astype(np.int32), (first[last][i] + window).astype(np.int32)) for p, i in runs.split(home[at])] if len(at) else []

    def cut(mine: pa.Table, named: pa.Table) -> pa.Table:
        if not mine.num_rows or not named.num_rows:
            return runs.empty(schema)
        wanted = np.unique(runs.gather(named, 1, ["<i8"])[0])
        mine = mine.filter(pa.array(np.isin(mine.column("key").to_numpy(), wanted)))
        held = []
        for batch, buf, off in runs.pieces(mine):
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(int(runs.LAST)).to_numpy(zero_copy_only=False)
            (starts, ends, _, base), (r, at, count, value) = word_runs(buf, off, window, gram)
            pick = _survivors(r, _ordinals(r), keys, named)
            if not len(pick):
                continue
            r, at, words, value = r[pick], at[pick], count[pick] + window - 1, value[pick]
            each = _spread(at, words)
            text, begin = joined(buf, starts[each], ends[each])
            edge = np.append(begin, len(text))[np.append(0, np.cumsum(words))]
            held.append((value, ids[r], keys[r], at - base[r], np.diff(edge), text))
        if not held:
            return runs.empty(schema)
        value, ids, key, start, size, text = (np.concatenate(x) for x in zip(*held))
        del held
        string, place, gone = _removed(text, size, ids, window)  # windows that this partition can settle itself
        home = mine.column("part")[0].as_py()
        rows = ranges(key[string[gone]], np.full(int(gone.sum()), home), start[string[gone]] + place[gone])
        open_ = np.flatnonzero(np.bincount(string[~gone], minlength=len(size)) > 0)
        begin = np.cumsum(size) - size
        for p, i in runs.split((value[open_] >> np.uint64(33)).astype(np.int64) % parts):
            i = open_[i]
            rows.append((p, 2, np.append(home, ids[i]), key[i], start[i].astype(np.int32), size[i].astype(np.int64), text[_spread(begin[i], size[i])]))
        return pa.Table.from_batches([runs.packets(rows)]).cast(schema)

    def count(table: pa.Table) -> pa.Table:
        tidy()
        kinds = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kinds == 3))]
        _, key, start, size, text = runs.gather(table, 2, ["<i8", "<i8", "<i4", "<i8", "u1"])
        if len(key):
            sent = [np.frombuffer(table.column("a")[int(i)].as_py(), "<i8") for i in np.flatnonzero(kinds == 2)]  # home, then ids
            ids, home = np.concatenate([x[1:] for x in sent]), np.concatenate([np.full(len(x) - 1, x[0]) for x in sent])
            string, place, gone = _removed(text, size, ids, window)
            if rows := ranges(key[string[gone]], home[string[gone]], start[string[gone]].astype(np.int64) + place[gone]):
                out.append(pa.Table.from_batches([runs.packets(rows)]).cast(table.schema))
        return pa.concat_tables(out)

    decided = runs.at_home(own, found, cut, runs.PACKETS).groupBy("part").applyInArrow(count, runs.PACKETS)
    return own, decided


def _covered(mine: pa.Table, named: pa.Table):
    """Blocks of documents with word bounds and which words are covered."""
    key, lo, hi = runs.gather(named, 3, ["<i8", "<i4", "<i4"])
    order = np.argsort(key)
    key, lo, hi = key[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    for batch, buf, off in runs.pieces(mine):
        keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
        starts, ends, row = cut_words(buf, off)
        base = np.searchsorted(row, np.arange(len(off)))
        a, b = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
        each, r = _spread(a, b - a), np.repeat(np.arange(len(keys)), b - a)
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, base[r] + lo[each], 1)
        np.add.at(change, base[r] + hi[each], -1)
        yield batch, buf, starts, ends, base, np.cumsum(change[:-1]) > 0


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document the word ranges to remove: doc_id, n_words, starts, ends (ends exclusive)."""
    own, decided = repeated(docs, runs.partitions_for(docs), window, gram)

    def collect(mine: pa.Table, named: pa.Table) -> pa.Table:
        ids, n, lo, hi = [], [], [], []
        for batch, _, _, _, base, gone in _covered(mine, named):
            ids += batch.column(0).to_pylist()
            for a, b in zip(base[:-1].tolist(), base[1:].tolist()):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
                n.append(b - a)
                lo.append(edge[::2].astype(np.int32))
                hi.append(edge[1::2].astype(np.int32))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "starts": pa.array(lo, pa.list_(pa.int32())), "ends": pa.array(hi, pa.list_(pa.int32()))})

    return runs.at_home(own, decided, collect, SPANS)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) and kept text."""
    own, decided = repeated(docs, runs.partitions_for(docs), window, gram)

    def remove(mine: pa.Table, named: pa.Table) -> pa.Table:
        ids, n, removed, sha, kept = [], [], [], [], []
        for batch, buf, starts, ends, base, gone in _covered(mine, named):
            ids += batch.column(0).to_pylist()
            text, at = joined(buf, starts[~gone], ends[~gone])
            edge = np.append(at, len(text))
            before = np.append(0, np.cumsum(~gone))
            for a, b in zip(base[:-1].tolist(), base[1:].tolist()):
                s, e = int(edge[before[a]]), int(edge[before[b]])
                value = text[s : max(s, e - 1)].tobytes()
                n.append(b - a)
                removed.append(b - a - int(before[b] - before[a]))
                sha.append(hashlib.sha256(value).hexdigest())
                kept.append(value.decode())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string())})

    return runs.at_home(own, decided, remove, RESULT + ", kept string")


def op10_superkmer(spark, sf_dir: str) -> DataFrame:
    """Contract query: words that remain of every document."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
l AS (SELECT k, min(doc_id) AS least FROM v GROUP BY k HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM v JOIN l USING (k) WHERE doc_id > least),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT x.doc_id, count(*) AS n, count(c.p) AS gone, string_agg(word, ' ' ORDER BY x.p) FILTER (c.p IS NULL) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
