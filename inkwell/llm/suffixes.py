"""Suffix-array dedup: longest-previous-factor arrays over packed runs.

Inside a text, suffixes are sorted by prefix doubling; for each position the previous and next smaller
positions in suffix order give the longest earlier match (LPF), and the previous and next larger ones the
longest later match. A stretch whose earlier match is long enough is a later copy: ``dedup`` removes those
and keeps the first, or removes every copy (``keep_first=False``), as the contract query asks.

Across the corpus: runs of 200-byte windows with equal minimisers (32-byte grams) that recur are cut out,
and each distinct string travels once per task to its minimiser's partition, where the arrays are built
over batches of whole minimisers, or of contexts of a frequent one (``runs`` has the exchange). A string that a
task holds twice is settled there; the others come back with their ranges.

"First" is the smallest (doc_id, offset); a null doc_id counts as the largest. Defined results: null text
is empty; repeated rows are copies of each other; matches never cross documents. With ``keep_first`` a
repeated row (same doc_id and text) has no order among its like, so each of them counts as the first. Texts of any
length are read whole; an empty table gives an empty result; other columns may have any name. Whole strings are equal by
128 bits of BLAKE2b, parts of strings by the arrays themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm import runs
from inkwell.llm.superkmer import _ordinals, _spread, _survivors, sliding_min
from inkwell.llm.textbuf import prefix, rolling_hash, span_union, tidy

WINDOW = 200
GRAM = 32
#: Bytes of one suffix array. A minimiser with more distinct strings is split by the bytes around it; only strings of one
#: context have an array of their own size.
BATCH = 1 << 20
BARRIER = 255  # never a byte of UTF-8
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def suffix_ranks(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of every suffix by its first ``length`` bytes) for 8, 16, ... up to ``depth``."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= wide[j : n + j] << np.uint64(56 - 8 * j)
    levels, length = [], 8
    while True:
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        levels.append((length, rank.astype(np.int32)))
        if length >= depth or rank[order[-1]] == n - 1:
            return levels
        after = np.full(n, -1, np.int64)
        after[: n - length] = rank[length:]
        key = (rank.astype(np.uint64) << np.uint64(32)) | (after + 1).astype(np.uint64)
        length *= 2


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by at least their first ``depth`` bytes, and the length shared with the one before
    (exact below ``depth``)."""
    levels = suffix_ranks(text, depth)
    order = np.argsort(levels[-1][1])
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    n, got = len(text), np.zeros(max(0, len(text) - 1), np.int64)
    for length, rank in reversed(levels):
        x, y = a + got, b + got
        same = (np.maximum(x, y) + length <= n) & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        got += same * length
    going = np.ones(len(got), bool)
    for _ in range(7):
        x, y = a + got, b + got
        going &= (np.maximum(x, y) < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
        got += going
    return order, np.append(0, got)


def _smaller_before(value: np.ndarray, shared: np.ndarray, floor: int) -> np.ndarray:
    """For each place of the order, the length shared with the nearest smaller value before it, where it is
    at least ``floor``."""
    n = len(value)
    to = np.arange(n) - 1
    least = shared.copy()
    open_ = np.flatnonzero((to >= 0) & (value[np.maximum(to, 0)] > value) & (least >= floor))
    while len(open_):
        p = to[open_]
        least[open_] = np.minimum(least[open_], least[p])
        to[open_] = to[p]
        p = to[open_]
        open_ = open_[(p >= 0) & (value[np.maximum(p, 0)] > value[open_]) & (least[open_] >= floor)]
    least[(to < 0) | (least < floor)] = 0
    return least


def longest_previous_factor(text: np.ndarray, depth: int, order: np.ndarray | None = None, shared: np.ndarray | None = None, floor: int = 1) -> np.ndarray:
    """For each position the longest match that starts earlier in the text: exact below ``depth`` bytes,
    at least ``depth`` for longer ones, and 0 below ``floor``."""
    if order is None:
        order, shared = suffix_array(text, depth)
    before = _smaller_before(order, shared, floor)
    back = np.append(0, shared[:0:-1])
    after = _smaller_before(order[::-1], back, floor)[::-1]
    out = np.zeros(len(text), np.int64)
    out[order] = np.maximum(before, after)
    return out


def longest_factors(text: np.ndarray, depth: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Longest earlier and longest later match of each position."""
    order, shared = suffix_array(text, depth)
    n = len(text)
    earlier = longest_previous_factor(text, depth, order, shared, floor)
    later = longest_previous_factor(text, depth, n - 1 - order, shared, floor)[::-1]  # later positions are smaller when counted from the end
    return earlier, later


def byte_runs(buf: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of windows with one minimiser: row, first window, windows, minimiser, repeats within."""
    none = np.zeros(0, np.int64)
    n = len(buf) - window + 1
    if n < 1:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    sums = prefix(buf)
    at = np.arange(len(buf) - gram + 1)
    value = rolling_hash(sums, at, at + gram)
    wide = window - gram
    least = sliding_min(value, wide + 1)
    sizes = np.diff(off)
    valid = np.zeros(n + 1, np.int64)
    long_enough = sizes >= window
    np.add.at(valid, off[:-1][long_enough], 1)
    np.add.at(valid, off[1:][long_enough] - window + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first = off[:-1][long_enough]
    new[first] = True
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    count = np.add.reduceat(valid.astype(np.int64), start)
    # A run repeats within itself if its minimiser has several places in it.
    run_of = np.cumsum(new) - 1
    opens = np.flatnonzero((value[:n] == least) & valid)
    closes = np.flatnonzero((value[wide : wide + n] == least) & valid)
    lo = np.full(len(start), np.iinfo(np.int64).max)
    np.minimum.at(lo, run_of[opens], opens)
    hi = np.full(len(start), -1)
    np.maximum.at(hi, run_of[closes], closes + wide)
    inner = (count > wide + 1) | ((hi >= 0) & (lo < hi))
    return np.searchsorted(off, start, "right") - 1, start, count, least[start], inner


def _find(buf: np.ndarray, off: np.ndarray):
    row, _, _, value, inner = byte_runs(buf, off)
    return row, _ordinals(row), value, inner


def _text_keys(texts: list[bytes]) -> np.ndarray:
    """128 bits of the BLAKE2b digest of each string, as rows of two numbers."""
    joined = b"".join([hashlib.blake2b(t, digest_size=16).digest() for t in texts])
    return np.frombuffer(joined, "<u8").reshape(-1, 2)


def repeated(docs: DataFrame, parts: int, keep_first: bool, window: int = WINDOW, gram: int = GRAM, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and packets of kind 3 at home: key (a), first and last byte + 1 (b, c) of ranges
    to remove."""
    own = runs.keyed(docs, parts)
    found = runs.shared_runs(own, parts, runs.Finder(_find, within=True))
    schema = pa.schema([("part", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcde")])

    def answers(key: np.ndarray, home: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple]:
        return [(p, 3, key[i], lo[i].astype(np.int64), hi[i].astype(np.int64)) for p, i in runs.split(home)] if len(key) else []

    def cut(mine: pa.Table, named: pa.Table) -> pa.Table:
        if not mine.num_rows or not named.num_rows:
            return runs.empty(schema)
        wanted = np.unique(runs.gather(named, 1, ["<i8"])[0])
        mine = mine.filter(pa.array(np.isin(mine.column("key").to_numpy(), wanted)))
        held = []
        for batch, buf, off in runs.pieces(mine):
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(int(runs.LAST)).to_numpy(zero_copy_only=False)
            row, at, count, value, _ = byte_runs(buf, off, window, gram)
            pick = _survivors(row, _ordinals(row), keys, named)
            if not len(pick):
                continue
            row, at, value, stop = row[pick], at[pick], value[pick], at[pick] + count[pick] + window - 1
            strings = [buf[a:b].tobytes() for a, b in zip(at.tolist(), stop.tolist())]
            held.append((value, ids[row], keys[row], at - off[row], stop - at, _text_keys(strings), strings))
        if not held:
            return runs.empty(schema)
        value, ids, key, start, size, digest = (np.concatenate([h[i] for h in held]) for i in range(6))
        texts = [t for h in held for t in h[6]]
        order = np.lexsort((start, ids, digest[:, 1], digest[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (digest[order[1:]] != digest[order[:-1]]).any(1)
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(order)))
        leader = np.repeat(order[first], many)
        if keep_first:  # copies of the first one here go; it is sent itself
            gone = order[(ids[order] != ids[leader]) | (start[order] != start[leader])]
            asks = np.ones(len(first), bool)
        else:
            gone = order[np.repeat(many > 1, many)]
            asks = many == 1
        home = np.full(len(key), mine.column("part")[0].as_py())
        rows = answers(key[gone], home[gone], start[gone], start[gone] + size[gone])
        sent = order[first]
        for p, i in runs.split((value[sent] >> np.uint64(33)).astype(np.int64) % parts):
            j = sent[i]
            meta = np.stack([ids[j], key[j], start[j], size[j], home[j] * 2 + asks[i]], 1)
            rows.append((p, 2, value[j], meta, b"".join(texts[x] for x in j.tolist())))
        return pa.Table.from_batches([runs.packets(rows)]).cast(schema)

    def decide(table: pa.Table) -> pa.Table:
        tidy()
        kinds = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kinds == 3))]
        value, meta, text = runs.gather(table, 2, ["<u8", "<i8", "u1"])
        if len(value):
            ids, key, start, size, origin = meta.reshape(-1, 5).T
            home, asks = origin >> 1, origin & 1
            end = np.cumsum(size)
            digest = _text_keys([text[a:b].tobytes() for a, b in zip((end - size).tolist(), end.tolist())])
            order = np.lexsort((start, ids, digest[:, 1], digest[:, 0], value))
            new = np.ones(len(order), bool)
            new[1:] = (digest[order[1:]] != digest[order[:-1]]).any(1)
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(order)))
            who, lo, hi = [], [], []
            leader = np.repeat(order[first], many)
            if keep_first:
                whole = order[(ids[order] != ids[leader]) | (start[order] != start[leader])]
            else:
                whole = order[np.repeat(many > 1, many) & (asks[order] > 0)]
            who.append(whole); lo.append(start[whole]); hi.append(start[whole] + size[whole])  # noqa: E702
            # Of equal strings one goes on, with the strings that share its minimiser.
            kept = order[first]
            settled = (many > 1) | (asks[kept] == 0)
            bounds = np.append(runs.group_starts(value[kept]), len(kept))
            if not keep_first:  # a string that is settled and alone with its minimiser has no one to serve
                alone = np.repeat(np.diff(bounds) == 1, np.diff(bounds))
                kept, settled = kept[~(alone & settled)], settled[~(alone & settled)]
            bounds = np.append(runs.group_starts(value[kept]), len(kept))
            weight = np.cumsum(size[kept] + 1)
            a = 0
            while a < len(bounds) - 1:
                done = weight[bounds[a] - 1] if bounds[a] else 0
                b = max(a + 1, int(np.searchsorted(weight[bounds[1:] - 1], done + batch, "right")))
                part = np.arange(bounds[a], bounds[b])
                heavy = weight[part[-1]] - done > batch
                for own in _by_context(part, kept, text, end, size, value, window, gram, batch) if heavy else [part]:
                    for one in _ranges(kept[own], settled[own], text, end, ids, start, size, keep_first, window):
                        who.append(one[0]); lo.append(start[one[0]] + one[1]); hi.append(start[one[0]] + one[2])  # noqa: E702
                a = b
            who = np.concatenate(who)
            if rows := answers(key[who], home[who], np.concatenate(lo), np.concatenate(hi)):
                out.append(pa.Table.from_batches([runs.packets(rows)]).cast(table.schema))
        return pa.concat_tables(out)

    decided = runs.at_home(own, found, cut, runs.PACKETS).groupBy("part").applyInArrow(decide, runs.PACKETS)
    return own, decided


def _by_context(part, kept, text, end, size, value, window, gram, batch):
    """Sets of strings (of ``part``) with one minimiser, of about ``batch`` bytes, so that equal windows meet in one.

    A window holds half of what it has besides the minimiser either after it or before it, so strings meet by as many
    bytes after the minimiser, and by as many before it. A string may be in several sets, but once in each.
    """
    half = (window - gram) // 2
    groups: dict[tuple[bool, bytes], list[int]] = {}
    for i in part.tolist():
        j = kept[i]
        own = text[end[j] - size[j] : end[j]]
        at = np.arange(len(own) - gram + 1)
        for o in np.flatnonzero(rolling_hash(prefix(own), at, at + gram) == value[j]).tolist():
            after, before = own[o + gram : o + gram + half], own[max(0, o - half) : o]
            for side, context in ((True, after), (False, before)):
                if len(context) == half:
                    groups.setdefault((side, context.tobytes()), []).append(i)
    held: list[int] = []
    total = 0
    for members in groups.values():
        if len(members) < 2:
            continue
        more = sum(int(size[kept[i]]) + 1 for i in set(members))
        if held and total + more > batch:
            yield np.unique(held)
            held, total = [], 0
        held += members
        total += more
    if held:
        yield np.unique(held)


def _ranges(kept, settled, text, end, ids, start, size, keep_first, window):
    """(strings, from, to): removed ranges of distinct strings, by factor arrays over their joined text."""
    order = np.lexsort((start[kept], ids[kept]))  # earlier documents come first in the text
    own = kept[order]
    done = settled[order]
    sizes = size[own]
    if len(own) < 1:
        return
    at = np.append(0, np.cumsum(sizes + 1))
    joined = np.full(int(at[-1]), BARRIER, np.uint8)
    joined[_spread(at[:-1], sizes)] = text[_spread(end[own] - sizes, sizes)]
    earlier, later = longest_factors(joined, window, window)
    match = earlier >= window
    if not keep_first:
        match |= later >= window
    hit = np.flatnonzero(match)
    which = np.searchsorted(at, hit, "right") - 1
    whole = hit + window < at[which + 1]  # others run over a barrier
    hit, which = hit[whole], which[whole]
    if not keep_first:  # settled strings only serve the others
        hit, which = hit[~done[which]], which[~done[which]]
    if not len(hit):
        return
    lo, hi = span_union(hit, hit + window)
    which = np.searchsorted(at, lo, "right") - 1
    yield own[which], lo - at[which], hi - at[which]


def dedup(docs: DataFrame, keep_first: bool = True, window: int = WINDOW, gram: int = GRAM, batch: int = BATCH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    own, decided = repeated(docs, runs.partitions_for(docs), keep_first, window, gram, batch)

    def remove(mine: pa.Table, named: pa.Table) -> pa.Table:
        key, lo, hi = runs.gather(named, 3, ["<i8", "<i8", "<i8"])
        order = np.argsort(key)
        key, lo, hi = key[order], lo[order], hi[order]
        ids, n, removed, spans, sha, kept = [], [], [], [], [], []
        for batch, buf, off in runs.pieces(mine):
            ids += batch.column(0).to_pylist()
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            a, b = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
            for i, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                x, y = span_union(lo[a[i] : b[i]], hi[a[i] : b[i]])
                if len(x):
                    stays = np.append(0, y), np.append(x, e - s)
                    value = b"".join(buf[s + p : s + q].tobytes() for p, q in zip(*(t.tolist() for t in stays)))
                else:
                    value = buf[s:e].tobytes()
                n.append(e - s)
                removed.append(e - s - len(value))
                spans.append(len(x))
                sha.append(hashlib.sha256(value).hexdigest())
                kept.append(value)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary())})

    return runs.at_home(own, decided, remove, RESULT)


def op8_suffixes(spark, sf_dir: str) -> DataFrame:
    """Contract query: bytes that remain of every document when every copy goes."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_first=False).drop("kept")


ORACLE_SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT rid, unnest(range(1, octet_length(x) - 198)) AS i, x FROM t WHERE octet_length(x) >= 200),
h AS MATERIALIZED (SELECT rid, i, md5_number(x[i:i + 199]) AS k FROM w),
r AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
m AS (SELECT rid, i, i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -200) + 200 AS opens FROM h WHERE k IN (SELECT k FROM r)),
s AS (SELECT rid, min(i) AS lo, max(i) + 199 AS hi FROM (SELECT rid, i, sum(opens::INTEGER) OVER (PARTITION BY rid ORDER BY i) AS n FROM m) GROUP BY rid, n),
p AS (SELECT rid, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY rid ORDER BY lo) AS prev FROM s),
k AS (SELECT rid, count(*) AS n_spans, sum(hi - lo + 1)::BIGINT AS n_removed, string_agg(hex(x[prev + 1:lo - 1]), '' ORDER BY lo) AS head, max(hi) AS last FROM p JOIN t USING (rid) GROUP BY rid)
SELECT doc_id, octet_length(x) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || hex(x[coalesce(last, 0) + 1:]))) AS kept_sha256 FROM t LEFT JOIN k USING (rid)
"""
