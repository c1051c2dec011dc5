"""Quality rules by line sequence labelling: a conditional random field marks every line as content or
boilerplate, and the content share of a document's word characters decides whether it stays.

The chain is fitted on the driver from line features of a bounded sample of labelled documents (at most
``SAMPLE_DOCS``, chosen by the md5 of doc_id, and ``SAMPLE_LINES`` lines of each; a line takes its document's quality
as its label; of rows with one doc_id the least text counts) and a fixed
set of made-up lines, which alone serve where there are no labels. Scoring streams Arrow batches in
blocks; nothing is shuffled, and whole texts are read.

Base figures per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; documents of under
50 words, or with over half of their words in repeated 3-word windows, fail. Defined results: null or empty text
has no words and fails; repeated rows are judged alike; a document without lines of words has share 0; texts of
any length are judged whole; an empty table gives an empty result; other columns may have any name. Equal hashes are
checked byte by byte before a line or a window counts as repeated.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import crf
from inkwell.llm.textbuf import blocks, byte_hashes, cut_words, gram_hashes, mix, same_bytes, ship, utf8

#: Labelled documents that the chain is fitted on, at most.
SAMPLE_DOCS = 1500
#: Lines of one training sequence, and lines that the chain is fitted on of one document, at most.
SEQUENCE, SAMPLE_LINES = 32, 1024
#: Share of word characters in content lines that a document needs.
LEAST_CONTENT = 0.3
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
CONTENT, BOILERPLATE = 0, 1


def _pair(low: bytes, high: bytes) -> np.ndarray:
    """Counts of two classes of bytes in one number."""
    out = np.zeros(256, np.uint64)
    out[list(low)] += np.uint64(1)
    out[list(high)] += np.uint64(1 << 32)
    return out


_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SPACES = bytes([9, 10, 11, 12, 13, 32])
_COUNTS = [
    _pair(SYMBOLS, bytes(b for b in range(256) if b & 0xC0 != 0x80 and b not in _SPACES)),
    _pair(_UPPER, _LOWER),
    _pair(b"!?", b".,;:"),
    _pair(b"0123456789", b"|"),
]


def _groups(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each (value, row), and the first place of its group."""
    order = np.lexsort((value, row))
    new = np.ones(len(order), bool)
    new[1:] = (value[order[1:]] != value[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    group, first = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first[order] = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(order))))
    return group, first


def _same_lines(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each range has the bytes of the range ``first`` names."""
    size = ends - starts
    same = size == size[first]
    at = np.flatnonzero(same & (first < np.arange(len(first))))
    same[at] = same_bytes(buf, starts[at], starts[first[at]], size[at])
    return same


def _by_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: np.ndarray, repeated: np.ndarray) -> None:
    """Settle ``repeated`` of some rows by the words themselves."""
    for r in rows.tolist():
        own = np.flatnonzero(row == r)
        words = [buf[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist())]
        grams = list(zip(words, words[1:], words[2:]))
        times = Counter(grams)
        repeated[own] = False
        for i, g in enumerate(grams):
            if times[g] > 1:
                repeated[own[i : i + 3]] = True


def line_table(buf: np.ndarray, off: np.ndarray):
    """Lines (start, end, row) and per line eight counts, words, repeated neighbours and a duplicate flag;
    per row the base figures."""
    n_rows = len(off) - 1
    breaks = np.flatnonzero(buf == 10)
    # a break that ends a row opens an empty line of that row, at the next row's offset
    own = np.searchsorted(off, breaks, "right") - 1
    row = np.concatenate([np.arange(n_rows), own])
    order = np.argsort(row, kind="stable")
    starts, row = np.concatenate([off[:-1], breaks + 1])[order], row[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True)
    ends[last] = off[1:][row[last]]
    counts = []
    for table in _COUNTS:
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf], out=total[1:])
        both = total[ends] - total[starts]
        counts += [both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)]
    counts = np.stack(counts, 1).astype(np.int64)
    w_start, w_end, w_row = cut_words(buf, off)
    hashes = byte_hashes(buf, w_start, w_end)
    first, stop = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
    words = stop - first
    echo = np.zeros(len(w_start) + 1, np.int64)
    echo[2:] = np.cumsum(hashes[1:] == hashes[:-1]) if len(hashes) > 1 else 0
    repeats = np.where(words > 1, echo[stop] - echo[np.minimum(first + 1, len(w_start))], 0)
    # lines with a word, equal to an earlier line of the row
    has = np.flatnonzero(words > 0)
    group, first = _groups(byte_hashes(buf, starts[has], ends[has]), row[has])
    same = _same_lines(buf, starts[has], ends[has], first)
    duplicate = np.zeros(len(starts), bool)
    duplicate[has[same & (first < np.arange(len(has)))]] = True
    # words in 3-word windows that the row holds twice
    repeated = np.zeros(len(w_start), bool)
    at = np.flatnonzero(w_row[2:] == w_row[:-2]) if len(w_start) >= 3 else w_row[:0]
    if len(at):
        group, first = _groups(gram_hashes(hashes, 3)[at], w_row[at])
        for j in range(3):
            repeated[at[np.bincount(group)[group] > 1] + j] = True
        copy = np.flatnonzero(first < np.arange(len(at)))
        unequal = np.zeros(len(copy), bool)
        for j in range(3):
            unequal |= ~_same_lines(buf, w_start[at + j], w_end[at + j], first)[copy]
        _by_bytes(buf, w_start, w_end, w_row, np.unique(w_row[at[copy[unequal]]]), repeated)
    for r in np.unique(row[has[~same]]).tolist():  # unequal lines of one hash: settle the row by its bytes
        seen: set[bytes] = set()
        for i in has[row[has] == r].tolist():
            line = buf[starts[i] : ends[i]].tobytes()
            duplicate[i] = line in seen
            seen.add(line)
    base = np.stack(
        [
            np.bincount(w_row, minlength=n_rows),
            np.bincount(row, counts[:, 1], n_rows).astype(np.int64),
            np.bincount(row, counts[:, 0], n_rows).astype(np.int64),
            np.bincount(row, duplicate, n_rows).astype(np.int64),
            np.bincount(w_row, repeated, n_rows).astype(np.int64),
        ],
        1,
    )
    return row, np.concatenate([counts, words[:, None], repeats[:, None], duplicate[:, None]], 1), base


def features(lines: np.ndarray) -> np.ndarray:
    """Feature rows of lines with a word."""
    symbols, chars, upper, lower, shout, stops, digits, pipes, words, repeats, duplicate = lines.T.astype(float)
    chars, words = np.maximum(chars, 1), np.maximum(words, 1)
    letters = np.maximum(upper + lower, 1)
    size = np.log1p(words)
    out = [
        np.ones(len(lines)),
        symbols / words,
        np.minimum(symbols / words, 0.2) * 5,
        upper / letters,
        (upper / letters > 0.6) * 1.0,
        np.minimum(shout / words, 1.0),
        np.minimum(stops / words, 1.0),
        digits / chars,
        pipes / words,
        repeats / words,
        (repeats / words > 0.5) * 1.0,
        duplicate,
        np.minimum(size, 4.0) / 4.0,
        (words < 4) * 1.0,
    ]
    return np.stack(out, 1)


def made_up(seed: int = 7, docs: int = 240) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and sequence sizes of invented documents: prose, and menus, shouting, symbols, echoes."""
    rng = np.random.default_rng(seed)
    parts = ["ra", "to", "mi", "len", "or", "sa", "ken", "du", "vi", "est", "é", "ço"]

    def words(n: int) -> list[str]:
        return ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 5))) for _ in range(n)]

    def prose() -> str:
        out = []
        for _ in range(rng.integers(1, 6)):
            w = words(rng.integers(4, 18))
            out.append(" ".join(w).capitalize() + ".")
        return " ".join(out)

    def junk(kind: int) -> str:
        w = words(rng.integers(5, 40))
        if kind == 0:
            return " | ".join(w)
        if kind == 1:
            return " ".join(x.upper() + "!!" for x in w)
        if kind == 2:
            return " ".join(x + "#*$%&"[rng.integers(0, 5)] * 3 for x in w)
        return " ".join(w[:1] * len(w))

    texts, labels = [], []
    for i in range(docs):
        bad = i % 3 == 0
        kind = int(rng.integers(0, 4))
        lines, own = [], []
        for _ in range(rng.integers(2, 9)):
            junky = bad and rng.random() < 0.9 or rng.random() < 0.02
            lines.append(junk(kind) if junky else prose())
            own.append(BOILERPLATE if junky else CONTENT)
        texts.append("\n".join(lines))
        labels += own
    buf, off = utf8(pa.array(texts))
    row, lines, _ = line_table(buf, off)
    return features(lines), np.array(labels), np.bincount(row)


def _evenly(lines: np.ndarray, most: int = SAMPLE_LINES) -> np.ndarray:
    """All lines, or of more than ``most`` as many in sequences spread evenly over the text."""
    if len(lines) <= most:
        return lines
    starts = np.linspace(0, len(lines) - SEQUENCE, most // SEQUENCE).astype(np.int64)
    return np.concatenate([lines[s : s + SEQUENCE] for s in starts])


def fit(docs: DataFrame, labels: DataFrame | None, sample_docs: int = SAMPLE_DOCS) -> crf.Chain:
    """The chain from a bounded sample of labelled documents and the made-up lines."""
    x, y, sizes = ([part] for part in made_up())
    if labels is not None:
        ship(docs.sparkSession)
        pick = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        pick = pick.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample_docs)
        rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")  # the list has at most sample_docs rows
        rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # repeated ids give one row

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, buf, off in blocks(batches, "text"):
                row, lines, _ = line_table(buf, off)
                got = [lines[row == i] for i in range(batch.num_rows)]
                got = [np.ascontiguousarray(_evenly(g[g[:, 8] > 0]), np.int32).tobytes() for g in got]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("quality")).cast(pa.int32()), pa.array(got, pa.binary())], ["doc_id", "quality", "lines"])

        found = rows.mapInArrow(run, "doc_id long, quality int, lines binary").collect()
        for r in sorted(found, key=lambda r: (r["doc_id"], bytes(r["lines"]))):
            lines = np.frombuffer(bytes(r["lines"]), np.int32).reshape(-1, 11)
            if not len(lines):
                continue
            f = features(lines)
            for s in range(0, len(f), SEQUENCE):
                x.append(f[s : s + SEQUENCE])
                y.append(np.full(len(x[-1]), CONTENT if r["quality"] else BOILERPLATE))
                sizes.append(np.array([len(x[-1])]))
    return crf.fit(np.concatenate(x), np.concatenate(y), np.concatenate(sizes), 2)


def judge_block(buf: np.ndarray, off: np.ndarray, chain: crf.Chain, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base figures, whether they fail, content share and verdict of each row."""
    n = len(off) - 1
    row, lines, base = line_table(buf, off)
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    seen = np.flatnonzero(lines[:, 8] > 0)
    share = np.zeros(n)
    if len(seen):
        sizes = np.bincount(row[seen], minlength=n)
        label = crf.viterbi(features(lines[seen]) @ chain.emit, chain, sizes[sizes > 0])
        chars = lines[seen, 1]
        content = np.bincount(row[seen], chars * (label == CONTENT), n)
        share = content / np.maximum(np.bincount(row[seen], chars, n), 1)
    return base, failed, share, ~failed & (share >= least)


def judge(docs: DataFrame, chain: crf.Chain, least: float = LEAST_CONTENT) -> DataFrame:
    """Figures and verdict per document (SCHEMA)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in blocks(batches, "text"):
            base, failed, share, kept = judge_block(buf, off, chain, least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(base[:, i].astype(np.int64)) for i in range(5)), pa.array(failed), pa.array(share), pa.array(kept)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, chain: crf.Chain, least: float = LEAST_CONTENT) -> DataFrame:
    """The documents that stay, with all their columns."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in blocks(batches, "text"):
            yield batch.filter(pa.array(judge_block(buf, off, chain, least)[3]))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: figures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels))
