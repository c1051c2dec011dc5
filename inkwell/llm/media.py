"""Media columns: text payloads stored as baseline JPEG pictures, and features read back from them.

The payload's bytes become quantised coefficients (the format's 8-bit unit) of a grey picture 24 pixels
wide, so they survive exactly. Reading parses the markers, Huffman-decodes the scan, rebuilds the
DC-only luminance thumbnail and keeps the dimensions and the thumbnail's hash. Any baseline picture
with one interleaved scan can be read for its dimensions and thumbnail.

Scale: rows are independent; both operators stream Arrow batches in blocks of bounded size and nothing
is shuffled. Defined results: null or empty text is one unit of padding; repeated rows give equal
values; a picture that can't be read gives null features.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm import jpeg
from inkwell.llm.textbuf import blocks, ship

STORED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, pictures int, feature string"


def padded(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes, each filled with 255 to a positive multiple of the unit, and the new offsets."""
    sizes = np.diff(off)
    full = np.maximum(-(-sizes // jpeg.UNIT), 1) * jpeg.UNIT
    cuts = np.append(0, np.cumsum(full))
    out = np.full(int(cuts[-1]), 255, np.uint8)
    out[np.arange(len(buf)) + np.repeat(cuts[:-1] - off[:-1], sizes)] = buf
    return out, cuts


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media: the payload as JPEG pictures, back to back."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in blocks(batches, "text", 2 << 20):
            media = jpeg.encode(*padded(buf, off))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(off)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, STORED)


def describe(files: list[bytes]) -> list[tuple | None]:
    """(payload bytes, width, height, pictures, feature) of each file of pictures, None if unreadable."""
    found, own = [], []
    for i, data in enumerate(files):
        at, mine = 0, []
        try:
            while at < len(data):
                p, at = jpeg.parse(data, at)
                mine.append((i, p))
        except (ValueError, IndexError, KeyError):
            mine = []
        own.append((len(found), len(mine)))
        found += mine
    try:
        coefs: list[np.ndarray | None] = list(jpeg.coefficients(files, found))
    except (ValueError, IndexError):  # one is broken: read them one at a time
        coefs = []
        for i, p in found:
            try:
                coefs += jpeg.coefficients([files[i]], [(0, p)])
            except (ValueError, IndexError):
                coefs.append(None)
    out: list[tuple | None] = []
    for first, n in own:
        parts = coefs[first : first + n]
        if not n or any(c is None for c in parts):
            out.append(None)
            continue
        payload, thumbs = [], hashlib.sha1()
        for (_, p), c in zip(found[first : first + n], parts):
            thumbs.update(jpeg.thumbnail(p, c).tobytes())
            payload.append((c + 128).astype(np.uint8).tobytes())
        w, h = found[first][1].width, sum(p.height for _, p in found[first : first + n])
        out.append((b"".join(payload), w, h, n, f"jpeg:{w}x{h}x{n}:{thumbs.hexdigest()}"))
    return out


def features(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hash and payload digests of stored media (doc_id, n_bytes, media)."""
    ship(media.sparkSession)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = [x or b"" for x in batch.column(2).to_pylist()]
        got = describe(files)
        pick = lambda f: [f(x) if x else None for x in got]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(pick(lambda x: len(x[0])), pa.int64()),
                pa.array(pick(lambda x: hashlib.sha256(x[0]).hexdigest()), pa.string()),
                pa.array(pick(lambda x: zlib.crc32(x[0][-32:])), pa.int64()),
                pa.array([len(x) for x in files], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in files], pa.string()),
                pa.array(pick(lambda x: x[1]), pa.int32()),
                pa.array(pick(lambda x: x[2]), pa.int32()),
                pa.array(pick(lambda x: x[3]), pa.int32()),
                pa.array(pick(lambda x: x[4]), pa.string()),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "pictures", "feature"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(x) if x else 0 for x in batch.column(2).to_pylist()])
            at = 0
            while at < batch.num_rows:  # pieces of about 2 MB, or one row
                done = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + (2 << 20), "right")))
                yield rows(batch.slice(at, to - at))
                at = to

    return media.mapInArrow(run, FEATURES)


def op2_media(spark, sf_dir: str) -> DataFrame:
    """Contract query: every text through its stored pictures and back."""
    return features(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
