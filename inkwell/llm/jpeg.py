"""Baseline JPEG in numpy: an encoder that stores bytes as quantised coefficients, and a general
decoder that walks many scans in lockstep.

Decoding is sequential inside a restart interval, so the decoder runs one lane per interval and
advances all lanes of all images together, a Huffman symbol a step.
"""

from __future__ import annotations

import functools
import re
import struct
from dataclasses import dataclass, field

import numpy as np

UNIT = 576  # bytes; 9 blocks of 64 coefficients, three block rows of a picture 24 pixels wide
ROW = 192
MOST = 2728 * UNIT  # bytes of one picture; 65,472 lines, the format's limit is 65,535

#: Code lengths of the encoder's Huffman tables (symbols not named take 11 bits).
DC_LENGTHS = {s: 4 for s in range(9)}
AC_LENGTHS = {0x05: 1, 0x07: 2, 0x04: 3, 0x06: 4}

_SCAN_END = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.S)


def _canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """DHT body, codes and lengths by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(lengths[s] == n for s in order) for n in range(1, 17))
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        code += 1
    return counts + bytes(order), codes, sizes


_AC_ALL = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 9))]
DC_DHT, DC_CODE, DC_SIZE = _canonical(DC_LENGTHS)
AC_DHT, AC_CODE, AC_SIZE = _canonical({s: 11 for s in _AC_ALL} | AC_LENGTHS)
_CATEGORY = np.array([int(x).bit_length() for x in range(512)], np.int64)


def header(n_bytes: int) -> bytes:
    """Everything before the scan of a picture that holds n_bytes (a multiple of UNIT)."""
    seg = lambda tag, body: b"\xff" + bytes([tag]) + struct.pack(">H", len(body) + 2) + body
    return (
        b"\xff\xd8"
        + seg(0xDB, b"\x00" + b"\x01" * 64)
        + seg(0xC0, struct.pack(">BHHB", 8, n_bytes // ROW * 8, 24, 1) + b"\x01\x11\x00")
        + seg(0xC4, b"\x00" + DC_DHT)
        + seg(0xC4, b"\x10" + AC_DHT)
        + seg(0xDD, struct.pack(">H", 3))
        + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def encode(payload: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """JPEG pictures, back to back, for each piece payload[cuts[i]:cuts[i+1]] (multiples of UNIT).

    Each byte less 128 is a quantised coefficient in zigzag order with quantiser 1; three blocks make a
    restart interval. A piece above MOST bytes becomes several pictures.
    """
    values = payload.astype(np.int64).reshape(-1, 64) - 128
    dc = values[:, 0].copy()
    values[1:, 0] -= dc[:-1]
    values[::3, 0] = dc[::3]
    flat = values.reshape(-1)
    used = flat != 0
    used[::64] = True
    at = np.flatnonzero(used)
    v, k = flat[at], at & 63
    run = np.zeros(len(at), np.int64)
    run[1:] = at[1:] - at[:-1] - 1
    run[k == 0] = 0
    long_runs, run = run >> 4, run & 15
    size = _CATEGORY[np.abs(v)]
    symbol = run << 4 | size
    is_dc = k == 0
    code = np.where(is_dc, DC_CODE[symbol & 15], AC_CODE[symbol])
    length = np.where(is_dc, DC_SIZE[symbol & 15], AC_SIZE[symbol]) + size
    code = code << size | (np.where(v < 0, v - 1, v) & ((1 << size) - 1))
    ends = np.append(at[1:] >> 6 != at[:-1] >> 6, True) & (k < 63)
    stop = np.cumsum(1 + long_runs + ends)
    codes = np.full(stop[-1], AC_CODE[0xF0], np.int64)
    lengths = np.full(stop[-1], AC_SIZE[0xF0], np.int64)
    place = stop - 1 - ends
    codes[place], lengths[place] = code, length
    codes[stop[ends] - 1], lengths[stop[ends] - 1] = AC_CODE[0], AC_SIZE[0]
    # Bits of the intervals, each padded with ones to a byte.
    first = (stop - 1 - ends - long_runs)[is_dc][::3]
    bits = np.add.reduceat(lengths, first)
    n_bytes = (bits + 7) >> 3
    base = np.cumsum(n_bytes) - n_bytes
    total = int(n_bytes.sum())
    offset = np.cumsum(lengths) - lengths
    counts = np.diff(np.append(first, len(lengths)))
    offset += np.repeat(base * 8 - offset[first], counts)
    word = codes << (40 - lengths - (offset & 7))
    byte = offset >> 3
    stream = np.zeros(total + 8, np.int64)
    for j in range(4):
        stream[: total + 4] += np.bincount(byte + j, (word >> (32 - 8 * j)) & 255, total + 4).astype(np.int64)
    stream = stream[:total]
    pad = (n_bytes * 8 - bits).astype(np.int64)
    stream[base + n_bytes - 1] |= (1 << pad) - 1
    # A zero after each 255, a marker after each interval.
    stuffed = stream == 255
    extra = stuffed.astype(np.int64)
    last = base + n_bytes - 1
    extra[last] += 2
    to = np.cumsum(1 + extra)
    out = np.zeros(int(to[-1]), np.uint8)
    out[to - 1 - extra] = stream
    piece = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts) // ROW)
    inside = np.arange(len(piece)) - cuts[:-1][piece] // ROW
    number = inside % (MOST // ROW)
    finish = np.append(piece[1:] != piece[:-1], True) | (number == MOST // ROW - 1)
    out[to[last] - 2] = 255
    out[to[last] - 1] = np.where(finish, 0xD9, 0xD0 + number % 8)
    interval_end = to[last]
    result = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        parts = []
        for s in range(lo, hi, MOST):
            e = min(hi, s + MOST)
            begin = interval_end[s // ROW - 1] if s else 0
            parts += [header(e - s), out[begin : interval_end[e // ROW - 1]].tobytes()]
        result.append(b"".join(parts))
    return result


@dataclass
class Picture:
    """What the markers of one picture say, and where its scan lies."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal and vertical factor, quantiser
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # class << 4 | id
    choice: dict[int, tuple[int, int]] = field(default_factory=dict)  # part -> DC, AC
    interval: int = 0
    scan: tuple[int, int] = (0, 0)


def parse(data: bytes, at: int = 0) -> tuple[Picture, int]:
    """The picture whose SOI marker is at ``at``, and where the next one may begin."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    p, at = Picture(), at + 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        tag = data[at + 1]
        if tag == 0xD9:
            raise ValueError("no scan")
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if tag == 0xDB:
            i = 0
            while i < len(body):
                wide, q = body[i] >> 4, body[i] & 15
                step = 128 if wide else 64
                p.quant[q] = np.frombuffer(body[i + 1 : i + 1 + step], ">u2" if wide else np.uint8).astype(np.int64)
                i += 1 + step
        elif tag in (0xC0, 0xC1):
            bits, p.height, p.width, n_parts = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise ValueError("8-bit samples only")
            p.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n_parts)]
        elif 0xC2 <= tag <= 0xCF and tag not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline picture")
        elif tag == 0xC4:
            i = 0
            while i < len(body):
                many = sum(body[i + 1 : i + 17])
                p.tables[body[i]] = bytes(body[i + 1 : i + 17 + many])
                i += 17 + many
        elif tag == 0xDD:
            p.interval = int.from_bytes(body[:2], "big")
        elif tag == 0xDA:
            if body[0] != len(p.parts):
                raise ValueError("one interleaved scan only")
            p.choice = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(body[0])}
            end = _SCAN_END.search(data, at)
            stop = end.start() if end else len(data)
            p.scan = (at, stop)
            while end and data[end.end() - 1] != 0xD9:  # trailing segments are not read
                end = _SCAN_END.search(data, end.end())
            return p, end.end() if end else len(data)


@functools.lru_cache(maxsize=64)
def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: length << 8 | symbol of the code that starts there (0: none)."""
    out, code, i = np.zeros(65536, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[i]
            code, i = code + 1, i + 1
        code <<= 1
    return out


def _layout(p: Picture) -> tuple:
    """What pictures must share to be walked together: block pattern of an MCU and its tables."""
    if len(p.parts) == 1:
        pattern = ((0,),)
    else:
        pattern = (tuple(i for i, (_, h, v, _) in enumerate(p.parts) for _ in range(h * v)),)
    return (*pattern, *((p.tables[p.choice[c[0]][0]], p.tables[p.choice[c[0]][1]]) for c in p.parts))


def _mcus(p: Picture) -> tuple[int, int]:
    h, v = (1, 1) if len(p.parts) == 1 else (max(c[1] for c in p.parts), max(c[2] for c in p.parts))
    return -(-p.width // (8 * h)), -(-p.height // (8 * v))


def coefficients(files: list[bytes], pictures: list[tuple[int, Picture]]) -> list[np.ndarray]:
    """Quantised coefficients (blocks in scan order, 64 in zigzag order) of each (file, picture)."""
    out: list[np.ndarray] = [np.zeros((0, 64), np.int64)] * len(pictures)
    groups: dict[tuple, list[int]] = {}
    for i, (_, p) in enumerate(pictures):
        groups.setdefault(_layout(p), []).append(i)
    for layout, members in groups.items():
        scans = [np.frombuffer(files[pictures[i][0]], np.uint8)[slice(*pictures[i][1].scan)] for i in members]
        raw = np.concatenate([np.append(s, np.array([255, 0xD9], np.uint8)) for s in scans])
        after = np.append(raw[1:], 0)
        marks = np.flatnonzero((raw == 255) & (after >= 0xD0) & (after <= 0xD9))
        keep = np.ones(len(raw), bool)
        keep[1:] = ~((raw[1:] == 0) & (raw[:-1] == 255))
        keep[marks] = keep[marks + 1] = False
        place = np.cumsum(keep) - keep
        plain = np.append(raw[keep], np.full(16, 255, np.uint8)).astype(np.uint64)
        window = np.zeros(len(plain) - 7, np.uint64)
        for j in range(8):
            window |= plain[j : len(plain) - 7 + j] << np.uint64(56 - 8 * j)
        begin = np.append(0, place[marks[:-1]])
        last = after[marks] == 0xD9
        per_mcu = len(layout[0])
        blocks = []
        for i in members:
            p = pictures[i][1]
            n = int(np.prod(_mcus(p)))
            step = p.interval or n
            blocks.append(np.full(-(-n // step), step * per_mcu))
            blocks[-1][-1] = (n - (len(blocks[-1]) - 1) * step) * per_mcu
        total = np.concatenate(blocks)
        if len(total) != len(marks) or int(last.sum()) != len(members):
            raise ValueError("restart markers and the picture's size disagree")
        got = _walk(layout, window, begin.astype(np.int64) * 8, total)
        at = 0
        for i, own in zip(members, blocks):
            n = int(own.sum())
            out[i] = got[at : at + n]
            at += n
    return out


def _walk(layout: tuple, window: np.ndarray, pos: np.ndarray, total: np.ndarray) -> np.ndarray:
    """All lanes at once: ``pos`` is the bit where each begins, ``total`` its number of blocks."""
    pattern = np.array(layout[0])
    tables = np.concatenate([lookup(t) for pair in layout[1:] for t in pair])
    base = (np.cumsum(total) - total) * 64
    out = np.zeros(int(total.sum()) * 64, np.int64)
    lane = np.arange(len(pos))
    predicted = np.zeros((len(pos), int(pattern.max()) + 1), np.int64)
    block, k = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    single = len(layout) == 2
    while len(lane):
        part = 0 if single else pattern[block % len(pattern)]
        word = window[pos >> 3] << (pos & 7).astype(np.uint64)
        entry = tables[((part * 2 + (k > 0)) << 16) + (word >> np.uint64(48)).astype(np.int64)]
        length, symbol = entry >> 8, entry & 255
        if not length.all():
            raise ValueError("no such Huffman code")
        is_dc = k == 0
        size = np.where(is_dc, symbol, symbol & 15)
        run = np.where(is_dc, 0, symbol >> 4)
        value = ((word << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value -= np.where((size > 0) & (value < (1 << size >> 1)), (1 << size) - 1, 0)
        pos = pos + length + size
        if is_dc.any():
            at = np.flatnonzero(is_dc)
            own = part if single else part[at]
            predicted[at, own] += value[at]
            value[at] = predicted[at, own]
        blank = ~is_dc & (size == 0)
        k = k + run
        put = ~blank & (k < 64)
        out[(base + block * 64 + k)[put]] = value[put]
        k = np.where(blank & (run < 15), 64, k + 1)
        over = k >= 64
        block = block + over
        k[over] = 0
        if over.any() and (going := block < total).sum() < len(lane):
            lane, pos, block, k, total, base, predicted = (x[going] for x in (lane, pos, block, k, total, base, predicted))
    return out.reshape(-1, 64)


def thumbnail(p: Picture, coefs: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size, from the DC coefficients alone."""
    wide, high = _mcus(p)
    h, v = (1, 1) if len(p.parts) == 1 else p.parts[0][1:3]
    per = len(coefs) // max(1, wide * high)
    own = coefs[:, 0].reshape(high, wide, per)[:, :, : h * v]
    grid = own.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    _, fh, fv, q = p.parts[0]
    scale = (1, 1) if len(p.parts) == 1 else (max(c[1] for c in p.parts) // fh, max(c[2] for c in p.parts) // fv)
    grid = grid[: -(-p.height // (8 * scale[1])), : -(-p.width // (8 * scale[0]))]
    return np.clip((grid * p.quant[q][0] + 1028) >> 3, 0, 255).astype(np.uint8)
