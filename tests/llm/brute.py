"""Plain versions of the contracts, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def op4(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def op5(docs: list[tuple]) -> list[tuple]:
    sets = []
    for _, text in docs:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    group = list(range(len(docs)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b) if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) else 0
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = top(i), top(j)
                group[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)].append(d)
    return [(d, len(s), min(least[top(i)], default=None)) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def op8(docs: list[tuple], window: int = 200, keep_first: bool = False) -> list[tuple]:
    places = defaultdict(list)
    texts = [(t or "").encode() for _, t in docs]
    for i, t in enumerate(texts):
        for s in range(len(t) - window + 1):
            places[t[s : s + window]].append((docs[i][0] if docs[i][0] is not None else 1 << 70, s, i))
    out = []
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for s in range(len(t) - window + 1):
            found = places[t[s : s + window]]
            mine = docs[i][0] if docs[i][0] is not None else 1 << 70
            if (min(found)[:2] < (mine, s)) if keep_first else len(found) > 1:
                gone[s : s + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((docs[i][0], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def op10(docs: list[tuple], window: int = 13) -> list[tuple]:
    least: dict[tuple, float] = {}
    cut = [WORD.findall(t or "") for _, t in docs]
    rank = [float("inf") if d is None else d for d, _ in docs]
    for r, w in zip(rank, cut):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, float("inf")), r)
    out = []
    for (d, _), r, w in zip(docs, rank, cut):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < r:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


#: Documents with nulls, ties, repeats, long and empty texts.
def odd_documents() -> list[tuple]:
    long_text = " ".join(f"w{i % 977}x{i * 7919 % 1013}" for i in range(4000))
    passage = " ".join(f"shared{i}" for i in range(70))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\r\x0b\x0c "),
        (4, "one two three"),
        (5, long_text),
        (6, "Prefix words here. " + passage + " and a tail"),
        (7, "Other start, " + passage + " with another end é ß 漢字"),
        (8, long_text[:9000] + " changed " + long_text[9000:]),
        (8, long_text[:9000] + " changed " + long_text[9000:]),
        (None, passage),
        (None, "one two three"),
        (9, "a b a b " * 200),
        (10, "na " * 300),
        (11, "ONE two THREE"),
        (12, "x" * 1200),
        (-5, "\x1c\x1d wörter mit leer\n\n\nzeilen " * 12),
        (13, "tail " + passage.upper()),
        (14, passage + "\n" + passage),
    ]
