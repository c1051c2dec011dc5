"""PII by a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Patterns find emails, network addresses, card and phone numbers in their usual form. The method adds forms
that they miss. Every kind needs a digit or an at sign, be it spelled (in brackets), so the tagger reads overlapping
windows around those and nothing else: each window is decoded by Viterbi, then the windows of a text are reconciled:
a character takes the label of the window in which it lies deepest, runs of a label become spans, and an
address takes the rest of its words, however long. Spans that can't be what they claim (too few digits, no at sign) or
that touch a base span are dropped.

The tagger is trained by ``train`` from labelled spans in made-up sentences (``LESSONS`` of them, a fixed seed);
``store`` keeps the weights in ``tagger.json`` with a digest of the recipe, and if code or settings change the driver
trains anew. The weights, some 10 kB, travel with the tasks. Scale: rows are independent and
nothing is shuffled; windows are scored in batches of bounded size. Defined results: null or empty text has
no spans; repeated rows give equal spans; texts of any length are read whole; an empty table gives an empty
result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import crf
from inkwell.llm.spans import LOCAL, Span, apart, digest, digits, luhn, personal, printed
from inkwell.llm.textbuf import ship

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
#: Window width, distance of windows, and characters that a window reaches before its first trigger.
WIDTH, STRIDE, LEAD = 96, 48, 40
HIDDEN, EMBED = 14, 8
LESSONS, EPOCHS, BATCH = 3000, 8, 64
SEED = 20

#: Character classes of the tagger (fixed values): these characters, then digits, lower, upper, other letters, other.
SINGLE = "@.-+() _%/:,\n\"'="
CLASSES = len(SINGLE) + 6  # one more for padding
_PAD = CLASSES - 1
#: Signs between an address' two halves, and the characters of a domain.
AT = re.compile(r"[(\[{]\s?(?:@|at)\s?[)\]}]|@", re.I)
DOMAIN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-")


def classes(codes: np.ndarray) -> np.ndarray:
    """Class of each code point."""
    table = _class_table()
    return table[np.minimum(codes, 256)]


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    n = len(SINGLE)
    out = np.full(257, n + 4, np.int64)
    for c in range(256):
        ch = chr(c)
        out[c] = SINGLE.index(ch) if ch in SINGLE else n if "0" <= ch <= "9" else n + 1 if "a" <= ch <= "z" else n + 2 if "A" <= ch <= "Z" else n + 3 if c >= 192 else n + 4
    out[256] = n + 3
    return out


def lesson(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A sentence with labelled spans, and lookalikes that aren't labelled."""
    syllables = "an ber ción de en er ge heit ing la le ment no on ou que ra re st th tion und vi wh".split()
    n = lambda a, b: int(rng.integers(a, b + 1))
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(syllables[i] for i in rng.integers(0, len(syllables), n(1, 3)))
    pick = lambda *x: x[n(0, len(x) - 1)]

    def email() -> str:
        name = word() + pick("", ".", "_", "-") + pick("", word(), num(2))
        sign = pick("@", "@", "@", " @ ", "[@]", "(@)", "(at)", " (at) ", "[at]", " [at] ")
        return name + sign + pick("mail", "mx", word()) + pick("", num(1)) + "." + pick("example.com", "example.org", "net", "co.uk", word() + ".de")

    def ip() -> str:
        return ".".join(str(n(0, 255)) for _ in range(4))

    def card() -> str:
        if rng.random() < 0.2:  # of twelve digits
            d = pick("50", "6") + num(11)
            d = next(x for x in (d[:11] + str(c) for c in range(10)) if luhn(x))
            return pick(" ", "-", ".", ".", ".").join(d[i : i + 4] for i in range(0, 12, 4))
        d = pick("4", "5", "37") + num(15)
        d = next(x for x in (d[:15] + str(c) for c in range(10)) if luhn(x))
        return pick(d, d, "-".join(d[i : i + 4] for i in range(0, 16, 4)), " ".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4)))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        if rng.random() < 0.3:  # national forms of Spanish, French and German
            s, pairs = pick(" ", " ", "-", "."), [num(2) for _ in range(4)]
            return pick(f"{n(6, 9)}{a[:2]}{s}{b}{s}{c[:3]}", f"9{n(1, 8)}{s}{a}{s}{c[:2]}{s}{c[2:]}", f"{n(6, 9)}{a[:2]}{s}{s.join(pairs[:3])}", f"0{n(1, 9)}{s}{s.join(pairs)}", f"0{n(20, 99)}{pick(s, '/')}{b}{c}", f"01{n(50, 79)}{pick(s, '/')}{b}{c}")
        return pick(f"+1 ({a}) {b}-{c}", f"+{n(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{n(1, 99)}-{a}-{b}-{c}")

    def lookalike() -> str:
        hexes = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40))
        return pick(
            f"version {n(1, 9)}.{n(0, 20)}", f"{n(1900, 2030)}", f"{n(1900, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", f"{n(1, 28)}.{n(1, 12)}.{n(1990, 2030)}", f"{n(1, 999)},{num(3)}",
            f"$ {n(1, 99)}.{num(2)}", f'token = "{hexes}"', f"password={hexes[:18]}", "AKIA" + hexes[:16].upper(), f"{n(1, 23)}:{num(2)}", f"({n(1, 9)})", f"@{word()}", f"{n(1, 99)} %",
            f"{n(1, 9)}.{n(1, 9)}.{n(1, 9)}", f"ISBN 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(2)}/{num(2)}", f"{word()}{num(2)}", f"{num(5)}", f"{num(6)}", f"{n(256, 999)}.{n(0, 999)}.{n(0, 999)}.{n(0, 999)}",
        )

    text, found = "", []
    for _ in range(n(6, 14)):
        kind = n(0, 9)
        if kind < 4 and rng.random() < 0.35:
            piece = (email, ip, card, phone)[kind]()
            found.append((KINDS[kind], len(text), len(text) + len(piece)))
        elif rng.random() < 0.18:
            piece = lookalike()
        else:
            piece = pick(word(), word(), word().capitalize(), word().upper())
        text += piece + pick(" ", " ", " ", ", ", ". ", ".\n", "\n")
    return text, found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, an LSTM in each direction, emissions and a CRF over O and the kinds."""

    def __init__(self, rng: np.random.Generator) -> None:
        r = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        labels = len(KINDS) + 1
        self.w = {"embed": r(CLASSES, EMBED) * 2, "emit": r(2 * HIDDEN, labels), "bias": np.zeros(labels, np.float32), "move": np.zeros((labels, labels), np.float32), "first": np.zeros(labels, np.float32)}
        for d in "fb":
            self.w |= {d + "x": r(EMBED, 4 * HIDDEN), d + "h": r(HIDDEN, 4 * HIDDEN), d + "c": np.zeros(4 * HIDDEN, np.float32)}
            self.w[d + "c"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def _pass(self, ids: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction; ids is steps x windows, already in reading order."""
        w, h = self.w, np.zeros((ids.shape[1], HIDDEN), np.float32)
        c, out, trace = h.copy(), np.zeros((*ids.shape, HIDDEN), np.float32), []
        table = w["embed"] @ w[d + "x"] + w[d + "c"]
        for t in range(len(ids)):
            z = table[ids[t]] + h @ w[d + "h"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            old, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                trace.append((i, f, o, g, old, tc, h))
            h = out[t] = o * tc
        return out, trace

    def hidden(self, ids: np.ndarray, keep: bool = False):
        f, tf = self._pass(ids, "f", keep)
        b, tb = self._pass(ids[::-1], "b", keep)
        return np.concatenate([f, b[::-1]], 2), tf, tb

    def chain(self) -> crf.Chain:
        return crf.Chain(self.w["emit"], self.w["move"].astype(float), self.w["first"].astype(float))

    def labels(self, ids: np.ndarray) -> np.ndarray:
        """Viterbi labels of windows (windows x steps)."""
        states, _, _ = self.hidden(ids.T)
        scores = (states @ self.w["emit"] + self.w["bias"]).transpose(1, 0, 2).reshape(-1, len(KINDS) + 1).astype(float)
        return crf.viterbi(scores, self.chain(), np.full(len(ids), ids.shape[1])).reshape(ids.shape)

    def slopes(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradient over windows (windows x steps)."""
        n, steps, k = len(ids), ids.shape[1], len(KINDS) + 1
        w = self.w
        states, tf, tb = self.hidden(ids.T, True)
        scores = (states @ w["emit"] + w["bias"]).transpose(1, 0, 2).reshape(-1, k).astype(float)
        total, node, edge = crf.marginals(scores, self.chain(), np.full(n, steps))
        flat = y.reshape(-1)
        seen = np.eye(k)[flat]
        moves = np.zeros((k, k))
        np.add.at(moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        firsts = np.bincount(y[:, 0], minlength=k)
        gold = float(scores[np.arange(len(flat)), flat].sum() + (moves * w["move"]).sum() + (firsts * w["first"]).sum())
        count = n * steps
        grad = {"move": (edge - moves) / count, "first": (node.reshape(n, steps, k)[:, 0].sum(0) - firsts) / count}
        ds = ((node - seen) / count).reshape(n, steps, k).transpose(1, 0, 2).astype(np.float32)
        grad["emit"], grad["bias"] = np.einsum("tni,tnk->ik", states, ds), ds.sum((0, 1))
        dh = ds @ w["emit"].T
        grad["embed"] = np.zeros_like(w["embed"])
        for d, trace, own, seq in (("f", tf, dh[:, :, :HIDDEN], ids.T), ("b", tb, dh[::-1, :, HIDDEN:], ids.T[::-1])):
            self._back(d, trace, own, seq, grad)
        return (total - gold) / count, grad

    def _back(self, d: str, trace, dh: np.ndarray, ids: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        w = self.w
        back_h = back_c = np.zeros((ids.shape[1], HIDDEN), np.float32)
        by_class = np.zeros((CLASSES, 4 * HIDDEN), np.float32)
        grad[d + "h"] = np.zeros_like(w[d + "h"])
        for t in range(len(ids) - 1, -1, -1):
            i, f, o, g, old, tc, h = trace[t]
            dh_t = dh[t] + back_h
            dc = back_c + dh_t * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh_t * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            back_c, back_h = dc * f, dz @ w[d + "h"].T
            grad[d + "h"] += h.T @ dz
            np.add.at(by_class, ids[t], dz)
        grad[d + "c"] = by_class.sum(0)
        grad[d + "x"] = w["embed"].T @ by_class
        grad["embed"] += by_class @ w[d + "x"].T


@lru_cache(maxsize=2)
def train(seed: int = SEED, lessons: int = LESSONS, epochs: int = EPOCHS) -> Tagger:
    """The tagger, trained by Adam on windows cut from made-up lessons."""
    rng = np.random.default_rng(seed)
    ids, ys = [], []
    for _ in range(lessons):
        text, found = lesson(rng)
        x = classes(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64))
        y = np.zeros(len(x), np.int64)
        for kind, s, e in found:
            y[s:e] = KINDS.index(kind) + 1
        s = int(rng.integers(0, max(1, len(x) - WIDTH + 1)))
        x, y = x[s : s + WIDTH], y[s : s + WIDTH]
        ids.append(np.append(x, np.full(WIDTH - len(x), _PAD)))
        ys.append(np.append(y, np.zeros(WIDTH - len(y), np.int64)))
    ids, ys = np.stack(ids), np.stack(ys)
    tagger = Tagger(rng)
    m, v, step = {}, {}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(ids))
        for a in range(0, len(ids), BATCH):
            own = order[a : a + BATCH]
            _, grad = tagger.slopes(ids[own], ys[own])
            step += 1
            rate = 0.02 * (1 - 0.7 * epoch / epochs)
            for k, g in grad.items():
                g = np.clip(g, -0.05, 0.05)
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                tagger.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return tagger


STORED = os.path.join(os.path.dirname(os.path.abspath(__file__)), "tagger.json")


def recipe() -> str:
    """Digest of what training depends on: the code that writes lessons and learns from them, and its settings."""
    code = "".join(inspect.getsource(x) for x in (lesson, Tagger, train.__wrapped__, _class_table.__wrapped__, crf))
    return hashlib.sha256(f"{code}|{SINGLE!r}|{WIDTH}|{HIDDEN}|{EMBED}|{LESSONS}|{EPOCHS}|{BATCH}|{SEED}".encode()).hexdigest()


def store(path: str = STORED) -> None:
    """Train the tagger and keep its weights beside the code (``python -m inkwell.llm.pii``)."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"recipe": recipe(), "weights": {k: np.round(w.astype(float), 6).tolist() for k, w in train().w.items()}}, f)
        f.write("\n")


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger from its stored weights if they come from this recipe, else trained anew, which takes some 20 s."""
    if os.path.exists(STORED):
        with open(STORED, encoding="utf-8") as f:
            kept = json.load(f)
        if kept["recipe"] == recipe():
            tagger = Tagger(np.random.default_rng(SEED))
            tagger.w = {k: np.array(w, np.float32) for k, w in kept["weights"].items()}
            return tagger
    return train()


def triggers(text: str, raw: np.ndarray) -> np.ndarray:
    """Places that a window must show: digits, and the at signs, also spelled ones, with all of the word before them."""
    seen = (raw >= 48) & (raw <= 57)
    for m in AT.finditer(text):
        s = m.start()
        while s and text[s - 1] in LOCAL:
            s -= 1
        seen[s : m.end() : STRIDE] = True
        seen[m.start() : m.end()] = True
    return np.flatnonzero(seen)


def windows(trigger: np.ndarray, n: int) -> list[int]:
    """Starts of windows, STRIDE apart, that cover every trigger with LEAD characters before it."""
    out: list[int] = []
    for p in trigger.tolist():
        if not out:
            out.append(max(0, p - LEAD))
        elif p >= out[-1] + STRIDE:
            out.append(max(out[-1] + STRIDE, p - LEAD))
    return [max(0, min(s, n - WIDTH)) for s in out]


def healed(kind: str, text: str, s: int, e: int) -> tuple[int, int]:
    """A span with the rest of a word that its windows cut: an address takes its whole local part and domain."""
    if kind == "email" and AT.search(text, s, e):
        while s and text[s - 1] in LOCAL:
            s -= 1
        while e < len(text) and text[e] in DOMAIN_CHARS:
            e += 1
        while e > s and text[e - 1] in ".-":
            e -= 1
    return s, e


def plausible(kind: str, piece: str) -> bool:
    """Whether a tagged piece can be of its kind."""
    many = len(digits(piece))
    if kind == "email":
        signs = list(AT.finditer(piece))
        if len(signs) != 1:
            return False
        local, rest = piece[: signs[0].start()].strip(), piece[signs[0].end() :].strip()
        return any(c.isalnum() for c in local) and "." in rest.strip(".") and not any(c.isspace() for c in local + rest)
    if kind == "ip":
        parts = piece.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= many <= 19 and luhn(digits(piece)) and not any(c.isalpha() for c in piece)
    return 9 <= many <= 15 and not any(c.isalpha() for c in piece) and len(piece) > many


def tag(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans that the tagger sees in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    jobs: list[tuple[int, int]] = []
    codes: dict[int, np.ndarray] = {}
    for i, text in enumerate(texts):
        if not text or text.isalpha():
            continue
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        trigger = triggers(text, raw)
        if len(trigger):
            codes[i] = classes(raw.astype(np.int64))
            jobs += [(i, s) for s in dict.fromkeys(windows(trigger, len(raw)))]
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    depth = np.minimum(np.arange(WIDTH), WIDTH - 1 - np.arange(WIDTH)) + 1
    for a in range(0, len(jobs), 512):
        part = jobs[a : a + 512]
        ids = np.full((len(part), WIDTH), _PAD)
        for j, (i, s) in enumerate(part):
            piece = codes[i][s : s + WIDTH]
            ids[j, : len(piece)] = piece
        got = tagger.labels(ids)
        for j, (i, s) in enumerate(part):
            if i not in best:
                best[i] = np.zeros(len(codes[i]), np.int64), np.zeros(len(codes[i]), np.int64)
            label, deep = best[i]
            e = min(s + WIDTH, len(label))
            own = depth.copy()
            if s == 0:  # the text's own edges aren't edges of the view
                own = WIDTH - np.arange(WIDTH)
            if e == len(label):
                own = np.maximum(own, np.arange(WIDTH) + 1)
            better = own[: e - s] > deep[s:e]
            label[s:e][better] = got[j, : e - s][better]
            deep[s:e][better] = own[: e - s][better]
    for i, (label, _) in best.items():
        edge = np.flatnonzero(np.diff(label)) + 1
        for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(label)]):
            if not label[s]:
                continue
            kind = KINDS[label[s] - 1]
            while s < e and texts[i][s] in " ,;:\n\"'":
                s += 1
            while e > s and texts[i][e - 1] in " ,;:.\n\"'":
                e -= 1
            s, e = healed(kind, texts[i], s, e)
            # a span that cuts a word or a number isn't one
            whole = (s == 0 or not texts[i][s - 1].isalnum()) and (e == len(label) or not texts[i][e].isalnum())
            if whole and plausible(kind, texts[i][s:e]):
                out[i].append((kind, s, e))
    return out


def find(texts: list[str | None], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans of each text, and those that the tagger adds."""
    plain = [t or "" for t in texts]
    return [(b, apart(a, b)) for b, a in zip(map(personal, plain), tag(plain, tagger))]


def scan(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Per document the base counts by kind, the base digest, all spans and the number of added ones (SCHEMA)."""
    ship(docs.sparkSession)
    own = tagger or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = find(batch.column(1).to_pylist(), own)
                count = lambda kind: pa.array([sum(k == kind for k, _, _ in b) for b, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), *map(count, KINDS), pa.array([digest(printed(b, KINDS)) for b, _ in found]), pa.array([printed(b + a, KINDS) for b, a in found]), pa.array([len(a) for _, a in found], pa.int64())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def cover(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """The documents with personal data replaced, all columns kept; n_chars follows the text."""
    ship(docs.sparkSession)
    own = tagger or trained()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                place = names.index("text")
                texts = batch.column(place).to_pylist()
                done = [t and cover(t, b + a) for t, (b, a) in zip(texts, find(texts, own))]
                columns = list(batch.columns)
                columns[place] = pa.array(done, batch.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names)
    return out


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query: personal data in every text."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


if __name__ == "__main__":
    store()
