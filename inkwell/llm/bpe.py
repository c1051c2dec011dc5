"""BPE encoding and decoding by a tokenization automaton.

The automaton reads token arcs and accepts exactly the token sequences that merging produces. It starts
as one state with an arc for every base symbol. The gadget of merge (u, v) -> w acts on each state p that
has an arc u into a state with an arc v: p gains an arc w into v's state, and u's state loses its arc v.
A state is therefore named by the arc that enters it, and an arc (p, t) exists if

* no merge (p, t) has taken it away, and
* it was there when the later of p and t was made: then it stands for (p, first half of t) if t is the later
  one, or for (second half of p, t) if p is (for u = v, a single u can't be followed by the new uu).

So every arc follows from two shorter ones: the gadgets, compiled in the order of the merges, give for each state
the merge that made it and its two halves, and the arcs themselves, too many to be listed, are kept as words ask for
them. A word has one accepted path: its bytes run through a compiled transition table, and the tokens read are taken,
longest first, if the state has their arc. Decoding emits the arcs' labels.

Texts are prepared as the tokenizers file says: special tokens are split off, then NFC, lower case, and a split
into contractions, letters, single digits and other signs, whose bytes are spelled in the byte-level alphabet.

Scale: rows are independent and nothing is shuffled; each Python worker keeps its arcs and a bounded
cache of words and of pieces. The tokenizer file is read on the driver and broadcast (about 2 MB). Defined results: null
or empty text has no tokens and decodes to the empty text; repeated rows give equal values; texts of any length are
encoded whole; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import Split

from inkwell.llm.textbuf import ship

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words, and half as many pieces between spaces, that a worker remembers; it forgets them all when there are more.
CACHE = 300_000
END = "</w>"
FAR = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _ranges(kind: str, most: int) -> str:
    """Character class body of all characters of a general category, up to ``most``, by the Unicode version of
    the tokenizers library (a newer or older one splits a few rare scripts otherwise)."""
    every = "".join(chr(c) for c in range(most + 1) if not 0xD800 <= c <= 0xDFFF)
    found = Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(every)
    return "".join(f"\\U{ord(m[0]):08x}-\\U{ord(m[-1]):08x}" for m, _ in found)


#: White_Space of Unicode (fixed values).
WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@lru_cache(maxsize=2)
def splitter(most: int) -> re.Pattern:
    """The file's pre-split pattern, for texts of characters up to ``most``."""
    letters, numbers = _ranges("L", most), _ranges("N", most)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+")


@lru_cache(maxsize=1)
def newer_capitals() -> dict[int, str]:
    """Lower case of characters that are newer than Python's tables."""
    new = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")
    return {ord(a): b for a, b in zip(new, Lowercase().normalize_str(new)) if a != b}


@lru_cache(maxsize=1)
def has_newer_capitals() -> re.Pattern:
    """Finds texts that may hold one: those with a character from the first of them on."""
    return re.compile(f"[{chr(min(newer_capitals(), default=sys.maxunicode))}-\U0010ffff]")


class _Pieces(dict):
    """Ids of the pieces between spaces, as little-endian 32-bit integers; what isn't there is encoded when asked for."""

    def __init__(self, own: Automaton) -> None:
        self.own = own

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE // 2:
            self.clear()
        most = 0xFFFF if not piece or max(piece) <= "\uffff" else sys.maxunicode
        self[piece] = ids = b"".join(map(self.own.__getitem__, splitter(most).findall(piece)))
        return ids


class Automaton:
    """The compiled tables of one tokenizer file, and the arcs and pieces met so far.

    ``step`` is the transition table over bytes: from the bytes read since the last boundary to those and one more,
    as far as some token goes on; ``inner`` and ``ending`` name the token read, inside a word and at its end. The
    gadgets are compiled to three arrays: the merge that made each token, and its halves.
    """

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.labels = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.labels[i] = token
        n = len(self.labels)
        self.made = [-1] * n
        self.left, self.right = list(range(n)), list(range(n))
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            u, v, w = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge.setdefault(u << 20 | v, rank)
            if self.made[w] < 0:
                self.made[w], self.left[w], self.right[w] = rank, u, v
        self._compile()
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.pieces = _Pieces(self)

    def _compile(self) -> None:
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.step: dict[int, int] = {}
        self.inner, self.ending = [-1], [-1]
        for token, i in self.vocab.items():
            spelled = token.removesuffix(END)
            if not spelled or any(c not in byte_of for c in spelled):
                continue  # special tokens are split off before
            node = 0
            for c in spelled:
                key = node << 8 | byte_of[c]
                if key not in self.step:
                    self.step[key] = len(self.inner)
                    self.inner.append(-1)
                    self.ending.append(-1)
                node = self.step[key]
            (self.ending if token.endswith(END) and token != END else self.inner)[node] = i

    def arc(self, p: int, t: int, until: int = FAR) -> bool:
        """Whether state p has arc t once the merges before ``until`` have acted."""
        made, merge = self.made, self.merge
        while True:
            if merge.get(p << 20 | t, FAR) < until:
                return False
            a, b = made[p], made[t]
            if a < 0 and b < 0:
                return True
            if b >= a:  # the arc into t was made from the arc into its first half
                if p == self.left[t] and self.left[t] == self.right[t]:
                    return False
                if a == b:  # p is t: its state is that of its second half
                    p = self.right[p]
                t, until = self.left[t], b
            else:
                p, until = self.right[p], a

    def path(self, word: str) -> list[int]:
        """Token ids of one pre-split word.

        From each place the bytes that follow run through the transition table; of the tokens read, the longest whose
        arc the state has is taken. A place from which none leads on is on no path, and the walk goes back by one
        token; since every prefix has one path, no place is left twice.
        """
        raw = word.encode("utf-8", "surrogatepass")
        step, inner, ending, arcs, n = self.step.get, self.inner, self.ending, self.arcs, len(raw)
        out: list[int] = []
        open_: list[list[int]] = []  # for each place on the walk, the ends and tokens still to be tried, longest last
        places: list[int] = []
        dead: set[int] = set()
        place, state = 0, -1
        while place < n:
            if len(open_) == len(out):
                tries: list[int] = []
                node = 0
                for i in range(place, n):
                    node = step(node << 8 | raw[i])
                    if node is None:
                        break
                    t = inner[node] if i + 1 < n else ending[node]
                    if t >= 0:
                        tries += (i + 1, t)
                open_.append(tries)
                places.append(place)
            tries = open_[-1]
            while tries:
                t, end = tries.pop(), tries.pop()
                if end in dead:
                    continue
                if state >= 0:
                    key = state << 20 | t
                    ok = arcs.get(key)
                    if ok is None:
                        ok = arcs[key] = self.arc(state, t)
                    if not ok:
                        continue
                out.append(t)
                place, state = end, t
                break
            else:
                dead.add(place)
                open_.pop()
                places.pop()
                out.pop()
                place, state = places[-1], out[-1] if out else -1
        return out

    def __getitem__(self, word: str) -> bytes:
        """The word's ids as little-endian 32-bit integers."""
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            if len(self.arcs) >= 8 * CACHE:
                self.arcs.clear()
            ids = self.path(word)
            got = self.words[word] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if self.split_special is None or "<|" not in text:
            return self._plain(text)
        return b"".join(struct.pack("<I", self.special[part]) if k % 2 else self._plain(part) for k, part in enumerate(self.split_special.split(text)))

    def _plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")  # then composed already, and lowered one by one
            text = text.lower()
        except UnicodeEncodeError:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if has_newer_capitals().search(text):
                text = text.translate(newer_capitals())
            text = text.replace("Σ", "σ").lower()  # without final sigma
        # no token crosses white space, so pieces between spaces and line ends can be looked up whole
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs, joined as a tokenizer without decoder does."""
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I") if sys.byteorder == "little" else struct.unpack(f"<{len(ids) // 4}I", ids)))


_kept: dict[str, Automaton] = {}


def automaton(text: str, digest: str) -> Automaton:
    """The worker's automaton of a tokenizer file."""
    if digest not in _kept:
        _kept.clear()
        _kept[digest] = Automaton(text)
    return _kept[digest]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per document doc_id, n_tokens and digests of its ids and of the text they decode to; with ``with_ids``
    also the ids themselves."""
    ship(docs.sparkSession)
    with open(path or default_path(), encoding="utf-8") as f:
        text = f.read()
    digest = hashlib.sha256(text.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(shared.value, digest)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
                arrays = [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.array([memoryview(x).cast("I").tolist() for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query: every text encoded, and decoded again."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
