"""Secret scans by dictionary-primed zstandard novelty.

Patterns find assigned passwords, access keys and long hexadecimal strings. The method adds what they miss:
every long token that follows a sensitive word (plurals and parts of identifiers count) on its line is priced by the bytes it adds to a compressed
window of its surroundings, with the compressor primed by a dictionary of identifiers and by the
surrounding code itself. Names and prose are cheap after that; a string that costs nearly as much as
random characters would is reported as ``novel``. Short literals aren't entropy-coded there, so letters without
digits are priced by pairs of letters as well, and must cost no less than random letters.

Scale: rows are independent and nothing is shuffled; only texts with a sensitive word are priced, each
candidate over a window of fixed width. Defined results: null or empty text has no spans; repeated rows
give equal spans; texts of any length are read whole, a candidate up to its line's end; an empty table gives an
empty result; other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from inkwell.functions import fixed as X
from inkwell.llm.spans import Span, apart, digest, printed, secret
from inkwell.llm.textbuf import ship

KINDS = ("assign", "access", "hex", "novel")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
#: Words that make their line's tail sensitive (fixed values).
SENSITIVE = "password passwd passphrase pwd secret token apikey api_key api-key key auth authorization bearer credential credentials private session cookie signature salt".split()
#: Identifiers that prime the compressor (fixed values).
IDENTIFIERS = (
    "return import class function const static public private protected void string integer boolean float double null true false self this "
    "config configuration settings environment variable value default option parameter argument request response client server service "
    "connection database username password secret token session cookie header authorization bearer credential private key public key "
    "localhost example.com https:// http:// /usr/local/bin /etc/ /home/user/ index.html application/json content-type user-agent "
    "get_value set_value get_key set_key load_config read_file write_file create update delete select insert from where order group "
    "manager controller handler factory provider repository interface abstract exception error warning message logger debug info "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 the and for with that this from which are was were have has been"
)
#: Long words of the corpus' languages, whose pairs of letters price letters (fixed values).
LETTERS = (
    "international information communication organization responsibility characteristic development environment understanding relationship government administration "
    "transportation architecture representative establishment knowledge throughout everything something straightforward approximately opportunity experience "
    "verantwortung gesellschaft entwicklung geschwindigkeit wirtschaft wissenschaft unterschiedlich bundesrepublik versicherung zusammenarbeit arbeitgeber benutzer "
    "verwaltung krankenhaus schwierigkeiten moeglichkeit regierung durchschnittlich selbstverstaendlich jahrhundert beschreibung eigenschaft freundlich buchstabe zwischen "
    "responsabilidad desarrollo conocimiento comunicacion caracteristicas administracion universidad establecimiento aproximadamente trabajador importante siguiente "
    "gouvernement developpement particulierement communication environnement connaissance immediatement etablissement entreprise aujourdhui quelquefois naturellement "
    "buffer thread callback iterator dispatch listener synchronize initialize template generator transaction permission timeout schedule wrapper pool build module package backup "
    "query index cluster network security certificate encrypt algorithm parse document object property attribute component widget layout display window keyboard"
)
AROUND = 256
#: Shortest candidate, and the share of a random string's cost that makes one novel.
LEAST, NOVEL = 16, 0.75

_ANY = "|".join(map(re.escape, sorted(SENSITIVE, key=len, reverse=True)))
#: Whole words, parts before an upper-case letter, capitalised parts, and upper-case parts; each also in the plural.
_WORD = re.compile(rf"(?i:(?<![A-Za-z])(?:{_ANY})s?(?![a-z]))|(?<![A-Za-z])(?:{_ANY})s?(?![a-z])|(?:{'|'.join(re.escape(w.capitalize()) for w in SENSITIVE)})s?(?![a-z])|(?<![A-Z])(?:{_ANY.upper()})[Ss]?(?![A-Za-z])", re.A)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]++(?:\.[A-Za-z0-9+/_=-]++)*+")


@lru_cache(maxsize=1)
def _press() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def price(candidate: str, around: str) -> int:
    """Compressed bytes that the candidate adds to its surroundings."""
    before = around.encode("utf-8", "surrogatepass")
    return len(_press().compress(before + candidate.encode())) - len(_press().compress(before))


@lru_cache(maxsize=1)
def _pairs() -> dict[tuple[str, str], float]:
    """Bits of each letter after another, or after a word's start."""
    words = re.findall("[a-z]+", f"{LETTERS} {IDENTIFIERS} {' '.join(X.FUNCTION_WORDS)}".replace("abcdefghijklmnopqrstuvwxyz", "").lower())
    seen = Counter(x for w in words for x in zip(" " + w, w))
    after, alone = Counter(), Counter()
    for (a, b), n in seen.items():
        after[a] += n
        alone[b] += n
    letters = "abcdefghijklmnopqrstuvwxyz"
    share = {b: (alone[b] + 1) / (alone.total() + 26) for b in letters}
    return {(a, b): -math.log2((seen[a, b] + 2 * share[b]) / (after[a] + 2)) for a in f" {letters}" for b in letters}


def random_bytes(candidate: str) -> float:
    """Bytes a random string over the candidate's kinds of characters would need."""
    kinds = [(r"[0-9]", 10), (r"[a-z]", 26), (r"[A-Z]", 26), (r"[^0-9A-Za-z]", 2)]
    alphabet = sum(n for pattern, n in kinds if re.search(pattern, candidate))
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate):
        alphabet = 16
    return len(candidate) * math.log2(max(2, alphabet)) / 8


def spelt(candidate: str) -> bool:
    """Whether the letters of a candidate without digits follow each other as in words, rather than at random."""
    if re.search("[0-9]", candidate):
        return False
    pairs = _pairs()
    bits = [pairs[x] for word in re.findall("[a-z]+", candidate.lower()) for x in zip(" " + word, word)]
    return sum(bits) < len(bits) * math.log2(26)


def novel(text: str) -> list[Span]:
    """Candidates after a line's first sensitive word whose price is near that of random characters."""
    out: list[Span] = []
    done = 0
    while word := _WORD.search(text, done):
        newline = text.find("\n", word.end())
        done = newline if newline >= 0 else len(text)
        for m in _TOKEN.finditer(text, word.end(), done):
            token = m[0]
            if len(token) < LEAST or not re.search("[0-9A-Za-z]", token):  # a rule costs more than its random price
                continue
            around = text[max(0, m.start() - AROUND) : m.start()] + text[m.end() : m.end() + AROUND]
            if price(token, around) >= NOVEL * random_bytes(token) and not spelt(token):
                out.append(("novel", m.start(), m.end()))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and spans that the method adds."""
    text = text or ""
    base = secret(text)
    return base, apart(novel(text), base)


def scan(docs: DataFrame) -> DataFrame:
    """Per document the counts, the base digest and all spans (SCHEMA)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [find(t) for t in batch.column(1).to_pylist()]
                count = lambda kind: pa.array([sum(k == kind for k, _, _ in b + a) for b, a in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), count("assign"), count("access"), count("hex"), pa.array([digest(printed(b, KINDS)) for b, _ in found]), pa.array([printed(b + a, KINDS) for b, a in found]), count("novel")],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query: secrets in every text."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
