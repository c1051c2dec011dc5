"""Every operator on tables with clashing column names, nulls, empty and very long texts, repeats, and no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwell.llm import bpe, jaccard, media, mixing, pii, quality, runs, secrets, spans, suffixes, superkmer, urls
from tests.llm import brute
from tests.llm.test_repeats import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 200_000 + "password is xkqzvwjyhpfbgtrm and mail someone@mail.example.com\n" + "x" * 300_000
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six", "en", "a", 27), (3, "one two three four five six", "en", "a", 27), (None, "one two three four five six", "en", None, 27), (4, LONG, "en", "b", len(LONG)), (5, "tail " * 70, "en", "a", 350)]

#: Names that operators use inside, or used to.
CLASH = (
    "size target rank position taken source_size _key _c copies copy _copy words _bucket _order _ahead _at _class class own own_id id component bucket node place lead members sig name grams cluster part key kind a b c d e "
    "value start stop kept n_bytes starts ends shape template verdict rule host path weight _slice _held0 _position doc _ratio check bitmap counts fragment quality lines"
).split()
#: What only differs in case would clash in any table.
assert len({c.lower() for c in CLASH}) == len(CLASH)


def clashing(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select(*[F.lit(i).alias(c) for i, c in enumerate(CLASH)], *df.columns)


OPERATORS = {
    "mixing": mixing.plan,
    "media": lambda d: media.features(media.store(d)),
    "pii": pii.scan,
    "quality": lambda d: quality.judge(d, quality.fit(d, None)),
    "jaccard": jaccard.linked,
    "secrets": secrets.scan,
    "suffixes": lambda d: suffixes.dedup(d, keep_first=False),
    "bpe": bpe.encode,
    "superkmer": superkmer.dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_change_nothing(spark, name):
    plain = OPERATORS[name](spark.createDataFrame(ROWS, SCHEMA))
    got = OPERATORS[name](clashing(spark))
    assert got.columns == plain.columns
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(ROWS) and same(rows, [tuple(r) for r in plain.collect()])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, name):
    assert OPERATORS[name](clashing(spark, [])).count() == 0


KEEPERS = {"quality": lambda d: quality.keep(d, quality.fit(d, None)), "near_duplicates": jaccard.keep_one, "pii": pii.redact, "mixing": mixing.mix}


@pytest.mark.parametrize("name", KEEPERS)
def test_stages_keep_all_columns(spark, name):
    own = clashing(spark)
    got = KEEPERS[name](own)
    assert got.columns == own.columns and [t for _, t in got.dtypes] == [t for _, t in own.dtypes]
    want = KEEPERS[name](spark.createDataFrame(ROWS, SCHEMA)).select("doc_id", "source", F.md5("text").alias("t"))
    assert same([tuple(r) for r in got.select("doc_id", "source", F.md5("text").alias("t")).collect()], [tuple(r) for r in want.collect()])
    assert all(r[c] == i for r in got.select(*CLASH).collect() for i, c in enumerate(CLASH))
    assert KEEPERS[name](clashing(spark, [])).count() == 0


def test_urls_with_clashing_names(spark):
    pages = [(1, "http://x.net/" + "/".join(f"s{i}" for i in range(40))), (2, None), (2, None), (3, "http://example.org/es/" + "y" * 100_000), (None, "http://example.org/en/2")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    wide = df.select(*[F.lit(i).alias(c) for i, c in enumerate(CLASH)], "page_id", "url")
    got = [tuple(r) for r in urls.judge(wide).collect()]
    assert same(got, [tuple(r) for r in urls.judge(df).collect()]) and len(got) == len(pages)
    assert urls.judge(wide.limit(0)).count() == 0


def test_partitions_follow_the_texts(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = rows.join(rows.select("doc_id"), "doc_id")
    assert runs.partitions_for(rows) == runs.partitions_for(joined) == runs.partitions_for(rows.limit(0)) == least
    assert runs.partitions_for(rows, share=10_000) == 100


def test_many_spans_are_kept_apart():
    found = [("phone", 10 * i, 10 * i + 9) for i in range(20_000)]
    base = [("email", 10 * i + 5, 10 * i + 12) for i in range(0, 20_000, 4)]
    taken = set()
    for _, s, e in base:
        taken.update(range(s, e))
    assert spans.apart(found, base) == [f for f in found if not taken & set(range(f[1], f[2]))]
    assert spans.apart([("a", 0, 5), ("b", 3, 9), ("c", 5, 6)], []) == [("a", 0, 5), ("c", 5, 6)]


def test_tokens_are_reported_whole():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    text = f"Authorization: Bearer {jwt}"
    assert [text[s:e] for _, s, e in secrets.find(text)[1]] == [jwt]
    far = "private key " + "- " * 300 + "9fK2mX81bQz7LpTr4WvY"
    assert [far[s:e] for _, s, e in secrets.find(far)[1]] == ["9fK2mX81bQz7LpTr4WvY"]


def test_addresses_of_any_length():
    tagger = pii.train()
    for n in (12, 45, 60, 200):
        local = ("marion" * n)[:n]
        for sign in ("[@]", "(at)"):
            text = f"please write to {local}{sign}mail.example.com before the end of the week"
            assert [text[s:e] for k, s, e in pii.tag([text], tagger)[0] if k == "email"] == [f"{local}{sign}mail.example.com"], (n, sign)


def test_repeated_ids_give_one_training_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "a\n" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels).emit.shape[1] == 2
    assert len(quality._evenly(quality.np.zeros((5000, 11)))) == quality.SAMPLE_LINES


def test_odd_documents_in_the_mix(spark):
    rows = [(d, t, "en", "s", 0) for d, t in brute.odd_documents()]
    assert mixing.plan(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
