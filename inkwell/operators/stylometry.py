"""Style vectors of corpora in long form, distances between two corpora, and their bootstrap interval.

Counts are additive, so a corpus' vector is one aggregation over per-document counts: every distribution is
rows (corpus, block, key, n), every scalar a conditional sum. Distances join two corpora on (block, key).
Documents are measured one by one and summed, so sentences and vocabulary segments don't cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.functions import text as T
from inkwell.operators.ordered import numbered
from inkwell.session import settle, ship

BLOCKS = {
    "function_words": X.FUNCTION_WORDS,
    "openers": [*X.FUNCTION_WORDS[: X.OPENER_WORDS], "<content>"],
    "punctuation": X.PUNCTUATION,
    "sent_len_hist": [str(i) for i in range(len(X.SENTENCE_BINS) - 1)],
    "word_len_hist": [str(i) for i in range(len(X.WORD_BINS) - 1)],
}


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with tokens, sentences and the lengths of sentences in tokens."""
    out = docs.withColumns({"_tok": T.style_tokens(F.col("text")), "_sent": T.sentences(F.col("text"))})
    return out.withColumn("_len", F.transform("_sent", lambda s: F.size(T.style_tokens(s))))


def segment_ratios(tokens: Column) -> Column:
    """Distinct share of each full segment of tokens; of all tokens if there are fewer."""
    n, w = F.size(tokens), X.SEGMENT
    ratio = lambda i: F.size(F.array_distinct(F.slice(tokens, i * w + 1, F.lit(w)))) / F.lit(w)
    many = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / w).cast("int") - 1, F.lit(0))), ratio)
    return F.when(n < w, F.array(F.size(F.array_distinct(tokens)) / F.greatest(n, F.lit(1)))).otherwise(many)


def msttr(tokens: Column) -> Column:
    """Mean segmental type-token ratio."""
    r = segment_ratios(tokens)
    return F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / F.size(r)


def count_columns() -> dict[str, Column]:
    """Additive counts of ``measured`` documents, by name."""
    chars = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    said = lambda words: F.size(F.filter("_tok", lambda w: w.isin(words)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return {
        "n_tokens": F.size("_tok"),
        "n_sents": F.size("_sent"),
        "len_sum": total(F.transform("_len", lambda x: x.cast("long"))),
        "len_squares": total(F.transform("_len", lambda x: x.cast("long") * x)),
        "letters": total(F.transform("_tok", lambda w: F.length(w).cast("long"))),
        "ratio_sum": F.aggregate(segment_ratios(F.col("_tok")), F.lit(0.0), lambda a, x: a + x),
        "ratios": F.size(segment_ratios(F.col("_tok"))),
        "contractions": T.count(F.col("text"), X.CONTRACTION),
        "hedges": said(X.HEDGES),
        "intensifiers": said(X.INTENSIFIERS),
        "first_person": said(["i", "me", "my", "we", "our"]),
        "second_person": said(["you", "your"]),
        "em_dashes": chars("—"),
        "semicolons": chars(";"),
        "parens": chars("("),
        "questions": chars("?"),
        "exclaims": chars("!"),
        "paras": T.count(F.col("text"), r"\n\n") + 1,
    }


def document_counts(docs: DataFrame, *by: str) -> DataFrame:
    """Additive counts of every document, with the columns ``by``."""
    return measured(docs).select(*by, *[c.alias(name) for name, c in count_columns().items()])


RATES = {
    "contraction_rate": "contractions", "hedge_rate": "hedges", "intensifier_rate": "intensifiers", "first_person_rate": "first_person", "second_person_rate": "second_person",
    "em_dash_per_100": "em_dashes", "semicolon_per_100": "semicolons", "paren_per_100": "parens", "question_per_100": "questions", "exclaim_per_100": "exclaims",
}


def scalars(docs: DataFrame, corpus: str) -> DataFrame:
    """The sixteen scalars of each corpus."""
    counts = document_counts(docs, corpus)
    return derived(counts.groupBy(corpus).agg(*[F.sum(c).alias(c) for c in counts.columns if c != corpus]), corpus)


def derived(sums: DataFrame, *by: str) -> DataFrame:
    """The sixteen scalars of summed counts."""
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    sents = F.greatest(F.col("n_sents"), F.lit(1))
    mean = F.col("len_sum") / sents
    sd = F.sqrt(F.greatest(F.col("len_squares") / sents - mean * mean, F.lit(0.0)))
    return sums.select(
        *by,
        mean.alias("sent_len_mean"),
        sd.alias("sent_len_sd"),
        F.when(sd + mean > 0, (sd - mean) / (sd + mean)).otherwise(F.lit(0.0)).alias("burstiness"),
        F.when(F.col("n_tokens") > 0, F.col("letters") / F.col("n_tokens")).otherwise(F.lit(0.0)).alias("word_len_mean"),
        (F.col("ratio_sum") / F.col("ratios")).alias("msttr"),
        *[(F.col(c) / n * 100).alias(name) for name, c in RATES.items()],
        (F.col("n_sents") / F.greatest(F.col("paras"), F.lit(1))).alias("para_len_sents"),
    )


def block_counts(docs: DataFrame, *by: str) -> DataFrame:
    """(by..., block, key, n): raw counts of every distribution."""
    d = measured(docs)
    entry = lambda block, key: F.struct(F.lit(block).alias("block"), key.alias("key"))
    words = F.transform(F.filter("_tok", lambda w: w.isin(X.FUNCTION_WORDS)), lambda w: entry("function_words", w))
    letters = F.transform(F.filter(F.split("text", ""), lambda c: c.isin(X.PUNCTUATION)), lambda c: entry("punctuation", c))
    first = F.filter(F.transform("_sent", lambda s: F.get(T.style_tokens(s), F.lit(0))), lambda w: w.isNotNull())
    opener = F.transform(first, lambda w: entry("openers", F.when(w.isin(X.FUNCTION_WORDS), w).otherwise(F.lit("<content>"))))
    hist = lambda a, edges, name: F.filter(F.transform(a, lambda x: entry(name, T.bin_of(x, edges).cast("string"))), lambda e: e["key"].isNotNull())
    sent = hist(F.col("_len"), X.SENTENCE_BINS, "sent_len_hist")
    word = hist(F.transform("_tok", F.length), X.WORD_BINS, "word_len_hist")
    flat = d.select(*by, F.explode(F.concat(words, letters, opener, sent, word)).alias("e")).select(*by, "e.*")
    return flat.groupBy(*by, "block", "key").agg(F.count("*").alias("n"))


def _keys(spark) -> DataFrame:
    """All (block, key); a fixed table of a few hundred rows."""
    return spark.createDataFrame([(b, k) for b, keys in BLOCKS.items() for k in keys], "block string, key string")


def distributions(counts: DataFrame, corpora: DataFrame, *by: str) -> DataFrame:
    """(by..., block, key, p) over the fixed keys; uniform where a corpus has none of a block's keys."""
    keys = F.broadcast(_keys(counts.sparkSession))
    full = corpora.join(keys).join(counts, [*by, "block", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = full.groupBy(*by, "block").agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    p = F.when(F.col("_t") > 0, F.col("n") / F.col("_t")).otherwise(1.0 / F.col("_k"))
    return full.join(totals, [*by, "block"]).select(*by, "block", "key", p.alias("p"))


def js_divergence(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """(by..., block, js): Jensen-Shannon divergence, base 2, of two sets of distributions."""
    floor = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1e-12))
    both = a.withColumnRenamed("p", "_p").join(b.withColumnRenamed("p", "_q"), [*by, "block", "key"], "full_outer").withColumns({"_p": floor("_p"), "_q": floor("_q")})
    sums = both.groupBy(*by, "block").agg(F.sum("_p").alias("_sp"), F.sum("_q").alias("_sq"))
    p, q = F.col("_p") / F.col("_sp"), F.col("_q") / F.col("_sq")
    m = (p + q) / 2
    part = (p * F.log2(p / m) + q * F.log2(q / m)) / 2
    out = both.join(sums, [*by, "block"]).groupBy(*by, "block").agg(F.sum(part).alias("js"))
    return out.withColumn("js", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("js"))))


def scalar_gaps(s: DataFrame, corpus: str, a: str, b: str, *by: str) -> DataFrame:
    """(by..., name, value): normalised gap of every scalar (scalar:)."""
    long = s.unpivot([*by, corpus], list(X.SCALES), "name", "value")
    scale = F.create_map(*[F.lit(v) for kv in X.SCALES.items() for v in kv])
    gap = long.groupBy(*by, "name").agg(F.max(F.when(F.col(corpus) == a, F.col("value"))).alias("_a"), F.max(F.when(F.col(corpus) == b, F.col("value"))).alias("_b"))
    return gap.select(*by, F.concat(F.lit("scalar:"), "name").alias("name"), F.least(F.lit(1.0), F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))) / scale[F.col("name")]).alias("value"))


def corpus_distances(docs: DataFrame, corpus: str, a: str, b: str) -> DataFrame:
    """(name, value): divergence of every block (dist:) and normalised gap of every scalar (scalar:)."""
    sides = docs.where(F.col(corpus).isin(a, b))
    counts = block_counts(sides, corpus)
    names = docs.sparkSession.createDataFrame([(a,), (b,)], f"{corpus} string")
    d = distributions(counts, names, corpus)
    js = js_divergence(d.where(F.col(corpus) == a).drop(corpus), d.where(F.col(corpus) == b).drop(corpus))
    return js.select(F.concat(F.lit("dist:"), "block").alias("name"), F.col("js").alias("value")).unionByName(scalar_gaps(scalars(sides, corpus), corpus, a, b))


def overall(distances: DataFrame, *by: str) -> DataFrame:
    """One row (for each of ``by``): the mean of the divergences and the mean scalar gap, as one more."""
    dist = F.col("name").startswith("dist:")
    parts = distances.groupBy(*by).agg(F.sum(F.when(dist, F.col("value"))).alias("_d"), F.count_if(dist).alias("_n"), F.avg(F.when(~dist, F.col("value"))).alias("_s"))
    return parts.select(*by, F.round((F.col("_d") + F.col("_s")) / (F.col("_n") + 1), 4).alias("overall"))


def biggest_gaps(distances: DataFrame, k: int = 6) -> DataFrame:
    """The k largest distances."""
    return distances.select("name", F.round("value", 4).alias("value")).orderBy(F.desc("value"), "name").limit(k)


def _vectors(tokens: pa.Array, first: pa.Array, lengths: pa.Array, marks: pa.Array, plain: pa.Array) -> np.ndarray:
    """Counts of every text over the keys of all blocks, then its plain counts, as rows."""
    n = len(tokens)
    words = pa.array(X.FUNCTION_WORDS)

    def tally(lists: pa.ListArray, index: np.ndarray, size: int) -> np.ndarray:
        row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        good = (index >= 0) & (index < size)
        return np.bincount(row[good] * size + index[good], minlength=n * size).reshape(n, size)

    def bins(values: np.ndarray, edges: tuple[int, ...]) -> np.ndarray:
        at = np.searchsorted(edges, values, "right") - 1
        return np.where(values == edges[-1], len(edges) - 2, at)

    def places(lists: pa.ListArray) -> np.ndarray:
        return pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    opener = places(first)
    opener = np.where(opener < 0, X.OPENER_WORDS, np.where(opener < X.OPENER_WORDS, opener, -1))
    letters = pc.utf8_length(tokens.flatten()).to_numpy(zero_copy_only=False)
    return np.concatenate(
        [
            tally(tokens, places(tokens), len(X.FUNCTION_WORDS)),
            tally(first, opener, X.OPENER_WORDS + 1),
            marks.flatten().to_numpy(zero_copy_only=False).reshape(n, -1),
            tally(lengths, bins(lengths.flatten().to_numpy(zero_copy_only=False), X.SENTENCE_BINS), len(X.SENTENCE_BINS) - 1),
            tally(tokens, bins(letters, X.WORD_BINS), len(X.WORD_BINS) - 1),
            plain.flatten().to_numpy(zero_copy_only=False).reshape(n, -1),
        ],
        axis=1,
    ).astype(float)


def draws(docs: DataFrame, corpus: str, key: str, replicates: int, seed: int) -> DataFrame:
    """(corpus, key, draws): the replicates that drew each text, once for every time they did.

    Texts of a corpus are numbered by key; in each replicate every place draws a text by a hash, so the draws are
    the same in any engine and travel as small integers, gathered by the text that they hit.
    """
    places = settle(numbered(docs.select(corpus, key), [key], "_i", [corpus]).withColumn("_i", F.col("_i") - 1))
    sizes = places.groupBy(corpus).agg(F.count("*").alias("_n"))  # one row per corpus
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "_r", F.col(corpus), F.col("_i").cast("string"))), 1, 8), 16, 10).cast("long")
    cast = places.join(F.broadcast(sizes), corpus).select(corpus, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r"))
    hit = cast.select(corpus, (draw % F.col("_n")).alias("_i"), F.col("_r").cast("short").alias("_r")).groupBy(corpus, "_i").agg(F.collect_list("_r").alias("draws"))
    return places.join(hit, [corpus, "_i"]).select(corpus, key, "draws")


def replicate_sums(docs: DataFrame, corpus: str, key: str, replicates: int, seed: int) -> DataFrame:
    """(_r, corpus, pos, n): counts of every replicate, summed over the texts that it drew.

    A text's counts become one vector; a task multiplies the draws of a batch of texts with their vectors and adds
    up the products, so what it sends on has a fixed size.
    """
    ship(docs.sparkSession)
    d = measured(docs)
    first = F.filter(F.transform("_sent", lambda s: F.get(T.style_tokens(s), F.lit(0))), lambda w: w.isNotNull())
    marks = F.array(*[(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double") for c in X.PUNCTUATION])
    plain = F.array(*[c.cast("double") for c in count_columns().values()])
    rows = d.where(F.col("text").isNotNull()).select(corpus, key, "_tok", first.alias("first"), "_len", marks.alias("marks"), plain.alias("plain"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts = _vectors(*(pa.concat_arrays([batch.column(i)]) for i in range(2, 7)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(counts), pa.list_(pa.float64()))], [corpus, key, "counts"])

    types = dict(docs.dtypes)
    vectors = rows.mapInArrow(measure, f"`{corpus}` {types[corpus]}, `{key}` {types[key]}, counts array<double>")
    both = vectors.join(draws(docs, corpus, key, replicates, seed), [corpus, key]).select(F.col(corpus).cast("string").alias("corpus"), "counts", "draws")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in whole.slice(at, 256).columns], whole.schema.names)
                counts = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                drawn = batch.column(2)
                row = np.repeat(np.arange(batch.num_rows), np.diff(drawn.offsets.to_numpy()))
                weight = np.bincount(row * replicates + drawn.flatten().to_numpy(), minlength=batch.num_rows * replicates).reshape(-1, replicates).astype(float)
                names = batch.column(0).to_pylist()
                for c in sorted(set(names)):
                    own = [i for i, x in enumerate(names) if x == c]
                    sums[c] = sums.get(c, 0) + weight[own].T @ counts[own]
        for c, matrix in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array([c] * replicates), pa.array(list(matrix), pa.list_(pa.float64()))], ["_r", "corpus", "sums"])

    parts = both.mapInArrow(multiply, "_r int, corpus string, sums array<double>")
    flat = parts.select("_r", F.col("corpus").alias(corpus), F.posexplode("sums").alias("pos", "n"))
    return flat.groupBy("_r", corpus, "pos").agg(F.sum("n").alias("n"))


def bootstrap_ci(docs: DataFrame, corpus: str, a: str, b: str, key: str, replicates: int = 200, seed: int = X.SEED) -> DataFrame:
    """(low, high): 2.5 and 97.5 percentiles of the overall distance when texts are drawn with replacement.

    Distributions and scalars of a replicate follow from its summed counts; those fill a table of fixed size.
    """
    spark = docs.sparkSession
    sums = settle(replicate_sums(docs.where(F.col(corpus).isin(a, b)), corpus, key, replicates, seed))  # replicates x two corpora x keys
    keys = [(block, k) for block, own in BLOCKS.items() for k in own]
    named = spark.createDataFrame([(i, block, k) for i, (block, k) in enumerate(keys)], "pos int, block string, key string")
    counts = sums.join(F.broadcast(named), "pos").drop("pos")
    who = spark.range(replicates).select(F.col("id").cast("int").alias("_r")).join(spark.createDataFrame([(a,), (b,)], f"{corpus} string"))
    d = distributions(counts, who, "_r", corpus)
    js = js_divergence(d.where(F.col(corpus) == a).drop(corpus), d.where(F.col(corpus) == b).drop(corpus), "_r")
    plain = sums.groupBy("_r", corpus).agg(*[F.max(F.when(F.col("pos") == len(keys) + i, F.col("n"))).alias(c) for i, c in enumerate(count_columns())])
    gaps = scalar_gaps(derived(plain, "_r", corpus), corpus, a, b, "_r")
    per = overall(js.select("_r", F.concat(F.lit("dist:"), "block").alias("name"), F.col("js").alias("value")).unionByName(gaps), "_r")
    return per.agg(F.round(F.percentile("overall", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("overall", F.lit(0.975)), 4).alias("high"))
