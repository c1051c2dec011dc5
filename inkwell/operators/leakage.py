"""Leakage of training text into other text: shared n-grams, copied runs, entities, probes and echo.

Token tables are exploded once and meet on 128-bit gram digests by equi-joins; the longest copied run comes from
islands on diagonals (same offset between the two texts), not from joins repeated for every length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.functions import text as T
from inkwell.session import ship


def positioned_grams(docs: DataFrame, key: str, n: int = X.VERBATIM_N) -> DataFrame:
    """key, position and digest of the n-gram of every place of every document."""
    grams = docs.select(key, F.posexplode(T.grams(T.leak_tokens(F.col("text")), n)).alias("pos", "_g"))
    return grams.select(key, "pos", F.unhex(F.md5("_g")).alias("gram"))


def shared_grams(docs: DataFrame, training: DataFrame, key: str, train_key: str, n: int = X.VERBATIM_N) -> DataFrame:
    """Distinct (key, gram) that also occur in the training texts."""
    known = positioned_grams(training, train_key, n).select("gram").distinct()
    return positioned_grams(docs, key, n).select(key, "gram").distinct().join(known, "gram", "left_semi")


def verbatim_rate(docs: DataFrame, training: DataFrame, key: str, train_key: str, n: int = X.VERBATIM_N) -> DataFrame:
    """One row: documents, those with a shared n-gram, their rate and the gate's verdict."""
    hits = shared_grams(docs, training, key, train_key, n).agg(F.countDistinct(key).alias("hits"))
    total = docs.agg(F.count("*").alias("n"))
    rate = F.col("hits") / F.greatest(F.col("n"), F.lit(1))
    # both sides are one row
    return total.join(F.broadcast(hits)).select("n", "hits", F.round(rate, 4).alias("rate"), F.when(rate > X.VERBATIM_GATE, "FAIL").otherwise("PASS").alias("verdict"))


def longest_runs(docs: DataFrame, training: DataFrame, key: str, train_key: str, n: int = X.VERBATIM_N, cap: int = X.RUN_CAP) -> DataFrame:
    """key and longest run of tokens, up to ``cap``, that a training text holds in the same order."""
    a = positioned_grams(docs, key, n)
    b = positioned_grams(training, train_key, n).select(F.col(train_key).alias("_t"), F.col("pos").alias("_q"), "gram")
    met = a.join(b, "gram").select(key, "_t", "pos", (F.col("_q") - F.col("pos")).alias("_d"))
    order = Window.partitionBy(key, "_t", "_d").orderBy("pos")
    islands = met.withColumn("_i", F.col("pos") - F.row_number().over(order))
    runs = islands.groupBy(key, "_t", "_d", "_i").agg(F.count("*").alias("_n"))
    return runs.groupBy(key).agg(F.least(F.max("_n") + (n - 1), F.lit(cap)).alias("longest_run"))


def proper_nouns(text: Column) -> Column:
    return T.found(text, X.PROPER_NOUN)


def entity_vocabulary(docs: DataFrame, min_count: int = 2) -> DataFrame:
    """Proper nouns that don't open a sentence, with their counts."""
    inner = F.transform(F.split(F.col("text"), T.rx(X.SIMPLE_SENTENCE_END), -1), lambda s: proper_nouns(F.substring(s, 2, 1 << 30)))
    words = docs.select(F.explode(F.flatten(inner)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def entity_emission(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word and n of the vocabulary's words in the documents."""
    said = docs.select(F.explode(proper_nouns(F.col("text"))).alias("word"))
    return said.join(vocabulary.select("word"), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


def emission_summary(emitted: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: distinct words, occurrences and occurrences per document (3 places)."""
    n = docs.agg(F.count("*").alias("_n"))
    sums = emitted.agg(F.count("*").alias("n_distinct_leaked"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_occurrences"))
    return sums.join(F.broadcast(n)).select("n_distinct_leaked", "n_occurrences", F.round(F.col("n_occurrences") / F.greatest(F.col("_n"), F.lit(1)), 3).alias("per_generation"))


def fact_probes(docs: DataFrame, key: str, most: int = X.MAX_PROBES) -> DataFrame:
    """Cloze probes, the first ``most`` in document and sentence order: sentences of 8 to 40 words whose first
    name or number after the first character is masked."""
    parts = docs.select(key, F.posexplode(F.split("text", T.rx(X.SIMPLE_SENTENCE_END), -1)).alias("pos", "sentence"))
    n = T.word_count(F.col("sentence"))
    rest = F.substring("sentence", 2, 1 << 30)
    probes = parts.where((n >= 8) & (n <= 40)).withColumn("answer", F.regexp_extract(rest, T.rx(X.PROBE_ANSWER), 1)).where("answer <> ''")
    at = F.expr("instr(substring(sentence, 2), answer)")
    masked = F.concat(F.substring("sentence", 1, 1), F.expr("substring(sentence, 2, instr(substring(sentence, 2), answer) - 1)"), F.lit("____"), F.expr("substring(substring(sentence, 2), instr(substring(sentence, 2), answer) + length(answer))"))
    return probes.where(at > 0).select(key, "pos", masked.alias("probe"), "answer").orderBy(key, "pos").limit(most)


def probe_recall(scored: DataFrame) -> DataFrame:
    """n and recall (null without probes) of rows (answer, completion)."""
    hit = F.lower("completion").contains(F.lower("answer"))
    return scored.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("int")), 4).alias("recall"))


#: Query vectors that one pass over the training vectors serves.
ECHO_BLOCK = 16384


def _unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length one as rows, and the places of those that are neither null nor zero."""
    places = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if not len(places):
        return np.zeros((0, 0)), places
    whole = column.take(pa.array(places))
    rows = whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(places), -1)
    norm = np.sqrt((rows * rows).sum(1))
    return rows[norm > 0] / norm[norm > 0, None], places[norm > 0]


def semantic_echo(queries: DataFrame, training: DataFrame, key: str, vector: str, among: bool = False) -> DataFrame:
    """Highest cosine of each query vector with any training vector; ``among``: the queries are training rows, too, and
    a row of a query's own key is not compared with it. Null and zero vectors are left out.

    Queries go in blocks of at most ``ECHO_BLOCK``, each broadcast; training vectors stream past a block, and a task
    sends on one row per query of the block. Keys are unique and not null.
    """
    ship(training.sparkSession)
    blocks = max(1, -(-queries.count() // ECHO_BLOCK))
    out = None
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).select(F.col(key).cast("long").alias("key"), vector)
        arrow = mine.toArrow().combine_chunks()
        unit, places = _unit_rows(arrow.column(1).combine_chunks()) if arrow.num_rows else (np.zeros((0, 0)), np.zeros(0, np.int64))
        names = arrow.column(0).to_numpy()[places] if arrow.num_rows else places
        order = np.argsort(names)
        shared = training.sparkSession.sparkContext.broadcast((names[order], unit[order]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, q = shared.value
            best = np.full(len(own), -np.inf)
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    rows, kept = _unit_rows(batch.column(1))
                    if not len(kept) or not len(own):
                        continue
                    cosine = rows @ q.T
                    if among:
                        ids = batch.column(0).to_numpy(zero_copy_only=False)[kept]
                        where = np.minimum(np.searchsorted(own, ids), len(own) - 1)
                        self_ = np.flatnonzero(own[where] == ids)
                        cosine[self_, where[self_]] = -np.inf
                    best = np.maximum(best, cosine.max(0))
            seen = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(own[seen], pa.int64()), pa.array(best[seen], pa.float64())], ["key", "echo"])

        part = training.select(F.col(key).cast("long").alias("key"), vector).mapInArrow(run, "key long, echo double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(F.col("key").alias(key)).agg(F.max("echo").alias("echo"))
