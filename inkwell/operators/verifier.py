"""Authorship verifier: centroid and logistic heads, exact AUC, threshold sweep and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.functions import text as T
from inkwell.operators.ordered import numbered, running
from inkwell.operators.splits import class_balance, keep_first


def unit(vector: Column) -> Column:
    """The vector at length one."""
    return F.transform(vector, lambda x: x.cast("double") / F.sqrt(T.dot(vector, vector)))


def held_out(rows: DataFrame, group: str, share: float = X.AV_TEST_FRACTION, seed: int = X.SEED) -> DataFrame:
    """``rows`` with ``test``: whole groups, the first share of a seeded order, are held out."""
    groups = rows.select(group).distinct().withColumn("_o", T.seeded(seed, F.col(group)))
    placed = numbered(groups, ["_o", group], "_i")
    n = placed.agg(F.count("*").alias("_n"))
    marked = placed.join(F.broadcast(n)).select(group, (F.col("_i") <= F.ceil(F.col("_n") * F.lit(share))).alias("test"))
    return rows.join(marked, group)


def centroid(rows: DataFrame, vector: str) -> DataFrame:
    """(dim, value): mean of the vectors, at length one."""
    mean = rows.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(F.lit(0)))) + 1e-9  # one row per dimension
    return mean.select("dim", (F.col("m") / norm).alias("value"))


def centroid_scores(rows: DataFrame, center: DataFrame, key: str, vector: str, *carry: str) -> DataFrame:
    """Inner product of every vector with the centroid."""
    one = center.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("_c"))
    return rows.join(F.broadcast(one)).select(key, *carry, T.dot(F.col(vector), F.col("_c")).alias("score"))


def logistic_scores(rows: DataFrame, key: str, vector: str, label: str, test: str, *carry: str) -> DataFrame:
    """Scores of a balanced, L2-regularised logistic head fitted on the rows that aren't held out.

    regParam is 1 / (C n) at C = 1, classes weigh n / (2 n_c), and features aren't standardised.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    train = rows.where(~F.col(test)).select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    n = sum(sizes.values())
    weight = F.when(F.col("label") == 1, n / (2 * sizes.get(1.0, 1))).otherwise(n / (2 * sizes.get(0.0, 1)))
    head = LogisticRegression(weightCol="w", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=2000)
    model = head.fit(train.withColumn("w", weight))
    ready = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return model.transform(ready).select(key, label, test, *carry, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def training_texts(author: DataFrame, distractor: DataFrame, balance: bool = True, least: int = X.AV_MIN_TEXTS) -> DataFrame:
    """label (1 author), text, group and seq of what a verifier learns from (text, group, seq on either side).

    Blank texts go, of equal texts of a side the first stays, and both sides have as many as the smaller one if they
    are to be balanced. Fewer than six texts on a side are an error.
    """

    def side(rows: DataFrame, label: int) -> DataFrame:
        own = rows.select(F.lit(label).alias("label"), T.strip(F.col("text")).alias("text"), "group", "seq").where("text <> ''")
        return keep_first(own, ["text"], ["seq"])

    both = side(author, 1).unionByName(side(distractor, 0))
    sizes = {r["label"]: r["n"] for r in both.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    few = min(sizes.get(0, 0), sizes.get(1, 0))
    if few < least:
        raise ValueError(f"a verifier needs {least} texts on each side, one has {few}")
    return class_balance(both, "label", ["seq"]) if balance else both


def average_ranks(rows: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """``rows`` with 1-based ranks; ties share their mean. Ranks come from counts per distinct value."""
    per = running(rows.groupBy(value).agg(F.count("*").alias("_c")), [value], {"_to": F.col("_c")})
    return rows.join(per.select(value, (F.col("_to") - F.col("_c") + (F.col("_c") + 1) / 2).alias(name)), value)


def _per_score(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Rows and positives of every distinct score."""
    return scored.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_c"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: exact AUC by the rank sum of positives; null where a class is missing."""
    per = running(_per_score(scored, label, score), [score], {"_to": F.col("_c")})
    ranked = per.withColumn("_r", F.col("_to") - F.col("_c") + (F.col("_c") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("_r") * F.col("_p")).alias("r"), F.sum("_p").alias("p"), F.sum("_c").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(F.round((F.col("r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0)), 4).alias("auc"), p.alias("n_positive"), q.alias("n_negative"))


def threshold_sweep(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """score, true and false positives at or above it, and balanced accuracy, for every distinct score."""
    per = _per_score(scored, label, score)
    swept = running(per, [F.desc(score)], {"tp": F.col("_p"), "fp": F.col("_c") - F.col("_p")})
    every = swept.agg(F.sum("_p").alias("_all_p"), F.sum(F.col("_c") - F.col("_p")).alias("_all_q"))
    balanced = (F.col("tp") / F.nullif(F.col("_all_p"), F.lit(0)) + (F.col("_all_q") - F.col("fp")) / F.nullif(F.col("_all_q"), F.lit(0))) / 2
    return swept.join(F.broadcast(every)).select(F.col(score).alias("threshold"), "tp", "fp", balanced.alias("balanced_accuracy"))


def best_threshold(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the lowest threshold of the best balanced accuracy."""
    swept = threshold_sweep(scored, label, score)
    best = swept.orderBy(F.desc(F.round("balanced_accuracy", 12)), "threshold").limit(1)
    return best.select(F.col("threshold"), F.round("balanced_accuracy", 4).alias("accuracy"))


def evaluate(scored: DataFrame, threshold: DataFrame, by: str | None = None, score: str = "score") -> DataFrame:
    """Attribution rate, mean, median, population deviation, n and threshold of scores, in all or by a column."""
    rows = scored.join(F.broadcast(threshold.select("threshold")))
    grouped = rows.groupBy(F.coalesce(by, F.lit("unknown")).alias(by)) if by else rows.groupBy()
    return grouped.agg(
        F.round(F.avg((F.col(score) >= F.col("threshold")).cast("int")), 4).alias("attribution_rate"),
        F.round(F.avg(score), 4).alias("score_mean"),
        F.round(F.percentile(score, F.lit(0.5)), 4).alias("score_median"),
        F.round(F.stddev_pop(score), 4).alias("score_sd"),
        F.count("*").alias("n"),
        F.round(F.max("threshold"), 4).alias("threshold"),
    )


def auc_verdict(auc: Column) -> Column:
    """Too weak to use, suspiciously good, or fine."""
    return F.when(auc < X.AUC_LOW, "FAIL").when(auc > X.AUC_HIGH, "WARN").otherwise("PASS")
