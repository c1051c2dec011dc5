"""What an evaluation joins: generations with references, controls with runs, instruments with records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.functions import text as T
from inkwell.operators.ordered import numbered
from inkwell.operators.records import perplexity, reference_arm


def with_reference(generated: DataFrame, references: DataFrame, cut: int = X.SAMPLE_CHARS) -> DataFrame:
    """i (from 0), pair_id, prompt, generated and real of every generation (pair_id, seq, prompt, completion).

    The reference (pair_id, seq, response) of the same pair_id is the real text, the first one if there are
    several; otherwise the i-th of all references, counted round and round. Texts are cut to ``cut`` characters.
    """
    mine = numbered(generated, ["seq"], "i").withColumn("i", F.col("i") - 1)
    own = references.groupBy("pair_id").agg(F.min_by("response", "seq").alias("_own"))
    every = numbered(references.select("seq", "response"), ["seq"], "_j").select((F.col("_j") - 1).alias("_j"), F.col("response").alias("_any"))
    n = references.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    both = mine.join(own, "pair_id", "left").join(F.broadcast(n)).withColumn("_at", F.col("i") % F.col("_n"))
    found = both.join(every, F.col("_at") == F.col("_j"), "left")
    short = lambda c: F.substring(c, 1, cut)
    return found.select("i", "pair_id", F.coalesce("prompt", F.lit("")).alias("prompt"), short(F.coalesce("completion", F.lit(""))).alias("generated"), short(F.coalesce("_own", "_any")).alias("real"))


def samples(generated: DataFrame, references: DataFrame, most: int = X.SAMPLES) -> DataFrame:
    """The first generations with their references, for reading."""
    return with_reference(generated.orderBy("seq").limit(most), references)


def contamination(author: DataFrame, distractor: DataFrame, most: int = X.CONTAMINATION_CAP, least: int = X.CONTAMINATION_MIN) -> DataFrame:
    """One row: perplexity of a base model on the first non-blank texts of each side (ord, text, loss, n_tokens), and
    their ratio; under five texts on a side is an error."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        first = rows.where(T.strip(F.col("text")) != "").orderBy("ord").limit(most)
        n = F.count("*")
        enough = F.when(n >= least, n).otherwise(F.raise_error(F.lit(f"too few {name} texts for a ratio")).cast("long"))
        return perplexity(first).select(F.round("perplexity", 4).alias(f"ppl_{name}"), F.col("perplexity").alias(f"_{name}")).join(F.broadcast(first.agg(enough.alias(f"n_{name}_texts"))))

    both = side(author, "author").join(F.broadcast(side(distractor, "distractor")))  # one row each
    ratio = F.round(F.col("_author") / F.col("_distractor"), 4)
    return both.select("ppl_author", "ppl_distractor", ratio.alias("familiarity_ratio"), "n_author_texts", "n_distractor_texts")


def control_side(records: DataFrame, manifest: DataFrame, ratio: float | None, wanted: str = "full") -> DataFrame:
    """(measure, value) of one side: familiarity ratio, floor, few-shot and adapter rates, and leak of the reference arm."""
    arm = reference_arm(manifest, records, wanted)
    rel = lambda kind: F.concat(F.lit("sweep/"), "arm", F.lit(f"/{kind}"))
    pick = lambda c, which: F.max(F.when(which, F.col(c)))
    found = records.join(F.broadcast(arm)).agg(
        F.lit(ratio).cast("double").alias("ratio"),
        pick("av", F.col("rel") == "floor").alias("floor_av"),
        F.coalesce(pick("av", F.col("rel") == rel("baseline")), pick("av", F.col("rel") == "baseline")).alias("fewshot_av"),
        F.coalesce(pick("av", F.col("rel") == rel("stage_a")), pick("av", F.col("rel") == "stage_a")).alias("adapter_av"),
        F.coalesce(pick("leak", F.col("rel") == rel("stage_a")), pick("leak", F.col("rel") == "stage_a")).alias("leak"),
    )
    return found.unpivot([], found.columns, "measure", "value")


def control_table(public: DataFrame, private: DataFrame | None = None) -> DataFrame:
    """measure, public and private values side by side; the private column is null without a control."""
    left = public.select("measure", F.col("value").alias("public"))
    if private is None:
        return left.withColumn("private", F.lit(None).cast("double"))
    return left.join(private.select("measure", F.col("value").alias("private")), "measure", "full_outer")


def with_second_instrument(records: DataFrame, instruments: DataFrame) -> DataFrame:
    """Records with ``av2``, the second instrument's rate of the same run (run, av_second), null where it has none."""
    return records.join(instruments.groupBy(F.col("run").alias("rel")).agg(F.max_by("av_second", F.col("run")).alias("av2")), "rel", "left")


def distinct_aucs(records: DataFrame) -> DataFrame:
    """One row: the verifier's held-out AUCs that the records name, and whether there are several, in which case
    records were measured by different rulers."""
    found = records.agg(F.sort_array(F.collect_set(F.round("auc", 4))).alias("aucs"))
    return found.select("aucs", (F.size("aucs") > 1).alias("moved"))


def frontier_point(rel: Column) -> Column:
    """(series, label) of a record's path, null for records that no figure shows."""
    parts = F.split(rel, "/")
    part = lambda i: F.get(parts, F.lit(i))
    point = lambda series, label: F.struct(F.lit(series).alias("series"), label.alias("label"))
    arm = (part(0) == "sweep") & (F.size(parts) == 3)
    out = F.when(rel == "floor", point("base floor", F.lit("base")))
    for kind, series in (("baseline", "few-shot"), ("stage_a", "stage A"), ("stage_b", "stage A+B")):
        out = out.when(arm & (part(2) == kind), point(series, part(1)))
    return out.when((part(0) == "matrix") & (part(1) == "rq2"), point("stage A", F.get(F.split(part(2), "_"), F.lit(0))))


def frontier(records: DataFrame) -> DataFrame:
    """rel, series, label, av and leak of the records that the frontier shows."""
    shown = records.where("av IS NOT NULL AND leak IS NOT NULL AND NOT contains(rel, '/trajectory/')").withColumn("_p", frontier_point(F.col("rel")))
    return shown.where("_p IS NOT NULL").select("rel", "_p.series", "_p.label", "av", "leak")


def trajectory(records: DataFrame) -> DataFrame:
    """step, av and leak of a run's checkpoints (.../trajectory/.../step-N), by step."""
    step = F.regexp_extract("rel", r"/trajectory/(?:.*/)?step-([0-9]+)(?:/|$)", 1)
    rows = records.where("av IS NOT NULL AND leak IS NOT NULL").withColumn("_s", step).where("_s <> ''")
    return rows.select(F.col("_s").cast("int").alias("step"), "av", "leak").orderBy("step")


def response_words(pairs: DataFrame) -> DataFrame:
    """doc_id and n_words, every distinct response counted once however many questions it has."""
    once = pairs.select("doc_id", "response").distinct()
    return once.groupBy("doc_id").agg(F.sum(T.word_count(F.col("response"))).alias("n_words"))


def other_authors(rows: DataFrame, author: str, who: str = "author") -> DataFrame:
    """Distractor rows: those of everyone but the author; rows without a name stay."""
    return rows.where(~F.col(who).eqNullSafe(F.lit(author)))


def distractor_counts(rows: DataFrame, who: str = "author") -> DataFrame:
    """Windows, words (n_words) and distinct authors of every author, and of all (author null)."""
    return rows.rollup(who).agg(F.count("*").alias("windows"), F.sum("n_words").alias("words"), F.countDistinct(who).alias("authors"))


def ordered_arms(records: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """arm and place: the manifest's order, or without one by words and then by the first stamp of the arm's records."""
    if manifest is not None:
        return manifest.select("arm", F.col("ord").cast("int").alias("place"))
    arm = F.regexp_extract("rel", "^sweep/([^/]+)/", 1)
    per = records.withColumn("arm", arm).where("arm <> ''").groupBy("arm").agg(F.min("actual_words").alias("_w"), F.min("generated_at").alias("_t"))
    return numbered(per, [F.asc_nulls_last("_w"), "_t", "arm"], "_i").select("arm", (F.col("_i") - 1).cast("int").alias("place"))
