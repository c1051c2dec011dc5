"""Analytics over run records: agreement of two instruments, sweeps, loci, stages, noise floors, costs.

Records are flat rows: rel (path of the run), av, leak, verdicts, wall-clock and so on, one per run.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.operators.verifier import average_ranks


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, rank correlation with ties averaged (1 for constant input), disagreement (1 - rho) / 2."""
    whole = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    ranked = average_ranks(average_ranks(whole, "_a", "_ra"), "_b", "_rb")
    s = ranked.agg(
        F.count("*").alias("n"), F.sum("_ra").alias("sa"), F.sum("_rb").alias("sb"), F.sum(F.col("_ra") * F.col("_rb")).alias("ab"), F.sum(F.col("_ra") * F.col("_ra")).alias("aa"), F.sum(F.col("_rb") * F.col("_rb")).alias("bb")
    )
    n = F.col("n")
    va, vb = n * F.col("aa") - F.col("sa") * F.col("sa"), n * F.col("bb") - F.col("sb") * F.col("sb")
    rho = F.when((va <= 0) | (vb <= 0), F.lit(1.0)).otherwise((n * F.col("ab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb))
    return s.select("n", F.round(rho, 4).alias("spearman"), F.round((1 - rho) / 2, 4).alias("rank_disagreement")).where(n >= 2)


def gap_summary(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean and largest absolute difference of two instruments."""
    gap = F.abs(F.col(a) - F.col(b))
    return rows.where(gap.isNotNull()).agg(F.round(F.avg(gap), 4).alias("mean_abs_diff"), F.round(F.max(gap), 4).alias("max_abs_diff"))


def flagged_runs(rows: DataFrame, run: str, a: str, b: str) -> DataFrame:
    """Runs whose instruments differ by more than twice the mean difference."""
    whole = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_g", F.abs(F.col(a) - F.col(b)))
    mean = whole.agg(F.avg("_g").alias("_m"))
    return whole.join(F.broadcast(mean)).where((F.col("_m") > 0) & (F.col("_g") > F.greatest(F.col("_m") * 2, F.lit(1e-9)))).select(run, a, b)


def failed(verdict: Column) -> Column:
    return F.coalesce(F.upper(verdict).startswith("FAIL"), F.lit(False))


def gates_ok(fluency: Column, leak: Column) -> Column:
    """Neither gate failed."""
    return ~failed(fluency) & ~failed(leak)


def veto(verdicts: Sequence[str]) -> Column:
    """Names of the verdict columns that failed."""
    return F.filter(F.array(*[F.when(failed(F.col(v)), F.lit(v)) for v in verdicts]), lambda v: v.isNotNull())


def sweep_table(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Each arm (ord, arm, actual_words, documents) with its few-shot baseline and adapter, their difference and
    gates; arms without a record keep nulls."""
    side = lambda kind, cols: records.select(F.col("rel").alias(f"_{kind}"), *[F.col(c).alias(f"{kind}_{c}") for c in cols])
    rel = lambda kind: F.concat(F.lit("sweep/"), F.col("arm"), F.lit(f"/{kind}"))
    out = manifest.join(side("baseline", ["av"]), rel("baseline") == F.col("_baseline"), "left")
    out = out.join(side("stage_a", ["av", "leak", "flu_verdict", "leak_verdict"]), rel("stage_a") == F.col("_stage_a"), "left")
    ok = F.col("_stage_a").isNotNull() & gates_ok(F.col("stage_a_flu_verdict"), F.col("stage_a_leak_verdict"))
    return out.select("ord", "arm", "actual_words", "documents", F.col("baseline_av"), F.col("stage_a_av").alias("adapter_av"), F.col("stage_a_leak").alias("leak"), (F.col("stage_a_av") - F.col("baseline_av")).alias("delta"), ok.alias("ok"))


def crossover(swept: DataFrame, least: float = 0.02) -> DataFrame:
    """One row: the first arm whose difference exceeds ``least`` with both gates passing, else null."""
    return swept.agg(F.min_by("arm", F.when((F.col("delta") > least) & F.col("ok"), F.col("ord"))).alias("crossover"), F.count_if((F.col("delta") > least) & F.col("ok")).alias("wins"))


def quick_view(swept: DataFrame) -> DataFrame:
    """arm and verdict: WIN above zero with gates, gated above zero without, no win otherwise."""
    verdict = F.when((F.col("delta") > 0) & F.col("ok"), "WIN").when(F.col("delta") > 0, "gated").otherwise("no win")
    return swept.select("ord", "arm", "delta", verdict.alias("verdict"))


def style_per_leak(av: Column, leak: Column, floor: Column) -> Column:
    """Style gained over the floor per unit of leakage."""
    return (av - F.coalesce(floor, F.lit(0.0))) / (leak + 0.01)


def locus_table(cells: DataFrame, records: DataFrame) -> DataFrame:
    """Cells (ord, rel, label) with their records and the style per leak over the run called floor."""
    floor = records.where("rel = 'floor'").agg(F.max("av").alias("_floor"))
    out = cells.join(records.select("rel", "trainable", "av", "leak", "wallclock"), "rel", "left").join(F.broadcast(floor))
    return out.select("ord", "label", "trainable", "av", "leak", F.round(style_per_leak(F.col("av"), F.col("leak"), F.col("_floor")), 2).alias("spl"), "wallclock")


def stage_table(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Stages A and A+B of the arms that have a second stage."""
    arm = F.regexp_extract("rel", "^sweep/([^/]+)/stage_[ab]$", 1)
    rows = records.withColumn("arm", arm).where("arm <> ''").withColumn("stage", F.when(F.col("rel").endswith("stage_b"), "A+B").otherwise("A"))
    both = rows.where("stage = 'A+B'").select("arm")
    return rows.join(both, "arm", "left_semi").join(manifest.select("arm", "ord", "actual_words"), "arm").select("ord", "actual_words", "stage", "av", "leak", "wallclock", gates_ok(F.col("flu_verdict"), F.col("leak_verdict")).alias("ok"))


def reference_arm(manifest: DataFrame, records: DataFrame, wanted: str) -> DataFrame:
    """One row: the wanted arm if it has a record, else the largest that has one, else the wanted one."""
    have = manifest.join(records.select(F.regexp_extract("rel", "^sweep/([^/]+)/stage_a$", 1).alias("arm")), "arm", "left_semi")
    return have.agg(F.coalesce(F.max(F.when(F.col("arm") == wanted, F.col("arm"))), F.max_by("arm", "ord"), F.lit(wanted)).alias("arm"))


def model_table(records: DataFrame) -> DataFrame:
    """Cross-model cells: model and arm from the path, baseline and adapter side by side."""
    p = F.split("rel", "/")
    rows = records.where(F.col("rel").startswith("matrix/models/")).select(F.get(p, F.lit(2)).alias("model"), F.get(p, F.lit(3)).alias("arm"), F.get(p, F.lit(4)).alias("kind"), "av", "leak")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = rows.groupBy("model", "arm").agg(pick("baseline", "av").alias("fewshot_av"), pick("baseline", "leak").alias("fewshot_leak"), pick("stage_a", "av").alias("adapter_av"), pick("stage_a", "leak").alias("adapter_leak"), F.count_if(F.col("kind") == "stage_a").alias("_n"))
    return wide.where("_n > 0").drop("_n")


def noise_floor(records: DataFrame, least: int = 3) -> DataFrame:
    """arm, kind, seeds, mean, sample deviation and range of cells with at least three seeds."""
    arm = F.regexp_extract("rel", "^sweep/([^/]+)/(?:seed[^/]*/)?(stage_a|baseline)$", 1)
    kind = F.regexp_extract("rel", "^sweep/([^/]+)/(?:seed[^/]*/)?(stage_a|baseline)$", 2)
    rows = records.where("av IS NOT NULL").withColumns({"arm": arm, "kind": kind}).where("arm <> ''")
    return rows.groupBy("arm", "kind").agg(F.count("*").alias("seeds"), F.round(F.avg("av"), 4).alias("mean"), F.round(F.stddev_samp("av"), 4).alias("sd"), F.round(F.max("av") - F.min("av"), 4).alias("range")).where(F.col("seeds") >= least)


def phase_of(rel: Column) -> Column:
    """First path part, or the first two under matrix."""
    p = F.split(rel, "/")
    return F.when(F.get(p, F.lit(0)) == "matrix", F.concat_ws("/", F.slice(p, 1, 2))).otherwise(F.get(p, F.lit(0)))


def provenance(records: DataFrame) -> DataFrame:
    """Records, trained runs, seconds, first and last stamp of every phase, and of all (phase null)."""
    rows = records.withColumn("phase", phase_of(F.col("rel")))
    return rows.rollup("phase").agg(F.count("*").alias("records"), F.count_if(F.coalesce("wallclock", F.lit(0.0)) > 0).alias("trained"), F.sum(F.coalesce("wallclock", F.lit(0.0))).alias("seconds"), F.min("generated_at").alias("first_stamp"), F.max("generated_at").alias("last_stamp"))


def baseline_delta(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """name and delta of metrics that both runs have; the sign says that more is better (higher_better)."""
    both = metrics.alias("m").join(baseline.select("name", F.col("value").alias("_b")), "name").where(F.col("value").isNotNull() & F.col("_b").isNotNull())
    d = F.col("value") - F.col("_b")
    return both.select("name", F.round(F.when(F.col("higher_better"), d).otherwise(-d), 4).alias("delta"))


def perplexity(losses: DataFrame, *by: str) -> DataFrame:
    """exp of the token-weighted mean loss of texts (loss, n_tokens); NaN if no text has tokens."""
    used = F.col("n_tokens") > 0
    total = F.sum(F.when(used, F.col("n_tokens")))
    value = F.exp(F.sum(F.when(used, F.col("loss") * F.col("n_tokens"))) / total)
    return losses.groupBy(*by).agg(F.coalesce(value, F.lit(float("nan"))).alias("perplexity"), F.count_if(used).alias("n_texts"))


def fluency_verdict(on: Column, off: Column, budget: float = X.FLUENCY_BUDGET) -> Column:
    """Whether perplexity with the adapter stays within the budget of that without."""
    regression = (on - off) / off
    return F.when(off.isNull() | F.isnan(off), F.lit(None)).when(regression <= budget, "PASS").otherwise("FAIL")


def overfit(log: DataFrame) -> DataFrame:
    """One row: whether the last evaluation loss exceeds the smallest by over 5 %."""
    return log.where("eval_loss IS NOT NULL").agg(F.max_by("eval_loss", "step").alias("last"), F.min("eval_loss").alias("best")).withColumn("overfit", F.col("last") > F.col("best") * 1.05)


def locus_of(name: Column) -> Column:
    """Attention, feed-forward or other, from a parameter's name."""
    return F.when(name.rlike(r"q_proj|k_proj|v_proj|o_proj"), "attention").when(name.rlike(r"gate_proj|up_proj|down_proj"), "mlp").otherwise("other")


def trainable_summary(parameters: DataFrame) -> DataFrame:
    """n, trainable n and share by locus of a parameter table (name, n, trainable)."""
    total = Window.partitionBy(F.lit(0))  # three rows
    per = parameters.groupBy(locus_of(F.col("name")).alias("kind")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("trainable"), F.col("n")).otherwise(0)).alias("trainable"))
    return per.withColumn("pct", F.round(F.col("trainable") * 100 / F.sum("n").over(total), 4))


def lora_scale(alpha: Column, rank: Column, rank_stabilised: Column) -> Column:
    return F.when(rank_stabilised, alpha / F.sqrt(rank)).otherwise(alpha / rank)


def update_norms(modules: DataFrame) -> DataFrame:
    """module and Frobenius norm of scale * B A, from the small r x r products (module, a, b, scale)."""

    @F.pandas_udf("double")
    def norm(a: pd.Series, b: pd.Series, scale: pd.Series) -> pd.Series:
        def one(x, y, s: float) -> float:
            x, y = np.stack([np.asarray(r, float) for r in x]), np.stack([np.asarray(r, float) for r in y])
            return float(s * np.sqrt(max(0.0, float(np.trace((y.T @ y) @ (x @ x.T))))))

        return pd.Series([one(x, y, s) for x, y, s in zip(a, b, scale)])

    return modules.select("module", locus_of(F.col("module")).alias("kind"), F.regexp_extract("module", r"layers\.(\d+)\.", 1).alias("layer"), norm("a", "b", "scale").alias("update_norm"))


def anatomy(norms: DataFrame) -> DataFrame:
    """Share of each locus in the summed norms."""
    total = Window.partitionBy(F.lit(0))
    return norms.groupBy("kind").agg(F.sum("update_norm").alias("norm")).withColumn("share", F.round(F.col("norm") / F.sum("norm").over(total), 4))


def largest_updates(norms: DataFrame, k: int = 12) -> DataFrame:
    """The k modules with the largest norms."""
    return norms.orderBy(F.desc("update_norm"), "module").limit(k)


def depth_profile(norms: DataFrame) -> DataFrame:
    """Summed norms by layer, one column per locus."""
    return norms.where("layer <> ''").groupBy(F.col("layer").cast("int").alias("layer")).pivot("kind", ["attention", "mlp", "other"]).agg(F.sum("update_norm")).orderBy("layer")


def size_rollup(files: DataFrame, levels: int = 2) -> DataFrame:
    """Bytes and files by the first path parts, and in all (prefix null)."""
    return files.withColumn("prefix", F.concat_ws("/", F.slice(F.split("path", "/"), 1, levels))).rollup("prefix").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


def publish_guard(files: DataFrame, private: Sequence[str], block: int = 100 << 20, warn: int = 50 << 20) -> DataFrame:
    """Files that may not be published, or only with a warning, and why."""
    marked = F.lit(False)
    for marker in private:
        marked = marked | F.col("path").contains(marker)
    verdict = F.when(marked, "private").when(F.col("bytes") > block, "too large").when(F.col("bytes") > warn, "large")
    return files.withColumn("verdict", verdict).where("verdict IS NOT NULL")
