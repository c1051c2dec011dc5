"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source has a weight and a schedule: a piecewise linear rate over training time 0 to 1. The
weights fix how many words a source gives in all (its target); the schedule, integrated, fixes when.
The words of a source form a line in a seeded shuffled order, repeated as often as the target needs.
The word at place c of that line falls due when the source's cumulative demand reaches c, so a
document's training position is the inverse of the integrated schedule at its first word.

Targets: sources in code point order (null last) take the weights in rotation and share the total;
a target stops at ``cap`` times its source's size, and the excess goes to the others by weight.

Scale: sizes are counted once and settled in a narrow table. A running sum over a source would put a
hot source in one task, so each source is cut into 4096 hash buckets: sums per bucket, a running sum
over at most 4096 rows per source, then a running sum inside a bucket. Sources, of which there may be as
many as hosts, are ranked and filled by running sums over range partitions.

Defined results: null text or no words gives size 0 and is never taken; a null source is a source of
its own; repeated rows are separate documents; only the last copy a source gives may be cut short
(``words`` below the size), which makes the words taken equal the rounded target. Texts of any length
are counted whole; an empty table gives an empty plan; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.ordered import numbered, running
from inkwell.session import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Rates at knots of training time, in rotation over the sources like the weights.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))


def _pick(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def due(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """Training time at which the integrated, normalised schedule reaches ``share`` (0 to 1)."""
    pieces, area = [], 0.0
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:]):
        pieces.append((t0, r0, (r1 - r0) / (t1 - t0), area))
        area += (r0 + r1) / 2 * (t1 - t0)
    need = share * F.lit(area)
    out = None
    for t0, r0, slope, before in pieces:
        more = need - F.lit(before)
        if slope:
            at = F.lit(t0) + (F.sqrt(F.greatest(F.lit(r0 * r0) + F.lit(2 * slope) * more, F.lit(0.0))) - F.lit(r0)) / F.lit(slope)
        else:
            at = F.lit(t0) + more / F.lit(r0)
        out = at if out is None else F.when(need >= F.lit(before), at).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3) -> DataFrame:
    """One row per source key: source_size, rank and target; ``sizes`` has words by key and bucket.

    Sources are ranked by name and then stand in order of their cap per weight. Those that stop at the cap come
    first there; what the first other one finds left, in words and in weight, sets the level of all others.
    """
    per = sizes.groupBy("_key").agg(F.sum("_words").alias("source_size"))
    named = numbered(per, ["_key"], "rank").withColumn("rank", F.col("rank") - 1)
    most = F.col("source_size") * cap
    weighed = named.withColumn("weight", _pick(weights, F.col("rank")).cast("long")).withColumn("_ratio", most.cast("double") / F.col("weight"))
    filled = running(weighed, ["_ratio", "_key"], {"_to_cap": most, "_to_weight": F.col("weight")})
    whole = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    left = F.lit(whole["n"]) - (F.col("_to_cap") - most)
    weight_left = F.lit(whole["w"]) - (F.col("_to_weight") - F.col("weight"))
    capped = most.cast("double") * weight_left < left.cast("double") * F.col("weight")
    level = filled.where(~capped).agg(F.max(left).alias("left"), F.max(weight_left).alias("weight")).first()
    shared = F.lit(level["left"]).cast("double") * F.col("weight") / F.lit(level["weight"])
    return filled.select("_key", "source_size", "rank", F.when(capped, most.cast("double")).otherwise(shared).alias("target"))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, schedules=SCHEDULES, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """What the mix takes of every document.

    Returns doc_id, source, size, source_size, target, taken, position (of the first word taken, null
    if none is) and copies: array of (copy, words, position). ``carry`` names more columns to keep.
    """
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(
        "doc_id",
        "source",
        *carry,
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b")).alias("_key"),
        order.alias("_order"),
        F.substring(order, 1, 3).alias("_bucket"),
    )
    if not carry:
        sized = settle(sized)
    sums = sized.groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"))
    if carry:  # wide rows are not settled; their sums are, so that the texts are counted twice and no more
        sums = settle(sums)
    ahead = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.select("_key", "_bucket", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"))
    buckets = buckets.join(targets(sums, weights, cap), "_key")
    inside = Window.partitionBy("_key", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.join(buckets, ["_key", "_bucket"]).withColumn("_at", F.col("_ahead") + F.sum("size").over(inside) - F.col("size"))
    goal = F.floor(F.col("target") + 0.5)

    def copy(k: Column) -> Column:
        start = k * F.col("source_size") + F.col("_at")
        share = start.cast("double") / F.greatest(goal, F.lit(1)).cast("double")
        when = None
        for i, schedule in enumerate(schedules):
            own = due(share, schedule)
            when = own if when is None else F.when(F.col("rank") % len(schedules) == i, own).otherwise(when)
        return F.struct(k.cast("int").alias("copy"), F.greatest(F.least(goal - start, F.col("size")), F.lit(0)).alias("words"), when.alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: copy(k.cast("long"))), lambda c: c["words"] > 0)
    return placed.withColumn("copies", copies).select(
        "doc_id",
        "source",
        *carry,
        "size",
        "source_size",
        "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"),
        F.when(F.size("copies") > 0, F.col("copies")[0]["position"]).alias("position"),
        "copies",
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, schedules=SCHEDULES, seed: str = "mix") -> DataFrame:
    """The training stream: a row per copy taken, with the columns of ``docs``, range-sorted by position.

    A copy that is cut short keeps the text up to its last word taken. Columns travel under names of their own, so
    that none can clash.
    """
    held = [f"_held{i}" for i in range(len(docs.columns))]
    rows = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(h) for c, h in zip(docs.columns, held)])
    whole = plan(rows, weights, cap, schedules, seed, carry=held)
    taken = whole.select(*held, "doc_id", "size", F.explode("copies").alias("_copy"))
    text, words = F.col(held[docs.columns.index("text")]), F.col("_copy.words")
    head = F.concat_ws("", F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), F.greatest(words, F.lit(1)).cast("int")))
    own = F.when(words < F.col("size"), head).otherwise(text)
    new = {"text": own, "n_chars": F.length(own).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": own}
    out = taken.select(F.col("_copy.position").alias("_position"), "doc_id", *[new.get(c, F.col(h)).alias(f"{h}_") for c, h in zip(docs.columns, held)])
    return out.orderBy("_position", "doc_id").select(*[F.col(f"{h}_").alias(c) for c, h in zip(docs.columns, held)])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: what the mix takes of each document, range-sorted by training position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = plan(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _due_sql(share: str) -> str:
    """SQL of ``due`` for the source's own schedule."""
    whole = []
    for i, schedule in enumerate(SCHEDULES):
        text, area, pieces = "", 0.0, []
        for (t0, r0), (t1, r1) in zip(schedule, schedule[1:]):
            pieces.append((t0, r0, (r1 - r0) / (t1 - t0), area))
            area += (r0 + r1) / 2 * (t1 - t0)
        for t0, r0, slope, before in reversed(pieces):
            text += f" WHEN {share} * {area}::DOUBLE >= {before}::DOUBLE THEN {t0}::DOUBLE + (sqrt(greatest({r0 * r0}::DOUBLE + {2 * slope}::DOUBLE * ({share} * {area}::DOUBLE - {before}::DOUBLE), 0.0::DOUBLE)) - {r0}::DOUBLE) / {slope}::DOUBLE"
        whole.append(f"WHEN rank % {len(SCHEDULES)} = {i} THEN least(greatest(CASE{text} END, 0.0::DOUBLE), 1.0::DOUBLE)")
    return f"CASE {' '.join(whole)} END"


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
filled AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS l,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS ws
  FROM weighed WINDOW w AS (ORDER BY 3.0 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (3 * source_size)::DOUBLE * ws < l::DOUBLE * weight AS c FROM filled),
level AS (SELECT max(l) AS l0, max(ws) AS w0 FROM capped WHERE NOT c),
goals AS (SELECT source, source_size, rank, CASE WHEN c THEN (3 * source_size)::DOUBLE ELSE l0::DOUBLE * weight / w0 END AS target FROM capped, level),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.rank, floor(g.target + 0.5)::BIGINT AS goal,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS a
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (greatest(least(goal - a, size), 0) + greatest(least(goal - source_size - a, size), 0) + greatest(least(goal - 2 * source_size - a, size), 0))::BIGINT AS taken,
  CASE WHEN least(goal - a, size) > 0 THEN {_due_sql("(a::DOUBLE / greatest(goal, 1)::DOUBLE)")} END AS position
FROM placed
"""
