"""Named entities as spans that a recogniser gives: which of them may go, the text without them, and tag trigrams.

A recogniser is a column of spans (start, end, label; code points, end exclusive), from a Pandas UDF around any
model or from ``name_spans``, the offline one. Without a recogniser texts stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.functions import text as T
from inkwell.operators.stylometry import js_divergence

#: Two or more capitalised words in a row: what the offline recogniser takes for a person.
NAMES = r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"
_HYPHENS = ["-", "‐", "‑"]


def name_spans(text: Column, pattern: str = NAMES, label: str = "PERSON") -> Column:
    """Spans of a pattern's matches, from the lengths of the matches and of the parts between them."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    total = lambda lengths: F.aggregate(lengths, F.lit(0), lambda a, n: a + n)

    def one(piece: Column, i: Column) -> Column:
        start = total(F.transform(F.slice(parts, F.lit(1), i + 1), F.length)) + total(F.transform(F.slice(found, F.lit(1), i), F.length))
        return F.struct(start.alias("start"), (start + F.length(piece)).alias("end"), F.lit(label).alias("label"))

    return F.transform(found, one)


def may_go(text: Column, span: Column, never: Sequence[str] = ()) -> Column:
    """Whether a span can be replaced without harm to a word: it is no listed term, no person in capitals, and its
    edges cut neither a word nor a compound. An apostrophe may follow, as in a possessive; dashes join nothing."""
    at = lambda i: F.substring(text, i + 1, F.lit(1))
    piece = F.substring(text, span["start"] + 1, span["end"] - span["start"])
    word = lambda c: c.rlike("[0-9A-Za-z]")
    before = F.when(span["start"] > 0, at(span["start"] - 1)).otherwise(F.lit(""))
    further = F.when(span["start"] > 1, at(span["start"] - 2)).otherwise(F.lit(""))
    listed = F.lower(T.strip(piece)).isin(*X.NEVER_SCRUB, *[t.strip().lower() for t in never if t.strip()])
    capitals = (span["label"] == "PERSON") & (F.upper(piece) == piece) & (F.lower(piece) != piece) & (F.length(T.strip(piece)) > 1)
    left = word(before) | (before.isin(*_HYPHENS, "'", "’") & word(further))
    right = word(at(span["end"])) | (at(span["end"]).isin(*_HYPHENS) & word(at(span["end"] + 1)))
    return ~(listed | capitals | left | right)


def scrub_entities(rows: DataFrame, spans: Column | None, never: Sequence[str] = (), text: str = "text") -> DataFrame:
    """``rows`` with entities replaced by their placeholders, and ``entities``: array of (label, replaced) in order.

    Labels without a placeholder stay, as do spans that may not go; of overlapping spans the first one counts.
    """
    if spans is None:
        return rows.withColumn("entities", F.array().cast("array<struct<label:string,replaced:boolean>>"))
    names = F.create_map(*[F.lit(v) for pair in X.NER_PLACEHOLDERS.items() for v in pair])
    own = F.col(text)
    known = F.filter(F.array_sort(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,label:string>>"))), lambda s: s["label"].isin(*X.NER_PLACEHOLDERS))
    judged = F.transform(known, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), may_go(own, s, never).alias("go")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(own, state["at"] + 1, s["start"] - state["at"])
        put = F.concat(state["out"], gap, F.lit("<"), F.element_at(names, s["label"]), F.lit(">"))
        return F.when(s["go"] & (s["start"] >= state["at"]), F.struct(s["end"].alias("at"), put.alias("out"))).otherwise(state)

    done = rows.withColumn("_judged", judged).withColumn("_done", F.aggregate("_judged", start, step))
    whole = F.concat(F.col("_done.out"), F.substring(own, F.col("_done.at") + 1, F.length(own)))
    seen = F.transform("_judged", lambda s: F.struct(s["label"].alias("label"), s["go"].alias("replaced")))
    return done.withColumn("entities", seen).withColumn(text, whole).drop("_judged", "_done")


def coarse_tags(text: Column) -> Column:
    """The offline tagger: function word, number, name, other word or sign, for every token."""
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]"), F.lit(0))
    tag = lambda w: F.when(F.lower(w).isin(*X.FUNCTION_WORDS), "FUNC").when(w.rlike("^[0-9]"), "NUM").when(w.rlike("^[A-Z]"), "NAME").when(w.rlike("^[a-z]"), "WORD").otherwise("SIGN")
    return F.transform(tokens, tag)


def tag_trigrams(rows: DataFrame, tags: Column, *by: str) -> DataFrame:
    """(by..., trigram, n): counts of three tags in a row, all of them; texts of under three tags have none."""
    three = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 2, F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(3)), " "))
    flat = rows.select(*by, tags.alias("_t")).where(F.size("_t") >= 3).select(*by, F.explode(three(F.col("_t"))).alias("trigram"))
    return flat.groupBy(*by, "trigram").agg(F.count("*").alias("n"))


def tag_divergence(rows: DataFrame, tags: Column, corpus: str, a: str, b: str) -> DataFrame:
    """(block, js): divergence of two corpora's tag trigrams over the union of what either has."""
    counts = tag_trigrams(rows.where(F.col(corpus).isin(a, b)), tags, corpus)
    totals = counts.groupBy(corpus).agg(F.sum("n").alias("_t"))  # two rows
    shares = counts.join(F.broadcast(totals), corpus).select(corpus, F.lit("tag_trigrams").alias("block"), F.col("trigram").alias("key"), (F.col("n") / F.col("_t")).alias("p"))
    return js_divergence(shares.where(F.col(corpus) == a).drop(corpus), shares.where(F.col(corpus) == b).drop(corpus))
