"""Document filters and rewrites: normalisation, template and prose tests, scrubbing.

Every operator is a chain of built-in expressions, so filters reach the scan and the whole chain runs in
one stage. Costly patterns run only where a cheap substring test says that they can match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.functions import text as T


def normalize(text: Column, drop_bullet_runs: bool = True) -> Column:
    """Running prose only: no code, quotes, sign-offs, tables, page numbers or bullet runs."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))

    def cut(own: Column, pattern: str, to: str = "", hint: str | None = None) -> Column:
        if hint is None:
            return T.sub(own, pattern, to)
        return T.let(own, lambda t: F.when(t.rlike(hint), T.sub(t, pattern, to)).otherwise(t))

    out = cut(out, X.CODE_FENCE, " ", "```")
    out = cut(out, X.QUOTED_LINE, "", ">")
    out = cut(out, X.ORIGINAL_MESSAGE, "", "^-")
    out = cut(out, X.FORWARDED_MESSAGE, "", "^-")
    out = cut(out, X.WROTE, "", "wrote:")
    out = cut(out, X.FROM_SUBJECT, "", "Subject:")
    out = cut(out, X.CONFIDENTIALITY, "", "(?i)intended|confidential")
    out = cut(out, X.UNSUBSCRIBE, "", "(?i)unsubscribe|in your browser")
    out = cut(out, X.SENT_FROM, "", "(?i)sent from my|get outlook for")
    for _ in range(2):
        out = cut(out, X.SIGNOFF)
    out = cut(out, X.TABLE_ROW, "", r"\|")
    out = cut(out, X.PAGE_NUMBER, "", "[0-9]")
    if drop_bullet_runs:
        out = cut(out, X.BULLET_RUN, "\n")
    out = cut(out, X.URL, "<link>", r"https?://|www\.")
    out = F.replace(F.replace(out, F.lit(" "), F.lit(" ")), F.lit("​"), F.lit(""))
    out = T.sub(out, X.SPACE_RUN, " ")
    return T.strip(T.sub(out, X.NEWLINE_RUN, "\n\n"))


def prose_ratio(text: Column) -> Column:
    """Share of non-empty lines of at least eight words that aren't headings; 0 without lines."""

    def share(own: Column) -> Column:
        prose = F.filter(own, lambda s: (T.word_count(s) >= 8) & ~T.matches(s, X.HEADING_ONLY))
        return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(prose) / F.size(own))

    return T.let(T.lines(text), share)


def looks_like_template(text: Column, min_words: int = X.TEMPLATE_MIN_WORDS) -> Column:
    """Hint phrases, too few words, a wall of short lines, or too little punctuation."""
    low = F.lower(text)
    hint = F.lit(False)
    for phrase in X.TEMPLATE_HINTS:
        hint = hint | low.contains(phrase)
    n = T.word_count(text)
    stops = F.length(text) - F.length(F.translate(text, ".?!", ""))
    short = lambda own: (F.size(own) > 0) & (F.size(F.filter(own, lambda s: T.word_count(s) <= 4)) / F.size(own) > 0.6)
    return hint | (n < min_words) | T.let(T.lines(text), short) | (stops < n / 60)


def skip_reason(text: Column, min_prose_ratio: float = X.MIN_PROSE_RATIO, keep_templates: bool = False) -> Column:
    """Why ingest skips a normalised document; null if it keeps it."""
    template = F.lit(False) if keep_templates else looks_like_template(text)
    return F.when(text == "", "empty after normalization").when(prose_ratio(text) < min_prose_ratio, "low prose ratio").when(template, "looks like a template")


def register_of(path: Column, informal: Sequence[str], formal: Sequence[str]) -> Column:
    """Register named by any part of a path."""
    parts = F.split(F.lower(path), "/")
    has = lambda names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    return F.when(has(informal), "informal").when(has(formal), "formal").otherwise("unknown")


def document_id(source: Column, text: Column) -> Column:
    """Twelve hexadecimal digits from the source and the text's length."""
    return F.substring(F.sha1(F.concat_ws("|", source, F.length(text).cast("string"))), 1, 12)


def scrub(rows: DataFrame, terms: Sequence[str] = (), text: str = "text") -> DataFrame:
    """``rows`` with the text scrubbed and ``removed``: array of (kind, n), in order of application.

    Rules rewrite in a fixed order, each counted on what the earlier ones left; postal codes go only where an
    address or place was found; runs of one placeholder become one.
    """
    steps: list[tuple[str, str, str]] = [("CUSTOM", rf"(?i)\b\Q{t.strip()}\E\b", "<NAME>") for t in terms if len(t.strip()) >= X.MIN_TERM]
    steps += [(kind, pattern, f"<{kind}>") for kind, pattern in X.SCRUB_RULES]
    own = F.col(text)
    out = rows
    counts = []
    for i, (kind, pattern, to) in enumerate(steps):
        out = out.withColumns({f"_n{i}": T.count(own, pattern), text: T.sub(own, pattern, to)})
        counts.append(F.struct(F.lit(kind).alias("kind"), F.col(f"_n{i}").alias("n")))
    near = own.contains("<ADDRESS>") | own.contains("<PLACE>")
    out = out.withColumns({"_zip": F.when(near, T.count(own, X.ZIP)).otherwise(F.lit(0)).cast("long"), text: F.when(near, T.sub(own, X.ZIP, "<ZIP>")).otherwise(own)})
    counts.append(F.struct(F.lit("ZIP").alias("kind"), F.col("_zip").alias("n")))
    once = F.regexp_replace(own, r"(?dU)(<(?:[A-Z]+)>)(\s+\1)+", "$1")
    out = out.withColumns({text: T.sub(once, X.SPACE_RUN, " "), "removed": F.filter(F.array(*counts), lambda r: r["n"] > 0)})
    return out.drop(*(c for c in out.columns if c.startswith("_n") or c == "_zip"))


def placeholder_density(text: Column) -> Column:
    return T.count(text, X.PLACEHOLDER) / F.greatest(T.word_count(text), F.lit(1))


def scrub_records(rows: DataFrame, terms: Sequence[str] = (), most: float = X.MAX_PLACEHOLDER_DENSITY) -> tuple[DataFrame, DataFrame]:
    """(kept rows with text_len, log of kinds and counts only) of a table of chunks."""
    done = scrub(rows, terms).withColumn("placeholder_density", placeholder_density(F.col("text")))
    kept = done.where(F.col("placeholder_density") <= most).withColumn("text_len", T.word_count(F.col("text")))
    log = done.select("chunk_id", F.round("placeholder_density", 4).alias("placeholder_density"), "removed")
    return kept.drop("removed", "placeholder_density"), log


def removals_by_kind(scrubbed: DataFrame) -> DataFrame:
    """kind and n, most frequent first."""
    flat = scrubbed.select(F.explode("removed").alias("r")).select("r.*")
    return flat.groupBy("kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind")
