"""Column expressions over text: words, tokens, sentences, paragraphs and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import fixed as X


def rx(pattern: str) -> str:
    """A pattern with the flags all patterns share."""
    return X.FLAGS + pattern


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, as an array."""
    return F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(group))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(rx(pattern))).cast("long")


def sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, rx(pattern), to.replace("\\", "\\\\"))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?dU)^\s+|\s+\z", "")


def words(text: Column) -> Column:
    return found(text, r"\S+")


def word_count(text: Column) -> Column:
    return count(text, r"\S+")


def style_tokens(text: Column) -> Column:
    """Letters and apostrophes, lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z']+"), F.lit(0)), F.lower)


def leak_tokens(text: Column) -> Column:
    """Letters, digits and apostrophes, lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9']+"), F.lit(0)), F.lower)


def near_dup_tokens(text: Column) -> Column:
    """Lower-cased first, then letters and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']+"), F.lit(0))


def grams(tokens: Column, n: int) -> Column:
    """Every run of n tokens, joined by spaces; none if there are fewer."""
    none = F.array().cast("array<string>")

    def runs(t: Column) -> Column:
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(none)

    return let(tokens, runs)  # else the tokens would be cut anew for every run


def repetition(text: Column, n: int = 4) -> Column:
    """Share of word n-grams that repeat an earlier one; 0 up to n words."""

    def share(own: Column) -> Column:
        return F.when(F.size(own) < 2, F.lit(0.0)).otherwise(F.lit(1.0) - F.size(F.array_distinct(own)) / F.size(own))

    return let(grams(words(F.lower(text)), n), share)


def sentences(text: Column) -> Column:
    """Sentences, with the dots of abbreviations protected."""
    kept = text
    for abbreviation in X.ABBREVIATIONS:
        kept = F.replace(kept, F.lit(abbreviation), F.lit(abbreviation.replace(".", "\x00")))
    for abbreviation in X.INNER_ABBREVIATIONS:
        kept = F.replace(kept, F.lit(abbreviation), F.lit(abbreviation[:-1].replace(".", "\x00") + "."))
    parts = F.transform(F.split(kept, rx(X.SENTENCE_END), -1), lambda s: strip(F.replace(s, F.lit("\x00"), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def lines(text: Column) -> Column:
    """Lines with something on them, stripped."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Blank-line paragraphs; a single giant one becomes groups of sentences."""

    def packed(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(X.SENTENCE_GROUP))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i, F.lit(X.SENTENCE_GROUP)), " "))

    def grouped(plain: Column) -> Column:
        first = F.get(plain, F.lit(0))
        return F.when((F.size(plain) == 1) & (word_count(first) > X.GIANT_PARAGRAPH), let(sentences(first), packed)).otherwise(plain)

    return let(F.filter(F.transform(F.split(text, rx(r"\n\s*\n"), -1), strip), lambda s: s != ""), grouped)


def bin_of(value: Column, edges: tuple[int, ...]) -> Column:
    """Index of the half-open bin of a value; the last bin holds its right edge; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        top = value <= edges[i + 1] if i == len(edges) - 2 else value < edges[i + 1]
        out = F.when((value >= edges[i]) & top, F.lit(i)).otherwise(out)
    return out


def seeded(seed: int | str, key: Column) -> Column:
    """The order in which a seeded shuffle visits keys."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, as double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
