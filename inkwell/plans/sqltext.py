"""SQL fragments of the text functions, for the oracle of each query."""

from __future__ import annotations

from inkwell.functions import fixed as X


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def words(t: str) -> str:
    return f"len(regexp_extract_all({t}, '\\S+'))"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def sub(t: str, pattern: str, to: str) -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(to)}, 'g')"


def lines(t: str) -> str:
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def style_tokens(t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, {q(chr(91) + 'A-Za-z' + chr(39) + chr(93) + '+')}), lambda w: lower(w))"


def leak_tokens(t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, {q('[A-Za-z0-9' + chr(39) + ']+')}), lambda w: lower(w))"


def near_dup_tokens(t: str) -> str:
    return f"regexp_extract_all(lower({t}), {q('[a-z' + chr(39) + ']+')})"


def grams(tokens: str, n: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"


def sentences(t: str) -> str:
    kept = t
    for a in X.ABBREVIATIONS:
        kept = f"replace({kept}, {q(a)}, replace({q(a)}, '.', chr(1)))"
    for a in X.INNER_ABBREVIATIONS:
        kept = f"replace({kept}, {q(a)}, replace({q(a[:-1])}, '.', chr(1)) || '.')"
    cut = f"regexp_replace({kept}, {q(chr(40) + '[.!?][' + chr(34) + chr(39) + ')' + chr(92) + ']]?)' + chr(92) + 's+([' + chr(34) + chr(39) + '(' + chr(92) + '[A-Z])')}, '\\1' || chr(2) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(2)), lambda s: {strip('replace(s, chr(1), ' + q('.') + ')')}), lambda s: s <> '')"


def stops(t: str) -> str:
    return f"(length({t}) - length(translate({t}, '.?!', '')))"


def prose_ratio(t: str) -> str:
    own = lines(t)
    return f"(CASE WHEN len({own}) = 0 THEN 0.0 ELSE len(list_filter({own}, lambda l: {words('l')} >= 8 AND NOT regexp_matches(l, {q(X.HEADING_ONLY)}))) / len({own}) END)"


def is_template(t: str) -> str:
    hints = " OR ".join(f"contains(lower({t}), {q(h)})" for h in X.TEMPLATE_HINTS)
    own = lines(t)
    return f"({hints} OR {words(t)} < {X.TEMPLATE_MIN_WORDS} OR (len({own}) > 0 AND len(list_filter({own}, lambda l: {words('l')} <= 4)) / len({own}) > 0.6) OR {stops(t)} < {words(t)} / 60)"


def normalized(t: str) -> str:
    out = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    out = sub(out, X.CODE_FENCE, " ")
    for p in (X.QUOTED_LINE, X.ORIGINAL_MESSAGE, X.FORWARDED_MESSAGE, X.WROTE, X.FROM_SUBJECT, X.CONFIDENTIALITY, X.UNSUBSCRIBE, X.SENT_FROM, X.SIGNOFF, X.SIGNOFF, X.TABLE_ROW, X.PAGE_NUMBER):
        out = sub(out, p, "")
    out = sub(out, X.BULLET_RUN, "\n")
    out = sub(out, X.URL, "<link>")
    out = f"replace(replace({out}, chr(160), ' '), chr(8203), '')"
    return strip(sub(sub(out, X.SPACE_RUN, " "), X.NEWLINE_RUN, "\n\n"))


def bin_of(v: str, edges: tuple[int, ...]) -> str:
    out = "NULL"
    for i in reversed(range(len(edges) - 1)):
        top = "<=" if i == len(edges) - 2 else "<"
        out = f"CASE WHEN {v} >= {edges[i]} AND {v} {top} {edges[i + 1]} THEN {i} ELSE {out} END"
    return out


def seeded(seed: int | str, key: str) -> str:
    return f"md5('{seed}|' || {key}::VARCHAR)"


def array(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


#: No word character of any script: what follows where the engine's word boundary is Unicode-aware.
BREAK = r"(?:[^\p{L}\p{M}\p{N}_]|$)"


def continues(t: str) -> str:
    return f"regexp_matches({t}, {q(X.CONTINUATION.removesuffix(chr(92) + 'b') + BREAK)})"


def split_paragraphs(t: str) -> str:
    return f"list_filter(list_transform(string_split_regex({t}, {q(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}), lambda p: {strip('p')}), lambda p: p <> '')"


def paragraphs(t: str) -> str:
    own, sents = split_paragraphs(t), sentences(f"({split_paragraphs(t)})[1]")
    groups = f"list_transform(range(0, len({sents}), {X.SENTENCE_GROUP}), lambda i: array_to_string({sents}[i + 1:i + {X.SENTENCE_GROUP}], ' '))"
    return f"(CASE WHEN len({own}) = 1 AND {words(f'({own})[1]')} > {X.GIANT_PARAGRAPH} THEN {groups} ELSE {own} END)"


def is_heading(line: str) -> str:
    s = strip(line)
    bad = f"({s} = '' OR list_contains({array(list(X.SKIP_HEADINGS))}, upper({s})) OR length({s}) > 62 OR regexp_matches({s}, {q('^[“' + chr(34) + '‘_.]')}) OR regexp_matches({s}, '^[. ]+$'))"
    return f"(NOT {bad} AND (regexp_matches({s}, {q(X.ROMAN)}) OR regexp_matches(upper({s}), {q(X.CHAPTER)}) OR regexp_matches({s}, {q(X.ALL_CAPITALS)})))"


def is_prose(block: str) -> str:
    own = lines(block)
    return f"(len({own}) > 0 AND len(list_filter({own}, lambda l: {words('l')} <= 5)) / len({own}) <= 0.5 AND {stops(block)} >= {words(block)} / 45 AND NOT regexp_matches({block}, {q(X.EDITORIAL)}))"


def clean_section(t: str) -> str:
    kept = f"list_filter(string_split_regex({sub(t, X.BRACKET_LINE, '')}, {q(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}), lambda p: NOT regexp_matches(p, {q(X.FOOTNOTE)}))"
    return strip(sub(f"array_to_string({kept}, chr(10) || chr(10))", X.NEWLINE_RUN, "\n\n"))


def fold(units: str, cut: str, gap: str) -> str:
    """Texts of units (t, n, free) in runs; ``cut`` says from acc.held and x whether a unit opens a new run."""
    joined = f"list_append(acc.c[1:len(acc.c) - 1], acc.c[len(acc.c)] || {gap} || x.t)"
    step = f"{{'held': CASE WHEN {cut} THEN x.n ELSE acc.held + x.n END, 'c': CASE WHEN len(acc.c) = 0 OR {cut} THEN list_append(acc.c, x.t) ELSE {joined} END}}"
    return f"(list_reduce({units}, lambda acc, x: {step}, {{'held': 0::BIGINT, 'c': []::VARCHAR[]}})).c"


def packed(source: str, keys: str, least: int, most: int, name: str) -> str:
    """CTEs that end in ``name`` (keys, chunks): the greedy packing of paragraphs (keys, ps)."""
    cut = f"(acc.held >= {most} OR (x.free AND acc.held >= {least} AND acc.held + x.n > {most}))"
    line = "chr(10) || chr(10)"
    unit = lambda t, free: f"{{'t': {t}, 'n': {words(t)}::BIGINT, 'free': {free}}}"
    tail = f"CASE WHEN len(c) > 1 AND {words('c[len(c)]')} < {least} THEN list_append(c[1:len(c) - 2], c[len(c) - 1] || ' ' || c[len(c)]) ELSE c END"
    runt = f"CASE WHEN {words('x')} >= {least} THEN list_append(acc, x) WHEN len(acc) > 0 THEN list_append(acc[1:len(acc) - 1], acc[len(acc)] || {line} || x) ELSE acc END"
    return f"""{name}_p AS (SELECT {keys}, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM {source}),
{name}_g AS (SELECT *, {words('p')} > {most} AS giant FROM {name}_p),
{name}_r AS (SELECT *, 2 * sum(giant::INTEGER) OVER (PARTITION BY {keys} ORDER BY i) - giant::INTEGER AS r FROM {name}_g),
{name}_u AS (SELECT {keys}, r, bool_or(giant) AS giant, CASE WHEN bool_or(giant) THEN list_transform({sentences('any_value(p)')}, lambda s: {unit('s', 'true')}) ELSE list({unit('p', f"NOT {continues('p')}")} ORDER BY i) END AS units FROM {name}_r GROUP BY {keys}, r),
{name}_c AS (SELECT {keys}, r, giant, CASE WHEN giant THEN {fold('units', cut, "' '")} ELSE list_transform({fold('units', cut, line)}, lambda c: {strip('c')}) END AS c FROM {name}_u),
{name}_a AS (SELECT {keys}, flatten(list(CASE WHEN giant THEN {tail} ELSE c END ORDER BY r)) AS every FROM {name}_c GROUP BY {keys}),
{name} AS (SELECT {keys}, list_reduce(every, lambda acc, x: {runt}, []::VARCHAR[]) AS chunks FROM {name}_a)"""
