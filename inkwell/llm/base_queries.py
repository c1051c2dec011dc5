"""Queries over the part of an operator's result that SQL can express, through the operator itself, with their SQL.

The whole results of these operators come from models or files, so their contract queries have none.
"""

from __future__ import annotations

from inkwell.llm import media, pii, quality, secrets

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"


def media_payload(spark, sf_dir: str):
    """Sizes and digest of what the pictures hold."""
    return media.op2_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def quality_base(spark, sf_dir: str):
    """The base figures of every document."""
    return quality.op4_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark, sf_dir: str):
    """Digest of the base spans of personal data."""
    return pii.op3_pii(spark, sf_dir).select("doc_id", "base_sha256")


def secret_base(spark, sf_dir: str):
    """Counts and digest of the base spans of secrets."""
    return secrets.op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _spans(kinds: list[tuple[str, str, str]]) -> str:
    """CTEs that end in s (rid, kind, rank, a, b): matches m of each (kind, pattern, condition) with their places, from
    the lengths of the matches and of the parts between them."""
    parts = []
    for rank, (kind, pattern, good) in enumerate(kinds):
        parts.append(f"""SELECT rid, '{kind}' AS kind, {rank} AS rank, x.a AS a, x.a + length(x.m) AS b FROM (SELECT rid, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'m': m[i],
 'a': (coalesce(list_sum(list_transform(p[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT}})) AS x
 FROM (SELECT rid, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM t WHERE regexp_matches(text, '{pattern}'))) WHERE {good}""")
    return "t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),\ns AS (" + "\nUNION ALL ".join(parts) + ")"


_DIGITS = "string_split(regexp_replace(x.m, '[^0-9]', '', 'g'), '')"
_LUHN = f"list_sum(list_transform(list_reverse({_DIGITS}), lambda d, i: CASE WHEN i % 2 = 1 THEN d::BIGINT ELSE d::BIGINT * 2 // 10 + d::BIGINT * 2 % 10 END)) % 10 = 0"
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x.m, '.'), lambda y: length(ltrim(y, '0')) > 3 OR (length(ltrim(y, '0')) = 3 AND ltrim(y, '0') > '255'))) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15"),
]
_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_SECRETS = [
    ("assign", _ASSIGN, r"""length(regexp_extract(x.m, '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8"""),
    ("access", "AKIA[A-Z0-9]+", "length(x.m) >= 16"),
    ("hex", "[0-9a-f]{32,}", "true"),
]
_BASE = "sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank), ''))"

QUERIES = {"media_payload": media_payload, "quality_base": quality_base, "pii_base": pii_base, "secret_base": secret_base}

ORACLE_SQL = {
    "media_payload": """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
n AS (SELECT doc_id, x, octet_length(x) AS n, (greatest(1, ceil(octet_length(x) / 576.0)) * 576)::BIGINT AS padded FROM t)
SELECT doc_id, n AS n_bytes, padded AS payload_bytes, sha256(unhex(hex(x) || repeat('FF', (padded - n)::BIGINT))) AS payload_sha256 FROM n""",
    "quality_base": f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS k FROM t WHERE len(w) >= 3),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY rid),
b AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words
 FROM t JOIN l USING (rid) LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b""",
    "pii_base": f"WITH {_spans(_PII)} SELECT any_value(doc_id) AS doc_id, {_BASE} AS base_sha256 FROM (SELECT t.rid, t.doc_id, s.kind, s.rank, s.a, s.b FROM t LEFT JOIN s USING (rid)) GROUP BY rid",
    "secret_base": f"WITH {_spans(_SECRETS)} SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {_BASE} AS base_sha256 FROM (SELECT t.rid, t.doc_id, s.kind, s.rank, s.a, s.b FROM t LEFT JOIN s USING (rid)) GROUP BY rid",
}
