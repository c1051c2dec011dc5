"""URL filters by path-template trees (DataFrame functions only).

Listed rules decide first: the longest rule whose host is the url's host or a parent of it and whose path
starts the url's path. The urls that a rule decides are the labelled ones, unless labels are given.

For the others a tree of path templates is grown per host, level by level, over distinct paths with counts:

* runs of digits become ``*``; a node with many branches, most of them rare, makes its segment ``*`` whole;
* a branch whose labelled block rate doesn't differ from its siblings' by a two-proportion z test is merged
  with the other such branches into ``*``;
* a template is rejected if its block rate, smoothed towards its host's, which is smoothed towards
  ``PRIOR``, exceeds ``REJECT``.

Scale: rows are first counted by host and path shape, so the tree sees a row per distinct shape, and a
node's figures come from partial aggregates; a hot host's rows meet their template by a join on host and
shape, which adaptive execution splits.

Defined results: a null url or one without ``://`` has empty host and path and is judged as such; repeated
rows are judged alike; urls on hosts without labelled pages fall back to the prior and are allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import settle

#: (verdict, host and path), as given by the contract.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Levels of the SQL's tree; the operator's own is as deep as its paths.
LEVELS = 3
#: A node is variable beyond so many branches if they have under this many pages each on average.
BRANCHES, PER_BRANCH = 20, 2
Z = 1.96
PRIOR, WEIGHT, REJECT = 0.25, 2.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    has = url.isNotNull() & (at > 0)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, null if none does; the list is a parameter, so its size is bounded."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def shapes(path: Column) -> Column:
    """All segments with runs of digits as ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, "[0-9]+", "*"))


def templates(paths: DataFrame) -> DataFrame:
    """host, shape and template of distinct shapes (host, shape, n, blocked, labelled), as deep as the deepest."""
    tree = paths.withColumn("parts", F.split("shape", "\n")).withColumn("template", F.lit(""))
    for level in range(paths.agg(F.max(F.size(F.split("shape", "\n")))).first()[0] or 0):
        tree = tree.withColumn("part", F.coalesce(F.get("parts", F.lit(level)), F.lit("")))
        branch = tree.groupBy("host", "template", "part").agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("labelled").alias("m"))
        node = branch.groupBy("host", "template").agg(F.count("*").alias("branches"), F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.sum("m").alias("all_m"))
        both = branch.join(node, ["host", "template"])
        rate = F.col("all_b") / F.col("all_m")
        rest_b, rest_m = F.col("all_b") - F.col("b"), F.col("all_m") - F.col("m")
        gap = F.abs(F.col("b") / F.col("m") - rest_b / rest_m)
        error = F.sqrt(rate * (1 - rate) * (1 / F.col("m") + 1 / rest_m))
        differs = F.when((F.col("m") > 0) & (rest_m > 0), gap > F.lit(Z) * error).otherwise(False)
        variable = (F.col("branches") > BRANCHES) & (F.col("all_n") < F.col("branches") * PER_BRANCH)
        own = F.when(F.col("part") == "", "").when(variable | ~differs, "/*").otherwise(F.concat(F.lit("/"), F.col("part")))
        step = both.select("host", "template", "part", own.alias("_own"))
        tree = settle(tree.join(step, ["host", "template", "part"]).withColumn("template", F.concat("template", "_own")).drop("_own"))
    return tree.select("host", "shape", "template", "blocked", "labelled")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, template, block_rate and verdict of every page (page_id, url).

    ``labels`` (page_id, blocked boolean) replaces the rules' verdicts as labels of the tree.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", F.array_join(shapes(F.col("path")), "\n"))
    block = F.col("rule").isin([r for v, r in rules if v == "block"])
    if labels is None:
        marked = rows.withColumn("_blocked", block)
    else:
        named = labels.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("blocked").alias("_blocked"))
        marked = rows.join(named, "page_id", "left")
    counts = [F.count("*").alias("n"), F.count_if(F.col("_blocked")).alias("blocked"), F.count("_blocked").alias("labelled")]
    tree = templates(settle(marked.groupBy("host", "shape").agg(*counts)))
    per_host = tree.groupBy("host").agg(F.sum("blocked").alias("host_b"), F.sum("labelled").alias("host_m"))
    per = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("m")).join(per_host, "host")
    prior = (F.col("host_b") + F.lit(WEIGHT * PRIOR)) / (F.col("host_m") + F.lit(WEIGHT))
    rate = (F.col("b") + F.lit(WEIGHT) * prior) / (F.col("m") + F.lit(WEIGHT))
    found = tree.select("host", "shape", "template").join(per.select("host", "template", rate.alias("block_rate")), ["host", "template"])
    own = F.when(F.col("block_rate") > REJECT, "block").otherwise("allow")
    verdict = F.when(block, "block").when(F.col("rule").isNotNull(), "allow").otherwise(own)
    return rows.join(found, ["host", "shape"]).select("page_id", "host", "path", "rule", "template", "block_rate", verdict.alias("verdict"))


def op7_urls(spark, sf_dir: str) -> DataFrame:
    """Contract query: the verdict on every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _oracle() -> str:
    rule = "NULL"
    for _, r in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
        d, _, s = r.partition("/")
        rule = f"CASE WHEN (host = '{d}' OR host LIKE '%.{d}') AND path LIKE '/{s}%' THEN '{r}' ELSE {rule} END"
    blocked = ", ".join(f"'{r}'" for v, r in RULES if v == "block")
    sql = f"""
WITH cut AS (SELECT page_id, coalesce(instr(url, '://'), 0) > 0 AS has, substr(url, instr(url, '://') + 3) AS rest FROM pages),
named AS (SELECT page_id, CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM cut),
ruled AS (SELECT *, {rule} AS rule, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[0-9]+', '*', 'g')) AS p FROM named),
row_ AS (SELECT *, array_to_string(CASE WHEN len(p) > {LEVELS} THEN p[1:{LEVELS}] || [array_to_string(p[{LEVELS + 1}:], '/')] ELSE p END, chr(10)) AS shape FROM ruled),
t0 AS (SELECT host, shape, string_split(shape, chr(10)) AS parts, '' AS template, count(*) AS n, count(*) FILTER (rule IN ({blocked})) AS blocked, count(rule) AS labelled FROM row_ GROUP BY host, shape)"""
    for i in range(LEVELS + 1):
        sql += f""",
s{i} AS (SELECT *, coalesce(parts[{i + 1}], '') AS part FROM t{i}),
b{i} AS (SELECT host, template, part, sum(n) AS n, sum(blocked) AS b, sum(labelled) AS m FROM s{i} GROUP BY ALL),
n{i} AS (SELECT host, template, count(*) AS branches, sum(n) AS all_n, sum(b) AS all_b, sum(m) AS all_m FROM b{i} GROUP BY ALL),
d{i} AS (SELECT host, template, part, CASE WHEN part = '' THEN '' WHEN (branches > {BRANCHES} AND all_n < branches * {PER_BRANCH})
  OR NOT (CASE WHEN m > 0 AND all_m - m > 0 THEN abs(b / m - (all_b - b) / (all_m - m)) > {Z}::DOUBLE * sqrt(all_b / all_m * (1 - all_b / all_m) * (1 / m + 1 / (all_m - m))) ELSE false END)
  THEN '/*' ELSE '/' || part END AS own FROM b{i} JOIN n{i} USING (host, template)),
t{i + 1} AS (SELECT s.host, s.shape, s.parts, s.template || d.own AS template, s.n, s.blocked, s.labelled FROM s{i} s JOIN d{i} d USING (host, template, part))"""
    t = f"t{LEVELS + 1}"
    w = f"{WEIGHT}::DOUBLE"
    return f"""{sql},
h AS (SELECT host, sum(blocked) AS host_b, sum(labelled) AS host_m FROM {t} GROUP BY host),
r AS (SELECT t.host, t.template, (sum(blocked) + {w} * ((any_value(host_b) + {WEIGHT * PRIOR}::DOUBLE) / (any_value(host_m) + {w}))) / (sum(labelled) + {w}) AS block_rate FROM {t} t JOIN h USING (host) GROUP BY t.host, t.template)
SELECT page_id, host, path, rule, template, block_rate,
  CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN block_rate > {REJECT} THEN 'block' ELSE 'allow' END AS verdict
FROM row_ JOIN {t} USING (host, shape) JOIN r USING (host, template)"""


ORACLE_SQL = _oracle()
