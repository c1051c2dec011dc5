"""Queries over style: scalars, distributions, distances, bootstrap; and over embeddings: verifier and echo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.operators import leakage, stylometry, verifier
from inkwell.plans import sqltext as S
from inkwell.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
A, B = "en", "de"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def corpora(spark, sf_dir) -> DataFrame:
    """Documents with their language as corpus."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("corpus"), "text")


_M = f"""WITH m0 AS (SELECT doc_id, lang AS corpus, text, {S.style_tokens('text')} AS tok, {S.sentences('text')} AS sent FROM documents),
m AS (SELECT *, list_transform(sent, lambda s: len({S.style_tokens('s')})) AS lens FROM m0)"""


def _chars(c: str) -> str:
    return f"(length(text) - length(replace(text, {S.q(c)}, '')))"


def _said(words: list[str]) -> str:
    return f"len(list_filter(tok, lambda w: list_contains({S.array(words)}, w)))"


_RATIOS = f"CASE WHEN len(tok) < {X.SEGMENT} THEN [len(list_distinct(tok)) / greatest(len(tok), 1)] ELSE list_transform(range(0, len(tok) // {X.SEGMENT}), lambda i: len(list_distinct(tok[i * {X.SEGMENT} + 1:i * {X.SEGMENT} + {X.SEGMENT}])) / {X.SEGMENT}) END"
_SUMMED = ["n_tokens", "n_sents", "len_sum", "len_squares", "letters", "ratio_sum", "ratios", *stylometry.RATES.values(), "paras"]
_C = f"""c AS (SELECT doc_id, corpus, len(tok) AS n_tokens, len(sent) AS n_sents, coalesce(list_sum(lens), 0) AS len_sum, coalesce(list_sum(list_transform(lens, lambda x: x * x)), 0) AS len_squares,
 coalesce(list_sum(list_transform(tok, lambda w: length(w))), 0) AS letters, list_sum({_RATIOS}) AS ratio_sum, len({_RATIOS}) AS ratios,
 len(regexp_extract_all(text, {S.q(X.CONTRACTION)})) AS contractions, {_said(X.HEDGES)} AS hedges, {_said(X.INTENSIFIERS)} AS intensifiers, {_said(['i', 'me', 'my', 'we', 'our'])} AS first_person, {_said(['you', 'your'])} AS second_person,
 {_chars('—')} AS em_dashes, {_chars(';')} AS semicolons, {_chars('(')} AS parens, {_chars('?')} AS questions, {_chars('!')} AS exclaims, len(regexp_extract_all(text, '\\n\\n')) + 1 AS paras FROM m)"""


def _scalar_sql(by: str) -> str:
    """The scalars (sc) of summed counts (s), by the columns ``by``."""
    rates = ", ".join(f"{c} / greatest(n_tokens, 1) * 100 AS {n}" for n, c in stylometry.RATES.items())
    return f"""u AS (SELECT *, len_sum / greatest(n_sents, 1) AS mean FROM s), v AS (SELECT *, sqrt(greatest(len_squares / greatest(n_sents, 1) - mean * mean, 0.0)) AS sd FROM u),
sc AS (SELECT {by}, mean AS sent_len_mean, sd AS sent_len_sd, CASE WHEN sd + mean > 0 THEN (sd - mean) / (sd + mean) ELSE 0.0 END AS burstiness, CASE WHEN n_tokens > 0 THEN letters / n_tokens ELSE 0.0 END AS word_len_mean,
 ratio_sum / ratios AS msttr, {rates}, n_sents / greatest(paras, 1) AS para_len_sents FROM v)"""


_COUNTS = f"{_M}, {_C}, s AS (SELECT corpus, {', '.join(f'sum({x}) AS {x}' for x in _SUMMED)} FROM c GROUP BY corpus), {_scalar_sql('corpus')}"


@query(f"{_COUNTS} SELECT corpus, {', '.join(f'round({n}, 6) AS {n}' for n in X.SCALES)} FROM sc")
def stylometry_scalars(spark, sf_dir):
    """The sixteen scalars of each language."""
    s = stylometry.scalars(corpora(spark, sf_dir), "corpus")
    return s.select("corpus", *[F.round(n, 6).alias(n) for n in X.SCALES])


_E = f"""e0 AS (SELECT doc_id, corpus, 'function_words' AS block, unnest(list_filter(tok, lambda w: list_contains({S.array(X.FUNCTION_WORDS)}, w))) AS key FROM m
UNION ALL SELECT doc_id, corpus, 'punctuation', unnest(list_filter(string_split(text, ''), lambda c: list_contains({S.array(X.PUNCTUATION)}, c))) FROM m
UNION ALL SELECT doc_id, corpus, 'openers', CASE WHEN list_contains({S.array(X.FUNCTION_WORDS)}, w) THEN w ELSE '<content>' END FROM (SELECT doc_id, corpus, unnest(list_filter(list_transform(sent, lambda s: {S.style_tokens('s')}[1]), lambda w: w IS NOT NULL)) AS w FROM m)
UNION ALL SELECT doc_id, corpus, 'sent_len_hist', ({S.bin_of('x', X.SENTENCE_BINS)})::VARCHAR FROM (SELECT doc_id, corpus, unnest(lens) AS x FROM m)
UNION ALL SELECT doc_id, corpus, 'word_len_hist', ({S.bin_of('x', X.WORD_BINS)})::VARCHAR FROM (SELECT doc_id, corpus, length(unnest(tok)) AS x FROM m)),
e AS (SELECT * FROM e0 WHERE key IS NOT NULL),
k AS ({' UNION ALL '.join(f"SELECT '{b}' AS block, unnest({S.array(keys)}) AS key" for b, keys in stylometry.BLOCKS.items())})"""
_D = f"""{_M}, {_E}, n AS (SELECT corpus, block, key, count(*) AS n FROM e GROUP BY ALL),
f AS (SELECT c.corpus, k.block, k.key, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang AS corpus FROM documents) c CROSS JOIN k LEFT JOIN n ON n.corpus = c.corpus AND n.block = k.block AND n.key = k.key),
d AS (SELECT corpus, block, key, CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 1.0 / count(*) OVER w END AS p FROM f WINDOW w AS (PARTITION BY corpus, block))"""
_JS = f"""{_D}, pq AS (SELECT block, key, greatest(coalesce(a.p, 0), 1e-12) AS p, greatest(coalesce(b.p, 0), 1e-12) AS q FROM (SELECT * FROM d WHERE corpus = '{A}') a FULL JOIN (SELECT * FROM d WHERE corpus = '{B}') b USING (block, key)),
nm AS (SELECT block, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM pq WINDOW w AS (PARTITION BY block)),
js AS (SELECT block, greatest(0.0, least(1.0, sum((p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2))) AS js FROM nm GROUP BY block)"""


@query(f"{_D} SELECT corpus, block, key, round(p, 6) AS p FROM d")
def stylometry_dists(spark, sf_dir):
    """Distributions of each language over the fixed keys."""
    c = corpora(spark, sf_dir)
    return stylometry.distributions(stylometry.block_counts(c, "corpus"), c.select("corpus").distinct(), "corpus").select("corpus", "block", "key", F.round("p", 6).alias("p"))


@query(f"{_JS} SELECT block, round(js, 6) AS js FROM js")
def js_distance(spark, sf_dir):
    """Divergence of two languages by block."""
    d = stylometry.corpus_distances(corpora(spark, sf_dir), "corpus", A, B).where(F.col("name").startswith("dist:"))
    return d.select(F.substring("name", 6, 99).alias("block"), F.round("value", 6).alias("js"))


_DIST = f"""{_COUNTS}, {_E}, n AS (SELECT corpus, block, key, count(*) AS n FROM e GROUP BY ALL),{_JS[_JS.index('f AS (SELECT c.corpus') - 1:]},
lg AS (SELECT corpus, name, value FROM sc UNPIVOT (value FOR name IN ({', '.join(X.SCALES)}))),
gp AS (SELECT name, max(value) FILTER (corpus = '{A}') AS a, max(value) FILTER (corpus = '{B}') AS b FROM lg WHERE corpus IN ('{A}', '{B}') GROUP BY name),
al AS (SELECT 'dist:' || block AS name, js AS value FROM js UNION ALL SELECT 'scalar:' || name, least(1.0, abs(a - b) / CASE name {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in X.SCALES.items())} END) FROM gp)"""


@query(f"{_DIST} SELECT round((sum(value) FILTER (name LIKE 'dist:%') + avg(value) FILTER (name LIKE 'scalar:%')) / (count(*) FILTER (name LIKE 'dist:%') + 1), 4) AS overall FROM al")
def style_distance(spark, sf_dir):
    """Overall style distance of two languages."""
    return stylometry.overall(stylometry.corpus_distances(corpora(spark, sf_dir), "corpus", A, B))


@query(f"{_DIST} SELECT name, round(value, 4) AS value FROM al ORDER BY 2 DESC, 1 LIMIT 6")
def biggest_gaps(spark, sf_dir):
    """The six largest style gaps."""
    return stylometry.biggest_gaps(stylometry.corpus_distances(corpora(spark, sf_dir), "corpus", A, B))


@query(f"{_M} SELECT doc_id, round(list_sum({_RATIOS}) / len({_RATIOS}), 6) AS msttr FROM m")
def msttr(spark, sf_dir):
    """Mean segmental type-token ratio of every document."""
    d = stylometry.measured(corpora(spark, sf_dir))
    return d.select("doc_id", F.round(stylometry.msttr(F.col("_tok")), 6).alias("msttr"))


@query(f"{_M}, l AS (SELECT doc_id, unnest(CASE WHEN len(lens) = 0 THEN [0] ELSE lens END) AS x FROM m), a AS (SELECT doc_id, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY doc_id) SELECT doc_id, round(CASE WHEN s + m > 0 THEN (s - m) / (s + m) ELSE 0.0 END, 6) AS burstiness FROM a")
def burstiness(spark, sf_dir):
    """Burstiness of every document's sentence lengths."""
    d = stylometry.measured(corpora(spark, sf_dir)).select("doc_id", F.explode(F.when(F.size("_len") == 0, F.array(F.lit(0))).otherwise(F.col("_len"))).alias("x"))
    a = d.groupBy("doc_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return a.select("doc_id", F.round(F.when(F.col("s") + F.col("m") > 0, (F.col("s") - F.col("m")) / (F.col("s") + F.col("m"))).otherwise(F.lit(0.0)), 6).alias("burstiness"))


@query(f"{_M}, {_E} SELECT block, key::INTEGER AS bin, count(*) AS n FROM e WHERE block LIKE '%hist' GROUP BY ALL")
def length_histograms(spark, sf_dir):
    """Sentence and word lengths of all documents, by bin."""
    c = stylometry.block_counts(corpora(spark, sf_dir)).where(F.col("block").endswith("hist"))
    return c.select("block", F.col("key").cast("int").alias("bin"), "n")


_R = 200
_SCALE = f"CASE name {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in X.SCALES.items())} END"


@query(f"""{_M}, {_E}, {_C},
pl AS (SELECT doc_id, lang AS corpus, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IN ('{A}', '{B}')),
dr AS (SELECT r, corpus, ('0x' || substr(md5('{X.SEED}|' || r || '|' || corpus || '|' || i), 1, 8))::BIGINT % n AS j FROM pl, range({_R}) t(r)),
wt AS (SELECT r, dr.corpus, doc_id, count(*) AS w FROM dr JOIN pl ON pl.corpus = dr.corpus AND pl.i = dr.j GROUP BY ALL),
ct AS (SELECT doc_id, corpus, block, key, count(*) AS n FROM e WHERE corpus IN ('{A}', '{B}') GROUP BY ALL),
sm AS (SELECT r, wt.corpus, block, key, sum(w * n) AS n FROM wt JOIN ct USING (doc_id) GROUP BY ALL),
f AS (SELECT a.r, a.corpus, k.block, k.key, coalesce(sm.n, 0) AS n FROM (SELECT r, corpus FROM range({_R}) t(r), (VALUES ('{A}'), ('{B}')) v(corpus)) a CROSS JOIN k LEFT JOIN sm ON sm.r = a.r AND sm.corpus = a.corpus AND sm.block = k.block AND sm.key = k.key),
d AS (SELECT r, corpus, block, key, CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 1.0 / count(*) OVER w END AS p FROM f WINDOW w AS (PARTITION BY r, corpus, block)),
pq AS (SELECT r, block, key, greatest(a.p, 1e-12) AS p, greatest(b.p, 1e-12) AS q FROM (SELECT * FROM d WHERE corpus = '{A}') a JOIN (SELECT * FROM d WHERE corpus = '{B}') b USING (r, block, key)),
nm AS (SELECT r, block, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM pq WINDOW w AS (PARTITION BY r, block)),
js AS (SELECT r, block, greatest(0.0, least(1.0, sum((p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2))) AS js FROM nm GROUP BY ALL),
s AS (SELECT r, wt.corpus, {', '.join(f'sum(w * {x}) AS {x}' for x in _SUMMED)} FROM wt JOIN c USING (doc_id) GROUP BY ALL), {_scalar_sql('r, corpus')},
lg AS (SELECT r, corpus, name, value FROM sc UNPIVOT (value FOR name IN ({', '.join(X.SCALES)}))),
gp AS (SELECT r, name, max(value) FILTER (corpus = '{A}') AS a, max(value) FILTER (corpus = '{B}') AS b FROM lg GROUP BY ALL),
sg AS (SELECT r, avg(least(1.0, abs(a - b) / {_SCALE})) AS gap FROM gp GROUP BY r),
pr AS (SELECT r, round((sum(js) + any_value(gap)) / (count(*) + 1), 4) AS v FROM js JOIN sg USING (r) GROUP BY r) SELECT round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high FROM pr""")
def bootstrap_ci(spark, sf_dir):
    """95 % interval of the overall style distance of two languages."""
    return stylometry.bootstrap_ci(corpora(spark, sf_dir), "corpus", A, B, "doc_id", replicates=_R)


def _vectors(spark, sf_dir) -> DataFrame:
    """Embeddings at length one; label 0 is the author."""
    e = table(spark, sf_dir, "embeddings")
    return verifier.held_out(e.select("vec_id", (F.col("label") == 0).cast("int").alias("label"), F.col("label").alias("author"), verifier.unit(F.col("embedding")).alias("v")), "vec_id")


def _scored(spark, sf_dir) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    center = verifier.centroid(rows.where("NOT test AND label = 1"), "v")
    return verifier.centroid_scores(rows, center, "vec_id", "v", "label", "author", "test")


_V = f"""WITH u AS (SELECT vec_id, (label = 0)::INTEGER AS label, label AS author, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
t AS (SELECT *, row_number() OVER (ORDER BY {S.seeded(X.SEED, 'vec_id')}, vec_id) <= ceil((SELECT count(*) FROM embeddings) * {X.AV_TEST_FRACTION}) AS test FROM u),
x AS (SELECT unnest(v) AS x, unnest(range(0, len(v))) AS dim FROM t WHERE NOT test AND label = 1), mn AS (SELECT dim, avg(x) AS m FROM x GROUP BY dim),
ce AS (SELECT list(m / (sqrt((SELECT sum(m * m) FROM mn)) + 1e-9) ORDER BY dim) AS c FROM mn),
sc AS (SELECT vec_id, label, author, test, list_inner_product(v, c) AS score FROM t, ce),
te AS (SELECT label, author, round(score, 9) AS score FROM sc WHERE test)"""


@query(f"{_V} SELECT vec_id, label, test, round(score, 6) AS score FROM sc")
def centroid_scores(spark, sf_dir):
    """Centroid scores of all embeddings."""
    return _scored(spark, sf_dir).select("vec_id", "label", "test", F.round("score", 6).alias("score"))


def _test(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).where("test").withColumn("score", F.round("score", 9))


_AUC = "SELECT round((sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 4) AS auc, sum(label)::BIGINT AS n_positive, (count(*) - sum(label))::BIGINT AS n_negative FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM {})"


@query(f"{_V} {_AUC.format('te')}")
def roc_auc(spark, sf_dir):
    """Exact AUC of the held-out scores."""
    return verifier.roc_auc(_test(spark, sf_dir))


_TS = """g AS (SELECT score AS threshold, sum(label) AS p, count(*) - sum(label) AS q FROM te GROUP BY score),
ts AS (SELECT threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp, (sum(p) OVER w / sum(p) OVER () + (sum(q) OVER () - sum(q) OVER w) / sum(q) OVER ()) / 2 AS ba FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
be AS (SELECT threshold, ba FROM ts ORDER BY round(ba, 12) DESC, threshold LIMIT 1)"""


@query(f"{_V}, {_TS} SELECT round(threshold, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(ba, 6) AS balanced_accuracy FROM ts")
def threshold_sweep(spark, sf_dir):
    """Every threshold of the held-out scores."""
    return verifier.threshold_sweep(_test(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"), "tp", "fp", F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


_EV = "round(avg((score >= threshold)::INTEGER), 4) AS attribution_rate, round(avg(score), 4) AS score_mean, round(quantile_cont(score, 0.5), 4) AS score_median, round(stddev_pop(score), 4) AS score_sd, count(*) AS n, round(max(threshold), 4) AS threshold"


@query(f"{_V}, {_TS} SELECT {_EV} FROM te, be")
def av_evaluate(spark, sf_dir):
    """Attribution of the held-out embeddings at the best threshold."""
    t = _test(spark, sf_dir)
    return verifier.evaluate(t, verifier.best_threshold(t))


@query(f"{_V}, {_TS} SELECT author::VARCHAR AS author, {_EV} FROM te, be GROUP BY author")
def av_by_group(spark, sf_dir):
    """The same by author."""
    t = _test(spark, sf_dir).withColumn("author", F.col("author").cast("string"))
    return verifier.evaluate(t, verifier.best_threshold(t), "author")


@query()
def logistic_auc(spark, sf_dir):
    """AUC of the logistic head on held-out embeddings."""
    rows = verifier.logistic_scores(_vectors(spark, sf_dir), "vec_id", "v", "label", "test")
    return verifier.roc_auc(rows.where("test"))


@query(f"WITH l AS (SELECT toxic AS label, round({S.prose_ratio('text')}, 9) AS score FROM documents JOIN labels USING (doc_id)) {_AUC.format('l')}")
def label_auc(spark, sf_dir):
    """How well the prose ratio tells toxic documents: AUC with many ties."""
    from inkwell.operators import clean

    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("toxic").alias("label"), F.round(clean.prose_ratio(F.col("text")), 9).alias("score"))
    return verifier.roc_auc(rows)


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)
SELECT q.vec_id, round(max(list_inner_product(q.v, t.v)), 6) AS echo FROM u q, u t WHERE q.vec_id % 50 = 0 AND t.vec_id <> q.vec_id GROUP BY q.vec_id""")
def semantic_echo(spark, sf_dir):
    """Nearest cosine of every fiftieth embedding among all other rows."""
    e = table(spark, sf_dir, "embeddings")
    return leakage.semantic_echo(e.where(F.col("vec_id") % 50 == 0), e, "vec_id", "embedding", among=True).select("vec_id", F.round("echo", 6).alias("echo"))
