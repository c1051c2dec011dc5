"""Queries over entities, evaluations, preference pairs, controls and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.functions import text as T
from inkwell.operators import entities, evaluation, pairs, records, splits
from inkwell.plans import golden, text_queries
from inkwell.plans import sqltext as S
from inkwell.session import table, work_dir
from inkwell.streaming import incremental

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_docs, _pairs, _TURNS = text_queries.docs, text_queries._pairs, text_queries._TURNS

# Spans by the lengths of the matches and of the parts between them; m: matches, p: parts, i: place of a match.
_START = "(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT"
_SPANS = f"""WITH n AS (SELECT doc_id, text, string_split_regex(text, {S.q(entities.NAMES)}) AS p, regexp_extract_all(text, {S.q(entities.NAMES)}) AS m FROM documents),
s AS (SELECT doc_id, text, m[i] AS piece, {_START} AS a, {_START} + length(m[i]) AS b FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM n)),
e AS (SELECT *, CASE WHEN a > 0 THEN substr(text, a, 1) ELSE '' END AS before, CASE WHEN a > 1 THEN substr(text, a - 1, 1) ELSE '' END AS further, substr(text, b + 1, 1) AS after, substr(text, b + 2, 1) AS beyond FROM s),
j AS (SELECT *, NOT (list_contains({S.array(X.NEVER_SCRUB)}, lower(piece)) OR (upper(piece) = piece AND lower(piece) <> piece) OR regexp_matches(before, '[0-9A-Za-z]') OR (before IN ('-', '‐', '‑', '''', '’') AND regexp_matches(further, '[0-9A-Za-z]'))
  OR regexp_matches(after, '[0-9A-Za-z]') OR (after IN ('-', '‐', '‑') AND regexp_matches(beyond, '[0-9A-Za-z]'))) AS go FROM e),
o AS (SELECT doc_id, string_agg(substr(text, prev + 1, a - prev) || CASE WHEN go THEN '<PERSON>' ELSE piece END, '' ORDER BY a) AS out, max(b) AS last, count(*) FILTER (go) AS replaced, count(*) FILTER (NOT go) AS kept
  FROM (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM j) GROUP BY doc_id)"""


@query(f"{_SPANS} SELECT d.doc_id, md5(coalesce(out, '') || substr(text, coalesce(last, 0) + 1)) AS text_md5, coalesce(replaced, 0) AS replaced, coalesce(kept, 0) AS kept FROM documents d LEFT JOIN o USING (doc_id)")
def entity_scrub(spark, sf_dir):
    """Documents without the names that the offline recogniser finds and the guard lets go."""
    done = entities.scrub_entities(_docs(spark, sf_dir).select("doc_id", "text"), entities.name_spans(F.col("text")))
    gone = F.size(F.filter("entities", lambda e: e["replaced"])).cast("long")
    return done.select("doc_id", F.md5("text").alias("text_md5"), gone.alias("replaced"), (F.size("entities") - gone).alias("kept"))


@query(f"{_SPANS} SELECT 'PERSON' AS label, count(*) FILTER (go) AS replaced, count(*) FILTER (NOT go) AS kept FROM j")
def entity_counts(spark, sf_dir):
    """Entities by label: replaced, and kept by the guard."""
    done = entities.scrub_entities(_docs(spark, sf_dir).select("doc_id", "text"), entities.name_spans(F.col("text")))
    flat = done.select(F.explode("entities").alias("e"))
    return flat.groupBy("e.label").agg(F.count_if(F.col("e.replaced")).alias("replaced"), F.count_if(~F.col("e.replaced")).alias("kept"))


_TAGS = f"list_transform(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]'), lambda w: CASE WHEN list_contains({S.array(X.FUNCTION_WORDS)}, lower(w)) THEN 'FUNC' WHEN regexp_matches(w, '^[0-9]') THEN 'NUM' WHEN regexp_matches(w, '^[A-Z]') THEN 'NAME' WHEN regexp_matches(w, '^[a-z]') THEN 'WORD' ELSE 'SIGN' END)"


@query(f"WITH t AS (SELECT lang, {_TAGS} AS t FROM documents), g AS (SELECT lang, unnest({S.grams('t', 3)}) AS trigram FROM t WHERE len(t) >= 3) SELECT lang, trigram, count(*) AS n FROM g GROUP BY ALL")
def tag_trigrams(spark, sf_dir):
    """Three tags in a row, by language."""
    return entities.tag_trigrams(_docs(spark, sf_dir), entities.coarse_tags(F.col("text")), "lang")


@query(
    f"""WITH t AS (SELECT lang, {_TAGS} AS t FROM documents WHERE lang IN ('en', 'de')), g AS (SELECT lang, unnest({S.grams('t', 3)}) AS k FROM t WHERE len(t) >= 3), n AS (SELECT lang, k, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS p FROM n), x AS (SELECT greatest(coalesce(a.p, 0), 1e-12) AS p, greatest(coalesce(b.p, 0), 1e-12) AS q FROM (SELECT * FROM s WHERE lang = 'en') a FULL JOIN (SELECT * FROM s WHERE lang = 'de') b USING (k)),
y AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM x) SELECT 'tag_trigrams' AS block, round(greatest(0.0, least(1.0, sum((p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2))), 6) AS js FROM y"""
)
def tag_divergence(spark, sf_dir):
    """Divergence of two languages' tag trigrams."""
    return entities.tag_divergence(_docs(spark, sf_dir), entities.coarse_tags(F.col("text")), "lang", "en", "de").withColumn("js", F.round("js", 6))


_LOSS = f"SELECT doc_id AS ord, lang, text, ln(1 + length(text) / greatest(1, {S.words('text')})) AS loss, {S.words('text')} - 1 AS n_tokens FROM documents WHERE {S.strip('text')} <> ''"
_PPL = "exp(sum(loss * n_tokens) FILTER (n_tokens > 0) / sum(n_tokens) FILTER (n_tokens > 0))"


def _losses(spark, sf_dir, lang: str) -> DataFrame:
    """Documents of a language with a stand-in for a model's loss: the logarithm of characters per word."""
    t, n = F.col("text"), T.word_count(F.col("text"))
    return _docs(spark, sf_dir).where(F.col("lang") == lang).select(F.col("doc_id").alias("ord"), "text", F.log(1 + F.length(t) / F.greatest(F.lit(1), n)).alias("loss"), (n - 1).alias("n_tokens"))


@query(
    f"""WITH l AS ({_LOSS}), a AS (SELECT * FROM l WHERE lang = 'en' ORDER BY ord LIMIT {X.CONTAMINATION_CAP}), d AS (SELECT * FROM l WHERE lang = 'de' ORDER BY ord LIMIT {X.CONTAMINATION_CAP}),
x AS (SELECT {_PPL} AS p, count(*) AS n FROM a), y AS (SELECT {_PPL} AS p, count(*) AS n FROM d)
SELECT round(x.p, 4) AS ppl_author, round(y.p, 4) AS ppl_distractor, round(x.p / y.p, 4) AS familiarity_ratio, x.n AS n_author_texts, y.n AS n_distractor_texts FROM x, y"""
)
def contamination_check(spark, sf_dir):
    """Perplexities of two languages under a stand-in model, and their ratio."""
    return evaluation.contamination(_losses(spark, sf_dir, "en"), _losses(spark, sf_dir, "de"))


_REAL = f"""{_TURNS}, g AS (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS i, pair_id, prompt FROM p),
rf AS (SELECT pair_id, response, row_number() OVER (ORDER BY pair_id) - 1 AS j FROM p WHERE length(response) > length(prompt)),
sp AS (SELECT i, pair_id, prompt, substr(prompt, 1, {X.SAMPLE_CHARS}) AS generated, substr(coalesce(o.response, a.response), 1, {X.SAMPLE_CHARS}) AS real
 FROM g LEFT JOIN (SELECT pair_id, response FROM rf) o USING (pair_id) LEFT JOIN rf a ON a.j = g.i % (SELECT count(*) FROM rf))"""


def _generations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Prompts as generations, and the answers that are longer than their prompt as references."""
    p = _pairs(spark, sf_dir)
    generated = p.select("pair_id", F.col("pair_id").alias("seq"), "prompt", F.col("prompt").alias("completion"))
    return generated, p.where(F.length("response") > F.length("prompt")).select("pair_id", F.col("pair_id").alias("seq"), "response")


@query(f"{_REAL} SELECT i, pair_id, md5(prompt) AS prompt_md5, md5(generated) AS generated_md5, md5(real) AS real_md5 FROM sp")
def paired_references(spark, sf_dir):
    """Every generation with its reference, or with one by its place where it has none."""
    return evaluation.with_reference(*_generations(spark, sf_dir)).select("i", "pair_id", F.md5("prompt").alias("prompt_md5"), F.md5("generated").alias("generated_md5"), F.md5("real").alias("real_md5"))


@query(f"{_REAL} SELECT i, pair_id, prompt, generated, real FROM sp WHERE i < {X.SAMPLES}")
def report_samples(spark, sf_dir):
    """The first generations beside their references."""
    return evaluation.samples(*_generations(spark, sf_dir))


_REC = f"WITH r(rel, av, leak, flu_verdict, leak_verdict, trainable, wallclock, generated_at) AS (VALUES {golden.values(tuple(golden.records()))})"
_SIDE = "SELECT unnest(['ratio', 'floor_av', 'fewshot_av', 'adapter_av', 'leak']) AS measure, unnest([{ratio}::DOUBLE, max(av) FILTER (rel = 'floor'), max(av) FILTER (rel = 'sweep/{arm}/baseline'), max(av) FILTER (rel = 'sweep/{arm}/stage_a'), max(leak) FILTER (rel = 'sweep/{arm}/stage_a')]) AS value FROM r WHERE {keep}"


def _records(spark) -> DataFrame:
    return spark.createDataFrame(golden.records(), golden.RECORDS)


def _manifest(spark) -> DataFrame:
    return spark.createDataFrame([(i, arm, words, n) for i, (arm, words, n, *_) in enumerate(golden.SWEEP)], "ord int, arm string, actual_words long, documents long")


@query(f"{_REC}, a AS ({_SIDE.format(ratio=0.98, arm='full', keep='true')}), b AS ({_SIDE.format(ratio=0.71, arm='100k', keep=chr(39) + 'sweep/full/stage_a' + chr(39) + ' <> rel')}) SELECT measure, a.value AS public, b.value AS private FROM a FULL JOIN b USING (measure)")
def control_table(spark, sf_dir):
    """Measures of the runs beside those of a control without its largest arm."""
    r, m = _records(spark), _manifest(spark)
    return evaluation.control_table(evaluation.control_side(r, m, 0.98), evaluation.control_side(r.where("rel <> 'sweep/full/stage_a'"), m, 0.71))


_SECOND = "SELECT rel AS run, av / 2 + 0.25 AS av_second FROM r WHERE rel LIKE '%stage_a' AND av IS NOT NULL"


@query(f"{_REC}, i AS ({_SECOND}) SELECT rel, av, round(av_second, 6) AS av2 FROM r LEFT JOIN i ON i.run = r.rel")
def second_instrument(spark, sf_dir):
    """Records with a second instrument's rate, where it has one."""
    r = _records(spark)
    second = r.where("rel LIKE '%stage_a' AND av IS NOT NULL").select(F.col("rel").alias("run"), (F.col("av") / 2 + 0.25).alias("av_second"))
    return evaluation.with_second_instrument(r, second).select("rel", "av", F.round("av2", 6).alias("av2"))


@query(f"{_REC}, a AS (SELECT DISTINCT CASE WHEN rel LIKE 'matrix/models/%' THEN 0.9312::DOUBLE ELSE 0.9738::DOUBLE END AS auc FROM r) SELECT list_sort(list(auc)) AS aucs, count(*) > 1 AS moved FROM a")
def distinct_aucs(spark, sf_dir):
    """The held-out AUCs that records name: two, so two rulers."""
    return evaluation.distinct_aucs(_records(spark).withColumn("auc", F.when(F.col("rel").startswith("matrix/models/"), 0.9312).otherwise(0.9738)))


@query(
    f"""{_REC}, p AS (SELECT *, string_split(rel, '/') AS s FROM r),
f AS (SELECT rel, av, leak, CASE WHEN rel = 'floor' THEN 'base floor' WHEN s[1] = 'sweep' AND len(s) = 3 AND s[3] = 'baseline' THEN 'few-shot' WHEN s[1] = 'sweep' AND len(s) = 3 AND s[3] = 'stage_a' THEN 'stage A'
 WHEN s[1] = 'sweep' AND len(s) = 3 AND s[3] = 'stage_b' THEN 'stage A+B' WHEN s[1] = 'matrix' AND s[2] = 'rq2' THEN 'stage A' END AS series, CASE WHEN rel = 'floor' THEN 'base' WHEN s[1] = 'sweep' THEN s[2] ELSE string_split(s[3], '_')[1] END AS label FROM p)
SELECT rel, series, label, av, leak FROM f WHERE series IS NOT NULL AND av IS NOT NULL AND leak IS NOT NULL"""
)
def frontier_points(spark, sf_dir):
    """Series and label of the records that the frontier shows."""
    return evaluation.frontier(_records(spark))


@query("SELECT ((i * 7) % 12 * 50)::INTEGER AS step, round(i / 20, 6) AS av, round(i / 200, 6) AS leak FROM range(12) t(i)")
def trajectory(spark, sf_dir):
    """Checkpoints of a run in the order of their steps."""
    i = F.col("id")
    rel = F.concat(F.lit("matrix/trajectory/full/step-"), ((i * 7) % 12 * 50).cast("string"), F.lit("/stage_a"))
    rows = spark.range(12).select(rel.alias("rel"), (i / 20).alias("av"), (i / 200).alias("leak")).unionByName(_records(spark).select("rel", "av", "leak"))
    return evaluation.trajectory(rows).select("step", F.round("av", 6).alias("av"), F.round("leak", 6).alias("leak"))


@query(f"{_TURNS} SELECT doc_id, sum(w)::BIGINT AS n_words FROM (SELECT DISTINCT doc_id, response, {S.words('response')} AS w FROM p) GROUP BY doc_id")
def response_words(spark, sf_dir):
    """Words of a conversation's answers, each counted once however many questions it has."""
    twice = _pairs(spark, sf_dir).withColumn("question", F.explode(F.array(F.lit(0), F.lit(1))))
    return evaluation.response_words(twice)


_PREF = f"""{_TURNS}, {text_queries.judged('SELECT pair_id AS id, response AS ref, prompt AS got FROM p')}, x AS (SELECT id AS pair_id, outcome, length(ref) / 1000 AS a, length(got) / 1000 AS b FROM o)"""


@query(
    f"{_PREF} SELECT count(*) AS candidates, count(*) FILTER (outcome = 'pending') AS dropped_length, count(*) FILTER (outcome = 'dropped_degenerate') AS dropped_degenerate, count(*) FILTER (outcome = 'kept' AND a - b < {X.AV_MARGIN}) AS dropped_av, count(*) FILTER (outcome = 'kept' AND a - b >= {X.AV_MARGIN}) AS kept, 0 AS retries, count(*) FILTER (outcome = 'kept' AND a - b >= {X.AV_MARGIN}) >= {X.MIN_PREFERENCES} AS enough FROM x"
)
def preference_stats(spark, sf_dir):
    """What becomes of answers against their prompts as preference pairs."""
    return pairs.preference_stats(_judged(spark, sf_dir), X.AV_MARGIN)


def _judged(spark, sf_dir) -> DataFrame:
    p = _pairs(spark, sf_dir)
    judged = pairs.preference_pairs(p, p.select("pair_id", F.col("prompt").alias("completion"), F.lit(0).alias("seq")))
    return judged.withColumns({"av_chosen": F.length("response") / 1000, "av_rejected": F.length("completion") / 1000})


@query(f"{_PREF} SELECT pair_id, round(a, 4) AS av_chosen, round(b, 4) AS av_rejected FROM x WHERE outcome = 'kept' AND a - b >= {X.AV_MARGIN}")
def margin_gate(spark, sf_dir):
    """Kept pairs whose answer scores well above its prompt."""
    return pairs.margin_gate(_judged(spark, sf_dir).where("outcome = 'kept'")).select("pair_id", "av_chosen", "av_rejected")


@query(f"SELECT source, count(*) AS windows, sum({S.words('text')})::BIGINT AS words, count(DISTINCT source) AS authors FROM documents WHERE source IS DISTINCT FROM 'src0' GROUP BY ROLLUP (source)")
def distractor_counts(spark, sf_dir):
    """Windows and words of every author but one, and of all."""
    rows = evaluation.other_authors(_docs(spark, sf_dir).withColumn("n_words", T.word_count(F.col("text"))), "src0", "source")
    return evaluation.distractor_counts(rows, "source")


def _audited(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents as chunks, those done before, their pairs with an audit by length, and the pairs that pass it."""
    d = _docs(spark, sf_dir)
    chunks = d.select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text", F.col("lang").alias("register"), F.when(F.col("lang") == "es", F.col("source")).alias("prompt"))
    done = d.where("lang = 'fr'").select(F.col("doc_id").cast("string").alias("chunk_id"))
    made = pairs.build_pairs(chunks, done=done)
    verdict = F.when(F.col("n_words") < 100, "drop").when(F.col("n_words") > 500, "rewrite").otherwise("keep")
    audited = made.withColumn("audit", F.struct(verdict.alias("verdict"), F.concat(F.lit("Again: "), "prompt").alias("rewritten")))
    return chunks, done, audited, pairs.apply_audit(audited)


_AUDIT = f"""WITH b AS (SELECT *, {text_queries._bank()} AS b, {S.words('text')} AS w FROM documents WHERE lang <> 'fr'),
pr AS (SELECT doc_id, w, j, lang = 'es' AS supplied, CASE WHEN lang = 'es' THEN source ELSE b[(length(text) + j) % 5 + 1] END AS prompt FROM b, (VALUES (0), (1)) q(j) WHERE j = 0 OR lang <> 'es'),
ok AS (SELECT *, CASE WHEN supplied THEN 'keep' WHEN w < 100 THEN 'drop' WHEN w > 500 THEN 'rewrite' ELSE 'keep' END AS verdict FROM pr)"""


@query(
    f"""{_AUDIT} SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM documents WHERE lang = 'fr') AS resumed_skip, (SELECT count(*) FROM documents WHERE lang = 'es') AS supplied_prompt,
 (SELECT count(*) FROM documents WHERE lang <> 'fr') - count(DISTINCT doc_id) FILTER (verdict <> 'drop') AS no_question, count(*) FILTER (verdict <> 'drop') AS pairs,
 count(*) FILTER (NOT supplied) AS generated, count(*) FILTER (verdict = 'drop') AS dropped_by_audit, count(*) FILTER (verdict = 'rewrite') AS rewritten FROM ok"""
)
def backtranslate_stats(spark, sf_dir):
    """Counters of a resumed run with an audit."""
    chunks, done, audited, kept = _audited(spark, sf_dir)
    return pairs.pair_stats(chunks, kept, audited, done)


@query(f"{_AUDIT} SELECT doc_id || '-q' || j AS pair_id, md5(CASE WHEN verdict = 'rewrite' THEN 'Again: ' || prompt ELSE prompt END) AS prompt_md5, CASE WHEN supplied THEN 'supplied-prompt' ELSE 'offline-template' END AS generator FROM ok WHERE verdict <> 'drop'")
def audited_pairs(spark, sf_dir):
    """Pairs after the audit: dropped, rewritten or kept."""
    return _audited(spark, sf_dir)[3].select("pair_id", F.md5("prompt").alias("prompt_md5"), "generator")





@query("SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN length(text) > 2000 THEN 'drop' ELSE 'rewrite' END ELSE 'keep' END AS verdict, CASE WHEN lang = 'en' THEN 'x' || doc_id ELSE '' END AS rewritten FROM documents")
def audit_verdicts(spark, sf_dir):
    """Verdicts out of an auditor's free answers; answers that can't be read keep the pair."""
    verdict = F.when(F.length("text") > 2000, "drop").otherwise("rewrite")
    answer = F.concat(F.lit('Here it is: {"verdict": "'), verdict, F.lit('", "rewritten": "x'), F.col("doc_id").cast("string"), F.lit('"} - done'))
    raw = F.when(F.col("lang") == "en", answer).when(F.col("lang") == "de", F.lit("{broken")).otherwise(F.lit("no answer"))
    return _docs(spark, sf_dir).select("doc_id", pairs.audit_of(raw).alias("a")).select("doc_id", "a.verdict", "a.rewritten")


_ASKED = f"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {S.strip(S.sub('s', X.LIST_MARKER, ''))}), lambda s: {S.words('s')} >= 4 AND NOT regexp_matches(s, {S.q(X.TOPIC_LEAK)}))[1:2] AS q FROM documents"""


@query(f"SELECT doc_id, len(q)::INTEGER AS n, md5(array_to_string(q, '|')) AS questions_md5 FROM ({_ASKED})")
def usable_questions(spark, sf_dir):
    """The first two lines of every document that could be questions, as a generator's raw answer."""
    return _docs(spark, sf_dir).select("doc_id", pairs.generated_questions(F.col("text")).alias("q")).select("doc_id", F.size("q").alias("n"), F.md5(F.array_join("q", "|")).alias("questions_md5"))


@query(f"{_TURNS} SELECT pair_id, md5(prompt || replace(replace({S.q(X.LENGTH_HINT.replace('%d-%d', '#A-#B'))}, '#A', floor({S.words('response')} * 0.8)::BIGINT::VARCHAR), '#B', floor({S.words('response')} * 1.25)::BIGINT::VARCHAR)) AS prompt_md5 FROM p")
def length_hints(spark, sf_dir):
    """Prompts with a range of words around their answer's length."""
    return _pairs(spark, sf_dir).select("pair_id", F.md5(pairs.length_hint(F.col("prompt"), T.word_count(F.col("response")))).alias("prompt_md5"))


def _raw_chunks(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), "text")


@query(f"{_TURNS} SELECT pair_id, md5(d.text) AS response_md5, {S.words('d.text')}::BIGINT AS n_words FROM p JOIN documents d USING (doc_id) WHERE d.lang = 'en'")
def swap_responses(spark, sf_dir):
    """Pairs with the text of the English document of their number as their answer."""
    rows = pairs.swap_responses(_pairs(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id"), _raw_chunks(spark, sf_dir))
    return rows.select("pair_id", F.md5("response").alias("response_md5"), "n_words")


@query(f"{_TURNS} SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS swapped, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS missing FROM p")
def swap_stats(spark, sf_dir):
    """How many pairs have such a document."""
    return pairs.swap_stats(_pairs(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id"), _raw_chunks(spark, sf_dir))


@query(
    f"""WITH t AS (SELECT DISTINCT {S.strip('text')} AS text FROM documents WHERE lang = 'en' AND {S.strip('text')} <> ''), o AS (SELECT text, md5('{X.SEED}|' || text) AS k FROM t ORDER BY k, text LIMIT 5)
SELECT md5('Be brief.' || chr(10) || chr(10) || 'Write in the voice of these passages by one author.' || chr(10) || chr(10) || string_agg('<sample>' || chr(10) || text || chr(10) || '</sample>', chr(10) || chr(10) ORDER BY k)) AS system_md5, count(*)::INTEGER AS exemplars FROM o"""
)
def fewshot_prompt(spark, sf_dir):
    """A system prompt with five passages of the train split (here English)."""
    texts = _docs(spark, sf_dir).select("text", F.when(F.col("lang") == "en", "train").otherwise("val").alias("split"))
    return pairs.fewshot_system(texts, "Be brief.").select(F.md5("system").alias("system_md5"), "exemplars")


@query(
    f"""WITH u AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), n AS (SELECT greatest(1, floor(count(*) * 0.01)) AS n FROM documents)
SELECT doc_id::VARCHAR AS pair_id FROM u WHERE i = 1 ORDER BY {S.seeded(X.SEED, 'doc_id')}, doc_id::VARCHAR LIMIT (SELECT n::BIGINT FROM n)"""
)
def raw_mix(spark, sf_dir):
    """A hundredth of the documents, at most one of a source, for self-continuation."""
    rows = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("pair_id"), "doc_id", F.col("source").alias("chunk_id"))
    first = splits.keep_first(rows, ["chunk_id"], ["doc_id"])
    return pairs.raw_mix(rows.join(first.select("pair_id"), "pair_id", "left_semi"), 0.01 * rows.count() / max(1, first.count())).select("pair_id")


@query(f"{text_queries._CONT}, m AS (SELECT 'raw-' || id AS pair_id, 'unknown' AS register, md5(rest) AS completion_md5 FROM sc JOIN documents d ON d.doc_id::VARCHAR = id WHERE {S.strip('lead')} <> '' AND {S.words('rest')} >= 12 AND lang = 'de'), t AS (SELECT * FROM ({_TURNS} SELECT pair_id, md5(response) AS completion_md5 FROM p)) SELECT * FROM m UNION ALL SELECT pair_id, 'unknown', completion_md5 FROM t")
def with_raw_mix(spark, sf_dir):
    """Conversation pairs as training rows, with German documents as self-continuations beside them."""
    rows = pairs.prompt_completion(_pairs(spark, sf_dir).withColumn("register", F.lit(None).cast("string")))
    raw = _docs(spark, sf_dir).where("lang = 'de'").select(F.col("doc_id").cast("string").alias("pair_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("response"))
    return pairs.with_raw_mix(rows, raw, 1.0).select("pair_id", "register", F.md5(F.col("completion")[0]["content"]).alias("completion_md5"))


_FILES = "SELECT regexp_replace(url, '^https?://', '') AS path, length(html) * 10000 AS bytes FROM pages"


def _files(spark, sf_dir) -> DataFrame:
    """Pages as files: the url without its scheme, ten thousand bytes a character."""
    return table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"), (F.length("html") * 10000).cast("long").alias("bytes"))


@query(f"WITH f AS ({_FILES}), p AS (SELECT array_to_string(string_split(path, '/')[1:2], '/') AS prefix, bytes FROM f) SELECT prefix, sum(bytes)::BIGINT AS bytes, count(*) AS files FROM p GROUP BY ROLLUP (prefix)")
def size_rollup(spark, sf_dir):
    """Bytes by host and first folder, and in all."""
    return records.size_rollup(_files(spark, sf_dir))


@query(f"WITH f AS ({_FILES}), v AS (SELECT path, bytes, CASE WHEN contains(path, 'blog.') THEN 'private' WHEN bytes > 20000000 THEN 'too large' WHEN bytes > 10000000 THEN 'large' END AS verdict FROM f) SELECT path, bytes::BIGINT AS bytes, verdict FROM v WHERE verdict IS NOT NULL")
def publish_guard(spark, sf_dir):
    """Files that may not be published, or with a warning."""
    return records.publish_guard(_files(spark, sf_dir), ["blog."], block=20_000_000, warn=10_000_000)


@query(f"WITH u AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id) SELECT user_id, CASE WHEN b IS NULL OR a IS NULL THEN NULL WHEN (a - b) / b <= {X.FLUENCY_BUDGET} THEN 'PASS' ELSE 'FAIL' END AS verdict FROM u WHERE a IS NOT NULL")
def fluency_gate(spark, sf_dir):
    """Whether one mean stays within the budget of another, with event values as perplexities."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))
    return e.where("a IS NOT NULL").select("user_id", records.fluency_verdict(F.col("a"), F.col("b")).alias("verdict"))


@query("SELECT arg_max(value, event_id) AS last, min(value) AS best, arg_max(value, event_id) > min(value) * 1.05 AS overfit FROM events WHERE event_type = 'view'")
def overfit_readout(spark, sf_dir):
    """Whether the last loss exceeds the best, with event values as an evaluation log."""
    return records.overfit(table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("event_id").alias("step"), F.col("value").alias("eval_loss")))


@query(f"{_REC} SELECT rel, list_filter([CASE WHEN upper(flu_verdict) LIKE 'FAIL%' THEN 'flu_verdict' END, CASE WHEN upper(leak_verdict) LIKE 'FAIL%' THEN 'leak_verdict' END], lambda v: v IS NOT NULL) AS vetoes FROM r")
def verdict_vetoes(spark, sf_dir):
    """Names of the gates that each record failed."""
    return _records(spark).select("rel", records.veto(["flu_verdict", "leak_verdict"]).alias("vetoes"))


@query(f"{_REC}, a AS (SELECT * FROM r WHERE rel LIKE 'sweep/%/stage_a'), b AS (SELECT replace(rel, 'baseline', 'stage_a') AS rel, av FROM r WHERE rel LIKE 'sweep/%/baseline') SELECT rel AS name, round(CASE WHEN contains(rel, '0k') THEN a.av - b.av ELSE b.av - a.av END, 4) AS delta FROM a JOIN b USING (rel) WHERE a.av IS NOT NULL AND b.av IS NOT NULL")
def baseline_delta(spark, sf_dir):
    """Rates of runs against their baselines, signed so that more is better."""
    r = _records(spark)
    runs = r.where("rel LIKE 'sweep/%/stage_a'").select(F.col("rel").alias("name"), F.col("av").alias("value"), F.contains("rel", F.lit("0k")).alias("higher_better"))
    return records.baseline_delta(runs, r.where("rel LIKE 'sweep/%/baseline'").select(F.replace("rel", F.lit("baseline"), F.lit("stage_a")).alias("name"), F.col("av").alias("value")))


@query("SELECT split, register FROM (SELECT DISTINCT CASE WHEN source < 'src2' THEN 'train' WHEN source < 'src5' THEN 'val' ELSE 'blind' END AS split FROM documents) a, (SELECT DISTINCT lang || source AS register FROM documents WHERE source < 'src2') b EXCEPT SELECT CASE WHEN source < 'src2' THEN 'train' WHEN source < 'src5' THEN 'val' ELSE 'blind' END, lang || source FROM documents")
def missing_registers(spark, sf_dir):
    """Registers that train but another split doesn't hold, with sources dealt to splits by their name."""
    split = F.when(F.col("source") < "src2", "train").when(F.col("source") < "src5", "val").otherwise("blind")
    return splits.missing_registers(_docs(spark, sf_dir).where("source IS NOT NULL").select(split.alias("split"), F.concat("lang", "source").alias("register")))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, coalesce(sum(len(regexp_extract_all(text, '\\S+'))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 50000")
def word_budget(spark, sf_dir):
    """Documents in order until fifty thousand words are reached."""
    rows = _docs(spark, sf_dir).select("doc_id", "source", T.word_count(F.col("text")).alias("n_words"))
    return splits.word_budget(rows, ["doc_id"], 50_000).select("doc_id", "source")


@query(
    f"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents),
c AS (SELECT doc_id, coalesce(nullif(regexp_replace(substr(s, 1, 40), '-+$', ''), ''), 'untitled') AS slug FROM s) SELECT slug, min(doc_id) AS doc_id FROM c GROUP BY slug"""
)
def file_slugs(spark, sf_dir):
    """File names by the first words of every document; of equal ones the first document keeps it."""
    from inkwell.sources import files

    rows = _docs(spark, sf_dir).select("doc_id", F.substring("text", 1, 60).alias("title"))
    return files.file_per_row(rows, "title", "doc_id").select("slug", "doc_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_windows(spark, sf_dir):
    """Hourly counts by type out of a watermarked stream that runs to its end."""
    top = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parque[t]")
    counts = incremental.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    sink = counts.writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.write.mode("append").parquet(f"{top}/out"))
    sink.option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{top}/out").groupBy("start", "event_type").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    f"""WITH r AS (SELECT user_id, epoch_us(ts) / 6e7 AS minutes, round(value * 10)::BIGINT AS chars FROM events),
s AS (SELECT user_id, greatest(0, chars - lag(chars) OVER o) AS added, minutes - lag(minutes) OVER o AS gap FROM r WINDOW o AS (PARTITION BY user_id ORDER BY minutes, chars)),
t AS (SELECT user_id, coalesce(sum(added), 0) AS t, coalesce(sum(CASE WHEN added >= {X.PASTE_CHARS} AND added / greatest(gap, 1e-6) > {X.PASTE_RATE} THEN added ELSE 0 END), 0) AS p FROM s GROUP BY user_id)
SELECT user_id, round(CASE WHEN t > 0 THEN p / t ELSE -1.0 END, 6) AS paste_score FROM t"""
)
def streamed_pastes(spark, sf_dir):
    """Share of pasted characters over all revisions of a user, kept as state of a stream."""
    top = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    rows = e.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(6e7)).alias("minutes"), F.round(F.col("value") * 10).cast("long").alias("chars"))
    sink = incremental.paste_state(rows, "user_id").writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{top}/out"))
    sink.option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{top}/out").groupBy("user_id").agg(F.max_by("paste_score", "batch").alias("paste_score"))
    return last.select("user_id", F.round("paste_score", 6).alias("paste_score"))
