"""Queries over documents: filters, rewrites, sentences, chunks, leakage, near duplicates and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.functions import text as T
from inkwell.operators import chunk, clean, leakage, pairs, splits
from inkwell.plans import sqltext as S
from inkwell.session import table

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


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""SELECT doc_id, {S.words('text')}::BIGINT AS n_words, len({S.style_tokens('text')})::BIGINT AS n_style_tokens,
 len({S.leak_tokens('text')})::BIGINT AS n_leak_tokens, length(text)::BIGINT AS n_characters FROM documents""")
def doc_word_stats(spark, sf_dir):
    """Words, tokens and characters of every document."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", T.word_count(t).alias("n_words"), F.size(T.style_tokens(t)).cast("long").alias("n_style_tokens"), F.size(T.leak_tokens(t)).cast("long").alias("n_leak_tokens"), F.length(t).cast("long").alias("n_characters"))


@query("SELECT count(*) AS documents, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words FROM documents")
def corpus_totals(spark, sf_dir):
    """Documents and words in all."""
    return docs(spark, sf_dir).agg(F.count("*").alias("documents"), F.sum(T.word_count(F.col("text"))).alias("words"))


@query(f"SELECT doc_id, round({S.prose_ratio('text')}, 6) AS ratio FROM documents")
def prose_ratio(spark, sf_dir):
    """Share of prose lines of every document."""
    return docs(spark, sf_dir).select("doc_id", F.round(clean.prose_ratio(F.col("text")), 6).alias("ratio"))


@query(f"SELECT doc_id, {S.is_template('text')} AS is_template FROM documents")
def template_filter(spark, sf_dir):
    """Which documents look like templates."""
    return docs(spark, sf_dir).select("doc_id", clean.looks_like_template(F.col("text")).alias("is_template"))


@query(f"SELECT doc_id, md5(t) AS text_md5, length(t)::BIGINT AS n FROM (SELECT doc_id, {S.normalized('text')} AS t FROM documents)")
def normalize_text(spark, sf_dir):
    """Digest and length of every normalised document."""
    return docs(spark, sf_dir).select("doc_id", clean.normalize(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n"))


@query(f"""SELECT CASE WHEN t = '' THEN 'empty after normalization' WHEN {S.prose_ratio('t')} < {X.MIN_PROSE_RATIO} THEN 'low prose ratio'
 WHEN {S.is_template('t')} THEN 'looks like a template' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT {S.normalized('text')} AS t FROM documents) GROUP BY 1""")
def ingest_reasons(spark, sf_dir):
    """How many documents ingest keeps, or skips and why."""
    t = docs(spark, sf_dir).select(clean.normalize(F.col("text")).alias("t"))
    return t.groupBy(F.coalesce(clean.skip_reason(F.col("t")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _scrub_sql() -> tuple[str, list[str]]:
    ctes, kinds, prev = [], [], "documents"
    for i, (kind, pattern) in enumerate(X.SCRUB_RULES):
        if kind == "HANDLE":
            n, to = f"len(regexp_extract_all(text, {S.q('(^|[^0-9A-Za-z_])@[A-Za-z_][A-Za-z0-9_]{2,}')}))", f"regexp_replace(text, {S.q('(^|[^0-9A-Za-z_])@[A-Za-z_][A-Za-z0-9_]{2,}')}, '\\1<HANDLE>', 'g')"
        elif kind == "CARD":  # the engine's word boundary is Unicode-aware: a space before an accented letter belongs to the match
            wide = r"\b(?:\d[ -]?){12,15}\d[ -]([^\x00-\x7F])"
            first = f"regexp_replace(text, {S.q(wide)}, 'X_CARD_X\\1', 'g')"
            n, to = f"len(regexp_extract_all(text, {S.q(wide)})) + len(regexp_extract_all({first}, {S.q(pattern)}))", f"replace({S.sub(first, pattern, '<CARD>')}, 'X_CARD_X', '<CARD>')"
        else:
            n, to = f"len(regexp_extract_all(text, {S.q(pattern)}))", S.sub("text", pattern, f"<{kind}>")
        ctes.append(f"s{i} AS (SELECT * REPLACE ({to} AS text), {n} AS n_{kind} FROM {prev})")
        kinds.append(kind)
        prev = f"s{i}"
    near = "(contains(text, '<ADDRESS>') OR contains(text, '<PLACE>'))"
    ctes.append(f"z AS (SELECT * REPLACE (CASE WHEN {near} THEN {S.sub('text', X.ZIP, '<ZIP>')} ELSE text END AS text), CASE WHEN {near} THEN len(regexp_extract_all(text, {S.q(X.ZIP)})) ELSE 0 END AS n_ZIP FROM {prev})")
    kinds.append("ZIP")
    once = "text"
    for k in kinds:
        once = f"regexp_replace({once}, '(<{k}>)(\\s+<{k}>)+', '\\1', 'g')"
    ctes.append(f"done AS (SELECT * REPLACE ({S.sub(once, X.SPACE_RUN, ' ')} AS text) FROM z)")
    return "WITH " + ",\n".join(ctes), kinds


_SCRUB, _KINDS = _scrub_sql()
_DENSITY = f"len(regexp_extract_all(text, '<[A-Z]+>')) / greatest(1, {S.words('text')})"


@query(f"{_SCRUB} SELECT doc_id, md5(text) AS text_md5, round({_DENSITY}, 6) AS density, {_DENSITY} <= {X.MAX_PLACEHOLDER_DENSITY} AS kept FROM done")
def scrub_text(spark, sf_dir):
    """Digest and placeholder density of every scrubbed document."""
    done = clean.scrub(docs(spark, sf_dir).select("doc_id", "text")).withColumn("d", clean.placeholder_density(F.col("text")))
    return done.select("doc_id", F.md5("text").alias("text_md5"), F.round("d", 6).alias("density"), (F.col("d") <= X.MAX_PLACEHOLDER_DENSITY).alias("kept"))


@query(f"{_SCRUB} SELECT kind, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, n_{k} AS n FROM done" for k in _KINDS) + ") GROUP BY kind HAVING sum(n) > 0")
def scrub_counts(spark, sf_dir):
    """Removals by kind over all documents."""
    return clean.removals_by_kind(clean.scrub(docs(spark, sf_dir).select("doc_id", "text")))


@query(f"SELECT doc_id, len(s)::BIGINT AS n_sentences, sum_w::BIGINT AS n_words FROM (SELECT doc_id, {S.sentences('text')} AS s, list_sum(list_transform({S.sentences('text')}, lambda x: {S.words('x')})) AS sum_w FROM documents)")
def sentence_stats(spark, sf_dir):
    """Sentences of every document, and words in them."""
    s = docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate(F.transform("s", T.word_count), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"))


def _chunks(spark, sf_dir) -> DataFrame:
    return chunk.chunk_documents(docs(spark, sf_dir).withColumnRenamed("lang", "register"))


_CHUNKS = f"""WITH src AS (SELECT doc_id, {S.paragraphs('text')} AS ps FROM documents), {S.packed('src', 'doc_id', X.CHUNK_MIN_WORDS, X.CHUNK_MAX_WORDS, 'pk')},
ch AS (SELECT doc_id, unnest(chunks) AS text, unnest(range(0, len(chunks))) AS chunk_index FROM pk),
chunk AS (SELECT printf('%d-%03d', doc_id, chunk_index) AS chunk_id, doc_id, lang AS register, chunk_index, {S.words('ch.text')} AS n_words, ch.text FROM ch JOIN documents USING (doc_id))"""


@query(f"{_CHUNKS} SELECT chunk_id, doc_id, register, chunk_index::INTEGER AS chunk_index, n_words::BIGINT AS n_words, md5(text) AS text_md5 FROM chunk")
def chunk_documents(spark, sf_dir):
    """Answer-sized chunks of all documents."""
    return _chunks(spark, sf_dir).select("chunk_id", "doc_id", "register", "chunk_index", "n_words", F.md5("text").alias("text_md5"))


@query(
    f"""{_CHUNKS} SELECT register, count(*) AS n, round(avg(n_words), 1) AS words_mean, min(n_words)::BIGINT AS words_min, max(n_words)::BIGINT AS words_max, sum(n_words)::BIGINT AS total_words,
 round(avg({S.continues('text')}::INTEGER), 3) AS frac_starts_mid_thought, round(avg((NOT regexp_matches(text, {S.q(X.TERMINATED)}))::INTEGER), 3) AS frac_ends_unterminated, count(DISTINCT doc_id) AS n_docs FROM chunk GROUP BY register"""
)
def chunk_health(spark, sf_dir):
    """Health of the chunks by register (the document's language)."""
    return chunk.chunk_health(_chunks(spark, sf_dir), "register")


_G = f"""WITH d AS (SELECT doc_id, {S.leak_tokens('text')} AS t FROM documents), b AS (SELECT item_id, {S.leak_tokens('text')} AS t FROM benchmark),
dg AS (SELECT doc_id, unnest({S.grams('t', 12)}) AS gram, unnest(range(0, len(t) - 11)) AS pos FROM d WHERE len(t) >= 12),
bg AS (SELECT item_id, unnest({S.grams('t', 12)}) AS gram, unnest(range(0, len(t) - 11)) AS pos FROM b WHERE len(t) >= 12)"""


@query(f"{_G} SELECT doc_id, count(DISTINCT gram) AS n_shared FROM dg WHERE gram IN (SELECT gram FROM bg) GROUP BY doc_id")
def ngram_overlap(spark, sf_dir):
    """12-grams that documents share with the benchmark."""
    found = leakage.shared_grams(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_shared"))


@query(f"{_G}, h AS (SELECT count(DISTINCT doc_id) AS hits FROM dg WHERE gram IN (SELECT gram FROM bg)) SELECT (SELECT count(*) FROM documents) AS n, hits, round(hits / greatest(1, (SELECT count(*) FROM documents)), 4) AS rate, CASE WHEN hits / greatest(1, (SELECT count(*) FROM documents)) > {X.VERBATIM_GATE} THEN 'FAIL' ELSE 'PASS' END AS verdict FROM h")
def verbatim_rate(spark, sf_dir):
    """Share of documents with a 12-gram of the benchmark."""
    return leakage.verbatim_rate(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(f"""{_G}, m AS (SELECT dg.doc_id, bg.item_id, dg.pos, bg.pos - dg.pos AS d FROM dg JOIN bg USING (gram)),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY pos) AS isl FROM m),
r AS (SELECT doc_id, count(*) + 11 AS run FROM i GROUP BY doc_id, item_id, d, isl)
SELECT doc_id, least(max(run), {X.RUN_CAP})::BIGINT AS longest_run FROM r GROUP BY doc_id""")
def longest_verbatim_run(spark, sf_dir):
    """Longest run of tokens that a document copies from the benchmark."""
    return leakage.longest_runs(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


def _proper(t: str) -> str:
    return f"list_filter(regexp_extract_all({t}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,}}'))"


_VOCAB = f"""WITH p AS (SELECT unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2))) AS s FROM documents),
w AS (SELECT unnest({_proper('substr(s, 2)')}) AS word FROM p), v AS (SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 2)"""


@query(f"{_VOCAB} SELECT word, n FROM v")
def entity_vocab(spark, sf_dir):
    """Proper nouns that documents, as the author's texts, use inside sentences."""
    return leakage.entity_vocabulary(docs(spark, sf_dir))


_TURN_WORDS = f"e AS (SELECT unnest({_proper('text')}) AS word FROM conversations), c AS (SELECT word, count(*) AS n FROM e WHERE word IN (SELECT word FROM v) GROUP BY word)"


def _emitted(spark, sf_dir) -> DataFrame:
    return leakage.entity_emission(table(spark, sf_dir, "conversations"), leakage.entity_vocabulary(docs(spark, sf_dir)))


@query(f"{_VOCAB}, {_TURN_WORDS} SELECT word, n FROM c")
def entity_emission(spark, sf_dir):
    """Those nouns in conversations, as generated texts."""
    return _emitted(spark, sf_dir)


@query(f"{_VOCAB}, {_TURN_WORDS} SELECT count(*) AS n_distinct_leaked, coalesce(sum(n), 0)::BIGINT AS n_occurrences, round(coalesce(sum(n), 0) / (SELECT count(*) FROM conversations), 3) AS per_generation FROM c")
def emission_summary(spark, sf_dir):
    """Distinct nouns, occurrences, and occurrences per turn."""
    return leakage.emission_summary(_emitted(spark, sf_dir), table(spark, sf_dir, "conversations"))


@query(f"{_VOCAB}, {_TURN_WORDS} SELECT word, n FROM c ORDER BY n DESC, word LIMIT 10")
def top_entities(spark, sf_dir):
    """The ten nouns that conversations use most."""
    return _emitted(spark, sf_dir).orderBy(F.desc("n"), "word").limit(10)


_PROBE = X.PROBE_ANSWER.removeprefix(r"\b").removesuffix(r"\b").replace(r"\d", "[0-9]")


@query(
    f"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)) AS ss FROM documents),
s AS (SELECT doc_id, unnest(ss) AS s, unnest(range(0, len(ss))) AS pos FROM p),
a AS (SELECT *, regexp_extract(substr(s, 2), {S.q(r'(?:^|[^\p{L}\p{M}\p{N}_])' + _PROBE + S.BREAK)}, 1) AS answer FROM s WHERE {S.words('s')} BETWEEN 8 AND 40)
SELECT doc_id, pos::INTEGER AS pos, substr(s, 1, 1) || substr(s, 2, (instr(substr(s, 2), answer) - 1)::BIGINT) || '____' || substr(substr(s, 2), (instr(substr(s, 2), answer) + length(answer))::BIGINT) AS probe, answer
FROM a WHERE answer <> '' ORDER BY doc_id, pos LIMIT {X.MAX_PROBES}"""
)
def fact_probes(spark, sf_dir):
    """The first forty cloze probes."""
    return leakage.fact_probes(docs(spark, sf_dir), "doc_id")


@query(f"SELECT doc_id, round(CASE WHEN len(t) < 5 THEN 0.0 ELSE 1.0 - len(list_distinct({S.grams('t', 4)})) / len({S.grams('t', 4)}) END, 6) AS score FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\S+') AS t FROM documents)")
def repetition_score(spark, sf_dir):
    """Share of repeated 4-grams of every document."""
    return docs(spark, sf_dir).select("doc_id", F.round(T.repetition(F.col("text")), 6).alias("score"))


_ND = f"""WITH RECURSIVE t AS (SELECT doc_id, {S.near_dup_tokens('text')} AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest({S.grams('t', 5)}) AS gram FROM t WHERE len(t) >= 5),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b, c / least(x.n, y.n) AS containment FROM s JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / least(x.n, y.n) > {X.NEAR_DUP_THRESHOLD})"""
_GROUPS = f"""{_ND}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS root, a AS node FROM (SELECT DISTINCT a FROM e) UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node),
grp AS (SELECT d.doc_id, coalesce(min(r.root), d.doc_id) AS "group" FROM documents d LEFT JOIN r ON r.node = d.doc_id GROUP BY d.doc_id)"""


@query(f"{_ND} SELECT a, b, round(containment, 6) AS containment FROM p")
def near_dup_pairs(spark, sf_dir):
    """Pairs of documents that share over 15 % of the smaller one's 5-grams."""
    return splits.near_duplicate_pairs(docs(spark, sf_dir), "doc_id", digits=6)


@query(f'{_GROUPS} SELECT doc_id, "group" FROM grp')
def near_dup_groups(spark, sf_dir):
    """Groups of documents that such pairs connect."""
    return splits.near_duplicate_groups(docs(spark, sf_dir), "doc_id")


_SPLIT = f"""{_GROUPS}, reg AS (SELECT "group", arg_min(lang, doc_id) AS register FROM grp JOIN documents USING (doc_id) GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY register ORDER BY {S.seeded(X.SEED, '"group"')}, "group") AS i, count(*) OVER (PARTITION BY register) AS n FROM reg),
nb AS (SELECT *, CASE WHEN n >= 4 THEN greatest(1, round_even(n * {X.BLIND_FRACTION}, 0)) WHEN n >= 2 THEN 1 ELSE 0 END AS b, CASE WHEN n >= 4 THEN greatest(1, round_even(n * {X.VAL_FRACTION}, 0)) WHEN n = 3 THEN 1 ELSE 0 END AS v FROM rk),
sp AS (SELECT "group", register, CASE WHEN i <= b THEN 'blind' WHEN i <= b + v THEN 'val' ELSE 'train' END AS split FROM nb)"""


def _split(spark, sf_dir, **more) -> DataFrame:
    """Split documents; further columns are taken from the texts before these are joined, so that no text travels."""
    return splits.split_documents(docs(spark, sf_dir).select("doc_id", "text", "lang").withColumns(more), "doc_id", "lang")


@query(f'{_SPLIT} SELECT doc_id, "group", split FROM grp JOIN sp USING ("group")')
def group_split(spark, sf_dir):
    """Split of every document; near duplicates stay together."""
    return _split(spark, sf_dir).select("doc_id", "group", "split")


@query(f'{_SPLIT}, x AS (SELECT doc_id, split, lang AS register, {S.words("text")} AS w FROM grp JOIN sp USING ("group") JOIN documents USING (doc_id)) SELECT split, register, count(*) AS pairs, count(DISTINCT doc_id) AS docs, sum(w)::BIGINT AS words FROM x GROUP BY GROUPING SETS ((split, register), (split))')
def split_summary(spark, sf_dir):
    """Documents and words by split and register."""
    rows = _split(spark, sf_dir, n_words=T.word_count(F.col("text")), register=F.col("lang"))
    return splits.split_summary(rows, "doc_id")


@query(
    f"""WITH r AS (SELECT md5(text) AS text_md5, row_number() OVER (ORDER BY {S.seeded(X.SEED, 'doc_id')}, doc_id) AS i, count(*) OVER () AS n FROM documents),
s AS (SELECT text_md5, CASE WHEN i <= floor(n * {X.BLIND_FRACTION}) THEN 'blind' WHEN i <= floor(n * {X.BLIND_FRACTION}) + floor(n * {X.VAL_FRACTION}) THEN 'val' ELSE 'train' END AS split FROM r)
SELECT text_md5, list_sort(list(DISTINCT split)) AS splits FROM s GROUP BY text_md5 HAVING count(DISTINCT split) > 1"""
)
def split_overlap(spark, sf_dir):
    """Texts that lie in several splits when rows are split without groups: what the guard reports."""
    rows = splits.split_pairs_by_row(docs(spark, sf_dir).select("doc_id", F.md5("text").alias("text_md5")), "doc_id")
    return splits.split_overlap(rows, "text_md5")


@query(f'{_SPLIT} SELECT count(*) AS texts, count(*) FILTER (n > 1) AS in_several FROM (SELECT md5(text) AS t, count(DISTINCT split) AS n FROM grp JOIN sp USING ("group") JOIN documents USING (doc_id) GROUP BY 1)')
def split_leaks(spark, sf_dir):
    """Distinct texts, and those that lie in several splits when near duplicates move together."""
    rows = _split(spark, sf_dir, t=F.md5("text")).groupBy("t").agg(F.countDistinct("split").alias("n"))
    return rows.agg(F.count("*").alias("texts"), F.count_if(F.col("n") > 1).alias("in_several"))


_SWEEP = f"""WITH o AS (SELECT doc_id, {S.words('text')} AS w, {S.seeded(X.SEED, 'doc_id')} AS k FROM documents),
c AS (SELECT *, coalesce(sum(w) OVER (ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER () AS total FROM o),
a AS (SELECT target, label FROM (VALUES {', '.join(f"({s}, '{s // 1000}k')" for s in X.SWEEP_SIZES)}) v(target, label) WHERE target < (SELECT max(total) FROM c) UNION ALL SELECT max(total), 'full' FROM c),
m AS (SELECT target, label, doc_id, w FROM c JOIN a ON before < target)"""


def _sweep(spark, sf_dir) -> DataFrame:
    return splits.size_sweep(docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words")), "doc_id")


@query(f"{_SWEEP} SELECT target::BIGINT AS target, label, sum(w)::BIGINT AS actual_words, count(DISTINCT doc_id) AS documents FROM m GROUP BY ALL")
def size_sweep(spark, sf_dir):
    """Nested corpora of growing size."""
    return splits.sweep_manifest(_sweep(spark, sf_dir), "doc_id")


@query(
    f"{_SWEEP}, k AS (SELECT m.* FROM m JOIN documents d USING (doc_id) WHERE label <> 'full' OR lang <> 'de'), f AS (SELECT doc_id, min(target) AS first, count(*) AS in_arms FROM k GROUP BY doc_id) SELECT doc_id, in_arms, count(*) AS arms FROM f JOIN (SELECT DISTINCT target FROM k) t ON t.target >= first GROUP BY ALL HAVING count(*) <> in_arms"
)
def sweep_not_nested(spark, sf_dir):
    """Documents that break the nesting once the largest corpus has lost its German ones."""
    german = docs(spark, sf_dir).where("lang = 'de'").select("doc_id", F.lit("full").alias("label"))
    return splits.not_nested(_sweep(spark, sf_dir).join(german, ["doc_id", "label"], "left_anti"), "doc_id")


@query("SELECT doc_id, source, row_number() OVER (ORDER BY k, source) AS sequence, (k + 0.5::DOUBLE) / 20 AS position FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)")
def interleave(spark, sf_dir):
    """Documents of all sources, interleaved."""
    return splits.interleave(docs(spark, sf_dir).select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", "source", "sequence", "position")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def dedup_keep_first(spark, sf_dir):
    """The first document of each text."""
    return splits.keep_first(docs(spark, sf_dir).select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id", F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id FROM documents ORDER BY {S.seeded(X.SEED, 'doc_id')}, doc_id LIMIT 5")
def seeded_sample(spark, sf_dir):
    """Five documents by a seeded order."""
    return splits.seeded_sample(docs(spark, sf_dir).select("doc_id"), "doc_id", 5)


@query(f"SELECT toxic, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS i FROM labels) WHERE i <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)) GROUP BY toxic")
def class_balance(spark, sf_dir):
    """As many toxic as other labelled documents."""
    rows = splits.class_balance(table(spark, sf_dir, "labels"), "toxic", ["doc_id"])
    return rows.groupBy("toxic").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


_TURNS = """WITH t AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id || '-q' || turn AS pair_id, conv_id AS doc_id, text AS prompt, t2 AS response FROM t WHERE role = 'user' AND r2 = 'assistant')"""


def _pairs(spark, sf_dir) -> DataFrame:
    return pairs.conversation_pairs(table(spark, sf_dir, "conversations"))


@query(f"{_TURNS} SELECT pair_id, doc_id, md5(prompt) AS prompt_md5, md5(response) AS response_md5, {S.words('response')}::BIGINT AS n_words FROM p")
def pairs_from_conversations(spark, sf_dir):
    """User turns and the answers that follow."""
    return _pairs(spark, sf_dir).select("pair_id", "doc_id", F.md5("prompt").alias("prompt_md5"), F.md5("response").alias("response_md5"), "n_words")


def _bank() -> str:
    w = S.words("text")
    length = f"CASE WHEN {w} < 110 THEN 'a short paragraph' WHEN {w} < 240 THEN 'two or three paragraphs' ELSE 'several paragraphs' END"
    return "[" + ", ".join(f"replace(replace(replace({S.q(x)}, '{{length}}', {length}), '{{tone}}', {S.q(X.OTHER_TONE)}), '{{paragraphs}}', (len(regexp_extract_all(text, '\\n\\n')) + 1)::VARCHAR)" for x in X.QUESTIONS) + "]"


@query(f"SELECT doc_id, i::INTEGER AS j, b[(length(text) + i) % 5 + 1] AS question FROM (SELECT doc_id, text, {_bank()} AS b, unnest([0, 1]) AS i FROM documents)")
def offline_questions(spark, sf_dir):
    """Two content-blind questions for every document."""
    q = docs(spark, sf_dir).select("doc_id", F.posexplode(pairs.offline_questions(F.col("text"), F.col("lang"))).alias("j", "question"))
    return q


@query(f"{_TURNS} SELECT pair_id, least(a, b) > 0 AND abs(a - b) / greatest(a, b) <= {X.LENGTH_TOLERANCE} AS ok FROM (SELECT pair_id, {S.words('prompt')} AS a, {S.words('response')} AS b FROM p)")
def length_match(spark, sf_dir):
    """Whether prompt and response are of similar length."""
    return _pairs(spark, sf_dir).select("pair_id", F.coalesce(pairs.length_ok(F.col("prompt"), F.col("response")), F.lit(False)).alias("ok"))


@query(f"{_TURNS}, n AS (SELECT count(*) AS n FROM p) SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY {S.seeded(X.SEED, 'pair_id')}, pair_id) <= CASE WHEN n >= 20 THEN greatest(1, floor(n * 0.15)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM p, n")
def dpo_holdout(spark, sf_dir):
    """Train and val pairs."""
    return pairs.preference_holdout(_pairs(spark, sf_dir).select("pair_id"))


@query(f"{_TURNS} SELECT pair_id, 'unknown' AS register, md5('user:' || prompt) AS prompt_md5, md5('assistant:' || response) AS completion_md5 FROM p")
def prompt_completion(spark, sf_dir):
    """Pairs as messages; digests of their roles and contents."""
    rows = pairs.prompt_completion(_pairs(spark, sf_dir).withColumn("register", F.lit(None).cast("string")))
    flat = lambda c: F.md5(F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"))
    return rows.select("pair_id", "register", flat("prompt").alias("prompt_md5"), flat("completion").alias("completion_md5"))


_CONT = f"""WITH b AS (SELECT doc_id::VARCHAR AS id, text, {S.sentences('text')} AS s, greatest(12, floor({S.words('text')} * 0.2)) AS goal FROM documents),
f AS (SELECT id, text, list_reduce(s[1:len(s) - 1], lambda a, x: CASE WHEN a.ok AND a.taken < goal THEN {{'cut': CASE WHEN instr(substr(text, a.cut + 1), x) > 0 THEN a.cut + instr(substr(text, a.cut + 1), x) - 1 + length(x) ELSE a.cut END,
 'taken': a.taken + {S.words('x')}, 'ok': instr(substr(text, a.cut + 1), x) > 0}} ELSE a END, {{'cut': 0::BIGINT, 'taken': 0::BIGINT, 'ok': true}}) AS st FROM b WHERE len(s) >= 3),
sc AS (SELECT id, substr(text, 1, st.cut) AS lead, {S.strip('substr(text, st.cut + 1)')} AS rest FROM f WHERE st.ok)"""


@query(f"{_CONT} SELECT 'raw-' || id AS pair_id, md5({S.q(X.CONTINUE_INSTRUCTION)} || lead) AS prompt_md5, md5(rest) AS completion_md5 FROM sc WHERE {S.strip('lead')} <> '' AND {S.words('rest')} >= 12")
def self_continuation(spark, sf_dir):
    """Documents that continue from their own opening."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("pair_id"), F.col("text").alias("response"))
    return pairs.self_continuation(rows).select("pair_id", F.md5(F.col("prompt")[0]["content"]).alias("prompt_md5"), F.md5(F.col("completion")[0]["content"]).alias("completion_md5"))


def _neutral(t: str) -> str:
    out = f"translate({t}, '’‘', chr(39) || chr(39))"
    for short, whole in pairs.SPELLED.items():
        out = f"replace({out}, {S.q(short)}, {S.q(whole)})"
    out = S.sub(out, rf"(?i)\b(?:{'|'.join(pairs.FILLERS)})\b[ \t]*", "")
    out = S.strip(S.sub(S.sub(S.sub(out, "[ \\t]*[—–][ \\t]*", ", "), "([!?])[!?]+", "\\1"), "[ \\t]{2,}", " "))
    return out


def judged(source: str) -> str:
    """CTEs that end in ``o`` (id, ref, got, outcome): what becomes of generations (id, ref, got)."""
    grams = S.grams("t", 4)
    share = f"CASE WHEN len(t) < 5 THEN 0.0 ELSE 1.0 - len(list_distinct({grams})) / len({grams}) END"
    a, b = S.words("ref"), S.words("got")
    ok = f"least({a}, {b}) > 0 AND abs({a} - {b}) / greatest({a}, {b}) <= {X.LENGTH_TOLERANCE}"
    return f"""o0 AS MATERIALIZED ({source}), o1 AS MATERIALIZED (SELECT *, regexp_extract_all(lower(got), '\\S+') AS t FROM o0), o2 AS MATERIALIZED (SELECT id, ref, got, {share} AS rep FROM o1),
o AS (SELECT id, ref, got, CASE WHEN coalesce(got, '') = '' OR rep > {X.REPETITION_GATE} THEN 'dropped_degenerate' WHEN {ok} THEN 'kept' ELSE 'pending' END AS outcome FROM o2)"""


_NEUTRAL = f"SELECT doc_id::VARCHAR AS id, text AS ref, CASE WHEN n = '' THEN '' ELSE {S.q(pairs.OPENING)} || n END AS got FROM n0"


@query(f"WITH n0 AS MATERIALIZED (SELECT doc_id, text, {_neutral('text')} AS n FROM documents), {judged(_NEUTRAL)} SELECT id AS pair_id, outcome FROM o")
def preference_pairs(spark, sf_dir):
    """Outcome of every document against its genericised version."""
    refs = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("pair_id"), F.col("text").alias("response"))
    gens = refs.select("pair_id", pairs.genericised(F.col("response")).alias("completion"), F.lit(0).alias("seq"))
    return pairs.preference_pairs(refs, gens).select("pair_id", "outcome")


@query(f"{_CHUNKS}, bk AS (SELECT *, {_bank()} AS b FROM chunk) SELECT chunk_id || '-q' || j AS pair_id, chunk_id, doc_id, register, md5(b[(length(text) + j) % 5 + 1]) AS prompt_md5, n_words::BIGINT AS n_words, 'offline-template' AS generator FROM bk, (VALUES (0), (1)) q(j)")
def chunk_pairs(spark, sf_dir):
    """Two offline questions per chunk."""
    rows = pairs.build_pairs(_chunks(spark, sf_dir))
    return rows.select("pair_id", "chunk_id", "doc_id", "register", F.md5("prompt").alias("prompt_md5"), "n_words", "generator")
