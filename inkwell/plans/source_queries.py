"""Queries through files and file names: JSON lines, folders, archives' posts, hosted documents, runs and logs.

What they write lies in the application's shared folder, since executors read it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.operators import clean, extract
from inkwell.plans import sqltext as S
from inkwell.session import table, work_dir
from inkwell.sources import files
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


def _folder(spark) -> str:
    return f"{work_dir(spark)}/files-{uuid.uuid4().hex}"


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, md5(text) AS text_md5, source, (SELECT count(*) FROM documents) AS written FROM documents UNION ALL SELECT item_id, md5(text), 'appended', (SELECT count(*) FROM documents) FROM benchmark")
def jsonl_round_trip(spark, sf_dir):
    """Documents written as JSON lines, others appended, and all read back with a fixed schema."""
    top = _folder(spark)
    n = files.write_jsonl(_docs(spark, sf_dir).select("doc_id", "text", "source"), top)
    files.append_jsonl(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("appended").alias("source")), top)
    back = files.read_jsonl(spark, top, "doc_id long, text string, source string")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "source", F.lit(n).cast("long").alias("written"))


@query("SELECT lang AS split, doc_id, md5(text) AS text_md5 FROM documents")
def split_files(spark, sf_dir):
    """One folder per split, with the language as split, read back."""
    top = _folder(spark)
    files.write_splits(_docs(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("split")), top)
    rows = spark.read.schema("doc_id long, text string, split string").json(top)
    return rows.select("split", "doc_id", F.md5("text").alias("text_md5"))





@query(f"SELECT item_id, md5({S.normalized('text')}) AS text_md5, CASE WHEN item_id < 20 THEN 'what: ' || item_id END AS prompt, CASE WHEN {S.normalized('text')} = '' THEN 'empty after normalization' WHEN {S.prose_ratio(S.normalized('text'))} < {X.MIN_PROSE_RATIO} THEN 'low prose ratio' END AS reason FROM benchmark")
def folder_ingest(spark, sf_dir):
    """Benchmark items as text files, some with front matter, through the folder reader and the filters."""
    top = _folder(spark)
    head = F.when(F.col("item_id") < 20, F.concat(F.lit("---\nprompt: what: "), F.col("item_id").cast("string"), F.lit("\n---\n\n"))).otherwise(F.lit(""))
    rows = table(spark, sf_dir, "benchmark").select(F.concat(head, "text").alias("value"), "item_id")
    rows.write.partitionBy("item_id").text(top)
    raw = files.read_documents(spark, top).withColumn("item_id", F.regexp_extract("source", "item_id=(-?[0-9]+)", 1).cast("long"))
    done = raw.select("item_id", clean.normalize(F.col("text")).alias("text"), "prompt")
    return done.select("item_id", F.md5("text").alias("text_md5"), "prompt", clean.skip_reason(F.col("text"), keep_templates=True).alias("reason"))


_BLOGS = f"""WITH b AS (SELECT source, string_agg('<post>' || text || '</post>', '' ORDER BY doc_id) AS text, any_value(regexp_extract(source, '[0-9]+')::INTEGER) + 10 AS age FROM documents WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT source, age, unnest(regexp_extract_all(text, {S.q(X.POST)}, 1)) AS raw FROM b WHERE age >= {X.MIN_AGE}),
c AS (SELECT source, age, {S.strip(S.sub(S.sub(S.sub(S.sub('raw', X.POST_NOISE, ' '), '<[^>]{1,80}>', ' '), X.SPACE_RUN, ' '), X.NEWLINE_RUN, chr(10) + chr(10)))} AS t FROM p),
k AS (SELECT *, {S.words('t')} AS w, len(regexp_extract_all(t, {S.q(X.FIRST_PERSON)})) AS fp FROM c WHERE {S.words('t')} BETWEEN {X.POST_WORDS[0]} AND {X.POST_WORDS[1]}),
r AS (SELECT source AS id, 'x' AS gender, age::VARCHAR AS age, 'arts' AS industry, count(*) AS posts, sum(w)::BIGINT AS words, round(sum(fp) * 100 / sum(w), 2) AS fp_rate FROM k GROUP BY source, age HAVING sum(w) >= {X.MIN_BLOG_WORDS})"""


def _bloggers(spark, sf_dir) -> DataFrame:
    """Sources as bloggers, their documents as posts, with an age from the source's number."""
    rows = _docs(spark, sf_dir).where("source IS NOT NULL").groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda r: F.concat(F.lit("<post>"), r["text"], F.lit("</post>"))), "").alias("text"))
    age = F.regexp_extract("source", "[0-9]+", 0).cast("int") + 10
    return extract.bloggers(rows.select(F.concat_ws(".", "source", F.lit("x"), age.cast("string"), F.lit("arts"), F.lit("leo"), F.lit("xml")).alias("file"), "text"))


@query(f"{_BLOGS} SELECT * FROM r")
def blog_ranking(spark, sf_dir):
    """Adult bloggers with enough words, their posts, words and first-person rate."""
    return _bloggers(spark, sf_dir).drop("file")


@query(f"{_BLOGS} SELECT (SELECT id FROM r WHERE fp_rate >= 0.01 ORDER BY words DESC, id DESC LIMIT 1) AS id")
def best_blogger(spark, sf_dir):
    """The blogger with most words whose first-person rate reaches a floor."""
    return extract.best_blogger(_bloggers(spark, sf_dir), floor=0.01)


@query(f"SELECT page_id, CASE WHEN list_has_any(string_split(lower(url), '/'), {S.array([*X.INFORMAL_PARTS, 'fr'])}) THEN 'informal' WHEN list_has_any(string_split(lower(url), '/'), {S.array([*X.FORMAL_PARTS, 'de'])}) THEN 'formal' ELSE 'unknown' END AS register FROM pages")
def path_registers(spark, sf_dir):
    """Register by any part of a path, here with two languages among the names."""
    return table(spark, sf_dir, "pages").select("page_id", clean.register_of(F.col("url"), [*X.INFORMAL_PARTS, "fr"], [*X.FORMAL_PARTS, "de"]).alias("register"))


@query("SELECT doc_id, substr(sha1(source || '|' || length(text)), 1, 12) AS id FROM documents WHERE source IS NOT NULL")
def document_ids(spark, sf_dir):
    """Identifiers from source and length."""
    return _docs(spark, sf_dir).where("source IS NOT NULL").select("doc_id", clean.document_id(F.col("source"), F.col("text")).alias("id"))


@query("SELECT doc_id, md5(chr(10) || text || chr(10)) AS text_md5, contains(lower(substr(text, 1, 1946)), 'der') AS titled FROM documents WHERE text IS NOT NULL")
def book_bodies(spark, sf_dir):
    """Documents as books between marks: the body alone, and whether a title occurs near the start."""
    book = F.concat(F.lit("Front matter\n*** START OF THE BOOK ***\n"), "text", F.lit("\n*** END OF THE BOOK *** licence"))
    lead = F.concat(F.lit("." * 54), "text")
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.md5(extract.strip_boilerplate(book)).alias("text_md5"), extract.title_ok(lead, F.lit("DER")).alias("titled"))


@query("SELECT doc_id, md5(replace(text, chr(10), '')) AS text_md5 FROM documents WHERE text IS NOT NULL")
def hosted_texts(spark, sf_dir):
    """Documents as hosted JSON, a paragraph per line and a table between, flattened again."""
    line = lambda s: F.struct(F.struct(F.array(F.struct(F.struct(s.alias("content")).alias("textRun"))).alias("elements")).alias("paragraph"))
    body = F.to_json(F.struct(F.struct(F.transform(F.split("text", "\n", -1), line).alias("content")).alias("body")))
    rows = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", body.alias("body"))
    return rows.select("doc_id", F.md5(files.hosted_document_text("body")).alias("text_md5"))


@query("WITH f AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'click') AND value > 150) SELECT 'runs/' || user_id AS dir FROM f GROUP BY user_id HAVING count(*) = 2")
def complete_runs(spark, sf_dir):
    """Folders with generations and a report, with two kinds of events as the files."""
    e = table(spark, sf_dir, "events").where("value > 150")
    name = F.when(F.col("event_type") == "view", "gen.jsonl").when(F.col("event_type") == "click", "report.json").otherwise("other.txt")
    return files.complete_runs(e.select(F.concat(F.lit("runs/"), F.col("user_id").cast("string"), F.lit("/"), name).alias("path")))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1")
def last_log_entry(spark, sf_dir):
    """The last row of a log."""
    return files.last_entry(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")


@query("WITH d AS (SELECT DISTINCT user_id AS n FROM events WHERE event_type = 'purchase' AND value > 120), u AS (SELECT DISTINCT user_id AS n FROM events) SELECT n AS name FROM u WHERE n NOT IN (SELECT n FROM d) AND (n = 0 OR n - 1 IN (SELECT n FROM d))")
def pending_units(spark, sf_dir):
    """Units that aren't done though what they require is: each user requires the one before."""
    e = table(spark, sf_dir, "events")
    units = e.select(F.col("user_id").alias("name")).distinct().select("name", F.when(F.col("name") > 0, F.array(F.col("name") - 1)).otherwise(F.array().cast("array<long>")).alias("requires"))
    return incremental.pending_units(units, e.where("event_type = 'purchase' AND value > 120").select(F.col("user_id").alias("name")).distinct()).select("name")


@query(f"SELECT count(*) AS documents, coalesce(sum({S.words('text')}), 0)::BIGINT AS words FROM documents WHERE lang = 'de'")
def word_totals(spark, sf_dir):
    """Documents and words of one language, as ingest reports them."""
    return files.word_totals(_docs(spark, sf_dir).where("lang = 'de'"))
