"""Scans and sinks: JSON lines, directories of documents, books, archives and run records."""

from __future__ import annotations

import io
import json
import os
import re
import subprocess
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from inkwell.functions import fixed as X
from inkwell.functions import text as T
from inkwell.operators import clean
from inkwell.session import ship

FORMATS = ("txt", "md", "markdown", "docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_jsonl(spark: SparkSession, path: str, schema: str | Y.StructType) -> DataFrame:
    """JSON lines with a fixed schema; a missing file or a malformed line fails, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def iterate_jsonl(spark: SparkSession, path: str, schema: str | Y.StructType) -> Iterator[dict]:
    """Rows as mappings, a partition at a time, for a driver that takes them one by one."""
    for row in read_jsonl(spark, path, schema).toLocalIterator(prefetchPartitions=True):
        yield row.asDict(recursive=True)


def write_jsonl(df: DataFrame, path: str) -> int:
    """Overwrite a folder of JSON lines; returns the number of rows, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").json(path)
    return int(seen.get["n"])


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def front_matter(raw: str | None) -> tuple[dict[str, str], str]:
    """Keys and body of a text that opens with a block between --- lines; an unterminated block is body."""
    raw = raw or ""
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", raw, re.S)
    if not m:
        return {}, raw
    pairs = (line.split(":", 1) for line in m[1].split("\n") if ":" in line)
    return {k.strip(): v.strip() for k, v in pairs}, raw[m.end() :].lstrip("\n")


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(_W + "t")) for p in root.iter(_W + "p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


@F.pandas_udf(Y.StructType([Y.StructField("meta", Y.MapType(Y.StringType(), Y.StringType())), Y.StructField("text", Y.StringType())]))
def _decoded(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    metas, texts = [], []
    for p, c in zip(path, content):
        raw = docx_text(c) if p.lower().endswith(".docx") else c.decode("utf-8", "replace")
        meta, body = front_matter(raw)
        metas.append(meta)
        texts.append(body)
    return pd.DataFrame({"meta": metas, "text": texts})


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """source (path below the folder), meta, prompt and text of every document file below a folder."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(FORMATS) + "}").load(folder)
    rows = files.select("path", _decoded("path", "content").alias("d"))
    return rows.select(F.regexp_extract("path", re.escape(folder.rstrip("/")) + "/(.*)$", 1).alias("source"), "path", F.col("d.meta").alias("meta"), F.col("d.meta")["prompt"].alias("prompt"), F.col("d.text").alias("text"))


def ingest(raw: DataFrame, origin: str = "local", least_prose: float = X.MIN_PROSE_RATIO, keep_templates: bool = False, register: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped with their reason) of raw files (source, path, prompt, text)."""
    named = F.lit(register) if register else clean.register_of(F.col("path"), X.INFORMAL_PARTS, X.FORMAL_PARTS)
    done = raw.withColumns({"chars_raw": F.length("text"), "text": clean.normalize(F.col("text"))}).withColumn("reason", clean.skip_reason(F.col("text"), least_prose, keep_templates))
    kept = done.where("reason IS NULL").select(clean.document_id(F.col("path"), F.col("text")).alias("doc_id"), "source", F.lit(origin).alias("origin"), named.alias("register"), "chars_raw", "text", "prompt")
    return kept, done.where("reason IS NOT NULL").select("source", "reason")


def hosted_document_text(body: str):
    """Text of a hosted document's JSON: the runs of its paragraphs, in order; other elements are skipped."""
    schema = "struct<body: struct<content: array<struct<paragraph: struct<elements: array<struct<textRun: struct<content: string>>>>>>>>"
    paragraphs = F.filter(F.from_json(F.col(body), schema)["body"]["content"], lambda c: c["paragraph"].isNotNull())
    runs = F.flatten(F.transform(paragraphs, lambda c: F.coalesce(F.transform(c["paragraph"]["elements"], lambda e: F.coalesce(e["textRun"]["content"], F.lit(""))), F.array().cast("array<string>"))))
    return F.coalesce(F.array_join(runs, ""), F.lit(""))


@F.pandas_udf(Y.ArrayType(Y.StructType([Y.StructField("file", Y.StringType()), Y.StructField("text", Y.StringType())])))
def _members(content: pd.Series) -> pd.Series:
    out = []
    for c in content:
        with zipfile.ZipFile(io.BytesIO(c)) as z:
            out.append([{"file": n.rsplit("/", 1)[-1], "text": z.read(n).decode("latin-1")} for n in sorted(z.namelist()) if n.endswith(".xml")])
    return pd.Series(out)


def read_blog_archives(spark: SparkSession, path: str) -> DataFrame:
    """file and text of the XML members of ZIP archives (Latin-1)."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select(F.explode(_members("content")).alias("m")).select("m.*")


REPORT = (
    "run_name string, split string, model string, generated_at string, n_generations long, "
    "stylometry struct<overall: double>, av struct<attribution_rate: double>, av_metrics struct<auc: double>, "
    "leakage struct<verdict: string, verbatim: struct<rate: double, longest_verbatim_run_tokens: long>, entities: struct<per_generation: double>, echo: struct<echo: double>>, "
    "fluency struct<verdict: string, relative_regression: double>, training struct<trainable: long, train_runtime_s: double, stage: string>"
)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Flat run records of all report.json files below a folder; files that can't be read are skipped."""
    rows = spark.read.schema(REPORT + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "report.json").json(folder)
    rel = F.regexp_extract("_metadata.file_path", re.escape(folder.rstrip("/")) + "/(.*)/report.json$", 1)
    return rows.where("_corrupt_record IS NULL").select(
        rel.alias("rel"), "run_name", F.col("av.attribution_rate").alias("av"), F.col("av_metrics.auc").alias("auc"), F.col("leakage.verbatim.rate").alias("leak"), F.col("leakage.verbatim.longest_verbatim_run_tokens").alias("longest"),
        F.col("leakage.entities.per_generation").alias("entities"), F.col("leakage.echo.echo").alias("echo"), F.col("stylometry.overall").alias("sty"), F.col("fluency.relative_regression").alias("flu"), F.col("fluency.verdict").alias("flu_verdict"),
        F.col("leakage.verdict").alias("leak_verdict"), F.col("training.trainable").alias("trainable"), F.col("training.train_runtime_s").alias("wallclock"), F.col("training.stage").alias("stage"), "generated_at",
    )


def complete_runs(paths: DataFrame, trajectories: bool = False) -> DataFrame:
    """Folders (of paths) with both generations and a report; checkpoints and trajectories only if asked for."""
    parts = paths.select(F.regexp_extract("path", "^(.*)/([^/]+)$", 1).alias("dir"), F.regexp_extract("path", "^(.*)/([^/]+)$", 2).alias("file"))
    both = parts.where("file = 'gen.jsonl'").select("dir").distinct().join(parts.where("file = 'report.json'").select("dir"), "dir", "left_semi")
    return both if trajectories else both.where("NOT dir RLIKE 'checkpoint|trajectory'")


def last_entry(log: DataFrame, order: str) -> DataFrame:
    """The last row of an append-only log."""
    return log.orderBy(F.desc(order)).limit(1)


def file_per_row(rows: DataFrame, title: str, order: str) -> DataFrame:
    """``rows`` with a file slug; of equal slugs the first keeps it."""
    from inkwell.operators.splits import keep_first

    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(slug, 1, 40), "-+$", "")
    return keep_first(rows.withColumn("slug", F.when(cut == "", "untitled").otherwise(cut)), ["slug"], [order])


def distractors(spark: SparkSession, folder: str, least: int, most: int, limit: int | None = None) -> DataFrame:
    """Chunks of all text files below a folder, in path order, up to ``limit``."""
    from inkwell.operators.chunk import chunk_documents

    docs = read_documents(spark, folder).select(F.col("source").alias("doc_id"), "source", "text")
    rows = chunk_documents(docs, least, most).orderBy("source", "chunk_index")
    return rows.limit(limit) if limit is not None else rows


def word_totals(docs: DataFrame) -> DataFrame:
    """One row: documents and words."""
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(T.word_count(F.col("text"))), F.lit(0)).alias("words"))


def write_file_per_row(rows: DataFrame, folder: str, title: str, order: str) -> None:
    """A folder per slug with the row's text, as Spark writes them in parallel."""
    named = file_per_row(rows, title, order)
    named.select("slug", F.col("text").alias("value")).write.mode("overwrite").partitionBy("slug").text(folder)


def ingest_hosted(bodies: DataFrame, scores: DataFrame | None = None, most_pasted: float = X.MOST_PASTED, limit: int | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped) of hosted documents (path, source, body as JSON), normalised and filtered like local ones.

    ``scores`` (path, paste_score) drops documents that were mostly pasted; an unknown score, -1, passes.
    """
    raw = bodies.limit(limit) if limit is not None else bodies
    raw = raw.select("path", "source", F.lit(None).cast("string").alias("prompt"), hosted_document_text("body").alias("text"))
    kept, skipped = ingest(raw, origin="hosted", **how)
    if scores is None:
        return kept, skipped
    typed = raw.join(scores.select("path", "paste_score"), "path", "left")
    pasted = typed.where(F.col("paste_score") > most_pasted).select("path", "source", "prompt", "text")
    typed = typed.where(F.coalesce("paste_score", F.lit(-1.0)) <= most_pasted).select("path", "source", "prompt", "text")
    kept, skipped = ingest(typed, origin="hosted", **how)
    return kept, skipped.unionByName(pasted.select("source", F.lit("mostly pasted").alias("reason")))


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object of any layout as one row; null fields where it has none, an error where it can't be read."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


_TENSOR_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4"}


def tensors_of(data: bytes) -> list[tuple[str, np.ndarray]]:
    """Names and arrays of a safetensors file: eight bytes of length, a JSON header, then the raw values."""
    size = int.from_bytes(data[:8], "little")
    out = []
    for name, entry in json.loads(data[8 : 8 + size]).items():
        if name == "__metadata__":
            continue
        a, b = entry["data_offsets"]
        raw = data[8 + size + a : 8 + size + b]
        if entry["dtype"] == "BF16":  # the upper half of a 32-bit float
            values = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
        else:
            values = np.frombuffer(raw, _TENSOR_TYPES[entry["dtype"]])
        out.append((name, values.reshape(entry["shape"]).astype(float)))
    return out


def read_adapters(spark: SparkSession, path: str) -> DataFrame:
    """file, module, a and b (matrices) and magnitude of the adapters in safetensors files; modules without both
    matrices are left out."""
    ship(spark)

    @F.pandas_udf("array<struct<module:string, part:string, matrix:array<array<double>>>>")
    def parts(content: pd.Series) -> pd.Series:
        out = []
        for data in content:
            rows = []
            for name, values in tensors_of(data):
                m = re.match(r"(.*)\.lora_(A|B|magnitude_vector)(?:\.[^.]+)*$", name)
                if m:
                    rows.append({"module": m[1], "part": m[2][0], "matrix": [list(r) for r in values.reshape(len(values), -1)]})
            out.append(rows)
        return pd.Series(out)

    flat = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.explode(parts("content")).alias("p")).select("file", "p.*")
    of = lambda part: F.max_by("matrix", F.when(F.col("part") == part, 1))
    wide = flat.groupBy("file", "module").agg(of("A").alias("a"), of("B").alias("b"), of("m").alias("magnitude"))
    return wide.where("a IS NOT NULL AND b IS NOT NULL")


def repository_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and bytes of the files that a repository tracks or would add, for the publishing guard."""
    listed = subprocess.run(["git", "ls-files", "-z", "--cached", "--others", "--exclude-standard"], cwd=folder, check=True, capture_output=True, timeout=60).stdout.decode()
    rows = [(p, os.path.getsize(os.path.join(folder, p))) for p in sorted(set(filter(None, listed.split("\0")))) if os.path.isfile(os.path.join(folder, p))]
    return spark.createDataFrame(rows, "path string, bytes long")


def save_verifier(center: DataFrame, threshold: DataFrame, path: str, meta: dict) -> None:
    """A centroid head and its settings: the vector as Parquet, and av_meta as one JSON line with the threshold."""
    center.select("dim", "value").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
    line = threshold.select("threshold").withColumn("meta", F.lit(json.dumps(meta, sort_keys=True)))
    line.coalesce(1).write.mode("overwrite").json(f"{path}/av_meta")


def load_verifier(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(centroid, threshold, settings) as saved."""
    line = spark.read.schema("threshold double, meta string").json(f"{path}/av_meta")
    return spark.read.parquet(f"{path}/head"), line.select("threshold"), json.loads(line.first()["meta"])


def save_run(folder: str, config, **more) -> None:
    """run_meta.json: the resolved configuration and what else is known of a run; an existing record stays."""
    from inkwell.sources.config import plain

    path = os.path.join(folder, "run_meta.json")
    os.makedirs(folder, exist_ok=True)
    if not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"config": plain(config), **more}, f, ensure_ascii=False, indent=1, default=str)


#: Folders of a workspace (fixed values).
WORKSPACE = ("data/raw/author", "data/raw/distractor", "data/interim", "data/processed", "runs")


def scaffold(folder: str, repository: str | None = None) -> list[str]:
    """Make the folders of a workspace; one inside the repository is refused, since private text would be tracked."""
    top = os.path.abspath(folder)
    if repository is not None and os.path.commonpath([top, os.path.abspath(repository)]) == os.path.abspath(repository):
        raise ValueError(f"{top} lies inside the repository")
    made = [os.path.join(top, name) for name in WORKSPACE]
    for name in made:
        os.makedirs(name, exist_ok=True)
    return made
