"""Commands over folders of JSON lines: ``python -m inkwell COMMAND ...``.

Exit codes: 0 done; 1 nothing ingested, a split that can't be used, a verifier that is too weak, or too few preference
pairs; 2 a missing adapter, a missing plug-in, or a report whose fluency or leakage gate failed.

Models stay outside: ``--plugin module:function`` names what trains (kind, arguments) or generates (a DataFrame of
pairs to pair_id, seq, prompt, completion). Generation without a plug-in is the offline stand-in.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import fixed as X
from inkwell.functions import text as T
from inkwell.operators import chunk, clean, entities, evaluation, extract, leakage, pairs, splits, stylometry, verifier
from inkwell.plans import report
from inkwell.session import build_session, settle
from inkwell.sources import config as C
from inkwell.sources import files

DOCS = "doc_id string, source string, origin string, register string, chars_raw int, text string, prompt string"
CHUNKS = "chunk_id string, doc_id string, source string, register string, chunk_index int, n_words long, text string, prompt string"
PAIRS = "pair_id string, chunk_id string, doc_id string, register string, prompt string, response string, n_words long, generator string"
GENERATED = "pair_id string, seq long, register string, prompt string, completion string"


@dataclass
class Data:
    chunk_min_words: int = X.CHUNK_MIN_WORDS
    chunk_max_words: int = X.CHUNK_MAX_WORDS
    questions_per_chunk: int = 2
    scrub_entities: bool = True
    never_scrub: list = field(default_factory=list)
    use_supplied_prompts: bool = True
    supplied_prompt_scope: str = "first_chunk"
    val_frac: float = X.VAL_FRACTION
    blind_frac: float = X.BLIND_FRACTION
    split_by: str = "doc"
    near_dup_threshold: float = X.NEAR_DUP_THRESHOLD
    seed: int = X.SEED


@dataclass
class Settings:
    data: Data = field(default_factory=Data)


def settings(path: str | None) -> Settings:
    return C.build(Settings, C.load_raw(path)) if path else Settings()


def say(title: str, value) -> None:
    """Print a result of a few rows, or a mapping, as JSON."""
    if isinstance(value, DataFrame):
        value = [r.asDict(recursive=True) for r in value.limit(100).collect()]
    print(json.dumps({title: value}, ensure_ascii=False, default=str))


def plugin(name: str | None) -> Callable | None:
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def ingest(spark: SparkSession, a) -> int:
    if a.kind == "local":
        kept, skipped = files.ingest(files.read_documents(spark, a.input), register=a.register, keep_templates=a.keep_templates)
    else:
        bodies = spark.read.schema("path string, source string, body string").json(a.input)
        scores = spark.read.schema("path string, paste_score double").json(a.scores) if a.scores and a.typed_only else None
        kept, skipped = files.ingest_hosted(bodies, scores, limit=a.limit, register=a.register)
    kept = settle(kept)
    say("skipped", skipped.orderBy("source").limit(X.REASONS))
    totals = files.word_totals(kept).first()
    if not totals["documents"]:
        print("no documents: there is nothing to go on with", file=sys.stderr)
        return 1
    files.write_jsonl(kept, a.out)
    say("corpus", totals.asDict() | {"small": totals["words"] < X.SMALL_CORPUS})
    return 0


def chunks(spark: SparkSession, a) -> int:
    own = settings(a.config).data
    done = settle(chunk.chunk_documents(files.read_jsonl(spark, a.input, DOCS), own.chunk_min_words, own.chunk_max_words))
    files.write_jsonl(done, a.out)
    say("health", chunk.chunk_health(done))
    return 0


def scrub(spark: SparkSession, a) -> int:
    own = settings(a.config).data
    terms = [t.strip() for t in (a.terms or "").split(",") if t.strip()]
    if a.terms_file:
        with open(a.terms_file, encoding="utf-8") as f:
            terms += [line.strip() for line in f if line.strip()]
    rows = files.read_jsonl(spark, a.input, CHUNKS)
    find = plugin(a.plugin)
    if find and own.scrub_entities and not a.no_entities:
        rows = entities.scrub_entities(rows, find(F.col("text")), own.never_scrub).drop("entities")
    kept, log = clean.scrub_records(rows, terms)
    kept, log = settle(kept), settle(log)
    files.write_jsonl(kept, a.out)
    files.write_jsonl(log, a.log)
    say("scrubbed", {"in": log.count(), "kept": kept.count(), "entities": bool(find)})
    say("removals", clean.removals_by_kind(log))
    return 0


def backtranslate(spark: SparkSession, a) -> int:
    own = settings(a.config).data
    rows = files.read_jsonl(spark, a.input, CHUNKS)
    done = files.read_jsonl(spark, a.out, PAIRS).select("chunk_id") if a.resume and os.path.exists(a.out) else None
    ask = plugin(a.plugin)
    made = settle(pairs.build_pairs(rows, a.n or own.questions_per_chunk, own.use_supplied_prompts, own.supplied_prompt_scope, pairs.asked(ask) if ask else None, a.plugin or "offline-template", done))
    stats = pairs.pair_stats(rows, made, done=done).first()
    (files.append_jsonl if done is not None else files.write_jsonl)(made, a.out)
    say("pairs", stats.asDict())
    return 0


def split(spark: SparkSession, a) -> int:
    own = settings(a.config).data
    rows = files.read_jsonl(spark, a.input, PAIRS)
    if own.split_by == "pair":
        done = splits.split_pairs_by_row(rows, "pair_id", own.val_frac, own.blind_frac, own.seed)
    else:
        whole = rows.groupBy("doc_id").agg(F.min_by("register", "pair_id").alias("register"), F.array_join(F.sort_array(F.collect_set("response")), "\n\n").alias("text"))
        parts = splits.split_documents(whole, "doc_id", "register", own.val_frac, own.blind_frac, own.seed, own.near_dup_threshold)
        done = rows.join(parts.select("doc_id", "split"), "doc_id")
    done = settle(done)
    say("splits", splits.split_summary(done, "doc_id").orderBy("split", "register"))
    overlap = splits.split_overlap(done, "doc_id")
    if own.split_by != "pair" and not overlap.isEmpty():
        say("documents in several splits", overlap)
        return 1
    files.write_splits(done, a.outdir)
    have = {r["split"] for r in done.select("split").distinct().collect()}  # three names
    if not {"val", "blind"} <= have:
        print("val or blind is empty: a register needs three documents to fill both", file=sys.stderr)
        return 1
    say("registers that a split lacks", splits.missing_registers(done))
    return 0


def _embedded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", extract.hashed_bag(F.col("text")))


def fit_av(spark: SparkSession, a) -> int:
    own = settings(a.config).data
    author = files.read_jsonl(spark, a.author, PAIRS).select(F.col("response").alias("text"), F.col("doc_id").alias("group"), F.col("pair_id").alias("seq"))
    other = files.distractors(spark, a.distractor, own.chunk_min_words, own.chunk_max_words, a.limit).select("text", F.col("doc_id").alias("group"), F.col("chunk_id").alias("seq"))
    rows = settle(verifier.held_out(_embedded(verifier.training_texts(author, other, a.balance)), "group", seed=own.seed))
    center = settle(verifier.centroid(rows.where("NOT test AND label = 1"), "v"))
    scored = settle(verifier.centroid_scores(rows, center, "seq", "v", "label", "test"))
    auc = verifier.roc_auc(scored.where("test")).first()["auc"]
    files.save_verifier(center, verifier.best_threshold(scored.where("test")), a.out, {"embedder": "hashed_bag", "head": "centroid", "auc": auc})
    say("verifier", {"auc": auc})
    return 0 if auc is not None and auc >= X.AUC_LOW else 1


def contamination(spark: SparkSession, a) -> int:
    schema = "ord long, text string, loss double, n_tokens long"
    found = evaluation.contamination(files.read_jsonl(spark, a.author, schema), files.read_jsonl(spark, a.distractor, schema)).first()
    os.makedirs(os.path.dirname(os.path.abspath(a.out)), exist_ok=True)
    with open(a.out, "w", encoding="utf-8") as f:
        json.dump(found.asDict(), f)
    say("contamination", found.asDict())
    return 0


def evaluate(spark: SparkSession, a) -> int:
    generated = settle(files.read_jsonl(spark, a.gen, GENERATED))
    reference = files.read_jsonl(spark, a.ref, PAIRS).withColumn("seq", F.monotonically_increasing_id())
    training = files.read_jsonl(spark, a.train, PAIRS).select(F.col("pair_id").alias("id"), F.col("response").alias("text"))
    texts = generated.select("pair_id", F.col("completion").alias("text"))
    sides = reference.select("pair_id", F.col("response").alias("text")).distinct().withColumn("corpus", F.lit("real")).unionByName(texts.withColumn("corpus", F.lit("generated")))
    gaps = settle(stylometry.corpus_distances(sides, "corpus", "real", "generated"))
    copied = leakage.verbatim_rate(texts, training, "pair_id", "id").first()
    out = {
        "run_name": a.run_name, "n_generations": generated.count(), "biggest_gaps": [(r["name"], r["value"]) for r in stylometry.biggest_gaps(gaps).collect()],
        "stylometry": {"overall": stylometry.overall(gaps).first()["overall"]}, "leakage": {"verdict": copied["verdict"], "rate": copied["rate"]},
        "samples": [r.asDict() for r in evaluation.samples(generated, reference).orderBy("i").collect()],
    }
    if a.av:
        center, threshold, meta = files.load_verifier(spark, a.av)
        scored = verifier.centroid_scores(_embedded(texts), center, "pair_id", "v")
        out["av"] = verifier.evaluate(scored, threshold).first().asDict() | {"auc": meta["auc"]}
    if a.fluency:
        with open(a.fluency, encoding="utf-8") as f:
            out["fluency"] = json.load(f)
    report.write(out, a.out)
    say("report", {k: v for k, v in out.items() if k != "samples"})
    vetoed = [k for k in ("fluency", "leakage") if str((out.get(k) or {}).get("verdict") or "").upper().startswith("FAIL")]
    return 2 if vetoed else 0


def generate(spark: SparkSession, a) -> int:
    if a.adapter and not os.path.exists(a.adapter):
        print(f"no adapter at {a.adapter}", file=sys.stderr)
        return 2
    rows = files.read_jsonl(spark, a.split_path, PAIRS)
    make = plugin(a.plugin)
    done = make(rows, a) if make else rows.select("pair_id", F.lit(0).cast("long").alias("seq"), "register", "prompt", pairs.genericised(F.col("response")).alias("completion"))
    say("generations", {"n": files.write_jsonl(done, a.out)})
    files.save_run(os.path.dirname(os.path.abspath(a.out)), settings(a.config), stage="generate" if a.adapter else "base-floor")
    return 0


def train(spark: SparkSession, a) -> int:
    if a.stage == "dpo" and not (a.adapter and os.path.exists(a.adapter)):
        print("dpo starts from an existing --adapter", file=sys.stderr)
        return 2
    make = plugin(a.plugin)
    if make is None:
        print("training needs a --plugin", file=sys.stderr)
        return 2
    files.save_run(a.out, settings(a.config), stage=a.stage, metrics=make(a.stage, a))
    return 0


def preferences(spark: SparkSession, a) -> int:
    if not os.path.exists(a.adapter):
        print(f"no adapter at {a.adapter}", file=sys.stderr)
        return 2
    refs = files.read_jsonl(spark, a.split_path, PAIRS)
    hinted = lambda rows: rows.withColumn("prompt", pairs.length_hint(F.col("prompt"), T.word_count(F.col("response"))))
    make = plugin(a.plugin) or (lambda rows, attempt: rows.select("pair_id", pairs.genericised(F.col("response")).alias("completion"), F.lit(0).alias("seq")))
    judged = settle(pairs.regenerate(refs, lambda rows, attempt: make(hinted(rows), attempt)))
    stats = pairs.preference_stats(judged).first()
    kept = judged.where("outcome = 'kept'").select("pair_id", "register", "prompt", F.col("response").alias("chosen"), F.col("completion").alias("rejected"))
    files.write_splits(pairs.preference_holdout(settle(kept), a.val_frac), a.out)
    say("preferences", stats.asDict())
    return 0 if stats["enough"] else 1


def steps(a) -> list[list[str]]:
    """The commands of a whole run, in order."""
    p = lambda *x: os.path.join(a.workspace, *x)
    with_config = ["--config", a.config] if a.config else []
    out = [
        ["ingest", "local", "--in", p("data/raw/author"), "--out", p("data/interim/docs")],
        ["chunk", "--in", p("data/interim/docs"), "--out", p("data/interim/chunks"), *with_config],
        ["scrub", "--in", p("data/interim/chunks"), "--out", p("data/interim/scrubbed"), "--log", p("data/interim/scrub_log"), *with_config],
        ["backtranslate", "--in", p("data/interim/scrubbed"), "--out", p("data/interim/pairs"), *with_config],
        ["split", "--in", p("data/interim/pairs"), "--outdir", p("data/processed"), *with_config],
        ["eval", "fit-av", "--author", p("data/processed/split=train"), "--distractor", p("data/raw/distractor"), "--out", p("runs/av"), *with_config],
        ["baseline", "--split-path", p("data/processed/split=blind"), "--out", p("runs/baseline/gen"), *with_config],
    ]
    judge = lambda run: ["eval", "run", "--gen", p("runs", run, "gen"), "--ref", p("data/processed/split=blind"), "--train", p("data/processed/split=train"), "--av", p("runs/av"), "--out", p("runs", run, "report.html"), "--run-name", run]
    plug = ["--plugin", a.plugin] if a.plugin else []
    out += [judge("baseline"), ["train", "sft", "--out", p("runs/stage_a"), *with_config, *plug]]
    out += [["generate", "--adapter", p("runs/stage_a"), "--split-path", p("data/processed/split=blind"), "--out", p("runs/stage_a/gen"), *with_config], judge("stage_a")]
    if a.with_dpo:
        out += [["dpo-pairs", "--adapter", p("runs/stage_a"), "--split-path", p("data/processed/split=val"), "--out", p("data/processed/dpo")]]
        out += [["train", "dpo", "--adapter", p("runs/stage_a"), "--out", p("runs/stage_b"), *with_config, *plug]]
        out += [["generate", "--adapter", p("runs/stage_b"), "--split-path", p("data/processed/split=blind"), "--out", p("runs/stage_b/gen"), *with_config], judge("stage_b")]
    return out


def pipeline(spark: SparkSession, a) -> int:
    for step in steps(a):
        print("+", *step)
        if not a.dry_run and (code := main(step, spark)):
            return code
    return 0


def demo(spark: SparkSession, a) -> int:
    """Ingest, chunk, scrub, pairs, split and a report over a folder of texts, with the offline stand-ins."""
    os.makedirs(a.outdir, exist_ok=True)
    p = lambda *x: os.path.join(a.outdir, *x)
    own = p("demo.json")
    with open(own, "w", encoding="utf-8") as f:
        json.dump({"data": {"chunk_min_words": 40, "chunk_max_words": 200, "val_frac": 0.2, "blind_frac": 0.2}}, f)
    for step in (
        ["ingest", "local", "--in", a.input, "--out", p("docs"), "--register", "informal"],
        ["chunk", "--in", p("docs"), "--out", p("chunks"), "--config", own],
        ["scrub", "--in", p("chunks"), "--out", p("scrubbed"), "--log", p("scrub_log"), "--config", own],
        ["backtranslate", "--in", p("scrubbed"), "--out", p("pairs"), "--config", own],
        ["split", "--in", p("pairs"), "--outdir", p("processed"), "--config", own],
        ["generate", "--split-path", p("processed", "split=blind"), "--out", p("run", "gen"), "--config", own],
    ):
        if code := main(step, spark):
            return code
    main(["eval", "run", "--gen", p("run", "gen"), "--ref", p("processed", "split=blind"), "--train", p("processed", "split=train"), "--out", p("report.html"), "--run-name", "demo"], spark)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkwell")
    sub = top.add_subparsers(required=True)

    def command(under, name: str, run: Callable, *options: str, **defaults):
        p = under.add_parser(name)
        p.set_defaults(run=run, config=None, plugin=None)
        for option in ("--config", "--plugin", *options):
            flag = option.rstrip("!")
            p.add_argument(flag, required=option.endswith("!"), **({"dest": "input"} if flag == "--in" else {}))
        p.set_defaults(**defaults)
        return p

    kinds = sub.add_parser("ingest").add_subparsers(required=True)
    local = command(kinds, "local", ingest, "--in!", "--out!", "--register", kind="local")
    local.add_argument("--keep-templates", action="store_true")
    hosted = command(kinds, "hosted", ingest, "--in!", "--out!", "--register", "--scores", kind="hosted")
    hosted.add_argument("--limit", type=int)
    hosted.add_argument("--allow-pasted", dest="typed_only", action="store_false")
    command(sub, "chunk", chunks, "--in!", "--out!")
    command(sub, "scrub", scrub, "--in!", "--out!", "--log!", "--terms", "--terms-file").add_argument("--no-entities", action="store_true")
    back = command(sub, "backtranslate", backtranslate, "--in!", "--out!")
    back.add_argument("-n", type=int)
    back.add_argument("--resume", action="store_true")
    command(sub, "split", split, "--in!", "--outdir!")
    judged = sub.add_parser("eval").add_subparsers(required=True)
    fit = command(judged, "fit-av", fit_av, "--author!", "--distractor!", "--out!")
    fit.add_argument("--limit", type=int)
    fit.add_argument("--no-balance", dest="balance", action="store_false")
    command(judged, "contamination", contamination, "--author!", "--distractor!", "--out!")
    command(judged, "run", evaluate, "--gen!", "--ref!", "--train!", "--out!", "--av", "--fluency", "--run-name", run_name="run")
    command(sub, "baseline", generate, "--split-path!", "--out!", adapter=None)
    command(sub, "generate", generate, "--split-path!", "--out!", "--adapter")
    command(sub, "train", train, "--out!", "--adapter").add_argument("stage", choices=["sft", "dpo"])
    command(sub, "dpo-pairs", preferences, "--adapter!", "--split-path!", "--out!").add_argument("--val-frac", type=float, default=0.15)
    whole = command(sub, "pipeline", pipeline, "--workspace!")
    whole.add_argument("--with-dpo", action="store_true")
    whole.add_argument("--dry-run", action="store_true")
    command(sub, "demo", demo, "--in!", "--outdir!")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(spark or build_session("inkwell"), a)
