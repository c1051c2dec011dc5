"""Entities, evaluation joins, preference statistics, exact components, distributed orders and the command line."""

from __future__ import annotations

import json
import os
import random
import struct
import subprocess
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell import cli
from inkwell.functions import fixed as X
from inkwell.operators import chunk, entities, evaluation, extract, graph, leakage, ordered, pairs, records, splits, verifier
from inkwell.plans import golden, report
from inkwell.sources import files


def test_guard_and_splice(spark):
    cases = [("We met Ada Byron, twice", 7, 16, "PERSON", True), ("was Euler", 4, 9, "PERSON", False), ("use ANSYS now", 4, 9, "PERSON", False), ("wasn't", 3, 6, "GPE", False), ("Euler-Lagrange x", 0, 5, "ORG", False), ("the UW-Milwaukee one", 4, 16, "ORG", True)]
    cases += [("Kai's book", 0, 3, "PERSON", True), ("Kai Berg—the lead", 0, 8, "PERSON", True), ("xKai", 1, 4, "PERSON", False), ("Kai9", 0, 3, "PERSON", False), ("in May", 3, 6, "DATE", None)]
    df = spark.createDataFrame([(i, t, [(s, e, label)]) for i, (t, s, e, label, _) in enumerate(cases)], "id int, text string, spans array<struct<start:int,end:int,label:string>>")
    got = {r["id"]: r for r in entities.scrub_entities(df, F.col("spans")).collect()}
    for i, (t, s, e, label, go) in enumerate(cases):
        want = t[:s] + f"<{X.NER_PLACEHOLDERS[label]}>" + t[e:] if go else t
        assert got[i]["text"] == want and [x["replaced"] for x in got[i]["entities"]] == ([] if go is None else [go])
    plain = entities.scrub_entities(df, None)
    assert [r["text"] for r in plain.orderBy("id").collect()] == [c[0] for c in cases]
    many = spark.createDataFrame([("Ann Lee saw Bob Ray and Cy Young.",), (None,), ("",)], "text string")
    assert [r["text"] for r in entities.scrub_entities(many, entities.name_spans(F.col("text"))).collect()] == ["<PERSON> saw <PERSON> and <PERSON>.", None, ""]
    listed = entities.scrub_entities(many, entities.name_spans(F.col("text")), never=[" Bob Ray "]).first()
    assert listed["text"] == "<PERSON> saw Bob Ray and <PERSON>."


def test_tag_trigrams(spark):
    df = spark.createDataFrame([("The cat ran 3 times.",), ("two words",), ("",)], "text string")
    tags = ["FUNC", "WORD", "WORD", "NUM", "WORD", "SIGN"]
    want = Counter(" ".join(tags[i : i + 3]) for i in range(4))
    assert {r["trigram"]: r["n"] for r in entities.tag_trigrams(df, entities.coarse_tags(F.col("text"))).collect()} == want


def test_references_and_samples(spark):
    generated = [(f"p{i}", i, f"q{i}", "g" * (i + 1)) for i in range(8)]
    refs = [("p1", 0, "one"), ("p1", 1, "again"), ("x", 2, "two"), ("p6", 3, "r" * 2000)]
    g, r = spark.createDataFrame(generated, "pair_id string, seq int, prompt string, completion string"), spark.createDataFrame(refs, "pair_id string, seq int, response string")
    own = {"p1": "one", "p6": refs[3][2]}
    want = [own.get(p, refs[i % 4][2])[:1400] for i, (p, *_) in enumerate(generated)]
    got = evaluation.with_reference(g, r).orderBy("i").collect()
    assert [x["real"] for x in got] == want and [x["i"] for x in got] == list(range(8))
    assert [x["real"] for x in evaluation.samples(g, r).orderBy("i").collect()] == want[:6]


def test_contamination(spark):
    schema = "ord int, text string, loss double, n_tokens long"
    rows = [(i, "t" if i else " ", 1.0 + i, 10) for i in range(60)]
    got = evaluation.contamination(spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:6], schema)).first()
    assert got["n_author_texts"] == 48 and got["n_distractor_texts"] == 5
    assert got["ppl_author"] == pytest.approx(np.exp(np.mean([1.0 + i for i in range(1, 49)]))) and got["ppl_distractor"] == pytest.approx(np.exp(4.0), abs=1e-4)
    with pytest.raises(Exception, match="too few"):
        evaluation.contamination(spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:5], schema)).collect()


def test_controls_instruments_and_paths(spark):
    r = spark.createDataFrame(golden.records(), golden.RECORDS)
    m = spark.createDataFrame([(i, a, w, n) for i, (a, w, n, *_) in enumerate(golden.SWEEP)], "ord int, arm string, actual_words long, documents long")
    public = {x["measure"]: x["value"] for x in evaluation.control_side(r, m, 0.9).collect()}
    assert public == {"ratio": 0.9, "floor_av": 0.0, "fewshot_av": 0.004, "adapter_av": 0.7897, "leak": 0.0}
    assert {x["private"] for x in evaluation.control_table(evaluation.control_side(r, m, 0.9)).collect()} == {None}
    second = spark.createDataFrame([("floor", 0.5)], "run string, av_second double")
    assert evaluation.with_second_instrument(r, second).where("av2 IS NOT NULL").select("rel", "av2").collect() == [("floor", 0.5)]
    assert evaluation.distinct_aucs(spark.createDataFrame([(0.9,), (0.9,), (None,)], "auc double")).first()["moved"] is False
    points = {x["rel"]: (x["series"], x["label"]) for x in evaluation.frontier(r).collect()}
    assert points["floor"] == ("base floor", "base") and points["sweep/2k/baseline"] == ("few-shot", "2k") and points["matrix/rq2/a01_attention_only"] == ("stage A", "a01")
    assert "sweep/full/seed29/stage_a" not in points and not any(p.startswith("matrix/models") for p in points)
    steps = spark.createDataFrame([("matrix/trajectory/step-100/stage_a", 0.5, 0.0), ("matrix/trajectory/step-20", 0.1, 0.0), ("matrix/trajectory/step-x", 0.1, 0.0), ("a/step-3", 0.2, 0.0)], "rel string, av double, leak double")
    assert [x["step"] for x in evaluation.trajectory(steps).collect()] == [20, 100]
    assert [x["arm"] for x in evaluation.ordered_arms(r, m).orderBy("place").collect()] == [s[0] for s in golden.SWEEP]
    bare = r.withColumn("actual_words", F.length("rel"))
    assert evaluation.ordered_arms(bare).count() == len(golden.SWEEP)
    page = report.record_tables(m, spark.createDataFrame([(0, "sweep/full/stage_a", "both")], "ord int, rel string, label string"), r, evaluation.control_side(r, m, 0.9))
    assert page.count("## ") == 7 and "0.7897" in page
    html = report.frontier_page(evaluation.frontier(r), evaluation.trajectory(steps))
    assert "<polyline" in html and "few-shot" in html and "http://" not in html.replace("http://www.w3.org", "")


def test_other_pages(spark):
    norms = spark.createDataFrame([("layers.0.q_proj", "attention", "0", 1.0), ("layers.1.up_proj", "mlp", "1", 2.0)], "module string, kind string, layer string, update_norm double")
    lines = report.depth_bars(records.depth_profile(norms)).splitlines()
    assert lines[0].split() == ["0", "|", "a" * 14, "|", "1.000"] and lines[1].split() == ["1", "|", "m" * 28, "|", "2.000"]
    assert records.largest_updates(norms, 1).first()["module"] == "layers.1.up_proj"
    rows = spark.createDataFrame([("a", 0.5, 0.25)], "run string, first double, second double")
    page = report.instruments_page({"spearman": 0.5}, rows, rows)
    assert "| a | 0.5000 | 0.2500 | 0.2500 |" in page and page.count("* a") == 1


def test_report_has_every_measured_block():
    full = {
        "run_name": "r", "model": "m<", "n_generations": 3, "stylometry": {"overall": 0.25}, "baseline_delta": {"av": 0.1}, "biggest_gaps": [("dist:openers", 0.5)],
        "sent_len_hist": {"buckets": ["0-5", "5-10"], "real": [0.5, 0.5], "generated": [1.0, 0.0]}, "av": {"attribution_rate": 0.5, "verdict": "PASS"}, "av_by_register": {"formal": {"attribution_rate": 0.5}},
        "leakage": {"verdict": "FAIL: copies", "rate": 0.5, "verbatim": {"examples": ["a", "b"]}}, "fluency": {"verdict": "PASS", "relative_regression": 0.01}, "config": {"a": 1}, "samples": [{"prompt": "<p>", "real": "x"}],
    }
    page = report.render(full)
    for part in ("Against the baseline", "Biggest gaps", "Sentence lengths", "Attribution by register", "Leakage", "Fluency", "Configuration", "verbatim: examples", "2 listed", "&lt;p&gt;", "m&lt;"):
        assert part in page, part
    assert "Leakage" not in report.render({"run_name": "r"}) and dict(report.headline(full))["style distance"] == 0.25


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000)] + [(2000, 2000 + i) for i in range(1, 50)] + [(rng.randint(3000, 3100), rng.randint(3000, 3100)) for _ in range(60)]
    group = {}
    for u, v in edges:
        a, b = group.setdefault(u, {u}), group.setdefault(v, {v})
        if a is not b:
            a |= b
            for x in b:
                group[x] = a
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: min(own) for n, own in group.items()}


def test_components_of_edges_that_come_out_differently(spark):
    def turned(batches):
        import numpy

        rng = numpy.random.default_rng()
        for b in batches:
            flip = rng.random(len(b)) < 0.5
            yield b.assign(u=b["u"].where(~flip, b["v"]), v=b["v"].where(~flip, b["u"]))

    pairs_ = spark.range(0, 400, 2).selectExpr("id AS u", "id + 1 AS v")
    got = {r["node"]: r["component"] for r in graph.components(pairs_.mapInPandas(turned, "u long, v long")).collect()}
    assert got == {i: i - i % 2 for i in range(400)}


def test_running_sums_over_slices(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "who string, o int, x long")
    for within in ([], ["who"]):
        got = {r["o"]: r["s"] for r in ordered.running(df, ["o"], {"s": F.col("x")}, within).collect()}
        sums: Counter = Counter()
        want = {}
        for who, o, x in sorted(rows, key=lambda r: r[1]):
            sums[who if within else 0] += x
            want[o] = sums[who if within else 0]
        assert got == want
    assert ordered.numbered(df.limit(0), ["o"], "i").count() == 0


def test_split_guards(spark):
    rows = spark.createDataFrame([("d1", "train", "formal"), ("d1", "val", "formal"), ("d2", "train", "informal"), ("d3", "blind", "formal")], "doc_id string, split string, register string")
    assert [tuple(r) for r in splits.split_overlap(rows, "doc_id").collect()] == [("d1", ["train", "val"])]
    assert {tuple(r) for r in splits.missing_registers(rows).collect()} == {("val", "informal"), ("blind", "informal")}
    sweep = spark.createDataFrame([(10, "a", 1), (20, "b", 1), (30, "full", 1), (10, "a", 2), (30, "full", 2)], "target int, label string, doc_id int")
    assert [r["doc_id"] for r in splits.not_nested(sweep, "doc_id").collect()] == [2]


def test_preference_and_pair_statistics(spark):
    judged = spark.createDataFrame([("kept", 0.9, 0.1, 0), ("kept", 0.5, 0.49, 1), ("dropped_degenerate", None, None, 0), ("dropped_length", None, None, 2)], "outcome string, av_chosen double, av_rejected double, attempt int")
    assert tuple(pairs.preference_stats(judged, 0.05).first()) == (4, 1, 1, 1, 1, 3, False)
    assert tuple(pairs.preference_stats(judged).first())[3:5] == (0, 2)

    def client(text: str, register: str) -> str:
        if "bad" in text:
            raise RuntimeError("no answer")
        return f"1. What do you make of {text}?\n- too short"

    chunks = spark.createDataFrame([("c1", "d", "this one"), ("c2", "d", "bad one")], "chunk_id string, doc_id string, text string")
    made = pairs.build_pairs(chunks, questions=pairs.asked(client), generator="client")
    assert [(r["chunk_id"], r["prompt"]) for r in made.collect()] == [("c1", "What do you make of this one?")]
    assert pairs.pair_stats(chunks, made).first()["no_question"] == 1
    texts = spark.createDataFrame([("a", "train"), ("b", "val"), (" a ", "train")], "text string, split string")
    shot = pairs.fewshot_system(texts, "base").first()
    assert shot["exemplars"] == 1 and "<sample>\na\n</sample>" in shot["system"]
    schema = "text string, group string, seq int"
    author = spark.createDataFrame([(f"t{i % 7}", "g", i) for i in range(20)] + [(" ", "g", 99)], schema)
    other = spark.createDataFrame([(f"o{i}", "h", i) for i in range(9)], schema)
    assert Counter(r["label"] for r in verifier.training_texts(author, other).collect()) == {0: 7, 1: 7}
    with pytest.raises(ValueError, match="6 texts"):
        verifier.training_texts(author.limit(5), other)
    with pytest.raises(Exception, match="token budget"):
        pairs.check_budget(spark.createDataFrame([(5,)], "n int"), "n", 4).collect()


def test_scores_of_one_class(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert tuple(verifier.roc_auc(one).first()) == (None, 2, 0)
    assert verifier.best_threshold(one).count() == 1


def test_packing_follows_its_rules():
    words = lambda n, w="w": " ".join([w] * n)
    assert chunk.pack([words(3)], [[]], [False], 5, 10) == []  # a short text gives nothing
    assert chunk.pack([words(6), words(6)], [[], []], [False, False], 5, 10) == [words(6), words(6)]
    assert chunk.pack([words(6), words(6)], [[], []], [False, True], 5, 10) == [words(6) + "\n\n" + words(6)]  # goes on
    assert chunk.pack([words(10), words(2)], [[], []], [False, True], 5, 10) == [words(10) + "\n\n" + words(2)]  # a runt joins what is before
    giant = [words(6, "a"), words(6, "b"), words(2, "c")]
    assert chunk.pack([" ".join(giant)], [giant], [False], 5, 10) == [giant[0], " ".join(giant[1:])]
    assert chunk.pack([words(5), " ".join(giant), words(4)], [[], giant, []], [False] * 3, 5, 10) == [words(5), giant[0], " ".join(giant[1:]) + "\n\n" + words(4)]
    assert chunk.slices("abcd", [4, 4, 4, 4], [True, False, True, True], 4, 6) == ["ab", "c", "d"]


def test_hashed_bag(spark):
    got = spark.createDataFrame([("One two, one",), ("",)], "text string").select(extract.hashed_bag(F.col("text"), 8).alias("v")).collect()
    counts = Counter(zlib.crc32(w.encode()) % 8 for w in ("one", "two", "one"))
    norm = sum(n * n for n in counts.values()) ** 0.5
    assert got[0]["v"] == pytest.approx([counts.get(i, 0) / norm for i in range(8)]) and got[1]["v"] == [0.0] * 8


def test_echo_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(50, 4))
    vectors[3] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(50, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    cosine[:, 3] = -2
    want = {i: cosine[i].max() for i in range(0, 50, 7)}
    for size in (1 << 14, 3):
        monkeypatch.setattr(leakage, "ECHO_BLOCK", size)
        got = {r["k"]: r["echo"] for r in leakage.semantic_echo(df.where("k % 7 = 0"), df, "k", "v", among=True).collect()}
        assert got == pytest.approx(want)


def test_files_of_runs(spark, tmp_path):
    top = str(tmp_path)
    a, b = np.arange(6, dtype="<f4").reshape(2, 3), np.ones((3, 2), "<f4")
    header, blob = {}, b""
    for name, x in (("m.layers.0.q_proj.lora_A.weight", a), ("m.layers.0.q_proj.lora_B.weight", b), ("m.layers.1.q_proj.lora_A.weight", a)):
        header[name] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [len(blob), len(blob) + x.nbytes]}
        blob += x.tobytes()
    text = json.dumps(header).encode()
    with open(f"{top}/adapter.safetensors", "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text + blob)
    rows = files.read_adapters(spark, f"{top}/adapter.safetensors").collect()
    assert [(r["module"], r["a"], r["b"]) for r in rows] == [("m.layers.0.q_proj", a.tolist(), b.tolist())]
    center = spark.createDataFrame([(0, 0.5), (1, -0.5)], "dim int, value double")
    files.save_verifier(center, spark.createDataFrame([(0.25,)], "threshold double"), f"{top}/av", {"head": "centroid"})
    head, threshold, meta = files.load_verifier(spark, f"{top}/av")
    assert sorted(map(tuple, head.collect())) == [(0, 0.5), (1, -0.5)] and threshold.first()[0] == 0.25 and meta == {"head": "centroid"}
    files.save_run(f"{top}/run", cli.Settings(), stage="x")
    files.save_run(f"{top}/run", cli.Settings(), stage="y")
    with open(f"{top}/run/run_meta.json") as f:
        assert json.load(f)["stage"] == "x"
    assert all(os.path.isdir(p) for p in files.scaffold(f"{top}/space", repository=f"{top}/repo"))
    with pytest.raises(ValueError, match="inside"):
        files.scaffold(f"{top}/repo/space", repository=f"{top}/repo")
    os.makedirs(f"{top}/repo")
    subprocess.run(["git", "init", "-q", f"{top}/repo"], check=True, timeout=60)
    with open(f"{top}/repo/a.txt", "w") as f:
        f.write("abc")
    assert [tuple(r) for r in files.repository_files(spark, f"{top}/repo").collect()] == [("a.txt", 3)]
    files.write_file_per_row(spark.createDataFrame([("A Title!", "t1", 1), ("a title", "t2", 2)], "title string, text string, seq int"), f"{top}/corpus", "title", "seq")
    assert os.listdir(f"{top}/corpus/slug=a-title") and spark.read.text(f"{top}/corpus/slug=a-title").first()[0] == "t1"
    files.write_jsonl(spark.range(5), f"{top}/rows")
    assert sorted(r["id"] for r in files.iterate_jsonl(spark, f"{top}/rows", "id long")) == list(range(5))
    with open(f"{top}/one.json", "w") as f:
        f.write('{"ratio": 0.5,\n "more": 1}')
    assert files.read_object(spark, f"{top}/one.json", "ratio double, other string").first() == (0.5, None)
    body = json.dumps({"body": {"content": [{"paragraph": {"elements": [{"textRun": {"content": "This is a long line of plain prose that goes on and on. " * 12}}]}}]}})
    hosted = spark.createDataFrame([("a", "a", body), ("b", "b", body), ("c", "c", "{}")], "path string, source string, body string")
    kept, skipped = files.ingest_hosted(hosted, spark.createDataFrame([("a", -1.0), ("b", 0.9)], "path string, paste_score double"))
    assert [r["source"] for r in kept.collect()] == ["a"] and {r["source"]: r["reason"] for r in skipped.collect()} == {"b": "mostly pasted", "c": "empty after normalization"}


def test_command_line(spark, tmp_path, capsys):
    top = str(tmp_path)
    os.makedirs(f"{top}/raw")
    os.makedirs(f"{top}/none")
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "ru", "sol"]) for _ in range(rng.randint(1, 4)))
    for i in range(12):
        lines = [" ".join(" ".join(word() for _ in range(11)).capitalize() + "." for _ in range(9)) for _ in range(3)]
        with open(f"{top}/raw/{i:02d}.md", "w") as f:
            f.write("\n\n".join(lines))
    run = lambda *argv: cli.main(list(argv), spark)
    assert run("ingest", "local", "--in", f"{top}/none", "--out", f"{top}/nothing") == 1
    assert run("demo", "--in", f"{top}/raw", "--outdir", f"{top}/demo") == 0
    assert os.path.exists(f"{top}/demo/report.html") and os.path.exists(f"{top}/demo/report.json")
    assert run("backtranslate", "--in", f"{top}/demo/scrubbed", "--out", f"{top}/demo/pairs", "--resume") == 0
    assert '"resumed_skip"' in capsys.readouterr().out
    blind = f"{top}/demo/processed/split=blind"
    assert run("eval", "run", "--gen", f"{top}/demo/run/gen", "--ref", blind, "--train", blind, "--out", f"{top}/veto.html") == 2  # it copies its training text
    assert run("train", "dpo", "--out", f"{top}/b") == 2 and run("train", "sft", "--out", f"{top}/a") == 2
    assert run("generate", "--adapter", f"{top}/missing", "--split-path", blind, "--out", f"{top}/g") == 2
    assert run("dpo-pairs", "--adapter", f"{top}/raw", "--split-path", blind, "--out", f"{top}/dpo") == 1  # too few
    assert run("pipeline", "--workspace", f"{top}/w", "--with-dpo", "--dry-run") == 0
    out = capsys.readouterr().out
    assert out.count("+ eval run") == 3 and "+ train dpo" in out
    assert run("eval", "fit-av", "--author", f"{top}/demo/processed/split=train", "--distractor", f"{top}/raw", "--out", f"{top}/av") in (0, 1)
    assert os.path.exists(f"{top}/av/av_meta")
    rows = spark.createDataFrame([(i, "text", 1.0, 5) for i in range(6)], "ord long, text string, loss double, n_tokens long")
    rows.write.json(f"{top}/losses")
    assert run("eval", "contamination", "--author", f"{top}/losses", "--distractor", f"{top}/losses", "--out", f"{top}/c.json") == 0
    with open(f"{top}/c.json") as f:
        assert json.load(f)["familiarity_ratio"] == 1.0
