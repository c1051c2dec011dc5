from __future__ import annotations

import io
import json
import zipfile
from dataclasses import dataclass, field

import pytest

from inkwell.plans import report
from inkwell.sources import config, files
from inkwell.streaming import incremental


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a long, b string")
    assert files.write_jsonl(df, str(tmp_path / "x")) == 2
    assert files.read_jsonl(spark, str(tmp_path / "x"), "a long, b string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": oops\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a long").collect()


def test_directory_ingest(spark, tmp_path):
    prose = "This is a sentence with quite a few words in it, and it ends here. " * 12
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text(f"---\nprompt: Why: really?\n---\n\n{prose}")
    (tmp_path / "b.txt").write_text("short")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{prose}</w:t></w:r></w:p></w:body></w:document>')
    kept, skipped = files.ingest(files.read_documents(spark, str(tmp_path)))
    rows = {r["source"]: r for r in kept.collect()}
    assert set(rows) == {"notes/a.md", "c.docx"}
    assert rows["notes/a.md"]["prompt"] == "Why: really?" and rows["notes/a.md"]["register"] == "informal"
    assert [r["source"] for r in skipped.collect()] == ["b.txt"]
    assert files.front_matter("---\nopen: yes\nno end") == ({}, "---\nopen: yes\nno end")


def test_blog_archive(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("blogs/1.male.25.x.y.xml", "<Blog><post>caf\xe9</post></Blog>".encode("latin-1"))
    (tmp_path / "blogs.zip").write_bytes(data.getvalue())
    assert files.read_blog_archives(spark, str(tmp_path / "blogs.zip")).first()["text"] == "<Blog><post>café</post></Blog>"


def test_records_and_runs(spark, tmp_path):
    run = tmp_path / "sweep" / "full"
    run.mkdir(parents=True)
    (run / "report.json").write_text(json.dumps({"run_name": "x", "av": {"attribution_rate": 0.5}, "leakage": {"verbatim": {"rate": 0.1}}}))
    got = files.read_records(spark, str(tmp_path)).first()
    assert (got["rel"], got["av"], got["leak"], got["flu"]) == ("sweep/full", 0.5, 0.1, None)
    paths = spark.createDataFrame([("a/gen.jsonl",), ("a/report.json",), ("b/gen.jsonl",), ("a/checkpoint-1/gen.jsonl",), ("a/checkpoint-1/report.json",)], "path string")
    assert [r["dir"] for r in files.complete_runs(paths).collect()] == ["a"]


@dataclass
class Inner:
    rate: float = 0.1
    steps: int = 5


@dataclass
class Outer:
    name: str = "x"
    inner: Inner = field(default_factory=Inner)


def test_config(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"name": "base", "inner": {"rate": 0.5}}))
    (tmp_path / "child.json").write_text(json.dumps({"_extends": "base.json", "inner": {"steps": 9}}))
    got = config.build(Outer, config.load_raw(str(tmp_path / "child.json")))
    assert got == Outer("base", Inner(0.5, 9)) and config.build(Outer, config.plain(got)) == got
    with pytest.raises(ValueError, match="unknown"):
        config.build(Outer, {"inner": {"nope": 1}})
    (tmp_path / "a.json").write_text('{"_extends": "b.json"}')
    (tmp_path / "b.json").write_text('{"_extends": "a.json"}')
    with pytest.raises(ValueError, match="circular"):
        config.load_raw(str(tmp_path / "a.json"))


def test_report_is_escaped_and_offline(tmp_path):
    page = report.render({"run_name": "<b>x</b>", "biggest_gaps": [["dist:openers", 0.4]], "leakage": {"verdict": "FAIL", "rate": 0.2}, "samples": [{"model": "<script>1</script>"}]})
    assert "<script>" not in page and "<b>x" not in page and "http://" not in page.replace("http://www.w3.org/2000/svg", "")
    assert report.number(None) == "—" and report.number(12345) == "12,345" and report.duration(7200) == "2.0 h"


def test_stream_is_resumed_and_units(spark, tmp_path):
    files.append_jsonl(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"), str(tmp_path / "in"))
    for attempt in range(2):
        stream = incremental.stream_jsonl(spark, str(tmp_path / "in"), "k string, v long")
        incremental.run_available(stream, lambda d: d.where("v > 1"), str(tmp_path / "out"), str(tmp_path / f"c{attempt}"), "k")
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b"]
    units = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b"])], "name string, requires array<string>")
    assert [r["name"] for r in incremental.pending_units(units, spark.createDataFrame([("a",)], "name string")).collect()] == ["b"]
