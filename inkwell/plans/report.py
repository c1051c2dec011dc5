"""Reports from small collected tables: SVG charts, an HTML page that needs no network, and markdown tables."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

PALETTE = ("#3b6ea5", "#c2703d", "#5f8f5a")


def number(x: Any, places: int = 4) -> str:
    """A cell: a dash for null, fixed places for floats, separators from ten thousand on."""
    if x is None:
        return "—"
    if isinstance(x, float):
        return f"{x:.{places}f}"
    return f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) and abs(x) >= 10_000 else str(x)


def duration(seconds: float) -> str:
    return f"{seconds / 3600:.1f} h" if seconds >= 3600 else f"{seconds / 60:.0f} min"


def size(n: float) -> str:
    """Bytes in the unit that keeps them under 1024."""
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def markdown(df: DataFrame, most: int = 500, places: int = 4) -> str:
    """A result of bounded size as a markdown table."""
    rows = df.limit(most).collect()
    out = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(out + ["| " + " | ".join(number(v, places) for v in r) + " |" for r in rows]) + "\n"


def bars(items: Sequence[tuple[str, float]], width: int = 640, top: float | None = None) -> str:
    """Horizontal bars as SVG."""
    most = top or max((v for _, v in items), default=1.0) or 1.0
    parts = []
    for i, (name, value) in enumerate(items):
        y, w = 22 * i, max(0.0, min(1.0, value / most)) * (width - 300)
        parts.append(f'<text x="212" y="{y + 15}" text-anchor="end">{html.escape(name)}</text><rect x="220" y="{y + 4}" width="{w:.1f}" height="14" fill="{PALETTE[0]}"/><text x="{226 + w:.1f}" y="{y + 15}">{number(float(value))}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{22 * len(items) + 4}" font-size="12">{"".join(parts)}</svg>'


def grouped_bars(names: Sequence[str], series: Sequence[tuple[str, Sequence[float]]], width: int = 640, height: int = 180) -> str:
    """Vertical bars of several series side by side, with a legend, as SVG."""
    most = max((v for _, vs in series for v in vs), default=1.0) or 1.0
    slot = width / max(1, len(names))
    bar = slot * 0.8 / max(1, len(series))
    parts = []
    for s, (label, values) in enumerate(series):
        colour = PALETTE[s % len(PALETTE)]
        parts.append(f'<rect x="{120 * s}" y="0" width="10" height="10" fill="{colour}"/><text x="{120 * s + 14}" y="10">{html.escape(label)}</text>')
        for i, v in enumerate(values):
            h = v / most * (height - 50)
            parts.append(f'<rect x="{slot * i + slot * 0.1 + bar * s:.1f}" y="{height - 20 - h:.1f}" width="{bar:.1f}" height="{h:.1f}" fill="{colour}"/>')
    parts += [f'<text x="{slot * (i + 0.5):.1f}" y="{height - 5}" text-anchor="middle">{html.escape(n)}</text>' for i, n in enumerate(names)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-size="11">{"".join(parts)}</svg>'


def scatter(points: Sequence[tuple[str, float, float]], x: str, y: str, width: int = 640, height: int = 320) -> str:
    """Labelled points as SVG: the frontier of two measures."""
    xs, ys = [p[1] for p in points] or [0.0], [p[2] for p in points] or [0.0]
    place = lambda v, lo, hi, a, b: a + (v - lo) / ((hi - lo) or 1.0) * (b - a)
    parts = [f'<text x="{width / 2}" y="{height - 4}" text-anchor="middle">{html.escape(x)}</text><text x="12" y="14">{html.escape(y)}</text>']
    for name, a, b in points:
        cx, cy = place(a, min(xs), max(xs), 40, width - 120), place(b, min(ys), max(ys), height - 40, 30)
        parts.append(f'<circle cx="{cx:.1f}" cy="{cy:.1f}" r="4" fill="{PALETTE[1]}"/><text x="{cx + 7:.1f}" y="{cy + 4:.1f}">{html.escape(name)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-size="11">{"".join(parts)}</svg>'


def trajectory_panel(steps: Sequence[tuple[int, float, float]], width: int = 640, height: int = 220) -> str:
    """Rate (upper line) and leak (lower line) of a run's checkpoints by step, as SVG."""
    ordered = sorted(steps)
    last = max((s for s, _, _ in ordered), default=1) or 1
    parts = []
    for place, colour in ((1, PALETTE[0]), (2, PALETTE[1])):
        points = " ".join(f"{40 + p[0] / last * (width - 80):.1f},{height - 30 - p[place] * (height - 60):.1f}" for p in ordered)
        parts.append(f'<polyline points="{points}" fill="none" stroke="{colour}" stroke-width="2"/>')
    parts += [f'<text x="{40 + s / last * (width - 80):.1f}" y="{height - 10}" text-anchor="middle">{s}</text>' for s, _, _ in ordered]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-size="11">{"".join(parts)}</svg>'


def frontier_page(points: DataFrame, steps: DataFrame) -> str:
    """One page: the frontier of rate and leak, the trajectory and the points as a table; both results are small."""
    rows = points.orderBy("series", "label").collect()
    path = [(r["step"], r["av"], r["leak"]) for r in steps.collect()]
    table = "".join(f"<tr><td>{html.escape(r['rel'])}</td><td>{html.escape(r['series'])}</td><td>{number(r['av'])}</td><td>{number(r['leak'])}</td></tr>" for r in rows)
    charts = scatter([(f"{r['series']} {r['label']}", r["leak"], r["av"]) for r in rows], "leak", "rate") + (trajectory_panel(path) if path else "")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>frontier</title></head><body>{charts}<table>{table}</table></body></html>'


def depth_bars(profile: DataFrame, width: int = 28) -> str:
    """A profile (layer, a column per kind) as text: a line per layer with a mark, the kind's first letter, for every
    ``width``-th part of the largest layer's sum, then the sum."""
    kinds = [c for c in profile.columns if c != "layer"]
    rows = {r["layer"]: [float(r[k] or 0) for k in kinds] for r in profile.collect()}  # one row per layer
    unit = max(map(sum, rows.values()), default=0.0) / width or 1.0
    lines = []
    for layer, values in sorted(rows.items()):
        marks = "".join(kind[0] * round(value / unit) for kind, value in zip(kinds, values) if value)
        lines.append(f"{layer:>4} | {marks.ljust(width)} | {number(sum(values), 3)}\n")
    return "".join(lines)


def instruments_page(agreement: dict[str, Any], rows: DataFrame, flagged: DataFrame) -> str:
    """Markdown: how far two instruments agree, their rates by run (run, first, second), and the runs to look at."""
    compared = rows.selectExpr("run", "first", "second", "first - second AS difference").orderBy("run")
    parts = ["# Two instruments\n", "".join(f"* {k}: {number(v)}\n" for k, v in agreement.items()), markdown(compared)]
    names = [r["run"] for r in flagged.orderBy("run").collect()]
    return "\n".join([*parts, *(["Runs on which they differ:\n", "".join(f"* {n}\n" for n in names)] if names else [])])


def record_tables(manifest: DataFrame, cells: DataFrame, own: DataFrame, public: DataFrame, private: DataFrame | None = None) -> str:
    """All tables over run records as one markdown page: sweep, loci, stages, control, models, noise floor, provenance."""
    from inkwell.operators import evaluation as E
    from inkwell.operators import records as R

    tables = {
        "Corpus size": R.sweep_table(manifest, own).orderBy("ord").drop("ord"),
        "Adaptation locus": R.locus_table(cells, own).orderBy("ord").drop("ord"),
        "Stages": R.stage_table(manifest, own).orderBy("ord", "stage").drop("ord"),
        "Contamination control": E.control_table(public, private).orderBy("measure"),
        "Base models": R.model_table(own).orderBy("model", "arm"),
        "Noise floor": R.noise_floor(own).orderBy("arm", "kind"),
        "Provenance": R.provenance(own).orderBy("phase"),
    }
    return "\n".join(f"## {name}\n\n{markdown(df)}" for name, df in tables.items())


def pill(verdict: str | None) -> str:
    colour = {"PASS": "#5f8f5a", "WARN": "#c29a3d"}.get((verdict or "").split(" ")[0].upper(), "#a33" if verdict else "#888")
    return f'<span style="background:{colour};color:#fff;padding:1px 8px;border-radius:8px">{html.escape(verdict or "not measured")}</span>'


#: Blocks of the page with a verdict, and their headings.
JUDGED = {"av": "Attribution", "leakage": "Leakage", "fluency": "Fluency", "contamination": "Contamination", "smoke": "Smoke test"}


def _rows(block: dict[str, Any], prefix: str = "") -> str:
    """Table rows of a mapping; nested mappings follow under their own name, lists are counted."""
    out = []
    for key, value in block.items():
        name = f"{prefix}{key}"
        if isinstance(value, dict):
            out.append(_rows(value, f"{name}: "))
        else:
            shown = f"{len(value)} listed" if isinstance(value, (list, tuple)) else number(value)
            out.append(f"<tr><td>{html.escape(name)}</td><td>{html.escape(shown)}</td></tr>")
    return "".join(out)


def headline(report: dict[str, Any]) -> list[tuple[str, Any]]:
    """What a reader looks for first, of what was measured."""
    paths = {"style distance": ("stylometry", "overall"), "attribution": ("av", "attribution_rate"), "held-out AUC": ("av_metrics", "auc"), "verbatim rate": ("leakage", "rate"), "perplexity change": ("fluency", "relative_regression"), "generations": ("n_generations",)}
    out = []
    for name, path in paths.items():
        value: Any = report
        for part in path:
            value = value.get(part) if isinstance(value, dict) else None
        if value is not None:
            out.append((name, value))
    return out


def render(report: dict[str, Any]) -> str:
    """One page from a report; blocks that weren't measured are left out, all text is escaped."""
    out = [f"<h1>{html.escape(str(report.get('run_name', 'run')))}</h1>"]
    about = [f"{k} {report[k]}" for k in ("model", "split", "generated_at") if report.get(k)]
    out.append(f"<p>{html.escape(', '.join(about))}</p><table>{_rows(dict(headline(report)))}</table>")
    if delta := report.get("baseline_delta"):
        out.append(f"<h2>Against the baseline</h2><p>Above zero is better.</p><table>{_rows(delta)}</table>")
    if gaps := report.get("biggest_gaps"):
        out.append("<h2>Biggest gaps</h2>" + bars([(str(n), float(v)) for n, v in gaps], top=1.0))
    if shape := report.get("sent_len_hist"):
        out.append("<h2>Sentence lengths</h2>" + grouped_bars(shape["buckets"], [(k, shape[k]) for k in ("real", "generated") if k in shape]))
    if groups := report.get("av_by_register"):
        out.append("<h2>Attribution by register</h2>" + bars([(str(k), float(v["attribution_rate"])) for k, v in groups.items()], top=1.0))
    for name, title in JUDGED.items():
        block = report.get(name)
        if isinstance(block, dict):
            out.append(f"<h2>{title} {pill(block.get('verdict'))}</h2><table>{_rows(block)}</table>")
    for sample in report.get("samples") or []:
        out.append("<hr>" + "".join(f"<h3>{html.escape(str(k))}</h3><p>{html.escape(str(v))}</p>" for k, v in sample.items()))
    if config := report.get("config"):
        out.append(f"<h2>Configuration</h2><pre>{html.escape(json.dumps(config, ensure_ascii=False, indent=1, default=str))}</pre>")
    return '<!doctype html><html><head><meta charset="utf-8"><title>report</title></head><body>' + "".join(out) + "</body></html>"


def write(report: dict[str, Any], path: str) -> None:
    """The page, and the report beside it as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(report))
    with open(path.rsplit(".", 1)[0] + ".json", "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=1)
