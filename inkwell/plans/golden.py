"""Published record figures, as small tables: the golden inputs of the record queries (fixed values)."""

from __future__ import annotations

#: arm, words, documents, few-shot rate, adapter rate, verbatim leak of the adapter
SWEEP = (
    ("2k", 3156, 2, 0.0040, 0.0000, 0.0),
    ("5k", 5909, 4, 0.0, 0.0000, 0.0),
    ("10k", 10226, 7, 0.0, 0.0040, 0.0),
    ("15k", 15905, 10, 0.0, 0.5238, 0.0),
    ("20k", 20257, 13, 0.0, 0.5675, 0.0),
    ("25k", 27729, 17, 0.0, 0.7183, 0.0),
    ("50k", 50020, 30, 0.0, 0.8254, 0.0),
    ("100k", 100411, 60, 0.0, 0.7976, 0.0),
    ("full", 178708, 105, 0.0040, 0.7897, 0.0),
)
#: arm, kind, seed, rate
SEEDS = (
    ("full", "stage_a", 0, 0.7897), ("full", "stage_a", 29, 0.7778), ("full", "stage_a", 43, 0.7897),
    ("2k", "stage_a", 0, 0.0), ("2k", "stage_a", 29, 0.0040), ("2k", "stage_a", 43, 0.0),
)
#: label, run, trainable parameters, rate, leak
LOCUS = (
    ("both", "sweep/full/stage_a", 30965760, 0.7897, 0.0),
    ("attention only", "matrix/rq2/a01_attention_only", 7538688, 0.8571, 0.0),
    ("q,k only", "matrix/rq2/a17_qk_only", 3769344, 0.8373, 0.0),
    ("v,o only", "matrix/rq2/a18_vo_only", 3769344, 0.7817, 0.0),
    ("MLP only", "matrix/rq2/a02_mlp_only", 23427072, 0.7937, 0.0),
    ("both, MLP r8", "matrix/rq2/a05_split_rank_low_mlp", 19685376, 0.8095, 0.0),
)


def values(rows: tuple) -> str:
    """Rows as a SQL VALUES list."""
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def records() -> list[tuple]:
    """rel, av, leak, flu_verdict, leak_verdict, trainable, wallclock, generated_at of all runs above."""
    out = [("floor", 0.0, 0.0, "PASS", "PASS", None, None, "2026-01-01T00:00:00")]
    for i, (arm, words, _, base, rate, leak) in enumerate(SWEEP):
        out.append((f"sweep/{arm}/baseline", base, 0.0, None, "PASS" if i % 2 else "FAIL: copies", None, None, f"2026-01-02T0{i}:00:00"))
        out.append((f"sweep/{arm}/stage_a", rate, leak, "PASS", "PASS", 30965760, words / 100, f"2026-01-03T0{i}:00:00"))
    out += [(f"sweep/{arm}/seed{seed}/{kind}", rate, 0.0, "PASS", "PASS", 30965760, 600.5, "2026-01-04T00:00:00") for arm, kind, seed, rate in SEEDS if seed]
    out += [(rel, rate, leak, "PASS", "PASS", n, 611.0, "2026-01-05T00:00:00") for _, rel, n, rate, leak in LOCUS if rel.startswith("matrix")]
    out += [("sweep/full/stage_b", 0.8452, 0.0, "PASS", "PASS", 30965760, 388.0, "2026-01-06T00:00:00")]
    out += [(f"matrix/models/small/{arm}/{kind}", rate, 0.01, "PASS", "PASS", None, 83.0, "2026-01-07T00:00:00") for arm, kind, rate in (("10k", "baseline", 0.1), ("10k", "stage_a", 0.3), ("full", "baseline", 0.2))]
    return out


RECORDS = "rel string, av double, leak double, flu_verdict string, leak_verdict string, trainable long, wallclock double, generated_at string"
