"""Run configuration: nested dataclasses from JSON or YAML files that may extend others."""

from __future__ import annotations

import dataclasses
import json
import os
from typing import Any, TypeVar

C = TypeVar("C")


def load_raw(path: str, above: tuple[str, ...] = ()) -> dict[str, Any]:
    """A file's mapping over that of the file its ``_extends`` names; a circle is an error."""
    full = os.path.abspath(path)
    if full in above:
        raise ValueError(f"circular _extends: {' -> '.join([*above, full])}")
    with open(full, encoding="utf-8") as f:
        text = f.read()
    own = _parse(text, full)
    parent = own.pop("_extends", None)
    if parent is None:
        return own
    return merged(load_raw(os.path.join(os.path.dirname(full), parent), (*above, full)), own)


def _parse(text: str, path: str) -> dict[str, Any]:
    if path.endswith(".json"):
        return json.loads(text) or {}
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{path}: PyYAML isn't installed; use JSON") from e
    return yaml.safe_load(text) or {}


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``over`` on ``base``, mapping by mapping; other values replace."""
    both = {k: merged(base[k], v) for k, v in over.items() if isinstance(v, dict) and isinstance(base.get(k), dict)}
    return {**base, **over, **both}


def build(kind: type[C], values: dict[str, Any], where: str = "") -> C:
    """A dataclass from a mapping; unknown keys are errors."""
    fields = {f.name: f for f in dataclasses.fields(kind)}  # type: ignore[arg-type]
    if unknown := set(values) - set(fields):
        raise ValueError(f"unknown keys {sorted(unknown)} in {where or kind.__name__}")
    out = {}
    for name, value in values.items():
        default = fields[name].default_factory if fields[name].default_factory is not dataclasses.MISSING else None
        nested = type(default()) if default else None
        out[name] = build(nested, value, f"{where}.{name}".strip(".")) if nested is not None and dataclasses.is_dataclass(nested) and isinstance(value, dict) else value
    return kind(**out)


def plain(config: Any) -> dict[str, Any]:
    """The mapping that builds an equal configuration."""
    return dataclasses.asdict(config)
