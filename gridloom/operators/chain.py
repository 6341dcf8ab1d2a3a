"""Operators by name with checked parameters, and chains of them as one lazy plan."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

OPERATORS: dict[str, Callable[..., DataFrame]] = {}
RANGES: dict[str, dict[str, tuple[float, float]]] = {}


def register(name: str, fn: Callable[..., DataFrame], **ranges: tuple[float, float]) -> None:
    """``fn(df, **params)``; ``ranges`` bounds numeric parameters."""
    if name in OPERATORS:
        raise ValueError(f"{name} is registered twice")
    OPERATORS[name], RANGES[name] = fn, ranges


def schema(name: str) -> dict[str, dict]:
    """Parameters of an operator: whether each is required, its default, its range."""
    params = list(inspect.signature(OPERATORS[name]).parameters.values())[1:]
    return {p.name: {"required": p.default is p.empty, "default": None if p.default is p.empty else p.default, "range": RANGES[name].get(p.name)} for p in params}


def apply(name: str, df: DataFrame, **params) -> DataFrame:
    known = schema(name)
    if extra := set(params) - set(known):
        raise ValueError(f"{name} has no parameter {sorted(extra)}")
    if missing := [k for k, s in known.items() if s["required"] and k not in params]:
        raise ValueError(f"{name} needs {missing}")
    for k, v in params.items():
        if (r := known[k]["range"]) and not r[0] <= v <= r[1]:
            raise ValueError(f"{name}: {k} must be within {r}")
    return OPERATORS[name](df, **params)


def chain(inputs: dict[str, DataFrame], steps: list[dict]) -> dict[str, DataFrame]:
    """Steps ``{id, operator, params}``; a parameter or the input may be ``$id.output`` of an earlier step."""
    out = dict(inputs)

    def value(v):
        if isinstance(v, str) and v.startswith("$") and v.endswith(".output"):
            return out[v[1:-7]]
        return v

    for s in steps:
        params = {k: value(v) for k, v in s.get("params", {}).items()}
        out[s["id"]] = apply(s["operator"], params.pop("input"), **params)
    return out
