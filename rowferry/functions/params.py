"""Named parameters ``{{name}}`` in SQL text, bound through ``spark.sql(..., args=...)``."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowferry.model import ParamDef

# One alternation, leftmost match first: comments and quoted text are consumed
# whole, so only a marker in plain code reaches the last branch.
_TOKEN = re.compile(
    r"(?P<comment>--[^\n]*|/\*.*?\*/)"
    r"|(?P<quoted>'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\")"
    r"|\{\{\s*(?P<name>[A-Za-z_]\w*)\s*\}\}",
    re.S,
)
_MARKER = re.compile(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}")

# Ends the bind name of a parameter that stands in a quoted string, where it is text whatever its type.
TEXT = "__text"

INPUT_TYPES = ("text", "number", "date", "datetime", "select")


def scan_params(template: str) -> list[str]:
    """Unique parameter names in first-seen order; comments do not count."""
    names: dict[str, None] = {}
    for token in _TOKEN.finditer(template):
        if token["name"]:
            names[token["name"]] = None
        elif token["quoted"]:
            names.update(dict.fromkeys(_MARKER.findall(token["quoted"])))
    return list(names)


def normalise_params(template: str, defs: Sequence[ParamDef] = ()) -> list[ParamDef]:
    """Definitions for every parameter used, missing ones as required text, sorted by ``order``."""
    used = scan_params(template)
    for d in defs:
        if d.name not in used:
            raise ValueError(f"parameter {d.name} is defined but not used in the SQL")
        if d.input_type not in INPUT_TYPES:
            raise ValueError(f"parameter {d.name} has unknown input type {d.input_type}")
    known = {d.name: d for d in defs}
    full = [known.get(n) or ParamDef(n, required=True, order=i + 1) for i, n in enumerate(used)]
    return sorted(full, key=lambda d: d.order)


def resolve_values(defs: Sequence[ParamDef], runtime: Mapping[str, str] | None = None) -> dict[str, object]:
    """Run-time value, else the default, parsed by input type; errors name the parameter."""
    runtime = runtime or {}
    return {d.name: _parse(d, runtime.get(d.name) or d.default) for d in defs}


def _parse(d: ParamDef, text: str):
    if text == "":
        if d.required:
            raise ValueError(f"parameter {d.name} is required")
        return "" if d.input_type in ("text", "select") else None
    try:
        if d.input_type == "number":
            return int(text)
        if d.input_type == "date":
            return datetime.strptime(text, "%Y-%m-%d")
        if d.input_type == "datetime":
            return datetime.fromisoformat(text)
    except ValueError as error:
        raise ValueError(f"parameter {d.name}: {text!r} is not a {d.input_type}") from error
    if d.input_type == "select" and text not in [o.value for o in d.options]:
        raise ValueError(f"parameter {d.name}: {text!r} is not one of its options")
    return text


def bind_template(template: str, values: Mapping[str, object]) -> tuple[str, dict[str, object]]:
    """SQL with ``:name`` markers plus the arguments they bind.

    A parameter inside a quoted string cannot be a bind marker there, so the
    string becomes a ``concat`` of its pieces with the marker between them: no
    value is ever placed in the text of the query.
    """
    args: dict[str, object] = {}

    def fill(token: re.Match) -> str:
        if token["comment"]:
            return token[0]
        if token["quoted"]:
            quote, body = token[0][0], token[0][1:-1]
            pieces = _MARKER.split(body)
            if len(pieces) == 1:
                return token[0]
            parts = [f"{quote}{p}{quote}" for p in pieces[:1]]
            for name, after in zip(pieces[1::2], pieces[2::2]):
                args[name + TEXT] = _inline(_value(values, name))
                parts += [f":{name}{TEXT}", f"{quote}{after}{quote}"]
            return "concat(" + ", ".join(p for p in parts if p != quote * 2) + ")"
        args[token["name"]] = _argument(_value(values, token["name"]))
        return ":" + token["name"]

    return _TOKEN.sub(fill, template), args


def _value(values: Mapping[str, object], name: str):
    if name not in values:
        raise ValueError(f"no value for parameter {name}")
    return values[name]


def _inline(value) -> str:
    if isinstance(value, datetime):
        midnight = value.time() == datetime.min.time()
        return value.strftime("%Y-%m-%d" if midnight else "%Y-%m-%d %H:%M:%S")
    return "" if value is None else str(value)


def _argument(value):
    # A zone-free literal, so a naive date never shifts with the session zone.
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'") if isinstance(value, datetime) else value


def parameterised_query(
    spark: SparkSession,
    template: str,
    defs: Sequence[ParamDef] = (),
    runtime: Mapping[str, str] | None = None,
) -> DataFrame:
    """Run a template over the registered views; one trailing run of ``;`` is dropped."""
    text = template.strip().rstrip(";").strip()
    if not text:
        raise ValueError("SQL must not be empty")
    values = resolve_values(normalise_params(text, defs), runtime)
    sql, args = bind_template(text, values)
    return spark.sql(sql, args=args) if args else spark.sql(sql)
