"""Answers against a schema: what is wrong with a JSON document, by path. JVM expressions over VARIANT."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each kind of single value looks like in the schema of a variant.
KINDS = {"integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE)$", "string": "^STRING$", "boolean": "^BOOLEAN$"}
NO_JSON, NULL, MISSING, EXTRA, RANGE, CHOICE = "no JSON", "null", "missing", "extra", "out of range", "not a choice"


@dataclass(frozen=True)
class Field:
    """kind: one of KINDS, object or array. fields: of an object, in which no others may be; those in `absent` may be missing. items: of an array. empty: null is
    allowed. low, high: of a number; choices: of a string."""

    kind: str
    fields: dict[str, Field] | None = None
    items: Field | None = None
    empty: bool = False
    absent: frozenset[str] = frozenset()
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


def _told(path: Column, what: str) -> Column:
    return F.array(F.concat_ws(": ", F.nullif(path, F.lit("")), F.lit(what)))


def _joined(path: Column, name: Column) -> Column:
    return F.concat_ws(".", F.nullif(path, F.lit("")), name)


def _none() -> Column:
    return F.array().cast("array<string>")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f names it: inlined, a nested value would be taken out of its parents again for every use at each level."""
    return F.transform(F.array(x), f)[0]


def problems(v: Column, spec: Field, path: Column | None = None) -> Column:
    """"path: what" for each fault of a variant, in the order of the schema; empty if it fits. A value of a wrong kind is told once, not searched."""
    return _once(v, lambda x: _problems(x, spec, F.lit("") if path is None else path))


def _problems(v: Column, spec: Field, path: Column) -> Column:
    wrong = _told(path, f"no {spec.kind}")
    if spec.kind == "object":  # nothing else is a map, and nothing but an array an array: their schema, which is that of all in them, need not be told
        inner = _once(F.try_variant_get(v, "$", "map<string,variant>"), lambda entries: F.when(entries.isNull(), wrong).otherwise(_of_object(entries, spec, path)))
    elif spec.kind == "array":
        inner = _once(F.try_variant_get(v, "$", "array<variant>"), lambda items: F.when(items.isNull(), wrong).otherwise(_of_array(items, spec, path)))
    else:
        inner = F.when(~F.schema_of_variant(v).rlike(KINDS[spec.kind]), wrong).otherwise(_of_value(v, spec, path))
    null = _none() if spec.empty else _told(path, NULL)
    return F.when(v.isNull(), _told(path, NO_JSON)).when(F.is_variant_null(v), null).otherwise(inner)


def _of_value(v: Column, spec: Field, path: Column) -> Column:
    if spec.kind in ("integer", "number") and (spec.low is not None or spec.high is not None):
        x = F.try_variant_get(v, "$", "double")
        fits = (x >= spec.low if spec.low is not None else F.lit(True)) & (x <= spec.high if spec.high is not None else F.lit(True))
        return F.when(~fits, _told(path, RANGE)).otherwise(_none())
    if spec.choices:
        return F.when(~F.try_variant_get(v, "$", "string").isin(*spec.choices), _told(path, CHOICE)).otherwise(_none())
    return _none()


def _of_array(items: Column, spec: Field, path: Column) -> Column:
    return F.flatten(F.transform(items, lambda x, i: _problems(x, spec.items, _joined(path, i.cast("string"))))) if spec.items else _none()


def _of_object(entries: Column, spec: Field, path: Column) -> Column:
    names, known = F.map_keys(entries), spec.fields or {}
    parts = []
    for name, field in known.items():
        at = _joined(path, F.lit(name))
        missing = _none() if name in spec.absent else _told(at, MISSING)
        parts.append(F.when(F.array_contains(names, name), problems(entries[name], field, at)).otherwise(missing))
    listed = F.array(*map(F.lit, known)).cast("array<string>")
    extra = F.transform(F.array_sort(F.array_except(names, listed)), lambda k: F.concat(_joined(path, k), F.lit(f": {EXTRA}")))
    return F.concat(*parts, extra) if parts else extra


def judged(answer: Column, spec: Field) -> Column:
    """Faults of a JSON text: see `problems`. What is no JSON, or null, is one fault."""
    return problems(F.try_parse_json(answer), spec)
