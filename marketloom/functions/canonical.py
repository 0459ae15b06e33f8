"""Canonical JSON of any column: one text for one value, and its hash as a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that JSON has short escapes for.
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quoted(text: Column) -> Column:
    """A JSON string; characters from U+0080 on stay as they are."""
    out = text
    for c, shown in SHORT.items():
        out = F.replace(out, F.lit(c), F.lit(shown))
    for i in range(32):
        if chr(i) not in SHORT:
            out = F.replace(out, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1F"\\]'), out).otherwise(text), F.lit('"'))


def number(x: Column, whole: bool) -> Column:
    """A double by the fewest digits that give it back (the least denormals may have one more): with a fraction from 0.0001 to below 10 ** 16, else with an exponent of two digits at least.
    whole: those without a fraction as whole numbers (below 2 ** 63), and not-a-number as null."""
    # 17 digits always give it back; fewer may
    forms = [F.format_string(f"%.{p}e", x) for p in (14, 15, 16)]
    form = F.when(forms[0].cast("double") == x, forms[0]).when(forms[1].cast("double") == x, forms[1]).otherwise(forms[2])
    digits = F.regexp_replace(F.regexp_replace(F.split(form, "e")[0], r"[-.]", ""), "0+$", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    e, n = F.split(form, "e")[1].cast("int"), F.length(digits)
    tail = F.substr(digits, F.lit(2))
    point = F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)).when(n <= e + 1, F.concat(F.rpad(digits, e + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
    power = F.concat(F.substring(digits, 1, 1), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    sign = F.when(form.startswith("-"), "-").otherwise("")
    shown = F.concat(sign, F.when(e.between(-4, 15), point).otherwise(power))
    endless = F.when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
    if whole:
        shown = F.when((x == F.rint(x)) & (F.abs(x) < 2.0**63), x.cast("long").cast("string")).otherwise(shown)
    return F.when(F.isnan(x), "null" if whole else "NaN").otherwise(F.coalesce(endless, shown))


def json(x: Column, kind: T.DataType, item: str = ",", pair: str = ":", whole: bool = False) -> Column:
    """The canonical JSON of a column of type `kind`: keys of structs and maps in order of their code points, null for null, marks between items and after keys as given.
    Dates, times, decimals and the like are their text. A map's null values are null; duplicate keys can't be."""
    below = lambda v, k: json(v, k, item, pair, whole)
    if isinstance(kind, T.StructType):
        parts = []
        for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name)):
            parts += [F.lit(item if i else ""), quoted(F.lit(f.name)), F.lit(pair), below(x.getField(f.name), f.dataType)]
        shown = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_keys(x)), lambda k: F.concat(quoted(k.cast("string")), F.lit(pair), below(x[k], kind.valueType)))
        shown = F.concat(F.lit("{"), F.array_join(entries, item), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: below(v, kind.elementType)), item), F.lit("]"))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        shown = x.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        shown = number(x.cast("double"), whole)
    else:
        shown = quoted(x.cast("string"))
    return F.when(x.isNull(), "null").otherwise(shown)


def request(fields: dict[str, tuple[Column, T.DataType]], item: str = ",", pair: str = ":", whole: bool = False) -> Column:
    """The canonical JSON of an object of these fields; one that is null is not in it."""
    parts = [F.when(x.isNotNull(), F.concat(quoted(F.lit(k)), F.lit(pair), json(x, kind, item, pair, whole))) for k, (x, kind) in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(item, *parts), F.lit("}"))


def answer_key(fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """SHA-256 of the canonical JSON of the fields that make an answer."""
    return F.sha2(request(fields), 256)


def url_key(url: Column, params: dict[str, tuple[Column, T.DataType]]) -> Column:
    """SHA-1 of a url and the JSON of its parameters."""
    return F.sha1(F.concat(url, F.lit("?"), request(params, ", ", ": ")))
