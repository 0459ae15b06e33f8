"""Stage tables, documents, ledgers and settings read from files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Which stage writes a table.
WRITTEN_BY = {"companies": "source", "market": "source", "signals": "research", "scored": "score", "funnel": "source"}


class MissingTable(FileNotFoundError):
    """A stage's table is not there yet."""


def stage_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise MissingTable(f"{path} is not there: run the stage `{WRITTEN_BY.get(name, name)}` first") from e


def json_documents(spark: SparkSession, folder: str, schema: str, status: str | None = None) -> DataFrame:
    """A row for each *.json document of a folder, with the file's name; only those of a status if one is given."""
    found = spark.read.schema(schema).option("multiLine", True).json(folder, pathGlobFilter="*.json").select("*", F.col("_metadata.file_name").alias("file"))
    return found if status is None else found.where(F.col("status") == status)


def json_rows(spark: SparkSession, folder: str, schema: str, status: str | None = None) -> DataFrame:
    """Rows of a folder's JSON files of one document a line; only those of a status if one is given. Files are split over tasks."""
    found = spark.read.schema(schema).json(folder, pathGlobFilter="*.json")
    return found if status is None else found.where(F.col("status") == status)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each line that isn't blank; none if the file isn't there."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def env_file(path: str, prefix: str = "", env: dict[str, str] | None = None) -> dict[str, str]:
    """Settings KEY=VALUE of a file put into the environment; what is set already wins. Lines without = and comments are left out."""
    env = os.environ if env is None else env
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, mark, value = line.partition("=")
                if mark and not line.lstrip().startswith("#") and key.strip().startswith(prefix):
                    found[key.strip()] = env.setdefault(key.strip(), value.strip().strip("\"'"))
    return found


def yaml_subset(text: str) -> dict:
    """Settings as nested maps, lists and scalars by indentation: block maps, block lists, flow lists, quoted and folded (>) scalars, comments.
    Anchors, tags and flow maps are not read."""
    rows = []
    for raw in text.splitlines():
        line = raw.rstrip()
        if line.strip() and not line.lstrip().startswith("#"):
            rows.append((len(line) - len(line.lstrip()), line.strip()))
    value, rest = _block(rows, 0, rows[0][0]) if rows else ({}, 0)
    if rows and rest < len(rows):
        raise ValueError(f"settings can't be read from: {rows[rest][1]}")
    return value


def _scalar(text: str):
    quote = text[:1] if text[:1] in "\"'" else ""
    if quote and text.endswith(quote) and len(text) > 1:
        return text[1:-1]
    text = text.split(" #")[0].strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"": None, "null": None, "~": None, "true": True, "false": False}.get(text, text)


def _block(rows: list[tuple[int, str]], i: int, depth: int):
    """(value, next row) of the block that begins at row i with this indentation."""
    out: dict | list = [] if rows[i][1].startswith("- ") or rows[i][1] == "-" else {}
    while i < len(rows) and rows[i][0] == depth:
        line = rows[i][1]
        if isinstance(out, list):
            item = line[1:].strip()
            head, mark, _ = item.partition(":")
            if mark and " " not in head and head[:1] not in "\"'[":
                inner = depth + len(line) - len(item)
                rows[i] = (inner, item)
                value, i = _block(rows, i, inner)
            else:
                value, i = _scalar(item), i + 1
            out.append(value)
            continue
        key, mark, value = line.partition(":")
        if not mark:
            raise ValueError(f"settings can't be read from: {line}")
        key, value, i = key.strip().strip("\"'"), value.strip(), i + 1
        if value.split(" #")[0].strip() in (">", "|", ">-", "|-"):
            taken = []
            while i < len(rows) and rows[i][0] > depth:
                taken.append(rows[i][1])
                i += 1
            out[key] = ("\n" if value[0] == "|" else " ").join(taken)
        elif not value and i < len(rows) and (rows[i][0] > depth or (rows[i][0] == depth and rows[i][1].startswith("- "))):
            out[key], i = _block(rows, i, rows[i][0])
        else:
            out[key] = _scalar(value)
    return out, i
