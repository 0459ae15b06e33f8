"""Files that leave the engine: stage tables, documents, ledgers, spreadsheets and reports.

Tables are written by Spark. Documents for people are of a bounded size (a queue, a finding) and are written by the driver, row by row
as they come, so that no table is collected.
"""

from __future__ import annotations

import csv
import fcntl
import json
import os
import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame

BOM = "﻿"


def write_stage(df: DataFrame, folder: str, name: str) -> str:
    """A stage's table, in place of an earlier one."""
    path = f"{folder}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def _placed(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{os.getpid()}.{threading.get_ident()}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(part, path)


def replace_json(path: str, body: object) -> None:
    """The document stands whole or not at all."""
    _placed(path, json.dumps(body, ensure_ascii=False, indent=1))


def append_line(path: str, body: dict) -> None:
    """One JSON line at the end, by one writer at a time."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.write(json.dumps(body, ensure_ascii=False) + "\n")


def write_csv(df: DataFrame, path: str, columns: Iterable[str] | None = None) -> int:
    """UTF-8 with a byte order mark, every cell quoted, nulls empty; how many rows. Rows come in the table's order."""
    columns = list(columns or df.columns)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(BOM)
        out = csv.writer(f, quoting=csv.QUOTE_ALL)
        out.writerow(columns)
        for n, row in enumerate(df.select(*(f"`{c}`" for c in columns)).toLocalIterator(), 1):
            out.writerow("" if x is None else x for x in row)
    return n


def write_finding(folder: str, name: str, table: DataFrame, further: dict[str, DataFrame] | None = None, spec: dict | None = None) -> list[str]:
    """<name>.csv, <name>_<table>.csv for each further table, and <name>.vl.json for its chart."""
    made = []
    for at, df in {name: table, **{f"{name}_{k}": v for k, v in (further or {}).items()}}.items():
        made.append(f"{folder}/{at}.csv")
        write_csv(df, made[-1])
    if spec:
        made.append(f"{folder}/{name}.vl.json")
        replace_json(made[-1], spec)
    return made


def bar_spec(rows: DataFrame, x: str, y: str, title: str) -> dict:
    """A Vega-Lite bar chart of a small table, with the domain of its values from the data."""
    data = [r.asDict(recursive=True) for r in rows.toLocalIterator()]
    most = max([0, *(r[x] for r in data if r[x] is not None)])
    return {
        "$schema": "https://vega.github.io/schema/vega-lite/v5.json", "title": title, "data": {"values": data}, "mark": "bar",
        "encoding": {"x": {"field": x, "type": "quantitative", "scale": {"domain": [0, most]}}, "y": {"field": y, "type": "nominal", "sort": None}},
    }


def text_table(rows: Iterable[tuple[str, object]], width: int = 28) -> str:
    """Label and value a line; whole numbers with thousands marks."""
    return "\n".join(f"{label:<{width}}{value:>12,}" if isinstance(value, int) else f"{label:<{width}}{value:>12}" for label, value in rows)


def pct(x: float) -> str:
    return f"{100 * x:.0f}%"


def score_report(scored: DataFrame, queue: DataFrame, size: int, tied: int) -> str:
    """Tiers, distinct scores and the queue's lines. `queue`: queue_rank, rank, name, reason_en in order."""
    tiers = {r.tier: r["count"] for r in scored.groupBy("tier").count().collect()}
    total, values = sum(tiers.values()), scored.select("score").distinct().count()
    lines = [f"Scored {total} groups: " + ", ".join(f"{tiers.get(t, 0)} {t}" for t in "ABC") + f"; {values} distinct scores", f"Queue: top {size}, references excluded; {tied} places decided by a tie-break", ""]
    lines += [f"{r.queue_rank or 'ref':>3} #{r.rank:<4}{r.name[:38]:<38}  {r.reason_en}" for r in queue.toLocalIterator()]
    return "\n".join(lines)
