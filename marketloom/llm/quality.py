"""Quality rules with adaptive thresholds.

Each metric of a document is judged against a fence of its own language and source,
`q75 + spread * (q75 - q25) + slack`. The quantiles come from a mergeable sketch: counts of
documents by logarithmic bucket (relative error ALPHA), which add up in any order to the same
thresholds. Each group's counts are joined by PRIOR documents' worth of its language's, and these by as many of the corpus's, so that a
group of few documents leans on its parents, and the more it has, the less, without a step at any size. Weights are whole numbers: any
order of summing gives the same fences.

Handling: null texts, empty ones and texts without words have n_words = 0 and fail. Null language or source is a group of its own. Each row,
with a repeated id or a null one too, is judged by its own text. A very long text is counted whole. An empty table gives an empty result.
Columns beyond id, text and groups are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import free_name, materialize
from .words import PRINTED, blocks, grams

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
ALPHA = 0.02
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: metric: (expression over the counts, spread, slack)
RULES = {
    "symbol_ratio": ("n_symbols / word_chars", 3.0, 0.05),
    "dup_line_ratio": ("n_dup_lines / n_lines", 3.0, 0.25),
    "repeat_ratio": ("n_repeat_words / n_words", 3.0, 0.1),
    "word_length": ("word_chars / n_words", 3.0, 3.0),
    "upper_ratio": ("n_upper / word_chars", 3.0, 0.25),
}
#: Documents of the parent that a group's sketch is given.
PRIOR = 50


def repeated_words(h: np.ndarray, k: int = 5) -> int:
    """Words of one text in windows of k that it has twice or more."""
    g = grams(h, k)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(g), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    steps = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier one, lines with a word)"""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines)), len(lines)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper and the columns of `keep`."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text"), PRINTED):
                h = b.hashes()
                n = np.diff(b.bounds)
                first_bytes = (b.data & 0xC0) != 0x80
                chars, symbols, upper = (np.concatenate(([0], np.cumsum(m)))[b.edges] for m in (first_bytes & PRINTED[b.data], SYMBOLS[b.data], (b.data >= 65) & (b.data <= 90)))
                dup = np.zeros(b.n, np.int64)
                lines = np.zeros(b.n, np.int64)
                words = np.zeros(b.n, np.int64)
                for i in range(b.n):
                    dup[i], lines[i] = repeated_lines(b.text(i))
                    words[i] = repeated_words(h[b.bounds[i] : b.bounds[i + 1]])
                part = batch.slice(b.first, b.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(x.astype(np.int64)) for x in (n, np.diff(chars), np.diff(symbols), dup, words, lines, np.diff(upper))), *(part.column(f"k{i}") for i in range(len(keep)))],
                    [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", *keep],
                )

    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"))
    return table.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, {longs}" + "".join(f", `{c}` {kinds[c]}" for c in keep))


def _metrics() -> list:
    return [F.expr(f"coalesce(try_divide({a.partition(' / ')[0]}, {a.partition(' / ')[2]}), 0D)").alias(m) for m, (a, _, _) in RULES.items()]


def sketch(counted: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Documents by group, metric and bucket: (lang, source, metric, bucket, n). Two sketches merge by adding n."""
    metrics = counted.where("n_words > 0").select(*(F.col(g).alias(a) for g, a in zip(groups, ("lang", "source"))), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), x.alias("x")) for m, x in zip(RULES, _metrics())))).alias("v"))
    bucket = F.expr(f"CASE WHEN v.x <= 1e-9D THEN -1000 ELSE cast(ceil(ln(v.x) / {float(np.log(GAMMA))!r}D) as int) END")
    return metrics.select("lang", "source", "v.metric", bucket.alias("bucket")).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def _below(own: DataFrame, by: list[str], above: DataFrame, prior: int) -> DataFrame:
    """(by, metric, bucket, w, total): counts (by, metric, bucket, n) with `prior` documents spread as in `above`, (by without the last,
    metric, bucket, w, total); all times the total of above, so that they stay whole."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    size = own.groupBy(*by, "metric").agg(F.sum("n").cast("decimal(38,0)").alias("size"))
    same = F.col("s.metric") == F.col("a.metric")
    for c in by[:-1]:
        same &= F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}"))
    every = size.alias("s").join(above.alias("a"), same).select(*(F.col(f"s.{c}").alias(c) for c in by), F.col("s.metric").alias("metric"), "size", "bucket", "w", "total").alias("e")
    met = (F.col("e.metric") == F.col("o.metric")) & (F.col("e.bucket") == F.col("o.bucket"))
    for c in by:
        met &= F.col(f"e.{c}").eqNullSafe(F.col(f"o.{c}"))
    joined = every.join(own.alias("o"), met, "left")
    return joined.select(*(F.col(f"e.{c}").alias(c) for c in by), F.col("e.metric").alias("metric"), F.col("e.bucket").alias("bucket"), (F.coalesce(whole("n"), F.lit(0)) * whole("total") + F.lit(prior) * whole("w")).cast("decimal(38,0)").alias("w"), ((whole("size") + F.lit(prior)) * whole("total")).cast("decimal(38,0)").alias("total"))


def fences(sketched: DataFrame, prior: int) -> DataFrame:
    """(lang, source, f_<metric>): the fence of each metric by group. A group has at most a few hundred buckets a metric, whatever the corpus's
    size."""
    count = lambda by: sketched.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    every = count([]).select("metric", "bucket", F.col("n").cast("decimal(38,0)").alias("w"), F.sum("n").over(Window.partitionBy("metric")).cast("decimal(38,0)").alias("total"))
    weighed = _below(count(["lang", "source"]), ["lang", "source"], _below(count(["lang"]), ["lang"], every, prior), prior)
    seen = F.sum("w").over(Window.partitionBy("lang", "source", "metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.expr(f"CASE WHEN bucket = -1000 THEN 0D ELSE 2 * pow({GAMMA!r}D, bucket) / ({GAMMA!r}D + 1) END")
    quantile = lambda quarters: F.min(F.when(F.lit(4) * F.col("seen") >= F.lit(quarters) * F.col("total"), middle))
    found = weighed.withColumn("seen", seen).groupBy("lang", "source", "metric").agg(quantile(1).alias("q25"), quantile(3).alias("q75"))
    fence = F.coalesce(*(F.when(F.col("metric") == m, F.col("q75") + spread * (F.col("q75") - F.col("q25")) + slack) for m, (_, spread, slack) in RULES.items()))
    return found.withColumn("fence", fence).groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"f_{m}") for m in RULES))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source"), min_words: int = 10, max_repeat_percent: int = 20, prior: int = PRIOR, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: its id, the counts, base_failed, kept and `failed`, the adaptive rules it fails; and the columns of `keep`."""
    counted = materialize(counts(docs, id_col, text_col, (*groups, *keep)), "quality")  # a few numbers a document, read twice
    sketched = materialize(sketch(counted, groups), "sketch")
    # one small table with a row for each group that occurs; of known size: Spark broadcasts it if it is small enough, and shuffles if not
    table = materialize(fences(sketched, prior).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(f"f_{m}" for m in RULES)).coalesce(1), "fences")
    metrics = counted.select("*", *_metrics())
    joined = metrics.join(table, F.col(groups[0]).eqNullSafe(F.col("g_lang")) & F.col(groups[1]).eqNullSafe(F.col("g_source")), "left")
    failed = F.array_compact(F.array(*(F.when(F.col(m) > F.col(f"f_{m}"), F.lit(m)) for m in RULES)))
    base = F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words")
    judged = joined.withColumn("failed", F.array_join(failed, ",")).withColumn("base_failed", base)
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed", *RULES, *keep)


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source"), **rules) -> DataFrame:
    """The rows of docs that are kept. Rows alike in id, text and groups are judged alike, so that these tell which rows pass."""
    tid = free_name("tid", docs.columns)
    table = docs.withColumn(tid, F.xxhash64(text_col))
    keys = (id_col, *groups, tid)
    # the groups' columns are the operator's own output, so they ride along by other names
    ride = {c: free_name(f"{c}_", docs.columns) for c in groups}
    judged = judge(table.withColumns({v: F.col(k) for k, v in ride.items()}), id_col, text_col, groups, keep=(*ride.values(), tid), **rules)
    kept = judged.where("kept").select(*(F.col(ride.get(c, c)).alias(f"k{i}") for i, c in enumerate(keys))).distinct()
    same = F.lit(True)
    for i, c in enumerate(keys):
        same &= table[c].eqNullSafe(kept[f"k{i}"])
    return table.join(kept, same, "left_semi").drop(tid)
