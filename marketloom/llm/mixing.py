"""Mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source. The token budget runs down it by weight; what a node can't
supply (its tokens times `max_epochs`) goes to its siblings in proportion to their weights, and only what all
of them together can't supply goes to the siblings of an ancestor. A leaf with budget b and supply s gives all its
documents floor(b / s) times, and then a prefix of one more epoch, in an order seeded by epoch: the documents that fit, and the one that crosses
the budget if half of it or more fits. So a leaf takes its budget but for half a document, and what leaves take too much and too little
evens out.

Handling: null, empty and blank texts have no tokens and are never chosen. Null language or source is a node of its own. Rows that repeat an id and
its text stand at one place of a leaf's order, as do those without an id and with the same text, and are chosen together. A very long text is
one document. An empty table gives an empty result. Of the result's own columns `domain`, `n_tokens` and `epochs`, one whose name the
table has already gets underscores after it; the table's columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free_name, materialize

#: Weights by level; what is not named weighs 1 among its siblings.
WEIGHTS = {"domain": {"crawl": 1.0, "curated": 2.0}, "lang": {"en": 3.0, "de": 2.0, "fr": 2.0, "es": 2.0}, "source": {}}
DOMAIN = "CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END"
LEVELS = ("domain", "lang", "source")
BUCKET_DOCS = 4096


def n_tokens(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of the text; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def _poured(nodes: DataFrame, parent: list[str], total: Column) -> DataFrame:
    """Adds `budget`: total of each parent poured into its nodes by weight w, none over its capacity cap."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), *LEVELS[len(parent) - 1 : len(parent)])
    all_of = Window.partitionBy(*parent)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    found = nodes.withColumn("_total", total).withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("_rest", F.sum("w").over(after))
    # the fullest first: one is full if the rest, with it, would get no less than fills it
    found = found.withColumn("_full", F.col("cap") * F.col("_rest") <= (F.col("_total") - F.col("_used")) * F.col("w"))
    level = (F.col("_total") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0.0)).over(all_of)) / F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("w"))).over(all_of)
    return found.withColumn("_level", level).withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.col("_level") * F.col("w"))).drop("_total", "_used", "_rest", "_full", "_level")


def budgets(supply: DataFrame, total: float | None, fraction: float, weights: dict, max_epochs: int) -> DataFrame:
    """(domain, lang, source, docs, tokens, budget) from the same without budget. As many rows as there are leaves."""
    leaves = supply.where("tokens > 0").withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    nodes = None
    for i, name in enumerate(LEVELS):
        w = F.lit(1.0)
        for k, x in weights.get(name, {}).items():
            w = F.when(F.col(name) == k, float(x)).otherwise(w)
        own = leaves.groupBy(*LEVELS[: i + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).withColumn("w", w)
        if nodes is None:
            everything = leaves.agg(F.lit(total).cast("double").alias("_want") if total is not None else (F.sum("tokens") * F.lit(fraction)).alias("_want"))
            nodes = _poured(own.withColumn("_root", F.lit(0)).join(everything, F.lit(True)), ["_root"], F.col("_want")).drop("_want", "_root")
            continue
        above = nodes.select(*(F.col(c).alias(f"_{c}") for c in LEVELS[:i]), F.col("budget").alias("_above"))
        same = F.lit(True)
        for c in LEVELS[:i]:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        nodes = _poured(own.join(above, same), list(LEVELS[:i]), F.col("_above")).drop("_above", *(f"_{c}" for c in LEVELS[:i]))
    return nodes.drop("w", "cap")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", total: float | None = None, fraction: float = 0.8, max_epochs: int = 4,
    seed: int = 7, domain: str = DOMAIN, weights: dict | None = None,
) -> DataFrame:
    """The chosen rows of docs, with domain, n_tokens and `epochs`, how often each is taken.

    total: tokens wanted; if None, `fraction` of all there are."""
    weights = WEIGHTS if weights is None else weights
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("tid")).alias("_id"), F.expr(domain).alias("domain"), "lang", "source", n_tokens(F.col(text_col)).alias("n_tokens")).where("n_tokens > 0")
    leaf = [F.col(c).alias(c) for c in LEVELS]
    slim = materialize(rows.select("_id", *leaf, "n_tokens"), "tokens")  # read three times
    found = budgets(slim.groupBy(*LEVELS).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), total, fraction, weights, max_epochs)
    plan = materialize(
        found.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), "docs", "tokens", "budget")
        .withColumn("full", F.floor(F.col("budget") / F.col("tokens"))).withColumn("left", F.floor(F.col("budget") - F.col("full") * F.col("tokens")))
        .withColumn("buckets", F.ceil(F.col("docs") / BUCKET_DOCS)).drop("docs", "tokens", "budget").coalesce(1), "plan",
    )
    same = F.lit(True)
    for c in LEVELS:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("full"), i["id"], i["tid"]), F.lit(1 << 40))
    bucket = (F.col("h") * F.col("buckets") / F.lit(1 << 40)).cast("long")
    # a leaf's prefix: whole buckets of the hash by their sums, then single documents in the bucket where it ends
    placed = slim.join(plan, same).withColumn("h", place(F.col("_id"))).withColumn("bucket", bucket)
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.max("left").alias("left"))
    along = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("until", F.sum("n").over(along)).where("until > left")
    ends = ends.groupBy(*(F.col(c).alias(f"e_{c}") for c in LEVELS)).agg(F.min("bucket").alias("end"), F.min(F.col("until") - F.col("n")).alias("before"))
    ended = F.lit(True)
    for c in LEVELS:
        ended &= F.col(c).eqNullSafe(F.col(f"e_{c}"))
    last = placed.join(ends, ended & (F.col("bucket") == F.col("end")))
    one = Window.partitionBy(*LEVELS).orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*LEVELS, "h")
    # half of what stands at the place, or more, fits: holds up to some place, and for none after it
    fits = last.withColumn("until", F.col("before") + F.sum("n_tokens").over(one)).withColumn("here", F.sum("n_tokens").over(own)).where("2 * until - here <= 2 * left")
    cut = fits.groupBy(*(F.col(c).alias(f"c_{c}") for c in LEVELS)).agg(F.max("h").alias("cut"))
    to_cut, to_end = F.lit(True), F.lit(True)
    for c in LEVELS:
        to_cut &= F.col(f"_{c}").eqNullSafe(F.col(f"c_{c}"))
        to_end &= F.col(f"_{c}").eqNullSafe(F.col(f"e_{c}"))
    cuts = materialize(plan.join(ends, to_end, "left").join(cut, to_cut, "left").drop(*(f"{a}_{c}" for a in "ec" for c in LEVELS)).coalesce(1), "cuts")
    taken = rows.join(cuts, same).withColumn("h", place(F.col("_id"))).withColumn("bucket", bucket)
    more = F.col("end").isNull() | (F.col("bucket") < F.col("end")) | ((F.col("bucket") == F.col("end")) & F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)))
    return taken.withColumn("epochs", F.col("full") + more.cast("long")).where("epochs > 0").select("row.*", *(F.col(c).alias(free_name(c, docs.columns)) for c in ("domain", "n_tokens", "epochs")))
