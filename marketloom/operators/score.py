"""The rubric: signals to score, tier, rank and queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.numbers import rounded, size_curve
from ..functions.text import fixed
from .rank import SMALL, numbered


def values(signals: DataFrame, market: DataFrame, grades: DataFrame, heads: DataFrame, cfg: Config) -> DataFrame:
    """Long values after regrades and the size curve: gid, name, signal, v. A missing value is 0."""
    size = F.when((F.col("signal") == cfg.segment.size_signal) & (F.col("value") == 1) & F.col("curve").isNotNull(), F.col("curve"))
    curve = market.join(heads, "gid", "left").select("gid", F.coalesce("headcount", "mid").alias("hc")).select("gid", size_curve(F.col("hc"), cfg.segment).alias("curve"))
    ok = signals.where("status = 'ok'").join(grades, ["gid", "signal"], "left").join(curve, "gid", "left")
    return ok.select("gid", "name", "signal", F.coalesce(size, "grade", "value", F.lit(0.0)).alias("v"))


def weighted(weights: dict[str, float]) -> Column:
    """1 + 9 x weighted mean, summed in config order."""
    total = None
    for s, w in weights.items():
        total = F.col(s) * w if total is None else total + F.col(s) * w
    return rounded(1 + 9 * total / F.lit(float(sum(weights.values()))), 2)


def tier(score: Column, cfg: Config) -> Column:
    return F.when(score >= cfg.tier_a, "A").when(score >= cfg.tier_b, "B").otherwise("C")


def wide(signals: DataFrame, market: DataFrame, grades: DataFrame, heads: DataFrame, cfg: Config) -> DataFrame:
    """A row a lead: its values by signal, evidence_backed and what the market says of it. Signals are gathered in one pass; the size curve, which is of
    the lead and not of the signal, is put in after it."""
    size = cfg.segment.size_signal
    given = F.coalesce("grade", "value", F.lit(0.0))
    full = F.col("value") == 1
    of = lambda s, v: F.max(F.when(F.col("signal") == s, v))
    gathered = [of(s.id, F.when(~F.coalesce(full, F.lit(False)), given) if s.id == size else given).alias(s.id) for s in cfg.signals]
    at_full = [of(size, F.when(full, given)).alias("at_full")] if size else []
    ok = signals.where("status = 'ok'").join(grades, ["gid", "signal"], "left")
    backed = F.count_if(F.col("found") & (F.col("n_evidence") > 0)).alias("evidence_backed")
    rows = ok.groupBy("gid").agg(F.max("name").alias("name"), *gathered, *at_full, backed)
    hc = F.coalesce("headcount", "mid")
    about = market.join(heads, "gid", "left").select(
        "gid", hc.alias("hc"), F.when(F.col("headcount").isNotNull(), "regrade").when(F.col("mid").isNotNull(), "registry").alias("hc_source"), size_curve(hc, cfg.segment).alias("curve"), "is_reference", "pre_score", "region"
    )
    out = rows.join(about, "gid")
    if size:
        out = out.withColumn(size, F.greatest(F.col(size), F.when(F.col("at_full").isNotNull(), F.coalesce("curve", "at_full"))))
    return out.fillna(0.0, [s.id for s in cfg.signals]).drop("curve", "at_full")


def with_score(rows: DataFrame, cfg: Config, weights: dict[str, float] | None = None) -> DataFrame:
    return rows.withColumn("score", weighted(weights or cfg.weights)).withColumn("tier", tier(F.col("score"), cfg))


def scored(signals: DataFrame, market: DataFrame, grades: DataFrame, heads: DataFrame, cfg: Config, weights: dict[str, float] | None = None) -> DataFrame:
    return with_score(wide(signals, market, grades, heads, cfg), cfg, weights)


def best_first(score: str = "score") -> list[Column]:
    return [F.desc(score), F.desc("evidence_backed"), F.asc("name"), F.asc("gid")]


def ranked(table: DataFrame, score: str = "score", names: tuple[str, str] = ("rank", "place"), small: int = SMALL) -> DataFrame:
    """rank over all, place among leads that are no reference. Any number of leads may tie in score and evidence: see `numbered`."""
    return numbered(table, best_first(score), {names[0]: None, names[1]: ~F.col("is_reference")}, small)


def queue(table: DataFrame, size: int) -> DataFrame:
    """The first `size` leads: a top-k, so that only they are sorted in one place."""
    return table.where("NOT is_reference").orderBy(*best_first()).limit(size)


#: Marks in a reason line.
WEAKEST, REFERENCE, STRONG = "weakest: ", "reference (calibration, not queued)", 0.75


def phrases(cfg: Config, said: Column | None = None) -> dict[str, Column]:
    """What is said of each signal: the recorded phrase (map by signal), for the size with the headcount before it, else the label."""
    out = {}
    for s in cfg.signals:
        text = F.lit("") if said is None else F.regexp_replace(F.trim(F.coalesce(said[s.id], F.lit(""))), r"\.+$", "")
        if s.id == cfg.segment.size_signal:
            about = F.concat(F.lit("~"), fixed(F.col("hc"), 0), F.lit(" staff"))
            both = F.when(text == "", about).otherwise(F.concat(about, F.lit(", "), text))
            text = F.when(F.col("hc").isNull() | F.lower(text).contains("staff"), text).otherwise(both)
        out[s.id] = F.coalesce(F.nullif(text, F.lit("")), F.lit(s.label.lower()))
    return out


def reason(cfg: Config, said: Column | None = None) -> Column:
    """Score and tier, the strong signals by weight, then the weakest."""
    order, text = sorted(cfg.signals, key=lambda s: -s.weight), phrases(cfg, said)
    strong = F.array_compact(F.array(*(F.when(F.col(s.id) >= STRONG, text[s.id]) for s in order)))
    weak = F.array_min(F.array(*(F.struct(F.col(s.id).alias("v"), F.lit(-float(s.weight)).alias("w"), F.lit(i).alias("i"), text[s.id].alias("t")) for i, s in enumerate(order))))
    head = F.concat(fixed(F.col("score"), 1), F.lit(" "), F.col("tier"))
    ends = F.array_compact(F.array(F.when(weak["v"] < STRONG, F.concat(F.lit(WEAKEST), weak["t"])), F.when(F.col("is_reference"), F.lit(REFERENCE))))
    return F.array_join(F.concat(F.array(head), strong, ends), " | ")
