"""Loose search for persons: part of a name, and a range of birth months, over an inverted index of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..stage import handed_over

GRAM = 3
#: Spans of days: 1, 2, 4 and so on, each beginning at a multiple of its length.
LEVELS = 12
#: Names by months that every task may hold; trigrams are told by so many buckets before they are sent.
LOOKUPS, BUCKETS = 1 << 17, 1 << 16
SPAN, SEARCH = ["part", "level", "at"], ["part", "first", "last"]


def grams(name: Column) -> Column:
    """Distinct runs of GRAM characters; a shorter name is one."""
    n = F.greatest(F.length(name) - GRAM + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(name, i, F.lit(GRAM))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(BUCKETS))


def _shows(name: Column, part: Column, gram: Column) -> Column:
    """Of the trigrams of a name that hold a short part, whether this is the one by which the name is met: where the part first begins."""
    at = F.least(F.instr(name, part), F.greatest(F.length(name) - GRAM + 1, F.lit(1)))
    return (F.length(part) >= GRAM) | (gram == F.substring(name, at, F.lit(GRAM)))


def month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def _months(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(month(first), month(last))).alias("month")


def spans_of(day: Column) -> Column:
    """The spans that a day lies in, one of each level."""
    return F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright(F.unix_date(day), i).alias("at")) for i in range(LEVELS)))


def covering(first: Column, last: Column) -> Column:
    """Spans that together are the days from first to last, each day once: at most two of a level, and what is needed of the longest."""
    low, end = F.unix_date(first), F.unix_date(last) + 1
    at = [(F.shiftright(low + ((1 << i) - 1), i), F.shiftright(end, i)) for i in range(LEVELS)]

    def of_level(i: int) -> Column:
        (a, b), whole = at[i], F.sequence(at[i][0], at[i][1] - 1)
        if i + 1 < LEVELS:
            c, d = at[i + 1]
            ends = F.array_compact(F.array(F.when(a < c * 2, a), F.when(b > d * 2, b - 1)))
            whole = F.when(c < d, ends).otherwise(whole)
        return F.transform(F.when(a < b, whole).otherwise(F.array().cast("array<int>")), lambda n: F.struct(F.lit(i).alias("level"), n.alias("at")))

    return F.concat(*map(of_level, range(LEVELS)))


def search(persons: DataFrame, wanted: DataFrame, cap: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(hits, stats). persons: (id, name, born); wanted: (query, name, first, last: days between which the birth lies). A hit is a
    person whose name, without case and accents, holds the wanted one, and who was born within the range: (query, id, same: the names are equal). stats: (query,
    candidates, hits, same, truncated: more hits than `cap`, of which the first by id are kept), a row for each of wanted.

    Each wanted name is looked up by the rarest of its trigrams, together with each month of its ranges, so that a trigram that is in very many names is split by
    month of birth, and is chosen only where a name has none rarer. Names shorter than a trigram are compared with the trigrams they begin. Persons
    and wanted ones without a name or date have no hit. Trigrams are counted where names lie, before anything is sent.
    Up to LOOKUPS names by months go to where the persons are, and no trigram of a person is sent. Beyond that, a person is sent by trigrams that are
    looked up, and by few others (those of the same buckets).

    A wanted name meets a row once, however many ask for it and however often the row holds it; what has met is grouped by person only for persons of
    several rows. For each name and span of days it is told how many persons fit and which are the first `cap` of them; a search adds up the
    few spans that its range consists of, and its hits are never listed beyond `cap`. A person whose rows differ in what they tell is compared
    with each search of the name."""
    people = persons.select("id", T.normalize(F.col("name")).alias("name"), "born").where(F.col("name") != "").where(month(F.col("born")).isNotNull()).repartition("id").distinct()
    people = handed_over(people.withColumn("only", F.count("*").over(Window.partitionBy("id")) == 1), "persons")
    asked = handed_over(wanted.select("query", T.normalize(F.col("name")).alias("part"), "first", "last"), "asked")
    searches = asked.where("part <> '' AND first <= last").select(*SEARCH).distinct()
    index = people.select("*", month(F.col("born")).alias("month"), F.explode(grams(F.col("name"))).alias("gram"))
    sought = searches.select("part").distinct().select("part", F.explode(grams(F.col("part"))).alias("gram"))
    # trigrams that hold a short name's letters stand for it
    grams_wanted = sought.select("gram").distinct()
    full = F.length("gram") == GRAM
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    exact = grams_wanted.where(full).join(counts, "gram", "left").select("gram", F.col("gram").alias("found"), F.coalesce("n", F.lit(0)).alias("n"))
    short = grams_wanted.where(~full).join(counts.withColumnRenamed("gram", "found"), F.col("found").contains(F.col("gram"))).select("gram", "found", "n")
    by_part = Window.partitionBy("part").orderBy("n", "gram")
    rarest = sought.where(full).join(exact, "gram").withColumn("o", F.row_number().over(by_part)).where("o = 1").select("part", "found")
    every = rarest.union(sought.where(~full).join(short, "gram").select("part", "found"))
    months = searches.select("part", _months(F.col("first"), F.col("last"))).distinct().groupBy("part").agg(F.collect_list("month").alias("months"))
    lookups = handed_over(months.join(every, "part").select("part", F.col("found").alias("gram"), "months"), "lookups")
    few = (lookups.agg(F.sum(F.size("months"))).first()[0] or 0) <= LOOKUPS
    by_month = lookups.select("part", "gram", F.explode("months").alias("month"))
    if few:
        by_month = F.broadcast(by_month)
    else:
        sent = F.broadcast(lookups.select(_bucket(F.col("gram")).alias("bucket")).distinct())
        index = index.withColumn("bucket", _bucket(F.col("gram"))).join(sent, "bucket", "left_semi")
    met = index.join(by_month, ["gram", "month"]).where(_shows(F.col("name"), F.col("part"), F.col("gram")))
    met = handed_over(met.select("part", "id", "only", "born", F.col("name").contains(F.col("part")).alias("fits"), (F.col("name") == F.col("part")).alias("same")), "met")
    # persons of several rows, which may tell the same of a name
    held = met.where("NOT only").groupBy("part", "id").agg(F.collect_set(F.struct("born", "fits", "same")).alias("rows"))
    held = handed_over(held, "held")
    alone = met.where("only").drop("only").unionByName(held.where(F.size("rows") == 1).select("part", "id", F.col("rows")[0].alias("r")).select("part", "id", "r.*"))
    several = held.where(F.size("rows") > 1).select("part", "id", F.explode("rows").alias("r")).select("part", "id", "r.*").join(searches, "part")
    inside = F.col("fits") & F.col("born").between(F.col("first"), F.col("last"))
    near = month(F.col("born")).between(month(F.col("first")), month(F.col("last")))
    several = several.groupBy(*SEARCH, "id").agg(F.max(near).alias("near"), F.max(inside).alias("fits"), F.max(inside & F.col("same")).alias("same")).where("near")

    cover = searches.select(*SEARCH, F.explode(covering(F.col("first"), F.col("last"))).alias("s")).select(*SEARCH, "s.*")
    zero = F.lit(0).cast("long")
    by_day = alone.groupBy("part", "born").agg(F.count("*").alias("candidates"), F.count_if("fits").alias("hits"), F.count_if(F.col("fits") & F.col("same")).alias("same"))
    in_span = by_day.where("hits > 0").select("part", "hits", "same", F.explode(spans_of(F.col("born"))).alias("s")).select("part", "hits", "same", "s.*").groupBy(*SPAN).agg(F.sum("hits").alias("hits"), F.sum("same").alias("same"))
    sums = cover.join(in_span, SPAN).select(*SEARCH, zero.alias("candidates"), "hits", "same")
    in_month = by_day.groupBy("part", month(F.col("born")).alias("month")).agg(F.sum("candidates").alias("candidates"))
    looked_at = searches.select(*SEARCH, _months(F.col("first"), F.col("last"))).join(in_month, ["part", "month"]).select(*SEARCH, "candidates", zero.alias("hits"), zero.alias("same"))
    others = several.select(*SEARCH, F.lit(1).cast("long").alias("candidates"), F.col("fits").cast("long").alias("hits"), F.col("same").cast("long").alias("same"))
    stats = sums.unionAll(looked_at).unionAll(others).groupBy(*SEARCH).agg(*(F.sum(c).alias(c) for c in ("candidates", "hits", "same")))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "hits", "same")]
    stats = asked.join(stats, SEARCH, "left").select("query", *filled, (F.coalesce("hits", F.lit(0)) > cap).alias("truncated"))

    placed = alone.where("fits").select("part", "id", "same", F.explode(spans_of(F.col("born"))).alias("s")).select("part", "id", "same", "s.*")
    order = F.row_number().over(Window.partitionBy(*SPAN).orderBy("id"))
    first = placed.withColumn("o", order).where(F.col("o") <= cap).groupBy(*SPAN).agg(F.collect_list(F.struct("id", "same")).alias("some"))
    listed = cover.join(first, SPAN).select(*SEARCH, "some").unionAll(several.where("fits").select(*SEARCH, F.array(F.struct("id", "same")).alias("some")))
    kept = listed.groupBy(*SEARCH).agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, cap).alias("some"))
    hits = asked.distinct().join(kept, SEARCH).select("query", F.explode("some").alias("h")).select("query", "h.*")
    return hits, stats
