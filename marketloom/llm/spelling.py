"""Spelling variants by a symmetric-delete join. DataFrame operations only.

Every word sends itself and each distinct word that one deletion makes of it, as 64-bit keys; words that share a key meet by an equi-join. A deletion
carries the run of equal letters it stands for, which says whether the two words can be one edit apart, and each pair that can is then verified
letter by letter. The near word of largest count is a word's form, if it is common enough; roots are found by pointer doubling.

A key is shared by no more words than its own length times the size of the alphabet, so no group is hot however common a word is: occurrences are counted
before the join, in each task first. Rows that meet carry ids and places, never the words, so a long word costs its length for each key, not its square.
A form is at least twice as common as its word, so chains of n steps need 2 ** n occurrences, and doubling ends after log2(n) rounds.

Handling: null and empty texts have no words. Rows without an id count as rows with an empty id; rows that repeat an id and a text count once each. Words
of one count are ordered by code points. An empty table gives an empty result. Columns beyond id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

#: The letters of a run, and how often a letter is dropped.
LETTERS = "A-Za-zÀ-ÿ"
DROP_ONE_IN = 97
SHORTEST, LEAST, TIMES = 5, 3, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def typed(run: Column, doc_id: Column) -> Column:
    """The run as it was typed: one of DROP_ONE_IN, by the checksum of document and run, lacks a letter."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DROP_ONE_IN == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of words of at least `shortest` letters that occur `least` times. Shorter runs aren't cut out: a deletion makes none longer."""
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    found = docs.select(own.alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    seen = found.select(typed(F.translate("run", UPPER, LOWER), F.col("id")).alias("word")).where(F.length("word") >= shortest)
    return seen.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def keys(table: DataFrame) -> DataFrame:
    """(key, wid, size, lo, hi) of (wid, word): the word itself with lo = hi = 0, and for each run of equal letters, at places lo to hi
    from 1, the word that lacks one of them."""
    size = F.length("word")
    starts = F.expr("filter(sequence(1, length(word)), i -> i = 1 OR substring(word, i, 1) <> substring(word, i - 1, 1))")
    cut = F.expr("transform(starts, (s, k) -> struct(xxhash64(concat(substring(word, 1, s - 1), substring(word, s + 1))) AS key, s AS lo, coalesce(get(starts, k + 1) - 1, length(word)) AS hi))")
    whole = F.array(F.struct(F.xxhash64("word").alias("key"), F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    sent = table.select("wid", "word", size.alias("size"), starts.alias("starts")).select("wid", "size", F.explode(F.concat(whole, cut)).alias("k"))
    return sent.select("k.key", "wid", "size", "k.lo", "k.hi")


def near(table: DataFrame) -> DataFrame:
    """(wid, other) of (wid, word): words that differ by exactly one inserted, deleted or replaced letter, each pair once. Two deletions
    make equal words of two that differ in one place only if they can be made at the same place."""
    sent = keys(table)
    a, b = sent.alias("a"), sent.alias("b")
    replaced = "a.lo > 0 AND b.lo > 0 AND a.size = b.size AND greatest(a.lo, b.lo) <= least(a.hi, b.hi)"
    inserted = "(a.lo = 0 AND b.lo > 0 AND b.size = a.size + 1) OR (b.lo = 0 AND a.lo > 0 AND a.size = b.size + 1)"
    met = a.join(b, F.expr(f"a.key = b.key AND a.wid < b.wid AND (({replaced}) OR {inserted})"))
    pairs = met.select(F.col("a.wid").alias("wid"), F.col("b.wid").alias("other"))
    one, two = table.select("wid", F.col("word").alias("w1")), table.select(F.col("wid").alias("other"), F.col("word").alias("w2"))
    return pairs.join(one, "wid").join(two, "other").where(F.levenshtein("w1", "w2", 1) == 1).select("wid", "other")


def roots(links: DataFrame) -> DataFrame:
    """(wid, root) of (wid, form): where a word's forms end, by pointer doubling."""
    at = materialize(links.select("wid", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        after = materialize(at.join(onward, "root", "left").select("wid", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        ended = after.where("moved").isEmpty()
        discard(at)
        at = after.select("wid", "root")
        at._stored_at = after._stored_at
        if ended:
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row a word: word, n, form (its commonest near word, of ties the first, if that is `times` as common), form_n, n_near and root."""
    # the ids must not change when a lost task runs again: they are written down
    table = materialize(words(docs, id_col, text_col, shortest, least).withColumn("wid", F.monotonically_increasing_id()), "words")
    pairs = materialize(near(table), "near")
    both = pairs.union(pairs.select("other", "wid"))
    known = table.select(F.col("wid").alias("other"), "word", "n")
    best = F.min(F.struct((-F.col("n")).alias("n"), "word", "other"))
    chosen = both.join(known, "other").groupBy("wid").agg(best.alias("best"), F.count("*").alias("n_near"))
    common = -F.col("best.n") >= times * F.col("n")
    given = [F.when(common, x).alias(c) for c, x in (("form", F.col("best.word")), ("form_n", -F.col("best.n")), ("form_wid", F.col("best.other")))]
    judged = materialize(table.join(chosen, "wid", "left").select("wid", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *given), "forms")
    discard(pairs)
    ends = roots(judged.where("form IS NOT NULL").select("wid", F.col("form_wid").alias("form")))
    named = ends.join(table.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root").select("wid", "root_word")
    return judged.join(named, "wid", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
