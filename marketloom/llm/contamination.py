"""Benchmark decontamination by a distributed positional inverted index. DataFrame operations only.

A window is 13 consecutive words of an item (all of a shorter one). Its terms are ordered from the rarest in the
training texts; postings (term, document, position) of each window's two rarest terms are stored, and their lists, shifted
by the terms' offsets in the window, are intersected: an equal start is a phrase candidate, which is then compared word
by word with the whole text, and a start up to `slop` words off is a proximity match.

Index and comparison fold A-Z alone: lower-casing by locale rules depends on the letters around (Greek sigma), so that a word by
itself and the same word in its text could differ.

Handling: null and empty texts have no words and no hit. Each row is judged by its own text: rows are told by id and a hash of the text, so those
that repeat an id, or have none, don't mix. A very long text is one document. Items with the same window are all named. Empty tables of
documents give an empty result, of items no hit. Columns beyond id and text are not read, whatever their names (`with_row` returns them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import id_in, id_out, input_bytes, materialize

WINDOW = 13
SLOP = 2
#: Bytes of the table itself, as stored, up to which it is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 16 << 20
_CUTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """Words, with their case. No letter's case makes it a delimiter, so positions hold for any folding."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _CUTS), "")


def fold(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def windows(items: DataFrame, size: int) -> DataFrame:
    """(w, words, items): each distinct window with the ids, as strings, of the items that have it."""
    table = items.select(F.col("item").cast("string").alias("item"), split_words(fold(F.col("text"))).alias("all")).where(F.size("all") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - size + 1)))
    cut = table.select("item", "all", starts.alias("at")).select("item", F.slice("all", F.col("at"), F.lit(size)).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.sha2(F.array_join("words", " "), 256).alias("w"), "words", "items")


def _hint(df: DataFrame) -> DataFrame:
    """df is a stored table, so its size is known."""
    return F.broadcast(df) if input_bytes(df) <= BROADCAST_BYTES else df


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.struct(id_in(docs, id_col).alias("id"), F.xxhash64(text_col).alias("tid"))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """(windows, matches): matches has (id, w, start, shift); shift 0: both rarest terms stand as in the window,
    else they are so many words nearer or further. Phrase matches are candidates still, for `contamination`."""
    table = docs.select(_key(docs, id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    found = materialize(windows(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), size), "windows")
    terms = found.select("w", F.posexplode("words").alias("offset", "word")).select("w", "offset", F.col("word").alias("term"))
    vocabulary = materialize(terms.select("term").distinct(), "terms")
    tokens = table.select("id", F.posexplode(split_words(fold(F.col("text")))).alias("pos", "term"))
    counts = tokens.select("term").join(_hint(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    ranked = terms.join(counts, "term", "left").groupBy("w").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))), 1, 2).alias("rare"))
    # the second of a one-word window is the first again
    rare = ranked.select("w", F.col("rare")[0].alias("first"), F.element_at("rare", -1).alias("second"), F.size("rare").alias("n_terms"))
    anchors = materialize(rare.where("first.n > 0").select("w", "first.term", "first.offset", F.col("second.term").alias("term2"), F.col("second.offset").alias("offset2"), "n_terms"), "anchors")
    wanted = materialize(anchors.select("term").union(anchors.select("term2")).distinct(), "wanted")
    postings = materialize(tokens.join(_hint(wanted), "term").select("term", "id", "pos"), "postings")
    shifts = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    first = postings.join(_hint(anchors), "term").select("id", "w", (F.col("pos") - F.col("offset")).alias("start"), "n_terms").distinct()
    first = first.select("id", "w", "start", "n_terms", shifts.alias("shift")).where("shift = 0 OR n_terms > 1").withColumn("start2", F.col("start") + F.col("shift"))
    second = postings.join(_hint(anchors).select("w", F.col("term2").alias("term"), "offset2"), "term").select("id", "w", (F.col("pos") - F.col("offset2")).alias("start2")).distinct()
    matches = first.join(second, ["id", "w", "start2"]).select("id", "w", "start", "shift")
    return found, materialize(matches, "matches")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, slop: int = SLOP, with_row: bool = False) -> DataFrame:
    """One row a row of docs: id, n_words, n_hit (words inside an occurrence of a window), items (ids as strings, sorted),
    n_items, n_near (proximity matches that are no phrase) and contaminated: a twentieth of the words or more is hit.
    with_row: `row` has the columns of docs."""
    found, matches = search(docs, items, id_col, text_col, item_col, item_text_col, size, slop)
    at = matches.where("shift = 0 AND start >= 0").join(found.select("w", "words"), "w").select("id", "w", "start", "words")
    near = matches.where("shift <> 0").groupBy("id").agg(F.count("*").alias("n_near"))
    candidates = at.groupBy("id").agg(F.collect_list(F.struct("start", "words", "w")).alias("at")).join(near, "id", "full")
    table = docs.select(_key(docs, id_col, text_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*docs.columns).alias("row")] if with_row else []))
    exact = F.expr(f"transform(array(array_remove(split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), r'{_CUTS}'), '')), a -> filter(at, c -> slice(a, c.start + 1, size(c.words)) = c.words))[0]")
    # what stands there word by word; one row of those that repeat id and text
    proved = table.select("id", "text").join(candidates.where("at IS NOT NULL").select("id", "at"), "id").dropDuplicates(["id"]).withColumn("exact", exact)
    hit = F.expr("aggregate(array_sort(array_distinct(transform(exact, c -> struct(c.start AS s, c.start + size(c.words) AS e)))), struct(0 AS seen, 0 AS n), (x, c) -> struct(greatest(x.seen, c.e) AS seen, x.n + greatest(0, c.e - greatest(x.seen, c.s)) AS n)).n")
    proved = materialize(proved.select("id", hit.cast("long").alias("n_hit"), F.array_distinct(F.transform("exact", lambda c: c["w"])).alias("ws")).where("n_hit > 0"), "proved")
    named = proved.select("id", F.explode("ws").alias("w")).join(found.select("w", F.explode("items").alias("item")), "w").groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = table.join(proved.select("id", "n_hit").join(named, "id").join(near, "id", "full"), "id", "left")
    both = both.withColumn("n_words", F.size(split_words(F.col("text"))).cast("long")).withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("id", F.col("id.id"))
    return both.select(
        id_out(docs, id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *(["row"] if with_row else []),
    )
