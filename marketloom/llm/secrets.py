"""Secret scans over an incremental ledger of blobs. DataFrame operations only.

Every version of every path is content-addressed by SHA-256. The ledger says which (blob, rule version) pairs have been
scanned and what was found in them; only pairs it doesn't have are scanned, each blob once however many paths have it, and
findings are joined back to all paths.

Handling: null texts are empty, and stay null when others are redacted. Rows that repeat an id, or have none, are versions of one path, each
found by its own content; rows that repeat both are scanned once and each get what was found. A very long text is one blob. Matches of one kind never overlap; those of two kinds are ordered by start and kind.
An empty table gives an empty result. Other columns are kept by `redacted`, whatever their names, and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import id_in, id_out, materialize, salted_join


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Kind: (pattern, group whose length counts, least length). The first three are fixed values; a match that is too short
#: is dropped, but still ends where it ends.
RULES = {
    "assign": (rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
    "github": ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": ("xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    "private_key": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
}
BASE = ("assign", "access", "hex")
RULE_VERSION = "1"
FINDING = "array<struct<start:long,ord:int,end:long,kind:string>>"


def _found(text: Column) -> Column:
    """For each kind: lengths of the text's parts between matches, of the matches, and of what counts in them."""
    kinds = []
    for i, (kind, (pattern, group, _)) in enumerate(RULES.items()):
        p = F.lit(pattern)
        lengths = lambda a: F.transform(a, F.length)
        whole = F.regexp_extract_all(text, p, F.lit(0))
        part = F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), lengths(F.split(text, pattern, -1)).alias("gaps"), lengths(whole).alias("sizes"), lengths(F.regexp_extract_all(text, p, F.lit(group))).alias("counts"))
        kinds.append(F.when(text.rlike(pattern), F.array(part)).otherwise(F.array().cast("array<struct<ord:int,kind:string,gaps:array<int>,sizes:array<int>,counts:array<int>>>")))
    return F.concat(*kinds)


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, findings) of (blob, text): spans in code points, end exclusive, by start and kind. Blobs without any give no row."""
    found = blobs.select("blob", F.explode(_found(F.coalesce("text", F.lit("")))).alias("f"))
    one = found.select("blob", "f.ord", "f.kind", F.posexplode(F.arrays_zip(F.slice("f.gaps", F.lit(1), F.size("f.sizes")).alias("gap"), F.col("f.sizes").alias("size"), F.col("f.counts").alias("count"))).alias("i", "m"))
    along = Window.partitionBy("blob", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = one.dropDuplicates(["blob", "ord", "i"]).withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(along).cast("long"))
    enough = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN m.count >= {n}" for k, (_, _, n) in RULES.items()) + " END")
    kept = spans.where(enough).select("blob", F.struct((F.col("end") - F.col("m.size")).cast("long").alias("start"), "ord", "end", "kind").alias("s"))
    return kept.groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("findings"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rule_version string, findings {FINDING}")


def update(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(paths, new): paths has (id, blob) of every version; new are the rows that the ledger lacked, a row for each pair that was scanned now
    (findings null if there are none): the old ledger stands as it is, and new is to be appended to it. Both are in the shared folder."""
    table = versions.select(id_in(versions, id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = materialize(table.select("id", "blob"), "paths")
    once = paths.groupBy("blob").agg(F.min("id").alias("id"))
    if ledger is not None:
        once = once.join(ledger.where(F.col("rule_version") == rule_version), "blob", "left_anti")
    new = materialize(once, "unseen")
    # rows that repeat id and blob are one: dealt as the join dealt them
    texts = table.join(new, ["id", "blob"], "left_semi").dropDuplicates(["id", "blob"]).select("blob", "text")
    scanned = new.join(scan(texts), "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), "findings")
    return paths, materialize(scanned, "ledger")


def grown(ledger: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if ledger is None else ledger.select("blob", "rule_version", "findings").unionByName(new)


def findings(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """(id, findings) of every version; an empty array where nothing is found."""
    paths, new = update(versions, ledger, id_col, text_col, rule_version)
    hits = grown(ledger, new).where((F.col("rule_version") == rule_version) & F.col("findings").isNotNull()).select("blob", "findings")
    joined = salted_join(paths, hits, "blob", "id", "left")
    return joined.select(id_out(versions, id_col), F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span, overlapping ones as one, put in place by the mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    size = F.length(text)

    def step(x: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= x["at"], F.concat(F.substring(text, x["at"].cast("int") + 1, (s["start"] - x["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(x["at"], s["end"]).alias("at"), F.concat(x["done"], piece).alias("done"))

    return F.aggregate(spans, start, step, lambda x: F.concat(x["done"], F.substring(text, x["at"].cast("int") + 1, size)))


def redacted(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """The same rows and columns; every span found is put in place by a mark. Null texts stay null."""
    _, new = update(versions, ledger, id_col, text_col, rule_version)
    hits = grown(ledger, new).where((F.col("rule_version") == rule_version) & F.col("findings").isNotNull()).select("blob", "findings")
    held = versions.select(F.struct(*versions.columns).alias("row"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("blob"), id_in(versions, id_col).alias("id"))
    joined = salted_join(held, hits, "blob", "id", "left")
    own = F.col("row")[text_col]
    text = F.when(F.col("findings").isNull(), own).otherwise(redact(own, F.col("findings")))
    return joined.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in versions.columns))
