"""Which texts hold any of many terms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stage import handed_over

#: Bytes of terms that one automaton is built of; more terms are looked up in several passes.
AUTOMATON_BYTES = 8 << 20
_BUILT: dict = {}


def _automaton(key: str, terms: bytes):
    """Built once in a worker for each set of terms; the last one only is held."""
    import ahocorasick

    if key not in _BUILT:
        found = ahocorasick.Automaton()
        for i, t in enumerate(pa.ipc.open_stream(terms).read_all().column("term").to_pylist()):
            found.add_word(t, i)
        found.make_automaton()
        _BUILT.clear()
        _BUILT[key] = found
    return _BUILT[key]


def counted(texts: pa.Array, automaton) -> pa.Array:
    """How many distinct terms each text holds. One text at a time is a Python string, whatever the batch holds."""
    held = (len({i for _, i in automaton.iter(t.as_py())}) if len(automaton) else 0 for t in texts)
    return pa.array(held, pa.int32(), size=len(texts))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def scan(texts: DataFrame, text: Column, terms: DataFrame, term: Column, keep: list[str], most: int = AUTOMATON_BYTES) -> DataFrame:
    """(keep..., n_terms): rows of texts that hold a term as it stands, at any place, with how many distinct terms they hold. Null texts and null or empty
    terms hold and are nothing.

    Whole terms are dealt by hash over automata of `most` bytes each (one, if they are few), which go to the workers one after another; texts
    are scanned once an automaton, however many terms it has, and nothing is sent but how many of its terms a row holds. Rows that are equal in
    `keep` are one, which holds as many terms as the row of them that holds most."""
    spark = texts.sparkSession
    wanted = handed_over(terms.select(term.alias("term")).where("term IS NOT NULL AND term <> ''").distinct(), "terms")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    passes = -(-int(size) // most)
    names = list(keep)
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n_terms int"])
    rows = texts.select(*names, text.alias("_text")).where("_text IS NOT NULL")
    found = []
    for i in range(passes):
        some = wanted.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == i).toArrow()  # about `most` bytes
        held, key = spark.sparkContext.broadcast(_packed(some)), f"{wanted._stage}/{i}"

        def run(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, held.value)
            for batch in batches:
                n = counted(batch.column(len(names)), automaton)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], n], [*names, "n_terms"]).filter(pa.array([x.as_py() > 0 for x in n], pa.bool_()))

        found.append(rows.mapInArrow(run, schema))
    if not found:
        return rows.where("false").select(*names, F.lit(0).alias("n_terms"))
    out = found[0].withColumn("_pass", F.lit(0))
    for i, f in enumerate(found[1:], 1):
        out = out.unionAll(f.withColumn("_pass", F.lit(i)))
    each = out.groupBy(*names, "_pass").agg(F.max("n_terms").alias("n_terms"))
    return each.groupBy(*names).agg(F.sum("n_terms").cast("int").alias("n_terms"))
