"""Entity resolution: companies that share a key are one group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..stage import discard, handed_over, stored_bytes

#: A hot node's edges are joined in so many pieces.
PIECES = 8
#: Companies that list a host from which it is a directory, and companies that may share an address.
DIRECTORY, SHARED_ADDRESS = 21, 3


#: Nodes that a task holds before it sends what it has; bytes of edges up to which one task joins all that is left. Cost alone differs.
NODES, SMALL = 1 << 20, 16 << 20


class Forest:
    """Union-find with path halving; the smaller of two roots is the root of both."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        p = self.parent
        while (up := p.setdefault(x, x)) != x:
            p[x] = x = p[up]
        return x

    def link(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        """(a, b): each node that is no root with its root; nothing is held after it."""
        found = [(x, r) for x in self.parent if (r := self.find(x)) != x]
        self.parent = {}
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges (a, b) of a task, in place of them."""
    held = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.link(a, b)
        if len(held.parent) > NODES:
            yield held.edges()
    yield held.edges()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, b) of a task's (id, key): edges without a key, and for each key one of its ids in b."""
    held, first = Forest(), {}

    def sent() -> Iterator[pa.RecordBatch]:
        keys = pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.nulls(len(first), pa.int64()), pa.array(list(first.values()), pa.int64())], ["key", "a", "b"])
        edges = held.edges()
        first.clear()
        yield keys
        yield pa.RecordBatch.from_arrays([pa.nulls(len(edges), pa.string()), *edges.columns], ["key", "a", "b"])

    for batch in batches:
        for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.link(i, first.setdefault(key, i))
        if len(held.parent) + len(first) > NODES:
            yield from sent()
    yield from sent()


def _pointed(edges: DataFrame) -> DataFrame:
    """Each edge (a, b), a > b: the neighbours of a node point at the least of them all, and so do node and least at each other."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    spread = least.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    met = both.withColumn("piece", F.pmod(F.xxhash64("b"), F.lit(PIECES)).cast("int")).join(spread, ["a", "piece"])
    out = met.select(F.col("b").alias("x"), F.col("m").alias("y")).unionAll(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def linked(keys: DataFrame) -> DataFrame:
    """(id, root) for the ids of (id, key) that shared keys lead to a smaller id, the smallest.

    Each task joins what its own rows link, and sends a forest and one id a key: a key that is everywhere is sent once a task. The same again by key leaves
    forests of what is linked across tasks. Little of it is joined in one task; more by rounds in which neighbours point at their
    least node and tasks join what they have, until each node points at its root alone: rounds grow with the logarithm of the longest path."""
    sent = handed_over(keys.where("id IS NOT NULL AND key IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("key").cast("string").alias("key")).mapInArrow(_members, "key string, a long, b long"), "members")
    met = sent.where("key IS NOT NULL").select(F.col("b").alias("id"), "key").repartition("key").mapInArrow(_members, "key string, a long, b long")
    edges = handed_over(sent.where("key IS NULL").union(met.where("key IS NULL")).select("a", "b"), "edges")
    discard(sent)
    while stored_bytes(edges) > SMALL:
        before, edges = edges, handed_over(_pointed(edges).mapInArrow(_forest, "a long, b long"), "edges")
        discard(before)
        # done when each node has one edge, to a node that has none itself
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionAll(edges.select(F.col("b").alias("x"), F.lit(0).alias("up")))
        seen = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("down"))
        if seen.where("ups > 1 OR ups = 1 AND down = 0").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return edges.coalesce(1).mapInArrow(_forest, "a long, b long").select(F.col("a").alias("id"), F.col("b").alias("root"))


def components(keys: DataFrame) -> DataFrame:
    """(id, root) for every id of (id, key): the smallest id that shared keys lead to."""
    return keys.select("id").distinct().join(linked(keys), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def company_keys(companies: DataFrame) -> DataFrame:
    """(id, kind, key) of companies (id, siren, officers: array of structs, phones, websites, address): every key that could link them. A company is a
    holding by its own number, so that it joins what it manages."""
    who = companies.select("id", F.explode("officers").alias("o")).where(~F.coalesce(T.normalize(F.col("o.qualite")).contains("COMMISSAIRE AUX COMPTES"), F.lit(False)))
    person = who.where("o.type_dirigeant = 'personne physique'").select("id", F.lit("manager").alias("kind"), T.person_key(F.col("o.nom"), F.col("o.prenoms"), F.col("o.date_de_naissance")).alias("value"))
    entity = who.where("o.type_dirigeant = 'personne morale'").select("id", F.lit("holding").alias("kind"), T.entity_key(F.col("o.siren"), F.coalesce("o.denomination", F.lit(""))).alias("value"))
    own = companies.select("id", F.lit("holding").alias("kind"), F.col("siren").alias("value"))
    phone = companies.select("id", F.lit("phone").alias("kind"), F.explode("phones").alias("x")).select("id", "kind", T.phone_key(F.col("x")).alias("value"))
    site = companies.select("id", F.lit("website").alias("kind"), F.explode("websites").alias("x")).select("id", "kind", T.website_host(F.col("x")).alias("value"))
    place = companies.where("address <> ''").select("id", F.lit("address").alias("kind"), T.normalize(F.col("address")).alias("value"))
    every = own.unionByName(person).unionByName(entity).unionByName(phone).unionByName(site).unionByName(place)
    return every.where("value IS NOT NULL").select("id", "kind", F.concat_ws(":", "kind", "value").alias("key")).distinct()


def linking(keys: DataFrame, directory: int = DIRECTORY, shared_address: int = SHARED_ADDRESS) -> DataFrame:
    """Keys (id, kind, key) that link: two members at least; a website not of a directory; an address of few."""
    n = keys.groupBy("kind", "key").agg(F.count("*").alias("n"))
    most = F.when(F.col("kind") == "website", directory - 1).when(F.col("kind") == "address", shared_address).otherwise(1 << 30)
    return keys.join(n.where((F.col("n") >= 2) & (F.col("n") <= most)), ["kind", "key"])


def expanded(candidates: DataFrame, officers: DataFrame, known: DataFrame, prefixes: tuple[str, ...], calls: int) -> tuple[DataFrame, DataFrame]:
    """(found, stats) of one hop by manager: candidates (person, ord), of which the first `calls` are looked up among officers (id, person, naf, open); known
    ids aren't found again, nor are closed companies and those of other trades. stats: lookups, hits, skipped_naf, closed."""
    asked = candidates.orderBy("ord").limit(calls)
    met = officers.join(asked.select("person").distinct(), "person", "left_semi").join(known.select("id"), "id", "left_anti")
    one = met.groupBy("id").agg(F.min("person").alias("person"), F.first("naf").alias("naf"), F.first("open").alias("open"))
    fits: Column = F.lit(False)
    for p in prefixes:
        fits |= F.col("naf").startswith(p)
    judged = handed_over(one.withColumn("fits", F.coalesce(fits, F.lit(False))))
    counts = judged.agg(F.count_if(F.col("fits") & F.col("open")).alias("hits"), F.count_if(~F.col("fits")).alias("skipped_naf"), F.count_if(F.col("fits") & ~F.col("open")).alias("closed"))
    return judged.where("fits AND open").select("id", "person"), asked.agg(F.count("*").alias("lookups")).join(counts)


def with_roots(companies: DataFrame, keys: DataFrame) -> DataFrame:
    """Companies with the root of their group; one that shares no key is its own."""
    return companies.join(linked(keys), "id", "left").withColumn("root", F.coalesce("root", "id"))


def link_keys(keys: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Keys (id, key) that link: 2 members at least, no more than their kind's cap."""
    kind = F.split("key", ":")[0]
    n = keys.groupBy("key").agg(F.countDistinct("id").alias("n"))
    cap = F.coalesce(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[kind], F.lit(1 << 30))
    return keys.join(n.where((F.col("n") >= 2) & (F.col("n") <= cap)), "key")
