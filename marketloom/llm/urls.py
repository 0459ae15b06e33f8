"""URL filters: rules by host and path, and what redirects and canonical links say of the rest.

Urls that lead to one another, by canonical link, meta refresh or a given redirect, are one page.
A page without a rule of its own takes its aliases' verdict: allow if any of them has an allow rule, else
block if any has a block rule, else allow. A rule of its own always wins.

Handling: a null url, or one without ://, has an empty host and path, fits no rule, links nowhere and is allowed; null and empty html have no link. Each
row is judged by its own url, with a repeated id or a null one too. Very long urls and html are read whole. An empty table gives an empty
result. Columns beyond id, url and html are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import materialize, salted_join

#: Fixed values: (verdict, host and path). The list is a parameter that every task holds.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(table: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds `own` and `rule`: verdict and text of the longest rule that fits columns host and path (of equal ones the one that sorts last, allow
    last), or nulls. Rules are looked up by each ending of the host, so their number costs memory, not time."""
    by_host: dict[str, list[tuple[int, str, bool, str, str]]] = {}
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        by_host.setdefault(h, []).append((len(rule), rule, verdict == "allow", f"/{p}", verdict))
    for found in by_host.values():
        found.sort(reverse=True)
    held = table.sparkSession.sparkContext.broadcast(by_host)

    def longest(host: str, path: str) -> tuple[str | None, str | None]:
        best, at = None, 0
        while True:
            first = next((r for r in held.value.get(host[at:], ()) if path.startswith(r[3])), None)
            if first and (best is None or first > best):
                best = first
            at = host.find(".", at) + 1
            if not at:
                return (best[4], best[1]) if best else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [longest(h or "", p or "") for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], [*batch.schema.names, "own", "rule"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in table.dtypes)
    return table.mapInArrow(run, f"{kinds}, own string, rule string")


def without_dots(path: Column) -> Column:
    """A path from the root, with `.` and `..` segments resolved."""
    parts = F.split(path, "/")
    done = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array(F.lit("")),
        lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(x))),
    )
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike(r"(?s)^/(.*/)?\.\.?(/|$)"), F.array_join(F.concat(done, end), "/")).otherwise(path)


def node_of(url: Column) -> Column:
    """Url without fragment and dot segments, scheme and host lower-cased: what redirects and canonical links point at."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    rest = F.regexp_replace(F.substring(url, F.length(head) + 1, F.length(url)), r"(?s)#.*", "")
    path = F.when(head != "", without_dots(F.regexp_extract(rest, r"(?s)^([^?]*)", 1))).otherwise(F.regexp_extract(rest, r"(?s)^([^?]*)", 1))
    return F.concat(F.translate(head, UPPER, LOWER), path, F.regexp_extract(rest, r"(?s)^[^?]*(.*)", 1))


def resolved(base: Column, link: Column) -> Column:
    """An absolute url from a link found on the page `base`; null for a link to nowhere."""
    link = F.trim(F.regexp_replace(link, "&amp;", "&"))
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.isNull() | (link == ""), None).when(link.rlike(r"^[^/?#]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes that are one page by canonical link or meta refresh. Pages without such a tag, a url or html give none."""
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"), F.lit(1))
    canonical = F.transform(tags, lambda tag: F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    meta = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    some = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where(F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b") & F.col("url").contains("://"))
    links = some.select("url", F.explode(F.concat(canonical, meta)).alias("link"))
    return links.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("url"), F.col("link"))).alias("b")).where("a <> b")


def alias_verdicts(edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame | None:
    """(node, verdict) of every node whose component has a rule; None where there are no edges."""
    edges = materialize(edges.distinct(), "aliases")
    if edges.isEmpty():
        return None
    nodes = components(edges, "a", "b")
    ruled = with_rule(nodes.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
    # allow sorts before block: the minimum is the verdict
    by_component = ruled.groupBy("component").agg(F.min("own").alias("verdict")).where("verdict IS NOT NULL")
    return salted_join(nodes, by_component, "component", "node").select("node", "verdict")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str]] | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """One row a page: its id, host, path, rule, verdict and `via` (rule, alias or default). redirects: (a, b) urls."""
    rules = RULES if rules is None else rules
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a <> b"))
    url = F.col("url")
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    own = with_rule(own, rules)
    aliases = alias_verdicts(edges, rules)
    own = salted_join(own, aliases.withColumnRenamed("verdict", "alias"), "node", "id", "left") if aliases is not None else own.withColumn("alias", F.lit(None).cast("string"))
    return own.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own", "alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default").alias("via"),
    )
