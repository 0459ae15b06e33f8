"""License scans: exact set-similarity join of text blocks with license templates.

A block is a window of a text, wherever its lines end, of as many words as the template has over the threshold, that begins and ends with a
word of the template. Its containment is the share of the template's distinct words that it has; every block at or over the threshold is
found, by these filters, and told, the fullest first (of equal ones the first), unless it overlaps one told before it: twenty sentences in a row are
twenty blocks:

- global order: template words from the rarest to the most frequent in the whole corpus;
- prefix: a block that reaches the threshold has one of a template's first n - need + 1 words;
- length: it has `need` distinct words at least, and no more words than the template's number over the threshold, so that the words of a
  template scattered over a long line or paragraph are no match;
- position: from its first prefix word on, the template must still have `need` words left.

Handling: null texts are empty, and empty texts have no block. Each row is judged by its own text, with a repeated id or a null one too. A very
long text is one run of words like any other. Ties: see above. An empty table gives an empty result. Columns beyond id and text are not read,
whatever their names. Templates are a parameter of fixed, small size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import LETTERS, blocks

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Characteristic sentences of public licenses.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "dedicated to the public domain under cc0 1 0",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "proprietary": "all rights reserved no part of this publication may be reproduced",
}


def _words(text: str) -> tuple[list[str], np.ndarray]:
    block = next(blocks(pa.array([text], pa.large_string()), LETTERS, lower=True))
    return [bytes(block.data[a:b]).decode() for a, b in zip(block.starts, block.ends)], block.hashes()


def term_counts(docs: DataFrame, templates: dict[str, str]) -> dict[int, int]:
    """How often each template word (by hash) occurs in all texts. One row a template word and task at most."""
    known = np.unique(np.concatenate([_words(t)[1] for t in templates.values()]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for b in blocks(batch.column(0), LETTERS, lower=True):
                h = b.hashes()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").sum("n").collect()
    return {np.int64(r[0]).view(np.uint64).item(): r[1] for r in rows}


class _Template:
    def __init__(self, label: str, text: str, rank: dict[int, int], threshold: float):
        self.label = label
        terms = sorted(set(_words(text)[1].tolist()), key=lambda h: (rank.get(h, 0), h))
        self.need = max(1, math.ceil(threshold * len(terms) - 1e-9))
        self.terms = np.array(terms, np.uint64)
        self.size = math.floor(len(_words(text)[1]) / threshold + 1e-9)
        self.place = {h: i for i, h in enumerate(terms)}
        self.prefix = terms[: len(terms) - self.need + 1]

    def windows(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, last word, how many terms) of windows of a text that reach `need`."""
        at = np.flatnonzero(np.isin(h, self.terms))
        here, end = np.arange(len(at)), np.searchsorted(at, at + self.size)
        n = np.zeros(len(at), np.int64)
        for x in self.terms:
            own = np.flatnonzero(h[at] == x)
            n += np.searchsorted(own, end) > np.searchsorted(own, here)
        good = np.flatnonzero(n >= self.need)
        # the fullest first, of equal ones the first: those that overlap none before them
        taken = np.zeros(len(h), bool)
        found = []
        for i in good[np.lexsort((at[good], -n[good]))].tolist():
            seen: set[int] = set()
            for j in range(i, int(end[i])):  # it ends with the word that makes it full
                seen.add(h[at[j]])
                if len(seen) == n[i]:
                    break
            if not taken[at[i] : at[j] + 1].any():
                taken[at[i] : at[j] + 1] = True
                found.append((int(at[i]), int(at[j]), int(n[i])))
        yield from sorted(found)


def _by_row(row: np.ndarray, hits: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    some, begin = np.unique(row, return_index=True)
    return some.tolist(), np.split(hits, begin[1:])


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None, threshold: float = 0.9,
) -> DataFrame:
    """One row a document: its id, n_words, n_base, first_word, last_word, base_labels, labels, score and `blocks`, the
    array of (label, first word, last word, containment) of every block that meets the threshold."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    table = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    rank = term_counts(table, templates)
    made = [_Template(k, t, rank, threshold) for k, t in templates.items()]
    by_term: dict[int, list[int]] = {}
    for i, t in enumerate(made):
        for h in t.prefix:
            by_term.setdefault(h, []).append(i)
    seeds = np.array(sorted(by_term), np.uint64)
    terms = [(label, _words(p)[1]) for p, label in phrases.items()]

    def met(have: np.ndarray, found: set[int]) -> Iterator[_Template]:
        """Templates of which these words, with the prefix words among them, reach `need`."""
        candidates: dict[int, int] = {}
        for x in found:
            for i in by_term[x]:
                candidates[i] = min(candidates.get(i, 1 << 30), made[i].place[x])
        for i, place in candidates.items():
            t = made[i]
            if len(have) < t.need or len(t.terms) - place < t.need:
                continue
            if int(np.isin(t.terms[place:], have).sum()) >= t.need:
                yield t

    def found_blocks(b, h: np.ndarray) -> Iterator[tuple[int, str, int, int, float]]:
        """(row, label, first word, last word, containment), words counted from the row's first."""
        at = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
        hits = np.flatnonzero(seeds[at] == h)
        if not len(hits):
            return
        for row, own in zip(*_by_row(np.searchsorted(b.bounds, hits, "right") - 1, hits)):
            lo, hi = int(b.bounds[row]), int(b.bounds[row + 1])
            for t in met(np.unique(h[lo:hi]), set(h[own].tolist())):
                for x, y, m in t.windows(h[lo:hi]):
                    yield row, t.label, x, y, m / len(t.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), LETTERS, lower=True):
                h = b.hashes()
                base: dict[int, list[tuple[int, str]]] = {}
                for label, p in terms:
                    n = len(h) - len(p) + 1
                    if n <= 0:
                        continue
                    same = np.flatnonzero(h[:n] == p[0])
                    for j in range(1, len(p)):
                        same = same[h[same + j] == p[j]]
                    rows = np.searchsorted(b.bounds, same, "right") - 1
                    inside = same + len(p) <= b.bounds[rows + 1]
                    for row, x in zip(rows[inside].tolist(), (same - b.bounds[rows])[inside].tolist()):
                        base.setdefault(row, []).append((x, label))
                more: dict[int, list] = {}
                for row, *x in found_blocks(b, h):
                    more.setdefault(row, []).append(x)
                out = []
                for row in range(b.n):
                    places, lines = base.get(row, []), more.get(row, [])
                    own = {x[1] for x in places}
                    at = [x[0] for x in places]
                    out.append({
                        "n_words": int(b.bounds[row + 1] - b.bounds[row]), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None),
                        "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {x[0] for x in lines})),
                        "score": max([1.0 if own else 0.0, *(x[3] for x in lines)]),
                        "blocks": [{"label": x[0], "first": x[1], "last": x[2], "containment": x[3]} for x in lines],
                    })
                ids = batch.column(0).slice(b.first, b.n)
                rest = pa.RecordBatch.from_pylist(out, _OUT)
                yield pa.RecordBatch.from_arrays([ids, *rest.columns], [id_col, *_OUT.names])

    kind = dict(table.dtypes)["id"]
    return table.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,first:long,last:long,containment:double>>")


_OUT = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("blocks", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))),
])
