"""Each operator against a brute-force version, on documents with nulls, copies, ties and long texts."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from marketloom.llm import classifier, components, contamination, jaccard, licenses, mixing, quality, repeats, secrets, urls, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, part int, kept string, score double, left string"


def words(n, r, size=60):
    return [f"w{r.randrange(size)}é" if r.random() < 0.1 else f"W{r.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = [" ".join(words(r.choice((0, 1, 3, 12, 60, 200)), r, 5000)) for _ in range(40)]
    passage = " ".join(words(55, r, 5000))
    texts = [None, "", " \n\t ", "one", "x" * 3000, "The same\nThe same\nThe same\n", "a b a b a b a b a b a b a b a b a b a b a b a b a b a b a b a b", " ".join(words(9000, r, 5000))]
    texts += base + base[:10] + [f"{b} {passage}" for b in base[10:20]] + [passage] * 3
    texts += [t.replace(t.split(" ")[5], "changed", 1) for t in base if len(t.split(" ")) > 100]
    texts += [f"{base[3]} password = \"abcdefgh12\" AKIA{'Z' * 20} {'0a' * 20}é token=short token==longerthan8", "AKIAAKIA12 secret: password=abcdefghijk", "Licensed under CC BY 4.0\nReleased under the MIT License.\nAll rights reserved. all RIGHTS reserved"]
    return [(i, t, None if i % 9 == 0 else "en" if i % 2 else "fr", None if i % 7 == 0 else "src0" if i % 3 else "src1", len(t or ""), 1, 2, "k", 0.5, "l") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_substring_dedup(docs, rows):
    got, first = by_id(repeats.dedup(docs)), set()
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in first:
                gone[p : p + 20] = [True] * 20
            first.add(k)
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), kept), i
        assert sum(s.end - s.start for s in got[i].spans) == sum(gone)


def test_licenses(docs, rows):
    got = by_id(licenses.scan(docs))
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base) == (len(w), len(at))
        assert got[i].base_labels == ",".join(sorted({x[1] for x in at}))
        found = set()
        for k, x in licenses.TEMPLATES.items():
            terms, size = set(x.split()), int(len(x.split()) / 0.9 + 1e-9)
            if any(len(terms & set(w[p : p + size])) >= 0.9 * len(terms) - 1e-9 for p in range(len(w))):
                found.add(k)
        assert set(filter(None, got[i].labels.split(","))) == found | {x[1] for x in at}


def test_licenses_across_lines(spark):
    wrapped = {
        "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
        "bsd": " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that",
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided",
        "apache": "Licensed\n\nunder the\n\nApache License\n\nVersion 2.0",
    }
    far = "Licensed under the\n\n" + "word\n\n" * 20 + "Apache License Version 2.0"
    scattered = "the weather license was released from under a bridge in mit town"
    texts = [f"é one\n\n{t}\n\nlast" for t in wrapped.values()] + [None, "\n", far, "Released under the MIT License\nof old", scattered]
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)))
    for i, label in enumerate(wrapped):
        assert (got[i].labels, got[i].score) == (label, 1.0), label
    assert [got[i].labels for i in range(5, 10)] == ["", "", "", "mit", ""] and got[9].score == 0.0
    assert [(x.first, x.last) for x in got[1].blocks] == [(2, 15)] and [(x.first, x.last) for x in got[8].blocks] == [(0, 4)]


def test_adjacent_license_blocks(spark):
    texts = ["released under the mit license " * 20, "released under the mit license and released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files " * 3]
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [len(got[i].blocks) for i in range(3)] == [20, 2, 3]
    assert [(x.first, x.last) for x in got[0].blocks] == [(5 * i, 5 * i + 4) for i in range(20)]


def test_substring_dedup_of_ids_with_several_texts(spark):
    w, u = (" ".join(f"{c}{i}" for i in range(40)) for c in "wu")
    texts = [(0, w), (1, "a b c " + w), (1, "x y z"), (1, w), (1, u), (None, w), (None, "n o"), (1, u)]
    for kind, name in (("long", lambda i: i), ("string", lambda i: None if i is None else f"d{i}")):
        rows = spark.createDataFrame([(name(i), t) for i, t in texts], f"doc_id {kind}, text string").repartition(3)
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in repeats.dedup(rows).collect())
        # of the texts of id 1, some copy of W other than the first loses all of it; U is there in one text only, twice
        a, b = str(name(0)), str(name(1))
        assert got == sorted([(a, 40, 0, w), (b, 43, 40, "a b c"), (b, 3, 0, "x y z"), (b, 40, 40, ""), (b, 40, 0, u), (b, 40, 0, u), ("None", 40, 40, ""), ("None", 2, 0, "n o")])


def test_a_blob_is_scanned_once(spark, monkeypatch):
    seen = []
    scan = secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda blobs: (seen.append(blobs.count()), scan(blobs))[1])
    text = "password = abcdefgh12"
    rows = spark.range(300).selectExpr("if(id % 2 = 0, null, 7L) as doc_id", f"if(id % 3 = 0, '{text}', 'nothing') as text")
    got = secrets.findings(rows).collect()
    assert len(got) == 300 and seen == [2] and sum(len(r.findings) for r in got) == 100


def brute_components(rows, k=5, percent=75):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets[i] = {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}
    find = lambda x: x if up[x] == x else find(up[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard(docs, rows):
    got = by_id(jaccard.join(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(rows)


def near_copies(n, size=120, seed=3):
    """Copies of one text with words changed at random: some link, some only through others, some not at all."""
    r = random.Random(seed)
    base = [f"b{r.randrange(10 ** 6)}" for _ in range(size)]
    return [(i, " ".join(f"x{r.randrange(10 ** 9)}" if r.random() < r.choice((0.005, 0.02, 0.05)) else w for w in base)) for i in range(n)]


@pytest.mark.parametrize("sliced", [False, True])
def test_jaccard_of_a_large_group(spark, sliced, monkeypatch):
    if sliced:  # runs in several slices, blocks in several chunks
        monkeypatch.setattr(jaccard, "HOT", 32)
        monkeypatch.setattr(jaccard, "CHUNK", 2000)
    rows = near_copies(300)
    got = by_id(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    want = brute_components(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want and 20 < len({x[1] for x in want.values()}) < 290


def test_prefix_tree_finds_what_sets_share():
    import numpy as np

    r = np.random.default_rng(1)
    sets = sorted({tuple(sorted(r.choice(40, r.integers(1, 30), replace=False).tolist())) for _ in range(300)})
    sets += [sets[7][:-1]] if len(sets[7]) > 1 and sets[7][:-1] not in sets else []
    paths = [np.array(x, np.uint64) for x in sorted(sets)]
    tree = jaccard.Trie(paths)
    for percent in (30, 75):
        for p in paths[::7]:
            want = [100 * len(np.intersect1d(p, x)) >= percent * len(np.union1d(p, x)) for x in paths]
            assert tree.linked(p, percent).tolist() == want


def test_only_one_row_of_a_group_stays(spark):
    copy = " ".join(f"w{i}" for i in range(30))
    table = [(2, copy, 1), (1, copy + " end", 2), (1, copy + " end", 3), (None, copy, 4), (3, "other words here", 5), (None, "more words of none", 6), (None, "more words of none", 7), (4, "", 8), (4, None, 9)]
    rows = jaccard.deduplicated(spark.createDataFrame(table, "doc_id long, text string, id int")).collect()
    left = sorted(r.id for r in rows)
    assert len(left) == 5 and left[1:] in ([5, 6, 8, 9], [5, 7, 8, 9]) and left[0] in (2, 3)


def test_words_that_polynomials_confuse(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = thue.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(25))
    table = spark.createDataFrame([(1, f"{thue} {tail}"), (2, f"{other} {tail}"), (3, thue), (4, other)], "doc_id long, text string")
    got = by_id(jaccard.join(table))
    assert (got[3].component_id, got[4].component_id) == (3, 4)
    assert by_id(repeats.dedup(table))[2].kept == other


def brute_fences(rows, prior):
    """Which rules each row fails, by the same sketch summed in plain fractions."""
    import math
    from fractions import Fraction

    counts = []
    for i, t, lang, source, *_ in rows:
        w = (t or "").encode().split()
        seen = {}
        for p in range(len(w) - 4):
            seen.setdefault(tuple(w[p : p + 5]), []).append(p)
        again = len({p + j for v in seen.values() if len(v) > 1 for p in v for j in range(5)})
        lines = [x for x in (t or "").split("\n") if x.strip()]
        c = sum(len(x.decode()) for x in w)
        values = (sum(x in "#*$%&|<>" for x in t or ""), c), (len(lines) - len(set(lines)), len(lines)), (again, len(w)), (c, len(w)), (sum("A" <= x <= "Z" for x in t or ""), c)
        counts.append((i, lang, source, len(w), [a / b if b else 0.0 for a, b in values]))
    bucket = lambda x: -1000 if x <= 1e-9 else math.ceil(math.log(x) / math.log(quality.GAMMA))
    failed = {i: set() for i, *_ in rows}
    for k, (name, (_, spread, slack)) in enumerate(quality.RULES.items()):
        own = {}
        for _, lang, source, n, v in counts:
            for key in ((), (lang,), (lang, source)) if n else ():
                own.setdefault(key, {})
                own[key][bucket(v[k])] = own[key].get(bucket(v[k]), 0) + 1
        def shares(key):
            here = own[key]
            size = sum(here.values())
            if not key:
                return {b: Fraction(n, size) for b, n in here.items()}
            up = shares(key[:-1])
            return {b: (here.get(b, 0) + prior * up[b]) / (size + prior) for b in up}
        for i, lang, source, n, v in counts:
            if not n:
                continue
            table, total, q = sorted(shares((lang, source)).items()), Fraction(0), {}
            for b, x in table:
                total += x
                for part in (1, 3):
                    if 4 * total >= part and part not in q:
                        q[part] = 0.0 if b == -1000 else 2 * quality.GAMMA**b / (quality.GAMMA + 1)
            if v[k] > q[3] + spread * (q[3] - q[1]) + slack:
                failed[i].add(name)
    return failed


@pytest.mark.parametrize("prior", [1, 50, 10_000])
def test_quality_fences(docs, rows, prior):
    got, want = by_id(quality.judge(docs, prior=prior)), brute_fences(rows, prior)
    assert {i: set(filter(None, r.failed.split(","))) for i, r in got.items()} == want
    assert all(r.kept == (not r.base_failed and not r.failed) for r in got.values())


def test_quality(docs, rows):
    got = by_id(quality.judge(docs))
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        seen = {}
        for p in range(len(w) - 4):
            seen.setdefault(tuple(w[p : p + 5]), []).append(p)
        again = len({p + j for v in seen.values() if len(v) > 1 for p in v for j in range(5)})
        lines = [x for x in (t or "").split("\n") if x.strip()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), again)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 10 or 100 * again > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_urls(spark):
    pages = spark.createDataFrame([
        (1, "http://A.net/x", None), (2, "https://good.org/fr/a#z", ""), (3, None, "x"), (4, "nothing", None), (5, "http://alias.com/p", '<link rel="canonical" href="http://a.net/x">'),
        (6, "http://other.com/q", '<meta http-equiv="refresh" content="0; url=http://alias.com/p">'), (7, "http://both.com/", '<link rel=canonical href="http://good.org/fr/a">'),
        (8, "http://both.com/z", '<link rel="canonical" href="/">'), (9, "http://b.com/y", '<link rel="canonical" href="http://a.net/x"><meta http-equiv=refresh content="1;url=http://both.com/">'), (10, "http://www.example.net/en/a?b", None), (1, "http://A.net/x", None),
    ], "page_id long, url string, html string")
    got = by_id(urls.judge(pages), "page_id")
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.net", "/x", "net/", "block")
    assert (got[10].rule, got[10].verdict) == ("example.net/en/", "allow")
    assert (got[3].host, got[3].path, got[3].verdict, got[4].host) == ("", "", "allow", "")
    # 9 joins the blocked and the allowed part: an allow rule goes first, but 1 keeps its own
    assert [got[i].verdict for i in (5, 6, 7, 8, 9)] == ["allow"] * 5
    alone = by_id(urls.judge(pages.where("page_id in (1, 5, 6)")), "page_id")
    assert [alone[i].verdict for i in (1, 5, 6)] == ["block"] * 3 and alone[6].via == "alias"


def test_url_aliases(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    pages = spark.createDataFrame([
        (1, "http://a.net/x", None), (2, "http://c.com/b/", None), (3, "http://d.com/", '<link rel="canonical">' + link.format("http://a.net/x")),
        (4, "http://e.com/p/q/r", refresh.format("http://f.com/") + refresh.format("http://a.net/x")), (5, "http://g.com/p/q/r?../a", link.format(".././../s/./t/..")), (6, "http://g.com/s/", refresh.format("http://a.net/x")),
        (7, "http://h.com/p/q", link.format("r?u=http://a.net/x")), (8, "http://h.com/p/r?u=http://a.net/x", refresh.format("http://a.net/y/../../x")), (9, "http://i.com/../.x/..y/", link.format("http://i.com/.x/..y/")),
        (10, "http://i.com/.x/..y/", refresh.format("//a.net/x")), (11, "http://j.com/a/../b?c=/../d", None), (12, None, link.format("../x")), (13, "../x", link.format("http://a.net/x")),
    ], "page_id long, url string, html string")
    got = by_id(urls.judge(pages), "page_id")
    assert {i for i, r in got.items() if r.via == "alias" and r.verdict == "block"} == {3, 4, 5, 6, 7, 8, 9, 10}
    assert {i for i, r in got.items() if r.via == "default"} == {2, 11, 12, 13} and (got[11].path, len(got)) == ("/a/../b", 13)
    edges = {(r.a, r.b) for r in urls.alias_edges(pages).collect()}
    assert {("http://d.com/", "http://a.net/x"), ("http://e.com/p/q/r", "http://f.com/"), ("http://e.com/p/q/r", "http://a.net/x"), ("http://h.com/p/q", "http://h.com/p/r?u=http://a.net/x")} <= edges


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://a/\r\n b", "same"), (1, None, "same"), (2, "u", None), (4, "u", ""), (5, "ü", "é" * 200_000), (None, "n", "same")], "page_id long, url string, html string")
    got = by_id(warc.round_trip(pages), "page_id")
    assert all(r.verified for r in got.values()) and len(got) == 6
    assert (got[1].record_type, got[3].record_type, got[3].refers_to, got[3].payload_bytes, got[None].refers_to) == ("response", "revisit", 1, 4, 1)
    assert (got[2].record_type, got[4].refers_to, got[5].payload_bytes) == ("response", 2, 400_000)
    assert got[3].payload_digest == warc.digest(b"same")
    one = warc.record(7, "u", b"abc", None) + warc.record(8, "u", b"abc", 7)
    (tmp_path / "x.warc.gz").write_bytes(one)
    assert [(r.page_id, r.payload) for r in warc.read_files(spark, str(tmp_path)).collect()] == [(7, b"abc"), (8, b"")]
    with pytest.raises(ValueError):
        list(warc.records([one[:-9]]))


def test_warc_rows_that_share_an_id(spark):
    pages = [(1, "a", "same"), (2, "b", "more"), (None, "c", "same"), (None, "d", "unique"), (5, "e", "same"), (5, "f", "more"), (5, "g", "own")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = warc.read(warc.write(table), with_payload=True).collect()
    got = {r.url: (r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in rows}
    revisits = {"c": 1, "e": 1, "f": 2}
    assert len(rows) == len(pages) and got == {u: (i, "revisit", revisits[u], b"") if u in revisits else (i, "response", None, h.encode()) for i, u, h in pages}


def test_mixing(docs, rows):
    got = mixing.mix(docs, fraction=0.5).collect()
    tokens = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    assert all(r.n_tokens == tokens[r.doc_id] > 0 and r.epochs > 0 for r in got)
    taken, total = sum(r.n_tokens * r.epochs for r in got), sum(tokens.values())
    leaves = len({(r[3] == "src0", r[2], r[3]) for r in rows})
    assert abs(taken - 0.5 * total) <= leaves * max(tokens.values()) / 2
    assert sorted((r.doc_id, r.epochs) for r in got) == sorted((r.doc_id, r.epochs) for r in mixing.mix(docs.repartition(7), fraction=0.5).collect())
    everything = {r.doc_id: r.epochs for r in mixing.mix(docs, fraction=1.0, max_epochs=1).collect()}
    assert everything == {i: 1 for i, n in tokens.items() if n}


def poured(total, nodes):
    """Shares of total by weight, none over its capacity: nodes are (key, weight, capacity)."""
    out, left = {}, list(nodes)
    while left:
        w = sum(x[1] for x in left)
        full = [x for x in left if x[2] <= total * x[1] / w + 1e-9]
        if not full:
            return out | {k: total * x / w for k, x, _ in left}
        out |= {k: c for k, _, c in full}
        total -= sum(c for _, _, c in full)
        left = [x for x in left if x not in full]
    return out


def brute_mix(spark, rows, fraction, max_epochs, seed=7):
    """{doc_id: epochs} of rows (doc_id, text, lang, source): budgets poured level by level, each leaf's documents in order of Spark's hash."""
    table = [(i, t, lang, source, len((t or "").encode().split())) for i, t, lang, source, *_ in rows]
    table = [x for x in table if x[4]]
    leaf = lambda x: ("crawl" if x[3] == "src0" else "curated", x[2], x[3])
    weigh = lambda key: mixing.WEIGHTS[mixing.LEVELS[len(key) - 1]].get(key[-1], 1.0)
    tokens = {}
    for x in table:
        tokens[leaf(x)] = tokens.get(leaf(x), 0) + x[4]
    budget = {(): fraction * sum(tokens.values())}
    for level in range(3):
        for up in [k for k in budget if len(k) == level]:
            below = {k[: level + 1] for k in tokens if k[:level] == up}
            budget |= poured(budget[up], [(k, weigh(k), max_epochs * sum(n for t, n in tokens.items() if t[: level + 1] == k)) for k in sorted(below, key=str)])
    found = {}
    for k, supply in tokens.items():
        full = int(budget[k] / supply + 1e-9)
        left, own = int(budget[k] - full * supply + 1e-6), [x for x in table if leaf(x) == k]
        h = {r[0]: r[1] for r in spark.createDataFrame([(x[0], x[1]) for x in own], "i long, t string").selectExpr("i", f"pmod(xxhash64({seed}, {full}L, cast(i as string), xxhash64(t)), {1 << 40}L)").collect()}
        used = 0
        for x in sorted(own, key=lambda x: h[x[0]]):
            more = used + x[4] / 2 <= left
            used += x[4]
            if full + more:
                found[x[0]] = full + more
    return found


@pytest.mark.parametrize(("fraction", "epochs"), [(0.2, 1), (0.8, 4), (2.5, 4)])
def test_mixing_takes_each_leafs_prefix(spark, docs, rows, fraction, epochs):
    got = {r.doc_id: r.epochs for r in mixing.mix(docs, fraction=fraction, max_epochs=epochs).collect()}
    assert got == brute_mix(spark, rows, fraction, epochs)


def test_budgets_go_to_siblings_first(spark):
    supply = spark.createDataFrame([("a", "x", "s", 1, 10), ("a", "y", "s", 1, 100), ("b", "x", "s", 1, 100)], "domain string, lang string, source string, docs long, tokens long")
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(supply, 100, 0, {}, 1).collect()}
    assert got == {("a", "x"): 10.0, ("a", "y"): 40.0, ("b", "x"): 50.0}


def test_contamination(spark, docs, rows):
    texts = [" ".join((rows[30][1] or "q w e").split()[:30]), rows[20][1], "changed", None, "", " ".join(rows[7][1].split()[100:140])]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got, wins = by_id(contamination.contamination(docs, items)), {}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    for i, t in enumerate(texts):
        w = split(t)
        for p in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[p : p + 13]), set()).add(str(i))
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for size in {len(k) for k in wins}:
            for p in range(len(w) - size + 1):
                if (k := tuple(w[p : p + size])) in wins:
                    hit |= set(range(p, p + size))
                    found |= wins[k]
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == (len(w), len(hit), len(found), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)), i


def test_contamination_by_letters_whose_case_depends_on_others(spark):
    passage = "Π.Α.Σ. εδώ ΝΟΜΟΣ.ΑΡΘΡΟ Σ Σ'Α Στ.Σ: İΣ"
    table = spark.createDataFrame([(1, passage), (2, f"one {passage} TWO"), (3, passage.replace("εδώ", "Εδώ"))], "doc_id long, text string")
    got = by_id(contamination.contamination(table, spark.createDataFrame([(7, passage), (8, "Two")], "item_id long, text string")))
    assert [(got[i].n_hit, got[i]["items"], got[i].contaminated) for i in (1, 2, 3)] == [(12, ["7"], True), (13, ["7", "8"], True), (0, [], False)]


def test_contamination_of_rows_that_share_an_id(spark):
    item = " ".join(f"i{k}" for k in range(13))
    table = spark.createDataFrame([(1, item), (1, "some other words"), (None, item), (None, "clean words"), (None, None), (1, item)], "doc_id long, text string")
    got = contamination.contamination(table, spark.createDataFrame([(7, item), (8, item + " more")], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in got) == sorted([(1, 13, 13, ["7", "8"])] * 2 + [(1, 3, 0, []), (0, 13, 13, ["7", "8"]), (0, 2, 0, []), (0, 0, 0, [])])


def test_proximity(spark):
    item = "alpha c1 c2 c3 c4 c5 c6 c7 c8 c9 c10 c11 omega"
    common = " ".join(f"c{k}" for k in range(1, 12))
    texts = [item, item.replace("c5", "c5 x"), item.replace("c5 ", ""), item.replace("c5", "c5 x y z"), *[common] * 5]
    _, matches = contamination.search(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    # alpha and omega are the rarest; one word more or less between them
    assert {(r.id.id, r["shift"]) for r in matches.collect()} == {(0, 0), (1, 1), (2, -1)} or {(r.id.id, abs(r["shift"])) for r in matches.collect()} == {(0, 0), (1, 1), (2, 1)}


def test_secrets(docs, rows):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = by_id(secrets.findings(docs))
    for i, t, *_ in rows:
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert [(s.start, s.ord, s.end) for s in got[i].findings if s.ord < 3] == sorted(want), i
    clean = by_id(secrets.redacted(docs))
    assert "abcdefgh12" not in "".join(r.text or "" for r in clean.values()) and clean[0].text is None
    assert clean[3].text == rows[3][1] and len(clean) == len(rows)
    _, ledger = secrets.update(docs.where("doc_id < 20"))
    _, new = secrets.update(docs, ledger)
    blobs = lambda some: {hashlib.sha256((x[1] or "").encode()).hexdigest() for x in some}
    assert {r.blob for r in new.collect()} == blobs(rows) - blobs(rows[:20]) and secrets.grown(ledger, new).count() == len(blobs(rows))
    # what the ledger has is taken from there, not scanned again
    said = ledger.withColumn("findings", F.expr("array(named_struct('start', 0L, 'ord', 0, 'end', 1L, 'kind', 'told'))"))
    assert {r.doc_id for r in secrets.findings(docs, said).collect() if r.findings and r.findings[0].kind == "told"} == {i for i, t, *_ in rows if blobs([(i, t)]) <= blobs(rows[:20])}


def test_own_kinds_of_secrets(spark):
    texts = ["x ghp_" + "a1B2" * 9 + " y", "xoxb-1234567890-abc", "eyJhbGciOi12.eyJzdWIiOi12.c2lnbmF0dXJl", "-----BEGIN RSA PRIVATE KEY-----", "é ghp_short"]
    got = by_id(secrets.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [[(s.kind, s.start, s.end) for s in got[i].findings] for i in range(5)] == [[("github", 2, 42)], [("slack", 0, 19)], [("jwt", 0, 38)], [("private_key", 0, 31)], []]


def test_classifier(docs, rows):
    model = classifier.fit(docs)
    got = by_id(classifier.score(docs, model))
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert not got[0].kept and not got[1].kept


def test_em_against_single_documents():
    """The same estimates as by a plain loop over documents, not over patterns."""
    import math

    import numpy as np

    r = random.Random(2)
    votes = []
    for _ in range(200):
        good = r.random() < 0.6
        votes.append(tuple(0 if r.random() < 0.3 else (2 if good else 1) if r.random() < 0.5 + 0.07 * j else (1 if good else 2) for j in range(5)))
    p = [(v.count(2) + 0.5) / (v.count(2) + 2 * v.count(1) + 1) for v in votes]
    for _ in range(classifier.ROUNDS):
        chance = [[[0.5 + sum((x if c else 1 - x) for v, x in zip(votes, p) if v[j] == k) for k in range(3)] for j in range(5)] for c in (0, 1)]
        chance = [[[x / sum(row) for x in row] for row in c] for c in chance]
        prior = sum(p) / len(p)
        p = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(math.log(chance[1][j][k] / chance[0][j][k]) for j, k in enumerate(v))))) for v in votes]
    patterns = sorted(set(votes))
    got, right = classifier.em(np.array(patterns), np.array([votes.count(v) for v in patterns], float))
    assert np.allclose([got[patterns.index(v)] for v in votes], p) and np.allclose(right, chance)


def test_classifier_sample_is_bounded_by_rows(spark, monkeypatch):
    held = []
    monkeypatch.setattr(classifier, "train", lambda at, x, p, width: (held.append(len(at)), __import__("numpy").zeros(width))[1])
    table = spark.range(4000).selectExpr("cast(id % 2 as long) as doc_id", "concat('good words of a text. ', cast(id % 3 as string)) as text")
    classifier.fit(table, sample=10)
    assert held[0] <= 10


def test_repeated_rows_take_one_place_of_the_sample(spark, monkeypatch):
    held = []
    monkeypatch.setattr(classifier, "train", lambda at, x, p, width: (held.append(len(at)), __import__("numpy").zeros(width))[1])
    table = spark.range(200 * 50).selectExpr("id % 200 as doc_id", "concat('good words of a text. ', cast(id % 200 as string)) as text")
    classifier.fit(table, sample=100)
    assert held == [50]  # one side has all documents, and fills its half


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/documents.parquet")
    scored = classifier.score(table, classifier.fit(table)).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert scored.selectExpr("avg(cast(kept = (quality = 1) as int))").first()[0] > 0.93


def test_components(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (200, 200), (7, None), (None, None), (100, 50)]
    wanted = {i: 0 for i in range(31)} | {50: 50, 70: 50, 100: 50}
    for kind in ("long", "string"):
        table = spark.createDataFrame(edges, "a long, b long").repartition(4).selectExpr(f"cast(a as {kind}) as a", f"cast(b as {kind}) as b")
        for small in (0, components.SMALL):  # by rounds, and by one task
            rows = components.components(table, "a", "b", small).collect()
            got = {int(r.node): int(r.component) for r in rows}
            assert len(rows) == len(got) and got == (wanted if kind == "long" else {i: 0 for i in range(31)} | {50: 100, 70: 100, 100: 100})
    assert components.components(table.limit(0), "a", "b").count() == 0


def test_forest_sends_what_it_holds(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(components, "HELD", 3)
    batches = [pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}) for a, b in (([5, 9], [4, 8]), ([4, 1], [1, 0]), ([8], [0]))]
    sent = [(a, b) for x in components._forest(iter(batches)) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
    assert sent == [(5, 4), (9, 8), (4, 0), (1, 0), (8, 0)]


def test_empty_and_null_ids(spark):
    for some in ([], [(None, None, None, None, None, None, None, None, None, None), (None, "one two three", None, None, 1, 1, 1, "", 0.0, ""), (4, "one two three", "en", "s", 1, 1, 1, "", 0.0, ""), (4, "one two three", "en", "s", 1, 1, 1, "", 0.0, "")]):
        docs = spark.createDataFrame(some, SCHEMA)
        items = spark.createDataFrame([], "item_id long, text string")
        assert repeats.dedup(docs).count() == licenses.scan(docs).count() == jaccard.join(docs).count() == quality.judge(docs).count() == len(some)
        assert contamination.contamination(docs, items).count() == secrets.findings(docs).count() == classifier.score(docs, classifier.fit(docs)).count() == len(some)
        assert mixing.mix(docs).count() <= len(some)
        pages = docs.selectExpr("doc_id as page_id", "text as url", "text as html")
        assert urls.judge(pages).count() == warc.round_trip(pages).count() == len(some)


def test_columns_that_clash(spark):
    names = ("_salt", "_blob", "_found", "_id", "row", "domain", "n_tokens", "epochs", "text2", "tid", "head", "chunk", "label", "own", "rule", "kept", "at", "items", "findings", "id", "g_lang", "lang_")
    values = ", ".join(f"'v{i}' as `{c}`" for i, c in enumerate(names))
    docs = spark.sql(f"select cast(i as long) as doc_id, concat('some words number ', i, ' password: abcdefgh', i) as text, 'en' as lang, 's' as source, {values} from explode(sequence(1, 12)) as t(i)")
    items = spark.createDataFrame([(1, "words number 3")], "item_id long, text string")
    for f in (repeats.dedup, licenses.scan, jaccard.join, quality.judge, secrets.findings, lambda d: contamination.contamination(d, items), lambda d: classifier.score(d, classifier.fit(d)), lambda d: urls.judge(d.selectExpr("doc_id as page_id", "text as url", "text as html", *names)), lambda d: warc.round_trip(d.selectExpr("doc_id as page_id", "text as url", "text as html", *names))):
        assert f(docs).count() == 12
    for f in (secrets.redacted, jaccard.deduplicated, quality.passing, mixing.mix):
        out = f(docs)
        assert set(docs.columns) <= set(out.columns) and all(r[c] == f"v{i}" for r in out.collect() for i, c in enumerate(names))
    assert {"domain_", "n_tokens_", "epochs_"} <= set(mixing.mix(docs).columns)
    assert contamination.contamination(docs, items, with_row=True).select("row.*").columns == docs.columns


def test_shared_folder_is_asked_for(spark):
    from marketloom.llm import storage

    class Cluster:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        conf, sparkContext = {}, Cluster

    with pytest.raises(ValueError):
        storage.shared_dir(Session)
