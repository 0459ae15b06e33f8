"""The corpus pipeline, stage by stage, against a brute-force version."""

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import LOWER, brute_components, brute_fences, brute_mix  # noqa: E402

from marketloom.llm import quality, secrets  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    word = lambda: f"w{r.randrange(3000)}"
    texts = [" ".join(word() for _ in range(r.choice((5, 12, 40, 90)))) for _ in range(60)]
    item = " ".join(f"item{k}" for k in range(20))
    texts += texts[:8] + [t.replace(t.split(" ")[9], "changed", 1) for t in texts[8:20] if len(t.split(" ")) > 60]
    texts += [" ".join(word() for _ in range(40)) + f" {item}", "spam spam spam spam spam spam spam " * 9, f"{texts[31]} token=abcdefghijkl", None, "", "###### $$$$$ " * 30]
    rows = [(i, t, r.choice(("en", "de", None)), r.choice(("src0", "src1", "src2")), len(t or ""), f"n{i}") for i, t in enumerate(texts)]
    rows += [(3, texts[3], rows[3][2], rows[3][3], 1, "again"), (None, " ".join(word() for _ in range(30)), "en", "src1", 1, "none"), (None, "spam spam spam spam spam spam " * 9, "en", "src1", 1, "spam")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_pipeline(spark, folder):
    path, rows, item = folder
    # rows are told by their place here, since ids repeat
    docs = {i: r for i, r in enumerate(rows)}
    failed = brute_fences([(i, *r[1:]) for i, r in docs.items()], quality.PRIOR)

    def base_failed(t):
        w, seen = (t or "").encode().split(), {}
        for p in range(len(w) - 4):
            seen.setdefault(tuple(w[p : p + 5]), []).append(p)
        return len(w) < 10 or 100 * len({p + j for v in seen.values() if len(v) > 1 for p in v for j in range(5)}) > 20 * len(w)

    docs = {i: r for i, r in docs.items() if not failed[i] and not base_failed(r[1])}
    assert 30 < len(docs) < len(rows)
    place = sorted(docs, key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    parts = brute_components([(n, docs[i][1]) for n, i in enumerate(place)])
    docs = {i: docs[i] for n, i in enumerate(place) if parts[n][1] == n}
    window = re.findall(r"[a-z0-9]+", item)
    clean = {}
    for i, r in docs.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r[1].translate(LOWER))
        hit = {p + j for p in range(len(w)) for k in range(8) if w[p : p + 13] == window[k : k + 13] for j in range(13)}
        if 20 * len(hit) < len(w):
            clean[i] = r
    assert len(clean) == len(docs) - 1
    text = lambda t: t.replace("token=abcdefghijkl", "[REDACTED]")
    clean = {i: (r[0], text(r[1]), *r[2:]) for i, r in clean.items()}
    want = brute_mix(spark, [r[:4] for r in clean.values()], 0.8, 4)
    got = pipeline.run(spark, path).collect()
    assert {r.text for r in got} <= {r[1] for r in clean.values()} and len(got) == len({(r.doc_id, r.text) for r in got})
    assert all(r.n_chars == len(r.text) and r.note for r in got)
    assert {r.doc_id: r.epochs for r in got} == want and len(got) == len(want)


def test_stages_keep_columns_and_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumnRenamed("note", "tid")
    for table in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, table, path)
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == table.columns
            assert out.count() <= table.count()


def test_stages_decide_by_row(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.note for r in pipeline.quality_rules(spark, docs, path).collect()}
    assert "none" in kept and "spam" not in kept
    left = [r.note for r in pipeline.near_duplicates(spark, docs, path).collect()]
    assert len([x for x in left if x in ("n3", "again", "n63")]) == 1
    assert "abcdefghijkl" not in "".join(r.text or "" for r in secrets.redacted(docs).collect())
