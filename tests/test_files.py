"""Sources, sinks, hand-off, replay and streams."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from marketloom import sinks
from marketloom.config import Config, load
from marketloom.functions import numbers, text
from marketloom.operators import handoff, replay, resolve, score
from marketloom.sources import cached, files, registry
from marketloom.streaming import ledger


def test_stored_responses_as_a_table(spark, tmp_path):
    sinks.replace_json(f"{tmp_path}/k1.json", {"total": 5})
    stored = cached.stored_table(spark, str(tmp_path), "total int").select("key", F.to_json("response").alias("response"))
    wanted = spark.createDataFrame([("k1",), ("k2",)], "key string")
    assert {r.key: r.response for r in cached.replayed(wanted, stored).collect()} == {"k1": '{"total":5}', "k2": None}
    with pytest.raises(Exception, match="not stored: k2"):
        cached.replayed(wanted, stored, "offline").collect()


def test_registry_pages(spark, tmp_path):
    for i in range(2):
        sinks.replace_json(f"{tmp_path}/p{i}.json", {"total": 4, "results": [{"siret": f"9{i}{k}", "domaine": d, "latitude": 1.5} for k, d in enumerate(("A", "B"))]})
    found = registry.registry(spark, str(tmp_path), ["A"], ("siret", "domaine", "latitude"))
    assert sorted(r.siret for r in found.collect()) == ["900", "910"] and found.columns == ["siret", "domaine", "latitude"]
    assert registry.registry(spark, str(tmp_path)).count() == 4
    assert [(r.domaine, r.truncated) for r in registry.capped(registry.registry(spark, str(tmp_path)), "domaine", 2).orderBy("domaine").collect()] == [("A", True), ("B", True)]


def test_made_up_market_is_the_same_however_dealt(spark):
    one, other = (sorted(map(str, registry.made_up_market(spark, 200, partitions=n).collect())) for n in (1, 7))
    assert one == other and len(one) == 200
    assert sorted(map(str, registry.made_up_market(spark, 200, seed=8).collect())) != one


def test_files(spark, tmp_path, monkeypatch):
    with pytest.raises(files.MissingTable, match="`score` first"):
        files.stage_table(spark, str(tmp_path), "scored")
    sinks.write_stage(spark.range(3), str(tmp_path), "scored")
    sinks.write_stage(spark.range(2), str(tmp_path), "scored")
    assert files.stage_table(spark, str(tmp_path), "scored").count() == 2
    for g, status in (("g1", "ok"), ("g2", "failed")):
        sinks.replace_json(f"{tmp_path}/docs/{g}.json", {"gid": g, "status": status})
    assert [r.gid for r in files.json_documents(spark, f"{tmp_path}/docs", "gid string, status string", "ok").collect()] == ["g1"]
    sinks.append_line(f"{tmp_path}/l.jsonl", {"lead": "é", "n": 1})
    with open(f"{tmp_path}/l.jsonl", "a", encoding="utf-8") as f:
        f.write("\n   \n")
    sinks.append_line(f"{tmp_path}/l.jsonl", {"lead": "b", "n": 2})
    assert [tuple(r) for r in files.json_lines(spark, f"{tmp_path}/l.jsonl", "lead string, n int").collect()] == [("é", 1), ("b", 2)]
    assert files.json_lines(spark, f"{tmp_path}/none.jsonl", "lead string").count() == 0
    (tmp_path / ".env").write_text("# x\nA_KEY='one'\nB=2\nnothing\n", encoding="utf-8")
    env = {"A_KEY": "set"}
    assert files.env_file(f"{tmp_path}/.env", "A_", env) == {"A_KEY": "set"} and files.env_file(f"{tmp_path}/.env", env=env)["B"] == "2"


def test_yaml_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("# settings\nqueue_size: 7\nsegment:\n  headcount_min: 10\n  headcount_max: 90\n  sweet_spot: [20, 50]\nsignals:\n  - id: size_fit\n    label: 'In band: yes'\n    weight: 2\n  - id: growth\n    label: Growing # said\nproduct_lines:\n  core: [STANDARD]\n", encoding="utf-8")
    cfg = load(f"{tmp_path}/c.yaml")
    assert (cfg.queue_size, cfg.segment.sweet_spot, cfg.weights, cfg.signals[0].label, cfg.signals[1].label) == (7, (20, 50), {"size_fit": 2.0, "growth": 1.0}, "In band: yes", "Growing")
    assert files.yaml_subset("a: >\n  one\n  two\nb:\n- x\n- y\n") == {"a": "one two", "b": ["x", "y"]}


def test_csv_and_findings(spark, tmp_path):
    df = spark.createDataFrame([("é \"x\"", None, 1), ("b\nc", "d", 2)], "a string, b string, n int").coalesce(1)
    made = sinks.write_finding(str(tmp_path), "f1", df, {"more": df.select("n")}, sinks.bar_spec(df.select("a", "n"), "n", "a", "T"))
    raw = open(made[0], "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf\"a\",\"b\",\"n\"")
    with open(made[0], encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f)) == [["a", "b", "n"], ["é \"x\"", "", "1"], ["b\nc", "d", "2"]]
    assert [os.path.basename(x) for x in made] == ["f1.csv", "f1_more.csv", "f1.vl.json"]
    assert json.load(open(made[2], encoding="utf-8"))["encoding"]["x"]["scale"]["domain"] == [0, 2]
    assert sinks.pct(0.256) == "26%" and sinks.text_table([("rows", 12345)]).endswith("12,345")


@pytest.mark.parametrize(("raw", "want"), [
    ("ACME ENERGIE (ACME ENERGIE)", "Acme Energie"), ("SOCIETE DE L'EMERAUDE SARL", "Societe de l'Emeraude SARL"), ("BTP 2000 (SLTE)", "BTP 2000 (SLTE)"), ("LE GALL (LA MAISON VERTE)", "Le Gall (La Maison Verte)"),
    ("Acme  (Autre)", "Acme (Autre)"), ("", ""), (None, ""), ("ÉTÉ AU SUD", "Été au Sud"),
])
def test_display_name(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(text.display_name(F.col("x"))).first()[0] == want


def test_texts(spark):
    one = lambda c, x: spark.createDataFrame([(x,)], "x string").select(c(F.col("x"))).first()[0]
    assert one(text.why, "9.7 A | ~60 staff | grows") == "~60 staff | grows" and one(text.why, None) == ""
    assert one(text.aim, "Find the site. Then read.") == "Find the site"
    assert one(text.aim, "word " * 40) == ("word " * 22)[:108].rsplit(" ", 1)[0] + " …"
    assert one(text.search_summary, "[{'url': 'https://www.a.fr/x'}, {'url': 'https://a.fr/y'}]") == "2 results: a.fr" and one(text.search_summary, None) == ""
    assert one(text.fetch_summary, "w " * 1204) == "Read about 1,200 words" and one(text.fetch_summary, "w " * 19) == ""
    assert one(text.role_en, "Président de SAS") == "president (of the SAS)" and one(text.language, "fr") == "French" and one(text.language, "xx") == "xx"
    assert one(text.titled, "LE GALL") == "Le Gall" and one(text.titled, "D'ARC") == "D'Arc" and one(text.titled, "Jean") == "Jean"
    assert one(text.escaped, "<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(lambda c: text.fixed(c.cast("double"), 1), "8.35") == "8.3" and one(lambda c: text.fixed(c.cast("double"), 1), "8.25") == "8.2"


def test_interpolation_at_coinciding_knots(spark):
    from marketloom.config import Segment

    seg = Segment(30, 300, (30, 300))
    df = spark.createDataFrame([(x,) for x in (10.0, 30.0, 100.0, 300.0, 400.0)], "x double")
    assert [r[0] for r in df.select(numbers.size_curve(F.col("x"), seg)).collect()] == [1.0] * 5


def test_ranks_against_a_plain_sort(spark):
    import random

    r = random.Random(4)
    rows = [(f"g{i}", f"n{r.randrange(20)}", r.choice((8.25, 9.0, 9.5)), r.randrange(3), r.random() < 0.1) for i in range(300)]
    got = {x.gid: (x.rank, x.place) for x in score.ranked(spark.createDataFrame(rows, "gid string, name string, score double, evidence_backed long, is_reference boolean")).collect()}
    want, place = {}, 0
    for n, x in enumerate(sorted(rows, key=lambda x: (-x[2], -x[3], x[1], x[0])), 1):
        place += not x[4]
        want[x[0]] = (n, None if x[4] else place)
    assert got == want


def test_link_keys(spark):
    officer = "array<struct<type_dirigeant:string,nom:string,prenoms:string,date_de_naissance:string,qualite:string,siren:string,denomination:string>>"
    person = lambda role="Gérant", born="1975-03": ("personne physique", "Durand (X)", "Anne, B", born, role, None, None)
    rows = [
        (1, "900000001", [person()], ["04 90 00 00 01"], ["http://www.a.example"], "1 rue X"), (2, "900000002", [person()], [], [], "2 rue X"), (3, "900000003", [person("Commissaire aux comptes")], [], [], None),
        (4, "900000004", [("personne morale", None, None, None, None, "900000001", "H")], [], [], ""), (5, "900000005", [("personne morale", None, None, None, None, None, "Holding É")], ["0033490000001"], ["a.example/x"], "1, RUE x"),
    ]
    keys = resolve.company_keys(spark.createDataFrame(rows, f"id long, siren string, officers {officer}, phones array<string>, websites array<string>, address string"))
    links = {}
    for r in resolve.linking(keys).collect():
        links.setdefault(r.key, set()).add(r.id)
    assert links == {"manager:DURAND|ANNE|1975-03": {1, 2}, "holding:900000001": {1, 4}, "phone:0490000001": {1, 5}, "website:a.example": {1, 5}, "address:1 RUE X": {1, 5}}
    assert not {k for k in links if k.startswith("website")} & {r.key for r in resolve.linking(keys, directory=2).collect()}
    assert "address:1 RUE X" not in {r.key for r in resolve.linking(keys, shared_address=1).collect()}
    found, stats = resolve.expanded(spark.createDataFrame([("p1", 1), ("p2", 2)], "person string, ord int"), spark.createDataFrame([(10, "p1", "43.2", True), (11, "p1", "56.1", True), (12, "p1", "43.2", False), (13, "p2", "43.2", True), (1, "p1", "43.2", True)], "id long, person string, naf string, open boolean"), spark.createDataFrame([(1,)], "id long"), ("43.",), 1)
    assert [r.id for r in found.collect()] == [10] and stats.first().asDict() == {"lookups": 1, "hits": 1, "skipped_naf": 1, "closed": 1}


def test_lead_card_and_named_groups(spark):
    with pytest.raises(KeyError):
        handoff.lead_card(spark.createDataFrame([("g1",)], "gid string"), "g2")
    with pytest.raises(ValueError, match="nope"):
        handoff.named(spark.createDataFrame([("g1",)], "gid string"), ["g1", "nope"])
    flat = [f.label for f in Config().signals]
    assert len(flat) == 4


def test_replay_of_paused_runs(spark):
    block = lambda **k: {c: k.get(c) for c in ("type", "id", "name", "input", "tool_use_id", "content")}
    asked = block(type="server_tool_use", id="a", name="web_search", input={"query": "q"})
    api = {"request": {"messages": [{"role": "assistant", "content": [asked]}, {"role": "user", "content": [block(type="web_search_tool_result", tool_use_id="a", content='"url": "http://www.x.fr/1"')]}]}, "response": {"content": [block(type="tool_use", id="b", name="record", input={"signals": "{}"})]}}
    recordings = spark.createDataFrame([("k2", json.dumps(api))], "key string, j string").select("key", F.from_json("j", replay.RECORDING).alias("r"))
    line = "lead string, purpose string, key string, model string, backend string, line long, input_tokens long, cache_write_tokens long, cache_read_tokens long, output_tokens long, usd double, notional_usd double"
    rows = [("g1", "research", "k0", "old", None, 1, 100, 0, 0, 0, 9.0, None), ("g1", "research", "k1", "m", None, 2, 1, 2, 3, 4, 0.5, None), ("g1", "research", "k1", "m", None, 3, 1, 2, 3, 4, 0.5, None), ("g1", "research", "k2", "m", None, 4, 10, 0, 0, 0, 0.25, None), ("g2", "research", "k9", "m", None, 5, 1, 1, 1, 1, 1.0, None)]
    got = replay.replays(spark.createDataFrame(rows, line), recordings).collect()
    assert [(r.lead, r.tokens, r.usd, r.searches, r.fetches, r.notional) for r in got] == [("g1", 20, 0.75, 1, 0, False)]
    assert [(s.kind, s.text, s.found) for s in got[0].steps] == [("search", "q", "1 result: x.fr"), ("record", "", "")]


def test_stream_equals_batch(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"g{i % 3}", f"k{i % 5}|{i % 3}", i % 5) for i in range(60)], "event_id long, lead string, key string, input_tokens long").selectExpr("*", "timestamp'2026-01-01 00:00:00' as called")
    lines.repartition(3).write.json(f"{tmp_path}/in")
    ledger.stream_totals(spark.readStream.schema(lines.schema).json(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("lead").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
    assert sorted(got.collect()) == sorted(ledger.batch_totals(lines).collect())


@pytest.mark.parametrize(("budget", "share", "why"), [(1.5, 0.1, "budget"), (99.0, 0.75, "window seven_day"), (99.0, 0.5, None)])
def test_guard_ends_a_run(spark, tmp_path, budget, share, why):
    lines = spark.createDataFrame([(1.0, False, "1", {"seven_day": share}), (1.0, False, "0", {"seven_day": 0.99}), (50.0, True, "2", {"five_hour": 0.1})], "usd double, replayed boolean, at string, windows map<string,double>")
    lines.coalesce(1).write.json(f"{tmp_path}/in")
    query = ledger.guarded(spark.readStream.schema(lines.schema).json(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at", budget, {"seven_day": 0.7})
    if why:
        with pytest.raises(Exception, match=why):
            query.awaitTermination()
    else:
        query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_research_goes_on_and_an_error_fails_its_lead(spark):
    leads = spark.createDataFrame([("g1", 0.5), ("g2", 0.9), ("g3", 0.9)], "gid string, pre_score double")
    left = ledger.to_run(leads, spark.createDataFrame([("g3",)], "gid string"))
    assert [r.gid for r in left.collect()] == ["g2", "g1"]

    def answer(row):
        if row["gid"] == "g1":
            raise ValueError("no answer")
        return {"value": row["pre_score"]}

    got = {r.gid: (r.value, r.status, r.reason) for r in ledger.research(left, answer, "gid string, value double").collect()}
    assert got == {"g2": (0.9, "ok", None), "g1": (None, "failed", "ValueError: no answer")}
