"""Golden values of the formulas, file sources, streaming against batch, and queries against DuckDB."""

import glob
import json
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from docweave.operators import analytics, cdc, documents, graph, lifecycle, retrieval, revisions, security
from docweave.plans import registry
from docweave.plans.views import lifecycle_events
from docweave.sources import files
from docweave.streaming import events as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_rrf_golden(spark):
    rows = lambda *r: spark.createDataFrame(r, "query_id long, chunk_id long, doc_key string, rank int")
    got = {r["chunk_id"]: r["score"] for r in retrieval.rrf(rows((1, 1, "a", 1), (1, 2, "a", 2)), rows((1, 1, "a", 2), (1, 2, "a", 1), (1, 3, "b", 3))).collect()}
    assert got[1] == pytest.approx(0.65 / 61 + 0.35 / 62) and got[2] == pytest.approx(0.016221575885774723) and got[3] == pytest.approx(0.35 / 63)


@pytest.mark.parametrize("r,g,want", [(0.5, 0.7, "graph"), (0.7, 0.5, "rag"), (0.6, 0.7, "hybrid")])
def test_route(spark, r, g, want):
    assert one(spark, retrieval.route(F.lit(r), F.lit(g))) == want


def test_trigrams(spark):
    pair = lambda a, b: one(spark, retrieval.jaccard(retrieval.trigrams(F.lit(a)), retrieval.trigrams(F.lit(b))))
    assert pair("abcdef", "abcdeg") == pytest.approx(0.6) and pair("ab", "ab") == 0 and pair("", "") == 0


@pytest.mark.parametrize("p,n,want", [(3, 1, 0.075), (0, 2, -0.15), (1, 1, 0.0), (2, 1, 0.05), (0, 0, 0.0)])
def test_feedback(spark, p, n, want):
    assert one(spark, retrieval.feedback_modifier(F.lit(p), F.lit(n))) == pytest.approx(want)


@pytest.mark.parametrize("s,t,points,label", [(0, 0, 0, "low"), (0, 10, 5, "low"), (1, 100, 35, "medium"), (1, 4, 65, "high"), (3, 100, 65, "high"), (5, 1000, 90, "critical"), (3, 10, 90, "critical")])
def test_user_risk(spark, s, t, points, label):
    got = analytics.user_risk(F.lit(s), F.lit(t))
    assert (one(spark, got), one(spark, analytics.risk_label(got))) == (points, label)


def test_role_filter_never_leaks(spark):
    rows = spark.createDataFrame([(1, ["admin"], "a"), (2, ["user", "admin"], "a"), (3, ["public", "user", "admin"], "b")], "chunk_id long, access_roles array<string>, tenant_id string")
    ids = lambda *a: {r[0] for r in retrieval.governed(rows, *a).collect()}
    assert ids("public") == {3} and ids("user") == {2, 3} and ids("admin") == {1, 2, 3} and ids("user", "a") == {2} and ids("nobody") == set()


def test_diverse_fills_up(spark):
    rows = spark.createDataFrame([(1, i, "d" if i < 6 else "e", 1.0 - i / 10) for i in range(8)], "query_id long, chunk_id long, doc_key string, score double")
    assert [r["chunk_id"] for r in retrieval.diverse(rows, 5).orderBy("rank").collect()] == [0, 1, 6, 7, 2]


def test_near_repeats_compare_with_kept_only(spark):
    texts = ["abcdefghij" * 5, "abcdefghij" * 5 + "k", "something else entirely"]
    rows = spark.createDataFrame([(1, i + 1, i, t) for i, t in enumerate(texts)], "query_id long, rank int, chunk_id long, text string")
    assert sorted(r["chunk_id"] for r in retrieval.drop_near_repeats(rows).collect()) == [0, 2]


def test_char_chunks(spark):
    spans = lambda n: [(r["char_start"], r["char_end"]) for r in documents.char_chunks(spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")).collect()]
    assert spans(3866) == [(0, 2000), (1600, 3600), (3200, 3866)] and spans(2000) == [(0, 2000), (1600, 2000)] and spans(0) == []


def test_sentence_packs(spark):
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(60))
    got = [r["chunk"] for r in documents.sentence_packs(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("n").collect()]
    assert all(50 < len(c) for c in got) and got[0].startswith("Sentence number 0") and got[-1].endswith("59 has some words in it.")
    assert got[1].split()[:20] == got[0].split()[-20:]


@pytest.mark.parametrize("name,base,version", [("PO_2024_Alpha_v12.txt", "PO_2024_Alpha", 12), ("Offer_Ann_Revised.pdf", "Offer_Ann", None), ("Talk_Round2.docx", "Talk", None), ("Rec_PAT1_2024_03.txt", "Rec_PAT1", None)])
def test_file_names(spark, name, base, version):
    assert (one(spark, revisions.base_name(F.lit(name))), one(spark, revisions.version_of(F.lit(name)))) == (base, version)


@pytest.mark.parametrize("name,kind,want", [
    ("Prescription_PAT01001_Med_v1.txt", "prescription", "PAT01001"), ("OfferLetter_Sarah_Johnson_Position001.txt", "offer letter", "Sarah_Johnson_001"),
    ("ExpenseReport_Employee001_2024.txt", "expense report", "Employee001"), ("PO_2024_Project_Alpha_v2.txt", "purchase order", "2024_Project_Alpha"),
    ("Contract_Acme_Corp.pdf", "contract", "Acme_Corp"), ("x_AB12.txt", "note", "AB12"), ("plain.txt", "note", None),
])
def test_entity_ids(spark, name, kind, want):
    assert one(spark, revisions.entity_id(F.lit(name), F.lit(kind))) == want


def test_delivery_outcomes(spark):
    rows = [(1, "Delivery date changed: 2024-02-15 → 2024-02-20"), (2, "delivery date changed: 2024-02-15 → 2024-02-16"), (3, "Delivery date changed: 2024-03-05 → 2024-03-01"), (4, "none")]
    got = revisions.delivery_outcomes(spark.createDataFrame(rows, "lifecycle_id long, note string")).collect()
    assert sorted(map(tuple, got)) == [(1, "TIME_OVERRUN", 5.0), (3, "TIME_UNDERRUN", 4.0)]


def test_lifecycle_ids(spark):
    assert one(spark, documents.lifecycle_id_in(F.lit("a\nLifecycle ID: LC-2024_7\n"))) == "lc-2024_7" and one(spark, documents.lifecycle_id_in(F.lit("none"))) is None


def test_content_notes(spark):
    from docweave.operators.diffs import content_notes, largest_percent

    rows = [
        ("Purchase Order", "1. Bolt - quantity: 5 units - unit price: $2.00\nTotal: $1,000", "1. Bolt - Quantity: 9 units - Unit Price: $2.50\n2. Rush delivery fee - quantity: 1\nTotal: $1,259"),
        ("Proposal", "1. Training: 5 days\nTotal: 10", "1. Training: 5 days [SAME]\nTotal: 10"), ("Contract", "Monthly fee: $1,000", "monthly FEE: $900\n[NEW] clause"), ("memo", None, "x"), ("memo", "a", "[new] x [CHANGED: b] version: 2"),
    ]
    df = spark.createDataFrame(rows, "t string, p string, c string").withColumn("n", content_notes(F.col("t"), F.col("p"), F.col("c"))).withColumn("m", largest_percent(F.col("n")))
    got = [r["n"] for r in df.collect()]
    assert got[0] == ["Quantity increase: bolt (5 → 9 units)", "Price adjustment: bolt ($2.00 → $2.50)", "New item added: rush delivery fee (Quantity: 1 units)", "Total cost change: $1,000.00 → $1,259.00 (+25.9%)"]
    assert got[1:] == [[], ["Monthly fee changed: $1,000 → $900 (+$-100)", "New provision added: clause"], [], ["Change noted: new", "Change noted: changed: b", "Document version: 2"]]
    assert df.first()["m"] == 25.9


def test_revisions_are_grouped_by_what_they_are_about(spark):
    names = ["Prescription_PAT01001_v1.txt", "Prescription_PAT01001_other_v2.txt", "Prescription_PAT09999_v1.txt"]
    rows = [("a", i, "PRESCRIPTION_UPLOADED", float(i), f"Document {n} uploaded.") for i, n in enumerate(names)]
    got = revisions.revision_rows(spark.createDataFrame(rows, "lifecycle_id string, event_id long, event_type string, ts double, summary string")).collect()
    assert [r["event_id"] for r in sorted(got, key=lambda r: r["n"])] == [0, 1] and revisions.revision_changes(spark.createDataFrame(got)).first()["note"] is None


def test_files_are_matched_by_name_then_order(spark):
    names = spark.createDataFrame([("a", "x_v1.txt"), ("a", "plan_v2.txt"), ("b", "none.txt")], "lifecycle_id string, file_name string")
    files = spark.createDataFrame([("a", "7_X_v1.txt", 1, "t7"), ("a", "x_v1.txt", 2, "t1"), ("a", "Plan_v1.txt", 3, "p"), ("a", "plan.txt", 4, "q")], "lifecycle_id string, stored_name string, seq int, text string")
    assert {r["file_name"]: r["text"] for r in revisions.match_files(names, files).collect()} == {"x_v1.txt": "t1", "plan_v2.txt": "p"}


@pytest.mark.parametrize("text,want", [("1 + 2 * 3", 7.0), ("(4 - 1) / 2", 1.5), ("7 % 4", 3.0), ("1 / 0", None), ("2 ** 99", None), ("__import__('os')", None), ("1 +", None)])
def test_arithmetic_is_only_arithmetic(text, want):
    from docweave.operators.answering import evaluate

    assert evaluate(text) == want


def test_rerank_takes_any_scorer(spark):
    from docweave.operators import answering

    rows = spark.createDataFrame([(1, "a b", i, "d", "a " * i, i) for i in range(1, 5)], "query_id long, query string, chunk_id long, doc_key string, text string, rank int")
    longest = answering.typed_scorer(lambda q, t: t.str.len().astype("float64"))
    ids = lambda df: [r["chunk_id"] for r in df.orderBy("rank").collect()]
    assert ids(answering.rerank(rows, 2, longest)) == [4, 3] and ids(answering.rerank(rows, 2, None)) == [1, 2] and ids(answering.rerank(rows, 3)) == [1, 2, 3]


def test_pii_is_masked_once(spark):
    rows = spark.createDataFrame([("mail a.b@x.org, 10.0.0.1, 555-123-4567, 123-45-6789",)], "t string")
    first = security.mask_pii(rows, "t").first()
    assert first["masked"] == "mail [EMAIL_REDACTED], [IP_ADDRESS_REDACTED], [PHONE_REDACTED], [SSN_REDACTED]"
    again = security.mask_pii(spark.createDataFrame([(first["masked"],)], "t string"), "t").first()
    assert again["masked"] == first["masked"] and again["pii"] == []


def test_retry_back_off(spark):
    src = spark.createDataFrame([(i, "high", "active", 0.0, i, None) for i in range(3)], "source_id int, priority string, status string, next_scheduled double, retry_count int, update_frequency int")
    bad = spark.createDataFrame([(i, False) for i in range(3)], "source_id int, ok boolean")
    got = {r["source_id"]: (r["status"], r["next_scheduled"]) for r in cdc.after_run(src, bad, 1000.0).collect()}
    assert got == {0: ("active", 1060.0), 1: ("active", 1300.0), 2: ("error", 0.0)}


def test_hops_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("c", "R", "a"), ("c", "R", "d")], "from_node string, relation string, to_node string")
    start = spark.createDataFrame([("a",)], "name string")
    walk = lambda **k: {r["name"]: r["hop"] for r in graph.hops(edges, start, 3, **k).collect()}
    assert walk() == {"a": 0, "b": 1, "c": 1, "d": 2} and walk(directed=True) == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_entities(spark):
    text = "Contract No: C-511047 starts 2019-11-01 and ends 12/31/2020, for $1,200.50, with Acme Widgets Inc"
    found = graph.entities(spark.createDataFrame([("d", text)], "doc_key string, text string")).first()
    assert found["contracts"] == ["C-511047"] and found["dates"] == ["12/31/2020", "2019-11-01"] and "1,200.50" in found["amounts"] and found["organizations"][0].endswith("Acme Widgets Inc")


def test_risk_bounds(spark, sf):
    got = lifecycle.risk(lifecycle_events(spark, sf)).agg(F.min("risk_score"), F.max("risk_score")).first()
    assert 0.2 <= got[0] <= got[1] <= 0.95


def test_rejected_requests_do_not_count(spark):
    rows = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 1, 2, 3, 59, 60, 61, 62])], "user_id long, request_id long, s double")
    got = security.admitted(rows.select("user_id", "request_id", F.timestamp_seconds("s").alias("ts"), F.lit("user").alias("role")), 2, 60).collect()
    assert {r["request_id"]: r["allowed"] for r in got} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hällo")
    (tmp_path / "b.csv").write_text('x,"y, ""z""\nw"\n1,2\n')
    (tmp_path / "c.json").write_text('{"k": 1, "l": "v"}')
    (tmp_path / "d.json").write_text("[1, 2]")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files._W[1:-1]}"><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p/></w:document>')
    (tmp_path / "f.pdf").write_bytes(b"%PDF-junk")
    got = {r["file_name"]: r["text"] for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "hällo", "b.csv": 'x | y, "z"\nw\n1 | 2', "c.json": "k: 1\nl: v", "d.json": "1\n2", "e.docx": "One two", "f.pdf": None}
    assert files.list_files(spark, str(tmp_path)).count() == 6


def test_error_log(spark, tmp_path):
    lines = [json.dumps({"ts": f"2024-01-0{i} 00:00:00", "level": "ERROR" if i % 2 else "INFO", "source": "s", "message": str(i)}) for i in range(1, 6)]
    (tmp_path / "log.jsonl").write_text("\n".join([*lines, "{broken"]))
    assert [r["message"] for r in files.read_error_log(spark, str(tmp_path), "ERROR", 2).collect()] == ["5", "3"]


def test_last_entry_of_a_feed_counts(spark):
    known = spark.createDataFrame([(1, "a.pdf", 5)], "item_id long, name string, size long").withColumn("modified", F.to_timestamp(F.lit("2024-01-01")))
    feed = [(1, 1, "b.pdf", False, False, 6), (1, 2, "c.pdf", False, False, 7), (2, 1, "n.pdf", False, False, 1), (2, 3, "n.pdf", True, False, 1)]
    delta = spark.createDataFrame(feed, "item_id long, seq int, name string, deleted boolean, is_folder boolean, size long").withColumn("modified", F.to_timestamp(F.lit("2024-02-01")))
    assert [(r["item_id"], r["name"]) for r in cdc.apply_delta(known, delta, "seq").collect()] == [(1, "c.pdf")]


def test_sources_are_controlled_and_dispatched(spark):
    rows = [(i, "u%d" % i, "website", "high", "active", 5.0, None) for i in range(4)]
    src = spark.createDataFrame(rows, "source_id int, url string, source_type string, priority string, status string, next_scheduled double, update_frequency int")
    said = spark.createDataFrame([(0, 1, "pause"), (1, 1, "pause"), (1, 2, "trigger"), (2, 1, "unregister")], "source_id int, seq int, command string")
    got = {r["source_id"]: (r["status"], r["next_scheduled"]) for r in cdc.control(src, said, 9.0).collect()}
    assert got == {0: ("paused", 5.0), 1: ("active", 9.0), 3: ("active", 5.0)}
    assert {r["next_scheduled"] for r in cdc.dispatch(src, 10.0).collect()} == {610.0}
    crawls = spark.createDataFrame([("u1", "done"), ("v", "done"), ("w", "running")], "url string, status string")
    assert [r["url"] for r in cdc.finished_crawls(crawls, src).collect()] == ["v"]


def test_grounding_of_short_and_missing(spark):
    answers = spark.createDataFrame([(1, "The quick brown fox jumps. Ok."), (2, "Short."), (3, "The quick brown fox jumps."), (4, "")], "answer_id long, text string")
    contexts = spark.createDataFrame([(1, i, c) for i, c in enumerate(["no", "none", "nothing", "the quick brown fox jumps"])] + [(2, 1, "x"), (4, 1, "x")], "answer_id long, rank int, context string")
    got = {r["answer_id"]: (r["sentences"], r["score"]) for r in retrieval.grounding(answers, contexts).collect()}
    assert got == {1: (1, 0.0), 2: (0, 1.0), 3: (0, 0.0), 4: (0, 0.0)}
    assert {r["score"] for r in retrieval.grounding(answers, contexts, scorer=None).where("answer_id < 3").collect()} == {1.0}


def test_streams_equal_batch(spark, sf, tmp_path):
    batch = lifecycle_events(spark, sf).withColumn("user_id", F.substring_index("lifecycle_id", "-", 1).cast("long"))
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    live = stream.read_events(spark, str(tmp_path / "in"), batch.schema)

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name)

    counts = run(stream.windowed_counts(live), "w", "complete")
    want = batch.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert counts.exceptAll(want).isEmpty() and want.exceptAll(counts).isEmpty()
    status = run(stream.status_stream(live), "s", "update").select("lifecycle_id", "status", "reopen_count")
    assert status.exceptAll(lifecycle.status_fold(batch).select("lifecycle_id", "status", "reopen_count")).isEmpty() and status.count() > 0
    requests = live.select("user_id", F.col("event_id").alias("request_id"), "ts")
    got = run(stream.admission_stream(requests, 3, 3600), "a", "append")
    same = security.admitted(batch.select("user_id", F.col("event_id").alias("request_id"), "ts", F.lit("user").alias("role")), 3, 3600).select("user_id", "request_id", "allowed")
    assert got.exceptAll(same).isEmpty() and got.count() == same.count()
    assert run(stream.sessions(live), "v", "complete").agg(F.sum("n")).first()[0] == batch.count()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    made = registry.QUERIES[name](spark, sf)
    rows = [tuple(r[c] for c in sorted(made.columns)) for r in made.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    want = duck.sql(registry.ORACLES[name])
    columns = want.columns
    asked = [tuple(r[columns.index(c)] for c in sorted(columns)) for r in want.fetchall()]
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    assert sorted(made.columns) == sorted(columns)
    assert sorted([tuple(map(plain, r)) for r in rows], key=str) == sorted([tuple(map(plain, r)) for r in asked], key=str)
