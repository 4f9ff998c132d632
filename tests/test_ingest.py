"""The ingest flow and the tables around it on odd rows."""

from pyspark.sql import functions as F

from docweave.operators import documents as D
from docweave.operators import ingest as I


def test_every_upload_gets_a_status(spark):
    known, other = "Known text of a contract.", "Another text."
    up = [("a/b.txt", known), ("a\\c.md", other), ("x.exe", "t"), ("noext", "t"), ("e.txt", "  "), (None, "t"), ("n.txt", None), ("new.TXT", "For immediate release: " + "w " * 3000), ("new.TXT", "For immediate release: " + "w " * 3000)]
    registry = spark.createDataFrame([("a__b.txt", known, 3), ("a__c.md", "older", 5)], "doc_key string, t string, version int").select("doc_key", D.text_hash(F.col("t")).alias("content_hash"), "version")
    files, chunks = I.ingest(spark.createDataFrame(up, "file_name string, text string"), registry)
    got = sorted((r["file_name"] or "", r["status"], r["version"], r["n_chunks"], tuple(r["roles"])) for r in files.collect())
    admin, everyone = ("admin",), ("public", "user", "admin")
    assert got == sorted([
        ("a/b.txt", "unchanged", 3, 0, ()), ("a\\c.md", "updated", 6, 1, admin), ("x.exe", "skipped", None, 0, ()), ("noext", "skipped", None, 0, ()), ("e.txt", "skipped", None, 0, ()),
        ("", "skipped", None, 0, ()), ("n.txt", "skipped", None, 0, ()), ("new.TXT", "new", 1, 4, everyone),
    ])
    assert {r["stored_as"] for r in chunks.collect()} == {"a__c.md", "new.TXT"} and chunks.count() == 5
    none, no_chunks = I.ingest(spark.createDataFrame([], "file_name string, text string"), registry)
    assert none.count() == 0 and no_chunks.count() == 0


def test_names_cards_feedback_and_sites(spark):
    docs = spark.createDataFrame([(1, "None", ""), (2, "", None), (3, "own", "T"), (4, None, None)], "doc_id long, file_name string, doc_type string")
    indexed = spark.createDataFrame([(1, "b"), (1, "a"), (2, "None")], "doc_id long, file_name string")
    stored = spark.createDataFrame([("2_x_y.pdf",), ("9_z",)], "stored_name string")
    assert sorted(map(tuple, I.file_names(docs, indexed, stored).collect())) == [(1, "a", "Document"), (2, "x_y.pdf", "Document"), (3, "own", "T")]

    documents = spark.createDataFrame([(i, "F%d.txt" % i, None, "l1", ["e"] * 7, "body" * 600 if i % 2 else None) for i in range(8)], "doc_id long, file_name string, doc_type string, lifecycle_id string, entities array<string>, text string")
    asked = spark.createDataFrame([(1, "with hits"), (2, "f3.TXT"), (3, "l1"), (4, "   l1"), (5, None)], "query_id long, query string")
    hits = spark.createDataFrame([(1, i, float(i)) for i in range(7)], "query_id long, doc_id long, score double")
    got = {}
    for r in I.document_cards(hits, asked, documents).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r
    assert [got[1][k]["doc_id"] for k in sorted(got[1])] == [6, 5, 4, 3, 2] and [r["doc_id"] for r in got[2].values()] == [3]
    assert set(got) == {1, 2}  # two characters are too few, and no name holds the blanks
    assert got[1][2]["card"] == "Document: F5.txt\nType: Document\nLifecycle: l1\nContent:\n" + ("body" * 600)[:2000] + "\nEntities: e, e, e, e, e"
    assert got[1][1]["card"].startswith("Document: F6.txt | type=Document") and got[1][1]["snippet"] == "type=Document, lifecycle=l1"

    log = spark.createDataFrame([(1, "q", "a" * 600, None), (2, "q", "b", "negative")], "log_id long, question string, answer string, feedback string")
    given = spark.createDataFrame([(1, 1, 9, "negative", None), (1, 2, 9, "positive", "c"), (2, 1, 9, "maybe", None), (3, 1, 9, "positive", None)], "log_id long, seq int, user_id long, feedback string, comment string")
    updated, records = I.record_feedback(log, given)
    assert sorted((r["log_id"], r["feedback"]) for r in updated.collect()) == [(1, "positive"), (2, "negative")]
    assert sorted((r["log_id"], r["seq"], len(r["answer"])) for r in records.collect()) == [(1, 1, 500), (1, 2, 500)]

    urls = spark.createDataFrame([("https://h.com/sites/a?x",), ("http://h.com/sites/a",), (None,)], "u string")
    assert [tuple(r) for r in urls.select(*I.site_of(F.col("u"))).collect()] == [("h.com", "a"), (None, None), (None, None)]
    moments = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.25+02:00",), ("2024-01-02",), ("2024-13-02",), ("x",), (None,)], "t string")
    assert [str(r[0]) for r in moments.select(I.moment_of(F.col("t"))).collect()] == ["2024-01-02 03:04:05", "2024-01-02 03:04:05.250000", "2024-01-02 00:00:00", "None", "None", "None"]


def test_seeds_come_in_the_order_of_the_maps(spark):
    loc = lambda *urls: "".join(f"<loc> {u} </loc>" for u in urls)
    index = "".join(f"<sitemap><loc>https://a/m{i}.xml</loc></sitemap>" for i in range(7))
    fetched = [
        ("https://a/sitemap.xml", "<html>no map</html>"), ("https://a/sitemap_index.xml", index + loc("https://a/own")), ("https://a/robots.txt", "Sitemap: https://a/other.xml"), ("https://a/other.xml", loc("https://a/never")),
        *[(f"https://a/m{i}.xml", loc(f"https://a/p{9 - i}", "https://a/own")) for i in range(7)],
        ("https://b/robots.txt", "User-agent: *\nSITEMAP: https://b/two.xml\nsitemap:https://b/one.xml"), ("https://b/one.xml", loc("https://b/1")), ("https://b/two.xml", loc("https://b/2", "ftp://x", "https://b/1")), ("https://c/sitemap.xml", None),
        ("https://d/sitemap.xml", "<sitemap><loc>https://d/sitemap.xml</loc></sitemap>"),
    ]
    sites = spark.createDataFrame([(f"https://{s}",) for s in "abcde"], "site string")
    got = {}
    for r in D.site_seeds(sites, spark.createDataFrame(fetched, "url string, text string")).orderBy("site", "seq").collect():
        got.setdefault(r["site"][-1], []).append(r["url"].removeprefix(r["site"] + "/"))
    assert got == {"a": [*[f"m{i}.xml" for i in range(7)], "own", "p9", "p8", "p7", "p6", "p5"], "b": ["2", "1"], "d": ["sitemap.xml"]}


def test_changes_have_the_notes_of_their_contents(spark):
    from docweave.operators import diffs, revisions

    up = [("l", i, "PURCHASE_ORDER_UPLOADED", f"2024-01-0{i}", f"Document PO_2024_A_v{i}.txt uploaded.") for i in range(1, 4)]
    events = spark.createDataFrame(up, "lifecycle_id string, event_id long, event_type string, ts string, summary string").withColumn("ts", F.to_timestamp("ts"))
    texts = spark.createDataFrame([("l", "PO_2024_A_v1.txt", "Timeline: 9 days"), ("l", "PO_2024_A_v2.txt", "Timeline: 4 days"), ("l", "PO_2024_A_v2.txt", None)], "lifecycle_id string, file_name string, text string")
    got = diffs.change_records(revisions.revision_rows(events), texts).orderBy("n").collect()
    assert [r["details"] for r in got] == [["Timeline compressed: 9 days → 4 days"], ["Version updated: v2 → v3"]]


def test_words_added_to_an_upload_do_not_change_its_class(spark, tmp_path):
    import duckdb

    from docweave.plans import ingest

    text = "liability warranty " + " ".join(f"w{i}" for i in range(97))  # two key words of 99, less than the least share with two words more
    docs = [(33, text, "en", "src1"), (22, text, "en", "src1"), (44, text, "en", "src1"), (9, text, "en", "src1"), (66, None, "en", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, ingest.ingested_files(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(ingest.ORACLES["ingested_files"]).fetchall())
    assert {(r[0], r[5]) for r in got if r[2] in ("new", "updated")} == {("in/src1/33.TXT", "legal"), ("in/src1/44.TXT", "legal"), ("in/src1/9.TXT", "legal")}
