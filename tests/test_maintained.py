"""Versioned tables, restartable feeds, kept postings, containment joins, entity classes, word boundaries."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docweave.operators import answering as A
from docweave.operators import cdc, graph, postings
from docweave.operators import retrieval as R
from docweave.operators.containment import contained
from docweave.sources import shared, versioned
from docweave.streaming import sync

FILES = "item_id long, name string, size long, modified timestamp"
DELTA = "item_id long, name string, deleted boolean, is_folder boolean, size long, modified timestamp"


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def known(spark, n=40):
    return spark.range(n).select(F.col("id").alias("item_id"), F.concat(F.lit("f"), "id", F.lit(".pdf")).alias("name"), (F.col("id") * 3).alias("size"), F.lit("2024-01-01").cast("timestamp").alias("modified"))


def delta(spark, lo, hi):
    i = F.col("id")
    return spark.range(lo, hi).select(
        i.alias("item_id"), F.concat(F.lit("f"), "id", F.when(i % 5 == 0, "b.pdf").otherwise(".pdf")).alias("name"), (i % 3 == 0).alias("deleted"), (i % 11 == 0).alias("is_folder"),
        (i * 3 + F.when(i % 4 == 0, 1).otherwise(0)).alias("size"), F.lit("2024-01-01").cast("timestamp").alias("modified"),
    )


def test_readers_see_whole_versions(spark, monkeypatch):
    path = shared.new_folder(spark, "t")
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, path)
    first = versioned.write(known(spark), path, "item_id", buckets=4)
    before = rows_of(versioned.read(spark, path), "item_id", "size")

    def stops(*_, **__):
        raise OSError("lost before the manifest")

    with monkeypatch.context() as m:
        m.setattr(versioned, "commit", stops)
        with pytest.raises(OSError):
            versioned.write(known(spark, 5), path, "item_id")
    assert versioned.versions(spark, path) == [first] and rows_of(versioned.read(spark, path), "item_id", "size") == before
    shared._at(spark, f"{path}/manifest/{7:012d}")[0].create(shared._at(spark, f"{path}/manifest/{7:012d}")[1]).close()  # a manifest cut short
    assert rows_of(versioned.read(spark, path), "item_id", "size") == before
    second = versioned.write(known(spark, 5), path, "item_id", buckets=4)
    assert second == 8 and versioned.read(spark, path).count() == 5 and versioned.read(spark, path, first).count() == 40
    with pytest.raises(FileExistsError):
        versioned.commit(spark, path, {}, after=first)  # another writer was faster
    versioned.rollback(spark, path, first)
    assert rows_of(versioned.read(spark, path), "item_id", "size") == before
    assert versioned.vacuum(spark, path, keep=1) == 2 and rows_of(versioned.read(spark, path), "item_id", "size") == before
    assert versioned.versions(spark, path) == [9]


def test_a_write_names_only_its_buckets(spark):
    path = shared.new_folder(spark, "t")
    versioned.write(known(spark), path, "item_id", buckets=8)
    old = versioned.manifest(spark, path)["buckets"]
    bucket = versioned.read(spark, path).select(versioned.bucket_of("item_id", 8)).first()[0]
    versioned.write(versioned.read(spark, path, only=[bucket]).withColumn("size", F.lit(-1).cast("long")), path, "item_id", only=[bucket])
    new = versioned.manifest(spark, path)["buckets"]
    assert {b for b in new if new[b] != old.get(b)} == {str(bucket)} and versioned.read(spark, path).count() == 40
    assert versioned.read(spark, path).where("size = -1").count() == versioned.read(spark, path, only=[bucket]).count()


@pytest.mark.parametrize("stop_after", ["sink", "start"])
def test_feed_goes_on_where_it_stopped(spark, stop_after):
    """The stream dies between sink and checkpoint (or before the sink); the batch comes again and changes nothing."""
    path = shared.new_folder(spark, "sync")
    versioned.write(known(spark), f"{path}/table", "item_id", buckets=4, tag=-1)
    feed = [delta(spark, 10 * k, 10 * k + 14) for k in range(5)]  # items come again in later files
    seen = []

    def run(fail_at):
        schema = feed[0].schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/feed")

        def after(batch):
            seen.append(batch)
            if batch == fail_at and stop_after == "sink":
                raise RuntimeError("stopped")

        query = sync.sync_files(stream, f"{path}/table", f"{path}/state", after=after)
        try:
            query.awaitTermination()
        except Exception as error:
            assert "stopped" in str(error)

    for k, part in enumerate(feed[:3]):
        part.coalesce(1).write.mode("append").parquet(f"{path}/feed")
    run(fail_at=1)
    for part in feed[3:]:
        part.coalesce(1).write.mode("append").parquet(f"{path}/feed")
    run(fail_at=None)
    want = known(spark)
    for part in feed:
        want = spark.createDataFrame(cdc.apply_delta(want, part).collect(), FILES)
    assert rows_of(versioned.read(spark, f"{path}/table"), "item_id", "name", "size") == rows_of(want, "item_id", "name", "size")
    assert sorted(seen) == list(range(5)) if stop_after == "start" else sorted(set(seen)) == list(range(5))
    assert not sync.merge_batch(feed[0], 2, f"{path}/table")  # a batch of long ago
    assert [r["tag"] for r in sync.history(spark, f"{path}/table").orderBy("version").collect()] == [-1, 0, 1, 2, 3, 4]


def chunks_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, f"d{i % 3}", t) for i, t in enumerate(texts)], "chunk_id long, doc_key string, text string")


def texts(seed, n):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(["und", "die", "Kinder", "é", "license", "of", "x_1", f"w{rnd.randrange(30)}"]) for _ in range(rnd.randrange(0, 25))) or None for _ in range(n)]


def test_kept_postings_score_as_bm25(spark):
    path = shared.new_folder(spark, "p")
    queries = spark.createDataFrame([(1, "die Kinder of w3 w3"), (2, "UND é nothing"), (3, "")], "query_id long, query string")

    def same(now):
        want = rows_of(R.bm25(now, queries), "query_id", "chunk_id", "doc_key", "score")
        got = rows_of(postings.search(spark, path, queries), "query_id", "chunk_id", "doc_key", "score")
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want)) and got

    with pytest.raises(FileNotFoundError):
        postings.search(spark, path, queries)
    now = chunks_of(spark, texts(1, 40))
    assert postings.maintain(spark, path, now, at=0.0, buckets=4) == "built"
    same(now)
    assert postings.maintain(spark, path, now, at=60.0) == "kept"
    now = now.unionByName(chunks_of(spark, texts(2, 20), first=100))
    assert postings.maintain(spark, path, now, at=120.0) == "refreshed"
    same(now)
    now = now.where("chunk_id % 4 <> 1")  # smaller: only age makes it stale
    assert postings.maintain(spark, path, now, at=130.0) == "kept" and postings.maintain(spark, path, now, at=9000.0) == "refreshed"
    same(now)
    changed = now.where("chunk_id % 3 = 0").withColumn("text", F.lit("Die neue license of w3"))
    postings.refresh(spark, path, changed, changed.select("chunk_id"), at=9001.0)
    same(now.where("chunk_id % 3 <> 0").unionByName(changed))


def test_kept_postings_merge_and_push_down(spark, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENTS", 2)
    path = shared.new_folder(spark, "p")
    for k in range(4):
        postings.refresh(spark, path, chunks_of(spark, texts(k, 10), first=100 * k), buckets=4)
    assert len(versioned.manifest(spark, path)["segments"]) <= 2
    queries = spark.createDataFrame([(1, "license w3")], "query_id long, query string")
    now = chunks_of(spark, texts(0, 10))
    for k in range(1, 4):
        now = now.unionByName(chunks_of(spark, texts(k, 10), first=100 * k))
    assert rows_of(postings.search(spark, path, queries), "query_id", "chunk_id") == rows_of(R.bm25(now, queries), "query_id", "chunk_id")
    found = postings.search(spark, path, queries)
    plan = found._jdf.queryExecution().toString()
    assert "In(term, [license,w3])" in plan.replace("w3,license", "license,w3") and "PartitionFilters: [" in plan and "bucket" in plan
    monkeypatch.setattr(postings, "BROADCAST_TERMS", 1)  # as many terms as cannot be named are joined
    assert rows_of(postings.search(spark, path, queries), "chunk_id", "score") == rows_of(found, "chunk_id", "score")


@pytest.mark.parametrize("seed", range(4))
def test_contained_is_brute_force(spark, seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcé_") for _ in range(n))
    short = [(i, rnd.choice([None, "", word(1), word(2), word(3), word(4), word(6), "abc" * 3])) for i in range(30)] + [(3, "ab"), (99, "zzzz")]
    long = [(i % 25, rnd.choice([None, "", word(2), word(12), word(40), "abc" * 9])) for i in range(30)]
    want = {(i, j) for i, s in short for j, t in long if s and t and s in t}
    a, b = spark.createDataFrame(short, "short_id long, s string"), spark.createDataFrame(long, "long_id long, t string")
    pairs = contained(a, b)
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert contained(a.limit(0), b).count() == 0 and contained(a, b.limit(0)).count() == 0


def test_files_without_a_long_word_are_mentioned(spark):
    from docweave.operators.context import mentioned_files

    names = spark.createDataFrame([("a_b.txt",), ("p7.xml",), ("p70.xml",), ("annual_report.pdf",)], "doc_key string")
    asked = spark.createDataFrame([(1, "read A_B now"), (2, "xp70"), (3, "the report of annual"), (4, "report"), (5, None)], "query_id long, query string")
    assert rows_of(mentioned_files(asked, names), "query_id", "doc_key", "score") == [(1, "a_b.txt", 1.0), (2, "p7.xml", 1.0), (3, "annual_report.pdf", 1.0)]


def test_all_neighbours_of_a_document(spark):
    rnd = random.Random(4)
    rows = [(f"d{rnd.randrange(12)}", f"e{rnd.randrange(20)}") for _ in range(60)] + [(f"d{i}", "hub") for i in range(12)] * 2
    mentions = spark.createDataFrame(rows, "source string, entity string")
    names = {}
    for d, e in rows:
        names.setdefault(d, set()).add(e)
    for d in ("d0", "d5", "absent"):
        want = sorted((o, len(names.get(d, set()) & names[o])) for o in names if o != d and names.get(d, set()) & names[o])
        assert rows_of(graph.entity_neighbours(mentions, d), "document", "shared") == want
    classes = {r["entity"]: (r["members"], r["links"]) for r in graph.entity_classes(mentions).collect()}
    assert classes["hub"] == (12, 66)


def test_words_end_at_letters_of_any_script(spark):
    asked = ["list all filesÇê dans", "list all files dans", "éshow log", "show log", "show logé", "la évalue"]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert [r[0] for r in df.select(A.admin_intent(F.col("q"))).collect()] == [None, "file_list", None, "log_view", None, None]
    flags = df.select(A.query_flags(F.col("q"))["needs_graph"].alias("g")).collect()
    assert not flags[-1]["g"]
    parts = spark.createDataFrame([("a éand b and c",)], "q string").select(A.question_parts(F.col("q"))).first()[0]
    assert parts == ["a éand b", "c"]


@pytest.mark.parametrize("seed", range(5))
def test_automaton_counts_as_replace_does(seed):
    from docweave.operators.automaton import counter

    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("ab é") for _ in range(n))
    families = [tuple(word(rnd.randrange(1, 5)) for _ in range(6)) for _ in range(4)] + [("aa", "aa", "a"), ()]
    whole = [("ab", "b"), ("é",)]
    count = counter(families, whole)
    for _ in range(60):
        text = "".join(rnd.choice("aab é_.\n") for _ in range(rnd.randrange(0, 60)))
        want = [sum((len(text) - len(text.replace(w, ""))) // len(w) for w in words) for words in families]
        bounded = lambda w: sum(text.startswith(w, i) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")) and not (i + len(w) < len(text) and (text[i + len(w)].isalnum() or text[i + len(w)] == "_")) for i in range(len(text)))
        want += [sum(map(bounded, words)) for words in whole]
        assert count(text) == [*want, len(text.split())], text
    assert counter([])("a b") == [2]


def test_routed_notes_are_content_notes(spark):
    from docweave.operators import diffs

    kinds = ["Purchase Order", "change order", "Prescription", "Offer Letter", "Proposal", "expense report", "Contract", "Patient Record", "LAB result", "memo", "", None]
    texts = [("total: $100.00\n1. bolt qty: 2 @ $3.00", "total: $150.00\n1. bolt qty: 5 @ $3.00"), ("version v1 [changed]", "version v2 [changed] [new]"), ("", "x"), (None, "y")]
    rows = spark.createDataFrame([(i, k, p, c) for i, (k, (p, c)) in enumerate((k, t) for k in kinds for t in texts)], "id long, doc_type string, prev string, curr string")
    got = rows_of(diffs.routed_notes(rows), "id", "notes")
    assert got == rows_of(rows.withColumn("notes", F.coalesce(diffs.content_notes(F.col("doc_type"), F.col("prev"), F.col("curr")), F.array().cast("array<string>"))), "id", "notes")
    assert len(got) == rows.count()


def brute_context(rows):
    """The passages' context by hand: rows in rank order, dicts with text, score, doc_key, source_type, url and page fields."""
    import re

    rows = [r for r in rows if r["score"] >= 0] or rows
    grams = lambda t: {t.lower()[:500][i : i + 3] for i in range(len(t[:500]) - 2)}
    kept = []
    for r in rows:
        a = grams(r["text"])
        if not any(a and grams(k["text"]) and len(a & grams(k["text"])) / len(a | grams(k["text"])) > 0.85 for k in kept):
            kept.append(r)
    first, seen = [], {}
    for r in kept:
        page = r["source_type"] == "website"
        key = (page, r["url"] if page and r["url"] is not None else r["doc_key"])
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= (1 if page else 2):
            first.append(r)
    picked = (first + [r for r in kept if r not in first])[:8]
    share, parts, sources = 8000 // len(picked), [], []
    for i, r in enumerate(picked):
        text = r["text"]
        if len(text) > share:
            sentences = re.split(r"(?<=[.!?])\s+", text.strip(" "))
            left, chosen = share - len(sentences[0]), {0}
            for n in sorted(range(1, len(sentences)), key=lambda n: (-len(sentences[n]), n)):
                if left > 0 and len(sentences[n]) <= left:
                    left -= len(sentences[n]) + 1
                    chosen.add(n)
            text = " ".join(sentences[n] for n in sorted(chosen))
        page = r["source_type"] == "website"
        if page:
            head = [f"[Website] {r['org_name'] + ': ' if r['org_name'] else ''}{r['title']}"] if r["title"] else []
            head += [f"URL: {r['url']}"] if r["url"] else []
            contact = " | ".join([f"Phone: {r['phone']}"] * bool(r["phone"]) + [f"Email: {r['email']}"] * bool(r["email"]))
            head += [f"Contact: {contact}"] if contact else []
            text = "\n".join(head) + ("\n\n" if head else "") + text
        parts.append(text)
        sources.append(r["url"] if page and r["url"] else f"{r['doc_key']}{' (line ' + str(r['line_start']) + ')' if r['line_start'] else ''}" if r["doc_key"] not in (None, "unknown") else f"Document chunk {i + 1}")
    whole = "\n\n---\n\n".join(parts)
    return whole[:8000] + "\n[Context truncated]" * (len(whole) > 8000), sources


@pytest.mark.parametrize("seed", range(4))
def test_contexts_are_as_by_hand(spark, seed):
    from docweave.operators import flow

    rnd = random.Random(seed)
    table, want = [], {}
    for q in range(12):
        rows = []
        for rank in range(1, rnd.randrange(2, 14)):
            text = " ".join("".join(rnd.choice("abcdefg ") for _ in range(rnd.randrange(3, 400))) + rnd.choice(".!?") for _ in range(rnd.randrange(1, 8)))
            if rows and rnd.random() < 0.3:
                text = rows[-1]["text"] + "."
            web = rnd.random() < 0.4
            rows.append({
                "query_id": q, "rank": rank, "chunk_id": 100 * q + rank, "doc_key": rnd.choice(["a.txt", "b.txt", "unknown", "c.txt"]), "text": text, "score": rnd.choice([1.0, 0.5, -0.1]) if q else -1.0,
                "source_type": "website" if web else None, "url": rnd.choice(["http://x/1", "http://x/2", ""]) if web else None, "title": rnd.choice(["Home", None]), "org_name": rnd.choice(["Org", None, ""]),
                "phone": rnd.choice(["123", None]), "email": rnd.choice(["a@b.c", None]), "line_start": rnd.choice([None, 7]),
            })
        table += rows
        want[q] = brute_context(rows)
    columns = "query_id long, rank int, chunk_id long, doc_key string, text string, score double, source_type string, url string, title string, org_name string, phone string, email string, line_start int"
    df = spark.createDataFrame([tuple(r.values()) for r in table], columns)
    got = {r["query_id"]: (r["context"], r["sources"]) for r in flow.build_context(flow.select_passages(df)).collect()}
    assert got == want
    assert flow.build_context(flow.select_passages(df.limit(0))).count() == 0


def test_questions_keep_their_rows(spark):
    from docweave.operators import flow

    chunks = spark.createDataFrame([(1, "a.txt", "The licence of node:7 is open. It ends soon.", ["user", "admin"]), (2, "b.txt", "secret licence", ["admin"])], "chunk_id long, doc_key string, text string, access_roles array<string>")
    for i in range(3, 9):
        chunks = chunks.unionByName(spark.createDataFrame([(i, "z", f"other words x{i}x", ["user"])], chunks.schema))
    edges = spark.createDataFrame([("node:7", "OWNS", "node:9")], "from_node string, relation string, to_node string")
    asked = spark.createDataFrame([(1, "What is the licence of NODE:7?"), (2, "nothing here matches qqq"), (3, None)], "query_id long, query string")
    got = {r["query_id"]: r for r in flow.ask(asked, chunks, edges, "user").collect()}
    assert sorted(got) == [1, 2, 3] and got[1]["sources"] == ["a.txt"] and got[1]["query_type"] == "fact"
    assert got[1]["context"].startswith("[Knowledge Graph]\nnode:7 --[OWNS]--> node:9\n\n[Documents]\nThe licence") and got[1]["confidence"] == 93
    assert not got[2]["accessible"] and got[2]["context"] == "" and not got[3]["accessible"]


def run_stream(spark, df, mode, path):
    from docweave.streaming import stateful

    stateful.use_rocksdb(spark)
    rows = []
    query = df.writeStream.outputMode(mode).foreachBatch(lambda out, _: rows.extend(map(tuple, out.collect()))).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return rows


def live(spark, rows, schema, path):
    """Rows as a stream of one file a batch, in the order of their times, and a last batch much later."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_admission_state_goes_with_its_window(spark):
    from datetime import datetime, timedelta

    from docweave.operators import security
    from docweave.streaming import stateful

    rnd, start, path = random.Random(2), datetime(2024, 1, 1), shared.new_folder(spark, "adm")
    schema = "user_id long, request_id long, ts timestamp"
    first = sorted((rnd.randrange(5), i, start + timedelta(seconds=rnd.randrange(7200))) for i in range(120))
    first.sort(key=lambda r: (r[2], r[1]))
    batches = [first[i : i + 40] for i in range(0, 120, 40)] + [[(99, 1000, start + timedelta(days=2))], [(99, 1001, start + timedelta(days=2, seconds=1))]]
    got = run_stream(spark, stateful.admissions(live(spark, batches, schema, f"{path}/in"), 3, 3600), "append", f"{path}/state")
    everything = spark.createDataFrame([r for b in batches for r in b], schema).withColumn("role", F.lit("user"))
    assert sorted(got) == sorted(map(tuple, security.admitted(everything, 3, 3600).select("user_id", "request_id", "allowed").collect()))
    stateful.use_rocksdb(spark)
    state = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", "held").load()
    assert {r["key"]["user_id"] for r in state.collect()} <= {99}  # the windows of two days before are gone
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_status_state_goes_when_done(spark):
    from datetime import datetime, timedelta

    from docweave.operators import lifecycle
    from docweave.streaming import stateful

    rnd, start, path = random.Random(3), datetime(2024, 1, 1), shared.new_folder(spark, "status")
    schema = "lifecycle_id string, event_id long, event_type string, ts timestamp"
    kinds = ["INVOICE_PAID", "CONTRACT_UPLOADED", "CHANGE_ORDER", "RISK_ALERT"]
    rows = [(f"l{rnd.randrange(6)}", i, rnd.choice(kinds), start + timedelta(minutes=i)) for i in range(90)]
    batches = [rows[i : i + 30] for i in range(0, 90, 30)] + [[("late", 500, "CHANGE_ORDER", start + timedelta(days=200))], [("late", 501, "CHANGE_ORDER", start + timedelta(days=200, seconds=9))]]
    got = run_stream(spark, stateful.statuses(live(spark, batches, schema, f"{path}/in")), "update", f"{path}/state")
    last = {r[0]: r[1:] for r in got}  # a later batch replaces an earlier one
    want = {r["lifecycle_id"]: (r["status"], r["reopen_count"]) for r in lifecycle.status_fold(spark.createDataFrame([r for b in batches for r in b], schema)).collect()}
    assert last == want
    stateful.use_rocksdb(spark)
    state = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", "status").load()
    left = {r["key"]["lifecycle_id"] for r in state.collect()}
    assert left == {k for k, v in want.items() if v[0] == "active"}  # completed ones were forgotten
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_linked_data_of_odd_blocks(spark):
    from docweave.operators.documents import linked_data

    block = lambda t: f'<script type="application/ld+json">{t}</script>'
    deep = '{"a": ' * 9 + '{"@type": "Person", "name": "too deep"}' + "}" * 9
    pages = [(1, block('{"@type": ["Person", "Chef"], "name": " Ana "}') + block("{broken") + block('[[{"@type": "Person", "name": "Bo"}, 1, "x", null]]')), (2, None), (3, "<p>none"), (4, block('{"@type": "Person", "name": 5}') + block('{"@type": "Person"}')), (5, block(deep)), (1, block('{"name": "Ana", "@type": "Person"}'))]
    df = spark.createDataFrame(pages, "page_id long, html string")
    assert rows_of(linked_data(df), "page_id", "type", "name") == [(1, "Chef", "Ana"), (1, "Person", "Ana"), (1, "Person", "Bo"), (4, "Person", "5")]
    assert linked_data(df.limit(0)).count() == 0


def test_equal_long_strings_are_looked_up_once(spark):
    from docweave.operators.containment import contained

    short = spark.createDataFrame([(1, "alpha"), (2, "alpha"), (3, "gone")], "short_id long, s string")
    long = spark.range(600).selectExpr("id as long_id", "if(id % 2 = 0, 'an alpha here', 'nothing') as t")
    pairs = contained(short, long)
    assert pairs.count() == 600 and pairs.distinct().count() == 600
    # the pieces of a text are made after equal texts have become one
    explode = next(line for line in pairs._jdf.queryExecution().optimizedPlan().toString().split("Generate explode", 1)[1].split("\n") if "Aggregate" in line or "Relation" in line or "Range" in line)
    assert "Aggregate" in explode


def test_queries_of_one_wording_are_compared_once(spark):
    from docweave.operators.context import mentioned_files

    names = spark.createDataFrame([("annual_report.pdf",), ("Annual-Report.txt",), ("report.md",)], "doc_key string")
    asked = spark.range(500).selectExpr("id as query_id", "if(id % 2 = 0, 'ANNUAL of report', 'nothing') as query")
    found = mentioned_files(asked, names)
    assert rows_of(found, "query_id", "doc_key", "score") == sorted(((i, "Annual-Report.txt", 1.0) for i in range(0, 500, 2)), key=str)
    words = [part.split("Range")[0] for part in found._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[1:]]
    assert all("Aggregate" in w for w in words)


def test_navigation_by_common_words(spark):
    from docweave.operators.context import navigation_match

    rnd, common = random.Random(5), [f"w{i}" for i in range(9)]
    pages = [(f"u{rnd.randrange(60)}", " ".join(rnd.choices(common, k=rnd.randrange(0, 7)))) for _ in range(120)]
    asked = [(i, "The " + " ".join(rnd.choices([*common, "none"], k=rnd.randrange(0, 6)))) for i in range(80)]
    want = []
    for i, q in asked:
        totals = {}
        for url, title in pages:
            if n := len((set(q.lower().split()) - {"the"}) & set(title.split())):
                totals[url] = totals.get(url, 0) + n
        if totals:
            want.append((i, *min(((-n, u) for u, n in totals.items()))[::-1]))
    got = navigation_match(spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(pages, "url string, title string"), ("the",))
    assert rows_of(got, "query_id", "url", "shared") == sorted(((i, u, -n) for i, u, n in want), key=str)
    # 6,000 titles with forty words that all have: by every word they would meet 1.4 billion times
    many = spark.range(6000).selectExpr("id as query_id", "concat_ws(' ', transform(sequence(1, 40), i -> concat('c', i)), id) as title", "concat('u', id) as url")
    began = time.perf_counter()
    got = navigation_match(many.selectExpr("query_id", "title as query"), many, ())
    assert got.where("url = concat('u', query_id) and shared = 41").count() == 6000
    assert time.perf_counter() - began < 40
