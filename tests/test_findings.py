"""Results at their edges: days told apart by fractions of a second, pages of one address, halves in percentages."""

from pyspark.sql import functions as F

from docweave.operators import cdc, diffs, portfolio
from docweave.operators import documents as D
from docweave.operators import lifecycle as L


def test_a_day_is_full_only_with_its_fraction(spark):
    rows = [("a", 1, "CHANGE_ORDER", "2024-01-01 10:00:00.900000"), ("a", 2, "NOTED", "2024-01-02 10:00:00.100000"), ("b", 3, "NOTED", "2024-01-01 10:00:00.900000"), ("b", 4, "NOTED", "2024-01-02 10:00:00.900000")]
    e = spark.createDataFrame(rows, "lifecycle_id string, event_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    days = {r["lifecycle_id"]: r["days"] for r in L.spans(e).collect()}
    assert days == {"a": 0, "b": 1}
    assert L.mean_cycle(e).first()["lifecycles"] == 1
    said = {r["lifecycle_id"]: r["sentence"] for r in L.activity(e).collect()}
    assert said == {"a": "2 events recorded.", "b": "2 events recorded over 1 days. Last activity: 2024-01-02."}
    trend = {r["lifecycle_id"]: r["score"] for r in L.risk_trend(e).where("percent = 100").collect()}
    assert trend == {"a": 0.41, "b": 0.36}
    assert [r["age"] for r in L.notifications(e.where("event_id = 1"), F.to_timestamp(F.lit("2024-01-01 10:01:00"))).collect()] == ["just now"]
    # three days but for 0.8 seconds
    late = e.withColumn("ts", F.when(F.col("event_id") == 2, F.col("ts") + F.expr("interval 2 days")).otherwise(F.col("ts"))).where("lifecycle_id = 'a'")
    none = late.limit(0).select("lifecycle_id", F.lit("hr").alias("lifecycle_type"), F.lit(0.0).alias("variance_percent"), F.lit("normal").alias("variance_status"), "ts")
    made = portfolio.full_metrics(late, none.select("lifecycle_id", "lifecycle_type"), none.select("lifecycle_id", "ts"), none.select("lifecycle_id", "variance_percent", "variance_status"), F.to_timestamp(F.lit("2024-02-01")))
    assert made.first()["cycle_time_days"] == 2 and L.metrics(late).first()["cycle_days"] == 2


def test_links_of_pages_of_one_address_count_together(spark):
    pages = spark.createDataFrame([("http://h/a", '<a href="/x"> <a href="/y">'), ("http://h/a", '<a href="/y"> <a href="/z"> <a href="http://other/">')], "url string, html string")
    got = [tuple(r) for r in D.page_links(pages).orderBy("n").collect()]
    assert got == [("http://h/a", 0, "http://h/x"), ("http://h/a", 1, "http://h/y"), ("http://h/a", 2, "http://h/z")]
    assert D.page_links(pages, most=2).count() == 2


def test_an_address_gives_all_of_its_links(spark):
    pages = spark.createDataFrame([("http://h/a", "".join(f'<a href="/p{i:03}">' for i in range(150)))], "url string, html string")
    got = [tuple(r) for r in D.page_links(pages).orderBy("n").collect()]
    assert got == [("http://h/a", i, f"http://h/p{i:03}") for i in range(150)] and D.page_links(pages, most=100).count() == 100


def test_pages_of_one_address_are_told_apart_by_their_keys(spark):
    seen = spark.createDataFrame([(1, "u", "h1"), (2, "u", "h2")], "page_id int, url string, content_hash string")
    crawled = spark.createDataFrame([(1, "u", "h1"), (2, "u", "x"), (3, "u", "h1")], "page_id int, url string, content_hash string")
    got = sorted(tuple(r) for r in cdc.page_changes(seen, crawled, ("page_id", "url")).select("page_id", "action").collect())
    assert got == [(1, "same"), (2, "changed"), (3, "new")]
    assert sorted(r["action"] for r in cdc.page_changes(seen, crawled.drop("page_id")).collect()) == ["changed", "same", "same"]


def test_halves_are_rounded_by_the_exact_value(spark):
    texts = spark.createDataFrame([("total: $800\nmonthly fee: $1", "total: $898\nmonthly fee: $1"), ("total: $1000", "total: $1001.50")], "prev string, curr string")
    notes = texts.select(F.array_join(diffs.clean(diffs.proposal((F.col("prev"), F.col("curr")))), "|").alias("n"))
    # 12.25 is exact: the half goes to the even digit; 0.15 as a binary number lies below
    want = [f"Total value changed: ${a:,.0f} → ${b:,.0f} ({(b - a) / a * 100:+.1f}%)" for a, b in ((800.0, 898.0), (1000.0, 1001.5))]
    assert [r["n"] for r in notes.collect()] == want


def test_lists_are_read_once_for_all_their_keys(spark):
    texts = (F.col("prev"), F.col("curr"))
    plan = spark.createDataFrame([("a", "b")], "prev string, curr string").select(diffs.prescription(texts).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(prev") + plan.count("regexp_extract_all(curr") <= 6


def test_names_of_files_are_reduced_before_they_meet(spark):
    from docweave.operators.revisions import match_files

    names = spark.createDataFrame([("l", "Doc-1x.txt"), ("l", "Doc-1x.txt"), ("l", "none.txt")], "lifecycle_id string, file_name string")
    files = spark.createDataFrame([("l", "77_DOC-1x.TXT", 2, "b"), ("l", "oc-1x", 1, "a"), ("m", "Doc-1x.txt", 0, "c")], "lifecycle_id string, stored_name string, seq int, text string")
    found = match_files(names, files)
    assert [tuple(r) for r in found.collect()] == [("l", "Doc-1x.txt", "oc-1x", "a")]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("regexp_replace" in j or "lower(" in j for j in joins)


def test_entities_are_read_once_for_all_relations(spark):
    from docweave.operators import graph as G

    text = "Contract No: C-77 and agreement no A-12/b dated 2024-01-05, ends 2024-03-01 for $1,200.50 and 30 USD issued by Acme Corp."
    found = G.entities(spark.createDataFrame([("d", text), ("e", None), ("f", "on 2024-01-05 for $7")], "doc_key string, text string"))
    plan = G.relations(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 10
    plan = G.relations(found, ("STARTS_ON", "HAS_AMOUNT"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 9 and "LLC" not in plan
    want = []
    for r in found.collect():
        for c in r["contracts"]:
            name = c if c.startswith("Contract") else f"Contract {c}"
            want += [(name, "Contract", "STARTS_ON", d, "Date", r["source"]) for d in r["dates"][:1]]
            want += [(name, "Contract", "ENDS_ON", d, "Date", r["source"]) for d in r["dates"][1:][-1:]]
            want += [(name, "Contract", "ISSUED_BY", o, "Organization", r["source"]) for o in r["organizations"]]
            want += [(name, "Contract", "HAS_AMOUNT", f"${a}", "Amount", r["source"]) for a in r["amounts"]]
        for column, kind in (("contracts", "Contract"), ("dates", "Date"), ("amounts", "Amount"), ("organizations", "Organization")):
            want += [(r["source"], "Document", "MENTIONS", e, kind, r["source"]) for e in r[column]]
    assert {w[2] for w in want} == set(G.RELATIONS)
    assert sorted(map(tuple, G.relations(found).collect())) == sorted(want)
    assert sorted(map(tuple, G.relations(found, ("ENDS_ON",)).collect())) == sorted(w for w in want if w[2] == "ENDS_ON")


def test_a_crawl_scores_only_what_it_meets(spark, monkeypatch):
    plans, write = [], D.checkpoint

    def noted(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(rows)

    monkeypatch.setattr(D, "checkpoint", noted)
    seeds = spark.createDataFrame([("http://h/",)], "url string")
    links = spark.createDataFrame([("http://h", "http://h/about/"), ("http://h", "http://h/x.pdf"), ("http://h/about", "http://h#top"), ("http://h/about", "http://h/blog/1"), ("http://h/x.pdf", "http://h/no")], "url string, link string")
    got = [tuple(r) for r in D.crawl(seeds, links).select("url", "depth", "seq").orderBy("seq").collect()]
    assert got == [("http://h", 0, 1), ("http://h/about", 1, 2), ("http://h/blog/1", 2, 3)]
    assert not [p for p in plans if "Join" in p and "wp-json" in p]
    pages = links.groupBy("url").agg(F.collect_list("link").alias("links"))
    assert [tuple(r) for r in D.crawl(seeds, pages, link=F.explode("links")).select("url", "depth", "seq").orderBy("seq").collect()] == got


def test_steps_of_the_model_are_sums_over_rows():
    import numpy as np

    from docweave.llm import lm_score

    rng = np.random.default_rng(3)
    d, of = rng.standard_normal((50, 5)).astype(np.float32), rng.integers(0, 50, 400)
    counts = np.array([1, 2, lm_score.SHORT, lm_score.SHORT + 1, 300, 1])
    first = np.cumsum(counts) - counts
    want = np.stack([d[of[a : a + n]].astype(float).sum(axis=0) for a, n in zip(first, counts)])
    assert np.allclose(lm_score.summed(d, of, first, counts), want, atol=1e-3)
    # a step against the plain gradient of the softmax, row by row
    table, bias = lm_score.Table(rng.standard_normal((16, 4)).astype(np.float32)), rng.standard_normal(4).astype(np.float32)
    rows, label, before = rng.integers(0, 16, (64, 3)), rng.integers(0, 4, 64), table.weights.astype(float)
    p = np.exp(before[rows].sum(axis=1) + bias)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(64), label] -= 1
    g = np.zeros((16, 4))
    np.add.at(g, rows.ravel(), np.repeat(p / 64, 3, axis=0))
    table.step(bias, rows, label)
    assert np.allclose(table.weights, before - g / np.sqrt(1e-3 + (g * g).sum(axis=1, keepdims=True)), atol=1e-4)
    assert table.updates.tolist() == np.bincount(rows.ravel(), minlength=16).tolist()


def test_links_are_counted_where_the_lists_meet(spark):
    import random
    from itertools import combinations

    from docweave.operators import graph as G

    rng = random.Random(5)
    rows = [(f"s{rng.randrange(60)}", f"e{rng.randrange(25)}") for _ in range(600)] + [(f"s{i}", "all") for i in range(60)] + [(None, "all"), ("s1", None), ("s2", None), ("alone", "one")]
    want = {}
    for e in {e for _, e in rows if e}:
        for pair in combinations(sorted({s for s, x in rows if x == e and s}), 2):
            want[pair] = want.get(pair, 0) + 1
    found = G.shared_entity_links(spark.createDataFrame(rows, "source string, to_node string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [block" in plan
    assert {(r["a"], r["b"]): r["shared"] for r in found.collect()} == want
    assert G.shared_entity_links(spark.createDataFrame([], "source string, to_node string")).count() == 0


def test_names_that_no_text_can_hold_are_not_moved(spark, monkeypatch):
    from docweave.operators import containment

    kept, write = [], containment.checkpoint

    def noted(rows):
        kept.append({r["s"] for r in rows.collect()})
        return write(rows)

    monkeypatch.setattr(containment, "checkpoint", noted)
    names = [*(f"part:{i}" for i in range(300)), "ab", "x", "zz", "", None, "what of part:11?", "part"]
    texts = ["what of part:11?", "cab", None, "", "part:2 and part:299"]
    short = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "short_id long, s string")
    long = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "long_id long, t string")
    want = sorted((i, j) for i, s in enumerate(names) for j, t in enumerate(texts) if s and t and s in t)
    assert sorted(map(tuple, containment.contained(short, long).collect())) == want
    assert len(kept) == 1 and len(kept[0]) < 12
    monkeypatch.setattr(containment, "FEW", 3)
    assert sorted(map(tuple, containment.contained(short, long).collect())) == want and len(kept) == 1


def test_postings_are_made_from_rows_of_chunks(spark, monkeypatch):
    from docweave.operators import postings
    from docweave.operators import retrieval as R
    from docweave.sources import shared

    def no_pass(*_):
        raise AssertionError("a pass over all postings")

    path = shared.new_folder(spark, "p")
    queries = spark.createDataFrame([(1, "die w3 é und"), (2, "rare")], "query_id long, query string")
    texts = ["die die w3", "é und W3 w3", None, "", "rare und", *(f"other w{i}" for i in range(9))]
    rows = [(i, f"d{i % 2}", t) for i, t in enumerate(texts)]
    make = lambda rows: spark.createDataFrame(rows, "chunk_id long, doc_key string, text string")
    found = lambda rows: sorted(map(tuple, rows.select("query_id", "chunk_id", "doc_key", "score").collect()))
    with monkeypatch.context() as during:
        during.setattr(postings, "_segments", no_pass)
        postings.refresh(spark, path, make(rows + rows[1:2]), buckets=4)  # one chunk comes twice
        for text in ("all new und", "und w3 once more"):
            changed = make([(0, "d0", text), (3, "d1", text)])
            postings.refresh(spark, path, changed, changed.select("chunk_id"))
        assert postings.refresh(spark, path, removed=make(rows[4:6]).select("chunk_id")) == len(rows) - 1
    now = make([r for r in rows + rows[1:2] if r[0] not in (0, 3, 4, 5)]).unionByName(changed)
    want, got = found(R.bm25(now, queries)), found(postings.search(spark, path, queries))
    assert [w[:3] for w in want] == [g[:3] for g in got] and want and all(abs(w[3] - g[3]) < 2e-6 for w, g in zip(want, got))


def test_pairs_of_neighbours_are_counted_exactly(spark, monkeypatch):
    """Every document's score under a model of 16 rows, which all contexts share, token by token."""
    import math
    import random
    from collections import Counter

    import numpy as np

    from docweave.llm import lm_score
    from docweave.llm._chunks import Chunk, squeeze

    rng, rnd = np.random.default_rng(4), random.Random(4)
    tables = (rng.standard_normal((16, k)).astype(np.float32) for k in (lm_score.CLASSES, lm_score.GROUPS))
    biases = (rng.standard_normal(k).astype(np.float32) for k in (lm_score.CLASSES, (lm_score.CLASSES, lm_score.GROUPS)))
    model = lm_score.Model(*tables, *biases)
    monkeypatch.setattr(lm_score, "train", lambda chunks, fresh, rounds: model)
    rows = [(i, " ".join(f"W{rnd.randrange(40)}" for _ in range(rnd.randrange(30)))) for i in range(60)] + [(60, None), (61, ""), (62, "w1 unseen w1 w2")]
    docs = {i: (t or "").lower().encode().split() + [b""] for i, t in rows}
    learnt = [docs[i] for i in docs if lm_score.learned(i)]
    count, pairs = Counter(w for ws in learnt for w in ws), Counter(p for ws in learnt for p in zip([None, *ws], ws))
    leaf, n_leaf, v_leaf = {}, Counter(), Counter()
    for ws in docs.values():
        text = b" ".join(ws)
        stream = lm_score.Stream(Chunk({"chunk": 0, "blob": squeeze(text), "ids": [0], "lengths": [len(text)]}))
        leaf.update(zip(ws, stream.leaves.tolist()))
    for w, c in count.items():
        n_leaf[leaf[w]] += c
        v_leaf[leaf[w]] += 1
    for size in (1 << 20, 200):  # one chunk and bucket, and many
        made = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk_bytes=size, bucket_bytes=max(1, size // 40), exact_over=0, prior=3.0)
        got = {r["doc_id"]: r["score"] for r in made.collect()}
        for i, ws in docs.items():
            text = b" ".join(ws)
            stream = lm_score.Stream(Chunk({"chunk": 0, "blob": squeeze(text), "ids": [i], "lengths": [len(text)]}))
            outside, want = model.log_probs(stream.features(), stream.leaves), 0.0
            for before, w, x in zip([None, *ws], ws, outside.tolist()):
                p = math.exp(x) * (count[w] + 0.5) / (n_leaf[leaf[w]] + 0.5 * (v_leaf[leaf[w]] + 1))
                context = len(learnt) if before is None else count[before]
                want += math.log10((pairs[before, w] + 3 * p) / (context + 3))
            assert math.isclose(got[i], want, rel_tol=1e-5), (i, got[i], want)


def test_what_is_learned_of_neighbours_reaches_unseen_documents(spark):
    from pyspark.sql import functions as F

    from docweave.llm import lm_score

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sums = lm_score.lm_scores(docs).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert (sums[2] - sums[1]) / sums[0] > 0.3  # 0.09 where neighbours are learned by the tables only


def test_logits_of_any_size():
    import numpy as np

    from docweave.llm import lm_score

    for scale in (1, 30, 300):
        weights = np.random.default_rng(5).standard_normal((8, 4)).astype(np.float32) * scale
        rows, label = np.array([[0, 1], [2, 3], [4, 4]]), np.array([0, 1, 3])
        z = weights[rows].sum(axis=1).astype(float)
        top = z.max(axis=1)
        want = z[np.arange(3), label] - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
        assert np.allclose(lm_score.log_softmax(weights, np.zeros(4, np.float32), rows, label), want, rtol=1e-4, atol=1e-4)
