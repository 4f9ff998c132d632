"""Mixing, decontamination, extraction, chat formatting, language models and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import decontaminate as dc
from docweave.llm import html_extract, language_id, lm_score
from docweave.llm.chat_format import chat_format, digest, masked_text, parse_turns
from docweave.llm.mixing import fit_budget, mix_sources
from tests.llm.test_dedup import SCHEMA, corpus


@pytest.mark.parametrize("seed", range(6))
def test_fit_budget_is_near(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 3000, 40))
    counts = rng.integers(1, 9, len(sizes))
    total = int((sizes * counts).sum())
    for budget in (0, 1, total // 7, total // 2, total - 1, total, total + 5):
        take = fit_budget(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * sizes).sum()) - min(budget, total)) <= int(sizes.min())


def test_mix(spark):
    docs = spark.createDataFrame(corpus(n=200), SCHEMA)
    rows = mix_sources(docs).collect()
    assert len(rows) == docs.count() and sorted(map(tuple, mix_sources(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    by = {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weights = dict(zip(names, [5, 2, 1] * len(names)))
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    budget, open_, want = 1.5 * sum(size.values()), set(names), {}
    while True:  # reshare until no source is above twice its size
        level = (budget - sum(want.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * size[s]}
        if not full:
            break
        want |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    want |= {s: level * weights[s] for s in open_}
    for s in names:
        assert by[s][0]["source_size"] == size[s] and math.isclose(by[s][0]["target"], want[s], rel_tol=1e-9)
        assert abs(sum(r["taken"] for r in by[s]) - want[s]) <= 3
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_words(text):
    out, now = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def runs_of(words, n=5):
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def is_leak(item, text):
    """Written apart from the operator: any place of the text, all shingles of item, question and answer."""
    words, runs = plain_words(item), runs_of(plain_words(text))
    sentences = [plain_words(s) for s in item.split(". ") if plain_words(s)]
    sides = [[w for s in sentences[:-1] for w in s], sentences[-1]] if len(sentences) > 1 else [words[: len(words) - len(words) // 3], words[len(words) - len(words) // 3 :]]
    share = lambda w: len(runs_of(w) & runs) / len(runs_of(w))
    return share(words) >= 0.8 and all(share(s) >= 0.5 for s in sides if len(s) >= 5)


def test_leaks_match_brute_force(spark):
    rng = random.Random(1)
    words = ["v%d" % i for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 40))) + ". " + " ".join(rng.choice(words) for _ in range(rng.randint(2, 9)))) for i in range(30)]
    items += [(900, None), (901, ""), (None, "no key at all in this one"), (902, items[2][1])]
    texts = []
    for i in range(80):
        body = [rng.choice(words) for _ in range(rng.choice([0, 5, 50, 400]))]
        if i % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = items[i % 30][1].upper().split()[: None if i % 2 else -1]
        texts.append(" ".join(body))
    texts.append(" ".join(rng.choice(words) for _ in range(40_000)) + " No, key AT all in this_one " + items[7][1])
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, texts[0]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).collect()}
    want = {(d, key) for key, text in items if text for d, t in rows if is_leak(text, t)}
    assert got == want and len(want) > 20 and (80, None) in want and (80, 7) in want
    left = dc.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == len([r for r in rows if r[0] not in {d for d, _ in got} or r[1] is None])
    assert dc.find_leaks(docs, bench.limit(0)).count() == 0 and dc.decontaminate(docs, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.6])
def test_wand_retrieves_all_that_full_scoring_does(threshold):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        terms = sorted(rng.sample(range(200), rng.randint(1, 30)))
        impacts = [rng.random() ** 3 for _ in terms]
        rows.append({"entry": i, "text": "", "length": len(terms), "terms": [f"t{t}" for t in terms], "impacts": [x / sum(impacts) for x in impacts]})
    index = dc.Index(rows)
    texts = [[f"t{rng.randrange(220)}" for _ in range(rng.randint(0, 120))] for _ in range(200)]
    got = {(t, at, item): s for t, at, item, s in dc.retrieve(index, texts, threshold)}
    want = {}
    for t, words in enumerate(texts):
        for at in range(0, max(1, len(words)), index.reach):
            have = set(words[at : at + 2 * index.reach])
            for i, r in enumerate(rows):
                score = sum(x for term, x in zip(r["terms"], r["impacts"]) if term in have)
                if score >= threshold:
                    want[t, at, i] = score
    assert got.keys() == want.keys() and len(want) > 10 and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)


def test_scores_do_not_depend_on_how_the_benchmark_is_cut(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join("v%d" % rng.randrange(80) for _ in range(rng.randint(5, 70)))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, "x y " + items[i % 60][1] + " z") for i in range(80)], "doc_id long, text string")
    first = sorted(map(tuple, dc.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 4000)
    monkeypatch.setattr(dc, "INDEX_ITEMS", 7)
    assert sorted(map(tuple, dc.find_leaks(docs, bench.repartition(3)).collect())) == first and len(first) >= 80


def test_extract(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/x>Home</a></li><li><a href=/y>More</a></li></ul></nav>"
        "<div class=ad>Buy this now</div><article><h1>Head &amp; line</h1><p>First  <b>bold</b>part of the long text, with words.<p>Second&nbsp;one here, as long as it gets.<br>Tail</article>"
        "<section id=comments class=comments><h3>Comments</h3><div class=comment><p>Nice one</p></div></section><footer>&copy; me &middot; 2024</footer></body></html>"
    )
    rows = [(1, "u1", page), (2, "u2", None), (3, None, ""), (4, "u4", "just <text"), (5, "u5", "<<<>>>&am"), (1, "u1", page), (None, "u", "<p>" * 3000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["Head & line First boldpart of the long text, with words. Second one here, as long as it gets. Tail"] * 2
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[2] == ""
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction_of_unseen_pages():
    rng, model = random.Random(4242), html_extract.trained()
    right = wrong = missed = 0
    for _ in range(60):
        page = html_extract.Page(html_extract.random_page(rng))
        x, own = page.features()
        for y, k, o in zip(page.labels, page.decode(model.logits(x), own), own):
            if y >= 0 and o:
                right, wrong, missed = right + (k and y) * o, wrong + (k and not y) * o, missed + (y == 1 and not k) * o
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_decoding_has_no_kept_child_of_a_dropped_parent():
    page = html_extract.Page("<div><p>a</p><div><p>b</p></div></div>")
    own = np.array([0, 0, 1, 0, 1], np.float32)
    keep = page.decode(np.array([0, 0, -9.0, 0, 9.0]), own)
    assert keep[4] and not keep[2]
    assert not any(page.decode(np.array([0, -9.0, -9.0, -9.0, 0.5]), own))


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be [brief] %25 <|end|>\n"), (1, 1, "user", None), (1, 2, "assistant", "a<|turn|>assistant\nb"), (1, 3, "assistant", "</s>[INST] ok [/INST]"),
        (2, 0, None, "x"), (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 5, "ro\nle<", "y" * 20000),
    ]
    made = chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = made.select("conv_id", parse_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in back} == want
    assert {r["conv_id"]: r["loss"] for r in back} == {c: "".join(t for r, t in v if r == "assistant") for c, v in want.items()}
    d = {r["conv_id"]: r for r in digest(made).collect()}
    told = "".join(f"{r}\n{t}\n" for r, t in want[1])
    assert d[1]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and d[1]["n_turns"] == 4
    assert chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_reply_trees(spark):
    #        1 - 2 - 4
    #          \ 3 - 5 - 6      and a cycle 7 <-> 8, an orphan 9
    edges = [(1, None, 1.0), (2, 1, 5.0), (3, 1, 2.0), (4, 2, 3.0), (5, 3, None), (6, 5, 9.0), (7, 8, 1.0), (8, 7, 1.0), (9, 77, 0.5)]
    rows = [(1, n, p, "user" if n % 2 else "assistant", f"t{n}", s) for n, p, s in edges]
    rows += [(2, n, n - 1 if n else None, "user", str(n), 0.0) for n in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    made = chat_format(df, node_col="node", parent_col="parent", score_col="score")
    got = {(r["conv_id"], r["branch"]): [t["text"] for t in r["t"]] for r in made.select("conv_id", "branch", parse_turns(F.col("formatted")).alias("t")).collect()}
    assert got[1, 1] == ["t1", "t2", "t4"] and got[1, 2] == ["t1", "t3", "t5", "t6"] and got[1, 3] == ["t9"] and got[2, 1] == [str(n) for n in range(70)]
    assert len(got) == 4
    assert chat_format(df, node_col="node", parent_col="parent", score_col="score", top_paths=1).count() == 2
    assert [r["path_score"] for r in made.where("conv_id = 1").orderBy("branch").collect()] == [3.0, 3.0, 0.5]
    # a leaf that hangs on a cycle has no root; a repeated node is one node with two turns
    odd = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 1, "user", "c", 0.0), (2, 1, None, "user", "x", 0.0), (2, 1, None, "assistant", "y", 0.0), (2, 2, 1, "user", "z", 0.0)]
    made = chat_format(spark.createDataFrame(odd, df.schema), node_col="node", parent_col="parent", score_col="score")
    assert [[t["text"] for t in r["t"]] for r in made.select(parse_turns(F.col("formatted")).alias("t")).collect()] == [["y", "x", "z"]]


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10001, None, "en"), (10002, "123 !?", "en"), (10003, "", None), (None, "the and of", None), (10004, "und die der " * 30000, None)], docs.schema)
    rows = language_id.identify(docs.unionByName(odd)).join(docs.withColumnRenamed("lang", "truth"), "doc_id", "left").collect()
    assert len(rows) == docs.count() + 5
    held = [r for r in rows if r["held_out"] and r["truth"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == r["truth"] for r in held) / len(held) > 0.93
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (10001, 10002, 10003)) and by[10004]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.limit(5).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_segments_agree_with_one_run_over_the_whole_text(spark, sf):
    """Within a segment nothing is cut: up to its length the pooled probabilities are those of one run, beyond they are close."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and length(text) > 1500").select("text", "lang").limit(25).collect()
    net = language_id.train([r["text"][:160].encode() for r in rows], [r["lang"] for r in rows], steps=120)
    far = []
    for r in rows:
        for n in (1, 5, 127, 128, 129, 1400):
            text = r["text"].encode()[:n]
            whole = net.positions(np.frombuffer(text, np.uint8).astype(np.int16)[:, None])[:, 0].mean(axis=0)
            lang, score = language_id.predict(net, [b"", text, b"zz"])[1]
            if lang != language_id.UNDETERMINED and n <= language_id.SEGMENT:
                assert lang == net.languages[int(whole.argmax())] and abs(score - whole.max()) < 1e-4
            elif n == 1400:
                far.append((abs(score - whole.max()), lang == net.languages[int(whole.argmax())]))
    assert np.mean([f[0] for f in far]) < 0.02 and np.mean([f[1] for f in far]) > 0.97


def test_every_language_is_learned(spark, monkeypatch):
    train = language_id.train
    monkeypatch.setattr(language_id, "train", lambda snippets, labels: train(snippets, labels, hidden=2, steps=2))
    alphabet = [chr(0x4E00 + 60 * k) for k in range(70)]  # more languages than any cap would allow, a few letters each
    rows = [(i, (alphabet[i % 70] + chr(ord(alphabet[i % 70]) + 1) + " ") * 20, f"l{i % 70:02d}") for i in range(420)]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert net.languages == [f"l{k:02d}" for k in range(70)]


def test_network_gradients():
    net = language_id.Network.fresh(["a", "b"], 3, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, label = np.array([[3, 4], [5, 256], [6, 256]]), np.array([0, 1])

    def loss():
        p = net.positions(x)
        real = x != language_id.PAD
        return -np.log(p[:, np.arange(2), label])[real].mean()

    grads = net.gradients(x, label)
    for name, at in (("f_in", (3, 1)), ("b_in", (6, 7)), ("f_gates", (1, 4)), ("b_cand", (0, 2)), ("out", (4, 1)), ("bias", (0,))):
        old = net.weights[name][at]
        net.weights[name][at] = old + 1e-3
        up = loss()
        net.weights[name][at] = old - 1e-3
        down = loss()
        net.weights[name][at] = old
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3


def test_lm_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, "  "), (None, "Aa aA")], docs.schema))
    rows = docs.collect()
    count = Counter()
    for r in rows:
        if lm_score.learned(r["doc_id"]):
            count.update((r["text"] or "").encode().lower().split() + [b""])
    n, v = sum(count.values()), len(count)
    for chunk in (4 << 20, 50_000):
        got = {r["doc_id"]: r for r in lm_score.lm_scores(docs.repartition(2), chunk_bytes=chunk, bucket_bytes=chunk // 40).collect()}
        for r in rows:
            words, g = (r["text"] or "").encode().lower().split() + [b""], got[r["doc_id"]]
            base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
            assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), n)
            assert math.isclose(g["base_score"], base, rel_tol=1e-9) and g["score"] < 0
        assert sum(g["score"] for g in got.values()) > sum(g["base_score"] for g in got.values())
    assert lm_score.lm_scores(docs.limit(0)).count() == 0


def random_model(seed=0, rows=1 << 10):
    rng = np.random.default_rng(seed)
    tables = (rng.standard_normal((rows, k)).astype(np.float32) for k in (lm_score.CLASSES, lm_score.GROUPS))
    biases = (rng.standard_normal(k).astype(np.float32) for k in (lm_score.CLASSES, (lm_score.CLASSES, lm_score.GROUPS)))
    return lm_score.Model(*tables, *biases)


def test_leaf_probabilities_sum_to_one():
    model, rng = random_model(), np.random.default_rng(1)
    for _ in range(5):
        features = np.repeat(rng.integers(0, 1 << 63, (1, 4)).astype(np.uint64), lm_score.LEAVES, axis=0)
        leaves = np.arange(lm_score.LEAVES)
        p = np.exp(model.log_probs(features, leaves))
        ends = leaves // lm_score.GROUPS == lm_score.END_CLASS
        assert math.isclose(p[~ends].sum() + p[ends][0], 1, abs_tol=1e-5)


def test_score_matches_plain_arithmetic(spark, monkeypatch):
    """The score of every document under a given model, word by word with Python's own numbers."""
    from docweave.llm._chunks import _BASE

    model = random_model(3)
    monkeypatch.setattr(lm_score, "train", lambda chunks, fresh, rounds: model)
    rows = [(i, t) for i, t in enumerate(["a bb ccc a bb", "Ccc a", "", None, "new words ccc bb a a", "a bb", "\u00e9t\u00e9 bb"])]
    full = (1 << 64) - 1

    def mixed(h):
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & full
        return h ^ (h >> 29)

    hash_of = lambda w: mixed(sum((b + 1) * pow(_BASE, i, 1 << 64) for i, b in enumerate(w)) & full)
    leaf = lambda w: ((int.from_bytes(w[-3:]) * 0x9E3779B1 & 0xFFFFFFFF) % 65521 % 23, hash_of(w) % 32) if w else (23, 0)
    docs = {i: [w.lower() for w in (t or "").encode().split()] + [b""] for i, t in rows}
    count = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n_leaf, v_leaf = Counter(), Counter()
    for w, c in count.items():
        n_leaf[leaf(w)] += c
        v_leaf[leaf(w)] += 1
    odd, golden, start = [int(x) for x in lm_score.ODD], int(lm_score.GOLDEN), int(lm_score.START)
    row = lambda h: h >> 54  # noqa: E731  1024 rows

    def share(weights, bias, at, own):
        z = [float(bias[j]) + sum(float(weights[r][j]) for r in at) for j in range(len(bias))]
        return z[own] - math.log(sum(math.exp(x) for x in z))

    got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, words in docs.items():
        want = 0.0
        for at, w in enumerate(words):
            back = [hash_of(words[at - k]) if at >= k else start for k in (1, 2, 3)]
            mixes = [back[0], (back[0] * 3 + back[1] * odd[0]) & full, back[1], back[2]]
            h = [(m + o) * golden & full for m, o in zip(mixes, odd)]
            c, g = leaf(w)
            want += share(model.classes, model.class_bias, [row(x) for x in h], c) / math.log(10)
            if w:
                want += share(model.groups, model.group_bias[c], [row((x ^ (c + 1) * odd[1] & full) * golden & full) for x in h], g) / math.log(10)
            want += math.log10((count[w] + 0.5) / (n_leaf[c, g] + 0.5 * (v_leaf[c, g] + 1)))
        assert math.isclose(got[i], want, rel_tol=1e-4), (i, got[i], want)


def test_the_model_gains_on_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sums = lm_score.lm_scores(docs).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert (sums[2] - sums[1]) / sums[0] > 0.05  # what the language of a text tells is worth 0.2 here


def test_averages_do_not_depend_on_how_pieces_are_dealt(spark):
    from docweave.llm._chunks import squeeze, unsqueeze

    rng = np.random.default_rng(2)
    rows, total, sums = [], np.zeros(4, np.int64), np.zeros((4, 3))
    for i in range(30):
        u, w = rng.integers(0, 9, 4), rng.standard_normal((4, 3)).astype(np.float16)
        rows.append((0, i % 5, bytearray(squeeze(u.tobytes())), bytearray(squeeze(w.tobytes()))))
        total, sums = total + u, sums + u[:, None] * w
    pieces = spark.createDataFrame(rows, lm_score.PIECE)
    made = lm_score.averaged(lm_score.averaged(pieces, ["block", "salt"]), ["block"]).collect()
    mean = np.frombuffer(unsqueeze(bytes(made[0]["piece"])), np.float16).reshape(4, 3)
    assert len(made) == 1 and np.allclose(mean, sums / total[:, None], atol=3e-3) and (np.frombuffer(unsqueeze(bytes(made[0]["updates"])), np.int64) == total).all()


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == columns
            docs = made.persist()
            kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[1] > 0.97 * kept[0]
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() <= kept[-1]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_rows(spark, sf, stage):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [r[:5] for r in corpus()]
    for df in (spark.createDataFrame(rows, columns), spark.createDataFrame([], columns)):
        assert corpus_pipeline.STAGES[stage][1](spark, df, sf).count() >= 0
