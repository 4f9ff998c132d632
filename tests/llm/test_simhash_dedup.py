"""Near duplicates by shingle similarity against brute force, and the pipeline's stages row for row."""

import random

import pytest

import corpus_pipeline
from docweave.llm import simhash_dedup
from docweave.llm.simhash_dedup import near_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = "edit%d" % rng.getrandbits(40)
    return out


def planted(seed=5):
    """Texts with copies of 0 to 8 edits, a crowd of copies of one text, and a line that many share."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    line, texts = [word() for _ in range(30)], []
    for i in range(40):
        base = [word() for _ in range(rng.choice([1, 4, 5, 6, 60, 150, 300]))]
        texts.append(base + (line if i % 3 == 0 else []))
        texts += [edited(rng, texts[-1], min(n, len(texts[-1]))) for n in rng.sample(range(9), 3)]
    crowd = [word() for _ in range(200)]
    texts += [edited(rng, crowd, rng.choice([2, 4, 6])) for _ in range(60)]
    texts += [[], [], ["W1", "w2"], ["w1", "w2"]]
    rng.shuffle(texts)
    rows = [(None if i % 9 == 0 else i // 2 if i % 9 == 1 else i, " ".join(t), "en", f"s{i % 3}", i) for i, t in enumerate(texts)]
    return rows + rows[:12]


def shingles(text, size=5):
    w = text.lower().split()
    return {tuple(w)} - {()} if len(w) <= size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows):
    """Sorted lists of row numbers: components of rows with a Jaccard index of 0.8 or more."""
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


@pytest.mark.parametrize("stars,sample,block,seed", [(4, 16_384, 4096, 5), (1, 10, 7, 6)])
def test_near_dedup_finds_every_pair(spark, monkeypatch, stars, sample, block, seed):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    monkeypatch.setattr(simhash_dedup, "STARS", stars)
    monkeypatch.setattr(simhash_dedup, "SAMPLE", sample)
    rows = planted(seed)
    groups = brute(rows)
    made = near_dedup(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    of = {rows[i]: g for g, members in enumerate(groups) for i in members}
    assert len(made) == len(groups) == len({of[tuple(r)] for r in made})
    for r in made:
        ids = [rows[i][0] for i in groups[of[tuple(r)]]]
        assert r["doc_id"] == min((x for x in ids if x is not None), default=None)


def test_near_stage_takes_lightly_edited_copies(spark):
    rng = random.Random(1)
    bases = [["w%d" % rng.randrange(9000) for _ in range(200)] for _ in range(40)]
    texts = bases + [edited(rng, b, 3) for b in bases]  # similarity 0.86 or more
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], COLUMNS)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


def odd_rows():
    """Rows repeated as they are, under one id with another text, and with null ids, equal and different texts."""
    rng = random.Random(2)
    text = lambda: " ".join("w%d" % rng.randrange(9000) for _ in range(50))
    same, null, twice = text(), text(), text()
    rows = [(1, same, "en", "a", 1)] * 3 + [(None, null, "en", "a", 1)] * 4 + [(None, same.upper(), "en", "b", 1)]
    return rows + [(2, twice, "en", "b", 1), (2, text(), "en", "b", 1), (None, text(), "en", "b", 1), (None, text(), "en", "a", 1)]


@pytest.mark.parametrize("stage", ["exact_dedup", "simhash_near_dedup"])
def test_one_row_of_each_group_stays(spark, stage):
    rows = odd_rows()
    kept = dict(corpus_pipeline.STAGES)[stage](spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "").collect()
    want = [r for i, r in enumerate(rows) if r not in rows[:i] and not (r[0] is None and r[1].isupper())]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rows = odd_rows()
    kept = near_dedup(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    want = [r for i, r in enumerate(rows) if r not in rows[:i] and not (r[0] is None and r[1].isupper())]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_mix_gives_one_row_per_copy(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else i // 2, "w " * rng.randint(1, 40), "en", "abc"[i % 3 if i % 5 else 0], i) for i in range(300)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    made = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "").collect()
    by = {}
    for r in made:
        by.setdefault(r["n_chars"], []).append(r)
    assert all(sorted(r["copy"] for r in g) == list(range(1, len(g) + 1)) and len(g) <= 2 for g in by.values())
    assert all(tuple(r)[:5] == rows[r["n_chars"]] for r in made)
    for s in "abc":
        taken = [r for r in made if r["source"] == s]
        assert abs(sum(r["size"] for r in taken) - taken[0]["target"]) <= 1


def test_stages_keep_clashing_columns(spark, sf):
    """Extra columns with the names that stages use inside come through as they are."""
    rows = [(i, f"the of and text number{i} w{i} " * 6, "en", "s", i, f"own{i}") for i in range(12)]
    extra = ["size", "copy", "target", "id", "fp", "h", "cell", "rep", "component", "n", "_row", "chunk", "held_out", "entry", "sig"]
    docs = spark.createDataFrame(rows, COLUMNS + ", x string")
    for c in extra:
        docs = docs.withColumn(c, docs["x"])
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        assert made.columns[: len(docs.columns)] == docs.columns and len(set(made.columns)) == len(made.columns)
        assert all(r[c] == r["x"] for r in made.collect() for c in extra), name
        if name == "mixing":
            assert {"mix_size", "mix_copy", "mix_target", "source_size"} <= set(made.columns)


def test_run_leaves_its_input_and_its_last_tables_only(spark, sf):
    from docweave.llm import _shared

    before = _shared.mark()
    made = corpus_pipeline.run(spark, sf)
    assert made.count() > 0 and _shared.mark() - before < 12
