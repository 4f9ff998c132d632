"""Byte-pair encoding, conversation repair and ball k-means against the library and brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from docweave.llm import ball_kmeans, bpe, chat_repair
from docweave.llm.queries import QUERIES

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def odd_texts(n=400):
    rnd = random.Random(5)
    kinds = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(0x250), lambda: rnd.randrange(0x3000), lambda: rnd.randrange(0xE000, 0x110000), lambda: rnd.randrange(0xD800)]
    out = ["", "  ", "<|endoftext|>x<|startoftext|>< |endoftext|>", "a" * 40 + "'ll're'''s", "İSTANBUL ΑΣ ﬁ ǅ é 日本語 ½²³ \x1c\x1d a\x85b c​", "\x1ca\x1fb \x00", "x" * 5000, "ññññ 9777946427004852 òò"]
    out += ["".join(chr(rnd.choice(kinds)()) for _ in range(40)) for _ in range(n)]
    return out + ["".join(rnd.choice("aabeinot's ñ") for _ in range(80)) for _ in range(n)]


@pytest.fixture(scope="module")
def coders():
    return {f: (bpe.load_tokenizer(public_tokenizers.path(f)), Library.from_file(public_tokenizers.path(f))) for f in FILES}


@pytest.mark.parametrize("file", FILES)
def test_bpe_is_the_library(coders, file):
    own, library = coders[file]
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == ids, text
        assert own.text(ids) == library.decode(ids, skip_special_tokens=False), text


def merged(word, merges):
    """Byte-pair encoding as it is defined: of all pairs that stand in the word the earliest merge, from the left."""
    parts = list(word)
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if parts[i : i + 2] == [a, b]:
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


@pytest.mark.parametrize("seed", range(8))
def test_automaton_of_random_merges(seed):
    rnd = random.Random(seed)
    tokens, merges = list("abc"), []
    while len(merges) < 14:
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        if a + b not in tokens and len(a + b) < 9:
            merges.append((a, b))
            tokens.append(a + b)
    automaton = bpe.compile_merges({t: i for i, t in enumerate(tokens)}, merges)
    for n in range(1, 8):
        for word in map("".join, itertools.product("abc", repeat=n)):
            assert [tokens[i] for i in automaton.encode(word)] == merged(word, merges), (word, merges)


def test_bpe_frames(spark, coders):
    own, library = coders[FILES[0]]
    texts = [None, "", "Hello, World's 42!", "Hello, World's 42!", "né " * 20000]
    docs = spark.createDataFrame([(i % 3 or None, t, [1], "kept") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, decoded string")
    rows = bpe.decode_ids(bpe.encode_texts(docs, own), own).orderBy(F.length("text")).collect()
    assert len(rows) == 5
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    empty = bpe.digest(bpe.decode_ids(bpe.encode_texts(docs.where("false"), own), own))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    gone = spark.createDataFrame([(None,), ([5, None, -1, 10**9],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode_ids(gone, own).collect()] == ["", library.decode([5], skip_special_tokens=False)]


def test_bpe_query(spark, sf, coders):
    library = coders[FILES[0]][1]
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_bpe_tokens"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"model": {"type": "Unigram"}, "added_tokens": [], "decoder": null, "normalizer": null, "pre_tokenizer": null}')
    with pytest.raises(ValueError):
        bpe.load_tokenizer(str(path))


# conversations


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def best_edits(rows):
    """The cheapest edits of (role, text, fault), least letters first: every path, kept by (cost, letters) for each state and level."""
    ends = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    takes = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    now = {0: (0, "", [])}

    def close(now):
        for _ in range(4):
            for q, (cost, letters, made) in list(now.items()):
                role, to = takes[q]
                new = (cost + 3, letters + "I", [*made, f"{role}:"])
                if to not in now or new[:2] < now[to][:2]:
                    now[to] = new
        return now

    for role, text, fault in rows:
        after = {}
        for q, (cost, letters, made) in close(now).items():
            moves = [(q, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                moves += [(to, more, "K", [f"{role}:{text}"]) for f, to in ends.get(role[:1], {}).items() if f == q]
                moves.append((takes[q][1], 3 + more, "R", [f"{takes[q][0]}:{text}"]))
            for to, price, letter, row in moves:
                new = (cost + price, letters + letter, made + row)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        now = after
    return min(v for q, v in close(now).items() if q in (0, 3))


def repaired(rows):
    """The whole contract for the rows of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    marked, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit, made = best_edits(marked)
    faults = [m[2] for m in marked]
    wrong = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), wrong, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def check_repairs(spark, rows):
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n string")
    got = chat_repair.digest(chat_repair.repair(chat_repair.damage(turns)), turns).collect()
    left = {}
    for r in damaged(rows):
        left.setdefault(r[0], []).append(r)
    want = {r[0]: repaired(left.get(r[0], [])) for r in rows}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def random_turns(seed, convs, longest):
    rnd = random.Random(seed)
    texts = ["Hi.", "So?", "no end", "", " \n", "ok!", "ok!", None, "Größe.", "a.\x0c"]
    out = []
    for conv in range(convs):
        for turn in range(rnd.randrange(1, longest)):
            out.append((conv or None, rnd.choice([turn, turn, turn, turn - 1, None]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "aide"]), rnd.choice(texts) or None))
            if rnd.random() < 0.1:
                out += [out[-1]] * rnd.randrange(1, 4)
    return out


@pytest.mark.parametrize("rows_in_block", [1, 3, 1024])
def test_repair_is_brute_force(spark, monkeypatch, rows_in_block):
    monkeypatch.setattr(chat_repair, "ROWS", rows_in_block)
    check_repairs(spark, random_turns(rows_in_block, 40, 14))


def test_repair_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "ROWS", 64)
    rnd = random.Random(3)
    rows = [(7, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["ok.", f"so {t}.", f"cut {t}"])) for t in range(700)]
    check_repairs(spark, rows + [(8, 0, "user", "ok.")] * 500 + [(9, 1, "assistant", "x" * 600_000 + ".")])


def test_repair_without_rows(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_repair.digest(chat_repair.repair(nothing), nothing).count() == 0
    kept = chat_repair.repair(spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "user", "No.")], "conv_id string, turn int, role string, text string"))
    assert [(r["conv_id"], r["role"], r["text"]) for r in chat_repair.repaired_turns(kept).orderBy("part", "seq", "position").collect()] == [("a", "user", "Hi."), ("a", "assistant", "No.")]


# clusters


def plain_kmeans(rows, k=40, rounds=5, dims=64):
    """Every vector against every centroid, in Python's integers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centroids)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in out if c == j) for j in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), names[j]) for i, j, d in out), key=str)


def clustered(df, **how):
    return sorted((tuple(r) for r in ball_kmeans.digest(*ball_kmeans.ball_kmeans(df, **how)).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_ball_kmeans_is_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(int(i), [float(x) for x in np.round(centres[i % 6] + rng.normal(0, 0.2, 8), 2)]) for i in range(150)]
    rows += [(None, rows[0][1]), (3, rows[5][1]), rows[7], rows[7], (500, None), (501, [0.0] * 7), (502, [None] + [0.0] * 7), (503, [float("nan")] + [0.0] * 7), (504, [float("inf")] * 8)]
    if seed == 2:
        rows += [(600, [9000.5] * 8), (601, [-1e6, *[3.0] * 7])]  # past what doubles hold
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    assert clustered(df, k=7, dims=8) == plain_kmeans(rows, 7, 5, 8)


def test_ball_kmeans_on_few_and_huge(spark):
    schema = "vec_id long, embedding array<float>"
    assert clustered(spark.createDataFrame([], schema)) == []
    assert clustered(spark.createDataFrame([(1, [1.0])], schema)) == []
    rows = [(i, [float(i % 2)] * 4) for i in range(5)]  # fewer than k, with ties
    assert clustered(spark.createDataFrame(rows, schema), dims=4) == plain_kmeans(rows, 40, 5, 4)
    huge = clustered(spark.createDataFrame([(1, [3e38] * 4), (2, [-3e38] * 4), (3, [0.0] * 4)], schema), k=1, dims=4)
    assert [r[0] for r in huge] == [1, 2, 3] and max(r[2] for r in huge) == 2**63 - 1


def test_balls_leave_out_what_cannot_be_nearer():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (400, 5)).astype(float)
    centroids = rng.integers(-300, 300, (9, 5)).astype(float)
    space = ball_kmeans.Distances(x, centroids)
    number, distance = space.nearest()
    moved = np.floor(centroids + rng.integers(-40, 40, centroids.shape))
    found = {int(i): (1, int(distance[number == i].max()), 0, [int(s) for s in moved[i]]) for i in np.unique(number)}
    after, radii = ball_kmeans.moved(centroids, found)
    near = ball_kmeans.neighbours(after, radii)
    assert sum(len(n[0]) for n in near) <= 72
    want = ball_kmeans.Distances(x, after).nearest()
    got = ball_kmeans.Distances(x, after).from_balls(number, near)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
