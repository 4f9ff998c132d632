"""Exact, near, window and substring deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import simhash, suffix_dedup
from docweave.llm.exact_dedup import exact_dedup, exact_groups
from docweave.llm.simhash import components, fingerprint, near_groups, near_links
from docweave.llm.substring_dedup import dedup_windows
from docweave.llm.suffix_dedup import maximal_repeats, dedup_substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, keep_id long, rank int, chunk string, fp string, id long"


def corpus(seed=3, n=60):
    """Texts of few words with copies, shared passages, nulls, blanks, repeated rows and clashing columns."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(40)] + ["É", "ñandú", "日本", "x" * 300]
    passage = [rng.choice(words) for _ in range(45)]
    texts = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 19, 20, 21, 60, 200]))]
        if i % 4 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        texts.append(rng.choice([" ", "  ", "\n", "\t"]).join(body))
    texts += [texts[5], texts[5].upper(), texts[8], None, None, "", "   ", "long " * 6000]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, "h", i, 1, "c", "f", i) for i, t in enumerate(texts)]
    return rows + [rows[4]] + [(None, texts[2], None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(docs, keep, weak):
    made = exact_groups(docs, keep=keep, **({"hash_fn": lambda c: F.length(c) % 3} if weak else {})).collect()
    by = {}
    for r in corpus():
        by.setdefault(lower(r[1]), []).append(r[0])
    want = []
    for text, ids in by.items():
        some = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(some) if some else None
        want += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(tuple, made), key=str) == sorted(want, key=str)


def test_exact_dedup_keeps_columns(docs, none):
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.select("text").distinct().count() <= kept.count() < docs.count()
    assert exact_dedup(none).count() == 0 == exact_groups(none).count()


def brute_windows(rows, size=20):
    order = sorted((r for r in rows), key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    words = [(r[1] or "").encode().split() for r in order]
    for d, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if first.setdefault(key, (d, i)) < (d, i):
                gone[i : i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((order[d][0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk,bucket,hot", [(4 << 20, 4 << 20, 1 << 14), (2000, 500, 1 << 14), (2000, 500, 2), (2000, 4000, 0)])
def test_windows(docs, chunk, bucket, hot):
    rows = [r for i, r in enumerate(corpus()) if i != len(corpus()) - 2]  # a repeated row has no order of its own
    spark = docs.sparkSession
    made = dedup_windows(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk_bytes=chunk, bucket_bytes=bucket, hot_runs=hot)
    got = [tuple(r) for r in made.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(brute_windows(rows), key=str)


def brute_substrings(rows, size=50):
    first = {}
    key = lambda r: 1 << 62 if r[0] is None else r[0]
    for r in rows:
        t = (r[1] or "").encode()
        for i in range(len(t) - size + 1):
            s = t[i : i + size]
            first[s] = min(first.get(s, 1 << 63), key(r))
    out = []
    for r in rows:
        t = (r[1] or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if first[t[i : i + size]] < key(r):
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((r[0], len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk,bucket,hot", [(4 << 20, 4 << 20, 1 << 14), (2000, 500, 1 << 14), (2000, 500, 2), (2000, 4000, 0)])
def test_substrings(docs, chunk, bucket, hot):
    made = dedup_substrings(docs, chunk_bytes=chunk, bucket_bytes=bucket, hot_runs=hot)
    got = [tuple(r) for r in made.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(brute_substrings(corpus()), key=str)


@pytest.mark.parametrize("chunk,hot", [(4 << 20, 1 << 14), (2000, 2)])
def test_maximal_repeats_give_all_occurrences(docs, chunk, hot):
    """Every group lists exactly the places where its string stands, and together they cover what two documents share."""
    rows = [(r[0], (r[1] or "").encode()) for r in corpus() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    spark = docs.sparkSession
    made = maximal_repeats(spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(3), chunk_bytes=chunk, bucket_bytes=500, hot_runs=hot)
    groups, text, covered = {}, dict(rows), set()
    for r in made.collect():
        groups.setdefault((text[r["doc_id"]][r["start"] : r["start"] + r["length"]], r["group_key"]), set()).add((r["doc_id"], r["start"]))
    for (string, _), places in groups.items():
        want = {(i, at) for i, t in rows for at in range(len(t) - len(string) + 1) if t.startswith(string, at)}
        assert places == want and len({i for i, _ in places}) > 1 and len(string) >= 50
        covered |= {(i, at + k) for i, at in places for k in range(len(string) - 49)}
    held = {}
    for i, t in rows:
        for at in range(len(t) - 49):
            held.setdefault(t[at : at + 50], set()).add((i, at))
    assert covered == {p for places in held.values() if len({i for i, _ in places}) > 1 for p in places}


def test_empty_tables(none):
    assert dedup_windows(none).count() == dedup_substrings(none).count() == near_groups(none).count() == 0


def test_repeat_groups_are_maximal():
    texts = [b"xABCDEFGHy", b"zABCDEFGHy", b"qABCDEFw"]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    group, owner, offset, length = suffix_dedup.repeat_groups(flat, ends - [len(t) for t in texts], ends, 4)
    found = {}
    for g, o, a, n in zip(group.tolist(), owner.tolist(), offset.tolist(), length.tolist()):
        found.setdefault(g, set()).add((o, texts[o][a : a + n]))
    assert sorted(map(sorted, found.values())) == [[(0, b"ABCDEF"), (1, b"ABCDEF"), (2, b"ABCDEF")], [(0, b"ABCDEFGHy"), (1, b"ABCDEFGHy")]]


def brute_components(fps, ids, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("radius,block", [(4, 512), (4, 3), (0, 512), (7, 16)])
def test_near_links(spark, radius, block):
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:15]:
        for _ in range(4):
            fps.append(f)
            for b in rng.sample(range(64), rng.randint(1, radius + 3)):
                fps[-1] ^= 1 << b
    fps = sorted(set(fps) | {0, 1, 2**64 - 1})
    ids = [i * 3 for i in range(len(fps))]
    prints = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in zip(ids, fps)], "rep long, fp long")
    got = {r["node"]: r["component"] for r in components(near_links(prints, radius, block)).collect()}
    assert [got.get(i, i) for i in ids] == brute_components(fps, ids, radius)


def test_near_groups(docs):
    made = near_groups(docs).collect()
    rows = [r for r in corpus() if r[0] is not None]
    fps = {r[0]: fingerprint((r[1] or "").encode()) for r in rows}
    want = dict(zip(fps, brute_components(list(fps.values()), list(fps), 4)))
    assert len(made) == len(corpus())
    for r in made:
        if r["doc_id"] is not None:
            assert (np.uint64(np.int64(r["fp"])), r["component_id"]) == (np.uint64(fps[r["doc_id"]]), want[r["doc_id"]])


@pytest.mark.parametrize("n", [10, 1 << 23, 1 << 40])
def test_masks_find_every_pair_within_the_radius(n):
    rng, masks = np.random.default_rng(1), simhash.part_masks(n, 4, 512)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & m & (1 << 64) - 1 == 0 for m in masks)
    assert len(masks) == {10: 5, 1 << 23: 15, 1 << 40: 70}[n]


def test_near_groups_of_null_ids_and_string_ids(spark):
    words = " ".join("w%d" % i for i in range(400))
    rows = [(None, words), ("b", words + " more"), ("a", words), (None, "only here"), (None, "Only HERE")]
    made = near_groups(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted((r["doc_id"] or "", r["component_id"] or "") for r in made.collect()) == [("", ""), ("", ""), ("", "a"), ("a", "a"), ("b", "a")]


def test_pairs_and_lanes_count_alike():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = a ^ np.array([sum(1 << int(x) for x in rng.choice(64, int(k), replace=False)) for k in rng.integers(0, 64, 1000)], np.uint64)
    for radius in (0, 4, 25, 63):
        near = simhash.near_pairs(a, b, radius)
        assert (near == (np.bitwise_count(a ^ b) <= radius)).all()
        lanes = simhash.near_lanes(a[:70], simhash.bit_planes(b[:70]), radius)
        assert [bool(lanes[i, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(70)] == near[:70].tolist()


def test_fingerprint_follows_its_definition():
    import xxhash

    words = "A b c D e f g".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).lower().encode(), 42) for i in range(4)]
    bits = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert fingerprint("A b\tc  D\ne f g".encode()) == bits
    assert fingerprint(b"One two") == xxhash.xxh64_intdigest(b"one two", 42) and fingerprint(b" ") == 0
    assert simhash.BLOCK >= 2
