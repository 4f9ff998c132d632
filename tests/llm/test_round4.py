"""What near dedup and materialised tables leave on disk, and how many texts it compares."""

import glob
import random

import numpy as np
from pyspark.sql import functions as F

from docweave.llm import _shared, simhash, simhash_dedup


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (blocks.apply(i).getName() for i in range(blocks.size())) if f.startswith("shuffle_")}


def test_a_materialised_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    made, kept = _shared.materialise(rows, "test"), spark.conf.get(_shared.CLEANUP)
    assert not shuffle_files(spark) - before and kept == "false"
    assert sum(r["n"] for r in made.collect()) == 1000


def test_near_dedup_leaves_its_numbered_rows_and_those_that_stay(spark):
    rng, place = random.Random(3), _shared.mark()
    base = ["w%d" % rng.randrange(9000) for _ in range(120)]
    texts = [" ".join(base[:i] + ["x"] + base[i:]) for i in range(0, 120, 10)] + [" ".join("v%d" % rng.randrange(9000) for _ in range(60)) for _ in range(20)]
    made = simhash_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    left = [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in _shared._written[place:]]
    assert left == ["numbered", "similar-stays"] and all(glob.glob(p.removeprefix("file://") + "/*.parquet") for p in _shared._written[place:])
    assert sorted(r["doc_id"] for r in made.collect()) == [0, *range(12, 32)]


def test_texts_that_share_a_line_make_no_families(spark, monkeypatch):
    rng, line = random.Random(8), []
    while not line or simhash_dedup.shingle_set(" ".join(line).encode(), 5)[0] > 1 << 58:  # a shingle that all of the texts keep
        line = ["w%d" % rng.randrange(9000) for _ in range(6)]
    texts = [" ".join([*("w%d" % rng.randrange(10**6) for _ in range(60)), *line]) for _ in range(200)]
    counts = {}

    def counted(df, tag):
        counts[tag] = (out := _shared.materialise(df, tag)).count()
        return out

    monkeypatch.setattr(simhash_dedup, "materialise", counted)
    monkeypatch.setattr(simhash_dedup, "SAMPLE", 1)
    assert simhash_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 200
    assert counts["similar-buckets"] >= 1 and counts["similar-ties"] <= 20  # a tree of all 200 with 64 bits


def test_distances_of_fingerprints_of_two_words():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, (90, 2)).astype(np.uint64)
    b = a[rng.permutation(90)] ^ (rng.integers(0, 1 << 63, (90, 2)) & rng.integers(0, 1 << 63, (90, 2))).astype(np.uint64)
    far = np.bitwise_count(a[:, None] ^ b).sum(axis=2)
    for radius in (20, 32, 41, 64):
        assert (simhash.near_pairs(a, b, radius) == (np.diagonal(far) <= radius)).all()
        lanes = np.unpackbits(simhash.near_lanes(a, simhash.bit_planes(b), radius).view(np.uint8).reshape(90, -1), axis=1, bitorder="little")[:, :90]
        assert (lanes == (far <= radius)).all()
    own, size = np.arange(90) % 7, np.full(90, 10)
    few = [(i, p.tolist()) for i, p in simhash_dedup.apart(own, size, a, 0.8, 60)]
    simhash_dedup.FEW, was = 0, simhash_dedup.FEW
    assert few == [(i, p.tolist()) for i, p in simhash_dedup.apart(own, size, a, 0.8, 60)]
    simhash_dedup.FEW = was
