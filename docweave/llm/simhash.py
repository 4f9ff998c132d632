"""SimHash near-deduplication with bit-sliced distance comparison.

Fingerprints within the radius agree on some parts of their bits (see part_masks), so equal
fingerprints are first collapsed to one row and the rest meet only in buckets of such parts' value.
Inside a bucket the bit planes are stored vertically and carry-save counters hold the distances of
one fingerprint to 64 others per machine word; rows whose every lane is past the radius are dropped
on the way. A bucket gives a spanning forest, never its pairs; crowded buckets are cut into blocks
that meet pairwise, which loses no link. Components then shrink by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._shared import drop_since, mark, materialise, sorted_groups, text_or_empty

#: Fingerprints of one block of a crowded bucket.
BLOCK = 512


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 bits: bit set where over half of the shingles' XXH64 (seed 42) have it; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, 42)
    h = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return majority(np.array([h(flat[a:b], 42) for a, b in spans], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set where over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        lanes = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp long): the fingerprint of every row's whole text; null text counts as empty."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in text_or_empty(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, fp long")


def word_rows(fps: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of words, also those of one word."""
    return fps if fps.ndim == 2 else fps[:, None]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """A row for each bit of the fingerprints (of one word, or a row of words each); lane i of a row is that bit of fingerprint i, 64 lanes to a word."""
    bits = np.unpackbits(np.ascontiguousarray(word_rows(fps)).view(np.uint8), axis=1, bitorder="little").T
    pad = -len(fps) % 64
    lanes = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little")
    return np.ascontiguousarray(lanes).view(np.uint64)


class Counters:
    """Carry-save counters of differing bits, one lane to a bit of each word; lanes past the radius are marked for good."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        self.far = np.zeros(shape, np.uint64)
        self.planes = [np.zeros(shape, np.uint64) for _ in range((radius + 1).bit_length())]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Two bit planes through a full adder into the ripple of counter planes; a carry out of the top marks its lane."""
        planes = self.planes
        ones = planes[0] ^ a
        carry = (planes[0] & a) | (ones & b)
        planes[0] = ones ^ b
        for c in range(1, len(planes)):
            planes[c], carry = planes[c] ^ carry, planes[c] & carry
        self.far = self.far | carry

    def within(self) -> np.ndarray:
        """Lanes whose counters hold at most the radius, compared from the top bit down."""
        less, equal = np.zeros_like(self.far), ~np.zeros_like(self.far)
        for c in reversed(range(len(self.planes))):
            if self.radius >> c & 1:
                less = less | (equal & ~self.planes[c])
                equal = equal & self.planes[c]
            else:
                equal = equal & ~self.planes[c]
        return (less | equal) & ~self.far

    def keep(self, some: np.ndarray) -> None:
        self.far, self.planes = self.far[some], [p[some] for p in self.planes]


def near_lanes(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """For each query a row of lanes: set where the distance to that lane's fingerprint is at most radius.

    Queries with only far lanes leave early.
    """
    out, words = np.zeros((len(queries), planes.shape[1]), np.uint64), word_rows(queries)
    alive, counters = np.arange(len(queries)), Counters(out.shape, radius)
    for p in range(0, len(planes), 2):
        q = words[alive, p >> 6]
        counters.add(*(planes[i][None, :] ^ (np.uint64(0) - (q >> np.uint64(i & 63) & np.uint64(1)))[:, None] for i in (p, p + 1)))
        if p % 16 == 14 and radius < p < len(planes) - 2:
            some = counters.within().any(axis=1)
            if not some.all():
                alive = alive[some]
                counters.keep(some)
                if not len(alive):
                    return out
    out[alive] = counters.within()
    return out


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Mask of the places where left and right differ in at most radius bits: 64 pairs to a word, words of only far pairs leave early."""
    if not len(left):
        return np.zeros(0, bool)
    planes = bit_planes(left) ^ bit_planes(right)
    out = np.zeros(planes.shape[1], np.uint64)
    alive, counters = np.arange(len(out)), Counters(out.shape, radius)
    for p in range(0, len(planes), 2):
        counters.add(planes[p, alive], planes[p + 1, alive])
        if p % 16 == 14 and radius < p < len(planes) - 2:
            some = counters.within() != 0
            if not some.all():
                alive = alive[some]
                counters.keep(some)
    out[alive] = counters.within()
    return np.unpackbits(out.view(np.uint8), bitorder="little")[: len(left)].astype(bool)


def forest(ids: np.ndarray, fps: np.ndarray, radius: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (smallest id, member) of the components that links within the radius make of these rows.

    With left (a mask), only links between a left row and a right row count.
    """
    n = len(ids)
    lanes = near_lanes(fps, bit_planes(fps), radius)
    if left is not None:
        side = np.packbits(np.pad(left, (0, -n % 64)), bitorder="little").view(np.uint64)
        lanes = lanes & np.where(left[:, None], ~side[None, :], side[None, :])
    some = np.flatnonzero(np.bitwise_count(lanes).sum(axis=1) > (1 if left is None else 0))
    if not len(some):
        return []
    tail = (1 << n) - 1
    rows = {int(i): int.from_bytes(lanes[i].tobytes(), "little") & tail for i in some}
    edges, todo = [], set(rows)
    while todo:
        first = todo.pop()
        seen, front = 1 << first, rows[first] & ~(1 << first)
        members = [first]
        while front:
            low = front & -front
            i = low.bit_length() - 1
            seen |= low
            members.append(i)
            todo.discard(i)
            front = (front | rows.get(i, 0)) & ~seen
        if len(members) > 1:
            own = sorted(int(ids[i]) for i in members)
            edges += [(own[0], x) for x in own[1:]]
    return edges


def part_masks(n: int, radius: int, block: int) -> list[int]:
    """Signed 64-bit masks: two fingerprints within the radius agree under at least one of them.

    Of p parts of the bits such a pair agrees on p - radius; all choices of so many are masks. More
    parts give more and longer keys: p is the least for which n fingerprints spread evenly fill
    a key's bucket with a block at most. Every p finds the same pairs.
    """
    for p in range(radius + 1, radius + 5):
        cuts = [round(64 * i / p) for i in range(p + 1)]
        parts = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:])]
        if n <= block << (64 * (p - radius) // p):
            break
    masks = [sum(chosen) for chosen in combinations(parts, p - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(prints: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b), a < b, that connect all rows of prints(rep, fp) within the radius of each other.

    prints has one row per different fingerprint. The edges span the same components as all links.
    """
    parts = F.array(*[F.col("fp").bitwiseAND(F.lit(mask)) for mask in part_masks(prints.count(), radius, block)])
    dealt = prints.select("rep", "fp", F.posexplode(parts).alias("part", "value"))
    crowded = (
        dealt.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > block)
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    )
    # in a crowded bucket a row of block i goes to every pair of blocks with i in it
    mine = F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int")
    meets = (
        dealt.join(crowded, ["part", "value"], "left")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .select("part", "value", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "rep", "fp")
    )
    keys = ["part", "value", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for (_, _, lo, hi), rows in sorted_groups(batches, keys):
            if rows.num_rows < 2:
                continue
            ids, fps = rows["rep"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
            found += forest(ids, fps, radius, None if lo == hi else rows["mine"].to_numpy() == lo)
            if len(found) > 100_000:
                yield edges_of(found)
                found = []
        yield edges_of(found)

    return meets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def edges_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges(a, b) reaches.

    Large-star and small-star steps in turn; the edges become stars around the smallest nodes in
    about log2(nodes) rounds. Each round is written to the shared folder; only the last one stays there.
    """
    place = mark()
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(up, "b")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        after = materialise(small, "cc")
        # stars at last: no node is both a centre and a member
        if after.select("b").join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            if after.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                break
        edges = after
    drop_since(after.sparkSession, place)
    return after.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        after.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4
) -> DataFrame:
    """One row per input row: (id_col, fp long, component_id, n_links).

    Texts are lower-cased (A-Z), cut into words and shingles; fingerprints at most radius bits apart
    are linked and component_id is the smallest id reachable. n_links counts the other rows with the
    same fingerprint. Null and blank texts have fingerprint zero and are linked like any other, as are
    rows with a null id; only where all of a component have none is its id null. Ids may be of any
    type that has an order. Empty tables give no rows.
    """
    rows = materialise(with_fingerprints(docs, id_col, text_col, shingle), "simhash")
    prints = materialise(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "prints")
    nodes = components(near_links(prints.select(F.col("fp").alias("rep"), "fp"), radius))
    of = prints.join(nodes, prints["fp"] == nodes["node"], "left").withColumn("component", F.coalesce("component", "fp"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(least, "component").select("fp", "component_id", (F.col("n") - 1).alias("n_links"))
    return rows.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "n_links")
