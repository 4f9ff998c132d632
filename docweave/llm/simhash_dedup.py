"""SimHash near-deduplication of a corpus: bit-sliced fingerprints propose, shingle sets decide.

A link is a Jaccard index of the texts' word shingles of the similarity or more. At 0.8 two
fingerprints of 128 bits differ in about twenty, too many for parts of the bits as keys. So texts meet
by shingles instead: a text keeps the few of its shingles that come first in one order of all (rare
ones before those that a sample finds often), and two sets of the similarity share a kept shingle.
Of the texts that meet, bit planes of 64 pairs at a time are counted with carry-save adders, and
words of only far pairs are abandoned; the radius is the least that a pair at the similarity
exceeds once in a million. With 64 bits that is 25, which one unrelated pair in twenty is within: texts
that share a line would then make families that grow with the square of the corpus; with 128 it is 41, one
in 40 000. What is left is compared by its shingles. A bucket first sends stars
around a few of its members, whose pairs are verified. Where a bucket then still holds several
components, those with fingerprints within the radius make a family (a spanning forest is sent, not
the pairs); the texts of a family meet in one task, or block by block if they are many, and
whatever is still apart is compared there, so pairs never leave a task. Equal sets are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._chunks import squeeze, unsqueeze
from docweave.llm._shared import ROW, drop_since, mark, materialise, numbered, sorted_groups, text_or_empty
from docweave.llm.simhash import bit_planes, components, edges_of, near_lanes, near_pairs

#: Texts of the sample that tells often met shingles, and how many of those are told to the tasks.
SAMPLE, OFTEN = 16_384, 200_000
#: Star centres of a bucket are the least members under so many hashes.
STARS = 4
#: Parts that the texts to be compared with one centre are dealt into.
SALTS = 64
#: Pairs held before they are compared and sent, and texts of one block of a family.
PAIRS, BLOCK = 1 << 17, 4096
#: Members up to which a bucket's fingerprints are compared word by word: setting up bit planes takes longer.
FEW = 512
#: Words of 64 bits of a fingerprint.
WORDS = 2
#: Most bits, as a power of two, of the map that tells which texts may be compared (8 MB).
MAP_BITS = 26


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 of the lower-cased (A-Z) text's shingles; of fewer words the whole sequence, of none nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(flat)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.unique(np.array([h(flat[a:b]) for a, b in spans], np.uint64))


def fingerprint(hashes: np.ndarray) -> bytes:
    """WORDS words of bits, each set where over half of the hashes, or of what they are mixed to for a later word, have it."""
    words, ones = [hashes], np.zeros(64 * WORDS, np.int64)
    while len(words) < WORDS:
        h = words[-1] + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        words.append(h ^ h >> np.uint64(31))
    lanes = np.stack(words, axis=1).view(np.uint8)
    for at in range(0, len(lanes), 8192):
        ones += np.unpackbits(lanes[at : at + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def words_of(fps: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of words; each item may hold several."""
    return np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WORDS)


def radius_for(similarity: float, miss: float = 1e-6, bits: int = 64 * WORDS) -> int:
    """The least number of differing bits that two sets of the similarity exceed with no more than this probability.

    Sets of equal size are the worst case: their angle has cosine 2 s / (1 + s), and a bit differs
    with probability angle / pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    within = 0.0
    for d in range(bits + 1):
        within += math.comb(bits, d) * p**d * (1 - p) ** (bits - d)
        if 1 - within <= miss:
            return d
    return bits


def prefix(hashes: np.ndarray, similarity: float, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first |set| - ceil(similarity x |set|) + 1 hashes by (count in the sample, hash)."""
    n = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    if not len(often) or n >= len(hashes):
        return hashes[:n]
    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
    rank = np.where(often[at] == hashes, counts[at], 0)
    return hashes[np.argsort(rank, kind="stable")[:n]]


def _often(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles met most in a sample of the texts."""
    every = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64(ROW), F.lit(every)) == 0).select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in text_or_empty(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["h"])

    met = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    top = materialise(met.orderBy(F.desc("n"), "h").limit(OFTEN), "similar-often").toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _buckets(reps: DataFrame) -> DataFrame:
    """(h1, h2, members): int64 arrays as binary, by member, of every kept shingle of reps(rep, keys) that two sets or more share; h1, h2 name the members."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(k, np.int64) for k in batch.column(1).to_pylist()]
            rep = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(rep)], ["key", "rep"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2
        seen: set[bytes] = set()

        def gather(cut: int) -> pa.RecordBatch:
            key, rep = (x[:cut] for x in held)
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if cut else np.zeros(1, np.int64)
            members = []
            for i in np.flatnonzero(np.diff(edges) > 1):
                m = rep[edges[i] : edges[i + 1]].tobytes()
                if (d := xxhash.xxh128_digest(m)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(d)
                    members.append(m)
            return pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["members"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for c, x in enumerate(held)]
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield gather(cut)
                held = [x[cut:] for x in held]
        yield gather(len(held[0]))

    # only the shingle and the number move for all kept shingles; sizes and fingerprints go to the few that meet
    dealt = reps.select("rep", "keys").mapInArrow(deal, "key long, rep long")
    met = dealt.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(meet, "members binary")
    return met.groupBy(F.xxhash64("members", F.lit(1)).alias("h1"), F.xxhash64("members", F.lit(2)).alias("h2")).agg(F.first("members").alias("members"))


def _described(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(h1, h2, members, sizes, fps) of the buckets: with the set size and fingerprint of each member, from nodes(rep, size, fp)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [np.frombuffer(m, np.int64) for m in batch.column(2).to_pylist()]
            own = [pa.array(np.repeat(batch.column(c).to_numpy(), [len(m) for m in members])) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate([np.zeros(0, np.int64), *members]))], ["h1", "h2", "rep"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (h1, h2), rows in sorted_groups(batches, ["h1", "h2"]):
            own = [rows["rep"].to_numpy().tobytes(), rows["size"].to_numpy().tobytes(), b"".join(rows["fp"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([h1]), pa.array([h2]), *[pa.array([x], pa.binary()) for x in own]], ["h1", "h2", "members", "sizes", "fps"])

    rows = buckets.select("h1", "h2", "members").mapInArrow(spread, "h1 long, h2 long, rep long").join(nodes.select("rep", "size", "fp"), "rep").select("h1", "h2", "rep", "size", "fp")
    return rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "rep").mapInArrow(gather, "h1 long, h2 long, members binary, sizes binary, fps binary")


def fitting(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Mask of the set sizes that allow the similarity."""
    return np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9


def _stars(buckets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Distinct pairs (a, b) of each bucket's centres and those of its other members that fit in size and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size_held = 0

        def near() -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in held)]) for c in (0, 1))
            left, right = (np.concatenate([np.zeros((0, WORDS), np.uint64), *(x[c] for x in held)]) for c in (2, 3))
            keep = near_pairs(left, right, radius)
            pairs = np.unique(np.stack([a[keep], b[keep]], axis=1), axis=0)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            for i in range(batch.num_rows):
                rep, size = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in range(2))
                fp = words_of([batch.column(2)[i].as_py()])
                mixed = rep.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                centres = {int(np.argmin(mixed * np.uint64(2 * i + 1) ^ mixed >> np.uint64(29))) for i in range(STARS)} if len(rep) > 2 else {0}
                for c in centres:
                    fits = fitting(size, size[c], similarity)
                    fits[c] = False
                    n = int(fits.sum())
                    held.append((np.full(n, rep[c]), rep[fits], np.repeat(fp[c : c + 1], n, axis=0), fp[fits]))
                    size_held += n
                if size_held > PAIRS:
                    yield near()
                    size_held = 0
        yield near()

    return buckets.select("members", "sizes", "fps").mapInArrow(run, "a long, b long").distinct()


class Sets:
    """Union-find over numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, i: int) -> int:
        up = self.up
        while (j := up.get(i, i)) != i:
            up[i] = up.get(j, j)
            i = j
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def apart(own: np.ndarray, size: np.ndarray, fp: np.ndarray, similarity: float, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places) for members outside the largest component: those of other components that fit in size and fingerprint."""
    kinds, number, count = np.unique(own, return_inverse=True, return_counts=True)
    queries = np.flatnonzero(number != count.argmax())
    planes, step = bit_planes(fp) if len(own) > FEW else None, max(1, (1 << 22) // len(own))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        if planes is None:
            bits = np.bitwise_count(fp[part][:, None] ^ fp).sum(axis=2) <= radius
        else:
            lanes = near_lanes(fp[part], planes, radius)
            bits = np.unpackbits(lanes.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")[:, : len(own)].astype(bool)
        bits &= (own[part][:, None] != own) & fitting(size[part][:, None], size, similarity)
        for i, row in zip(part.tolist(), bits):
            if row.any():
                yield i, np.flatnonzero(row)


def _ties(buckets: DataFrame, labels: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Edges (a, b) that connect, within each bucket, what fits in size and fingerprint and is in different components: a forest."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = [np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in (2, 3)]
                columns = [np.full(len(own[0]), batch.column(c)[i].as_py()) for c in (0, 1)] + own
                fp = pa.array([x.tobytes() for x in words_of([batch.column(4)[i].as_py()])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], fp], ["h1", "h2", "rep", "size", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()
        tied = Sets()  # components that earlier buckets of this task have tied are not compared again
        for _, rows in sorted_groups(batches, ["h1", "h2"]):
            rep, size, own = (rows[c].to_numpy() for c in ("rep", "size", "component"))
            if (own == own[0]).all():
                continue
            kinds, number = np.unique(own, return_inverse=True)
            own = np.array([tied.find(k) for k in kinds.tolist()], np.int64)[number]
            if (own == own[0]).all():
                continue
            for i, places in apart(own, size, words_of(rows["fp"].to_pylist()), similarity, radius):
                _, first = np.unique(own[places], return_index=True)
                edges |= {(int(rep[i]), int(rep[j])) for j in places[first].tolist() if tied.join(int(own[i]), int(own[j]))}
            if len(edges) > PAIRS:
                yield edges_of(sorted(edges))
                edges = set()
        yield edges_of(sorted(edges))

    # of two members the star was the only pair
    rows = buckets.where(F.octet_length("members") > 16).select("h1", "h2", "members", "sizes", "fps").mapInArrow(spread, "h1 long, h2 long, rep long, size long, fp binary")
    rows = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "rep", "size", "fp", F.coalesce("component", "rep").alias("component"))
    return rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(run, "a long, b long").distinct()


def _family_links(members: DataFrame, similarity: float, radius: int, shingle: int) -> DataFrame:
    """Edges (a, b) of the similarity that connect what can be connected in each family, of members(family, rep, size, fp, component, text)."""
    many = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int").alias("mine")
    meets = members.join(many, "family").select("*", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["family", "lo", "hi"]
    meets = meets.select("family", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "rep", "size", "fp", "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), rows in sorted_groups(batches, keys):
            rep, size, own, mine = (rows[c].to_numpy() for c in ("rep", "size", "component", "mine"))
            joined, found, number = Sets(), [], own.tolist()
            texts = rows["text"].cast(pa.binary()).to_pylist()
            shingles: dict[int, np.ndarray] = {}

            def set_of(i: int) -> np.ndarray:
                if i not in shingles:
                    shingles[i] = shingle_set(texts[i] or b"", shingle)
                return shingles[i]

            for i, places in apart(own, size, words_of(rows["fp"].to_pylist()), similarity, radius):
                for j in places.tolist():
                    if (lo == hi or mine[i] != mine[j]) and joined.find(number[i]) != joined.find(number[j]):
                        both = len(np.intersect1d(set_of(i), set_of(j), assume_unique=True))
                        if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                            joined.join(number[i], number[j])
                            found.append((int(rep[i]), int(rep[j])))
            yield edges_of(found)

    return meets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of the ends of pairs, and few others, without a shuffle of all texts: by a bit map of hashed row numbers."""
    bits = min(MAP_BITS, max(16, (16 * pairs.count()).bit_length()))

    def place(rows: np.ndarray) -> np.ndarray:
        return (rows.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for batch in batches:
            for column in batch.columns:
                held[place(column.to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([squeeze(np.packbits(held).tobytes())], pa.binary())], ["map"])

    held = np.zeros(1 << bits >> 3, np.uint8)
    for row in pairs.select("a", "b").mapInArrow(mark, "map binary").toLocalIterator():
        held |= np.frombuffer(unsqueeze(bytes(row["map"])), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(batch.column(0).to_numpy())
            yield batch.filter(pa.array(held[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1 == 1))

    return texts.mapInArrow(run, texts.schema)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets have the similarity; texts is (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for a, left, right in zip(batch.column(0).to_pylist(), text_or_empty(batch, "ta"), text_or_empty(batch, "tb")):
                if a != last:
                    last, of_last = a, shingle_set(left, shingle)
                other = shingle_set(right, shingle)
                both = len(np.intersect1d(of_last, other, assume_unique=True))
                keep.append(both >= similarity * (len(of_last) + len(other) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    place = mark()
    texts = materialise(_compared(pairs, texts), "similar-texts")
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    left = salted.select("a", "salt").distinct().join(texts.select(F.col(ROW).alias("a"), F.col("text").alias("ta")), "a")
    right = salted.join(texts.select(F.col(ROW).alias("b"), F.col("text").alias("tb")), "b")
    both = right.join(left, ["a", "salt"]).select("a", "b", "ta", "tb")
    found = materialise(both.mapInArrow(run, "a long, b long"), "similar-pairs")
    drop_since(found.sparkSession, place)
    return found


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of docs that stay, all columns: one row of each component of texts with the similarity or more.

    Similarity is the Jaccard index of the sets of shingles (see shingle_set); links reach on. A pair
    at the similarity itself is missed with a probability of at most 1e-6 (see radius_for). Blank
    and null texts are equal to each other. The row with the smallest id stays, null ids last; of
    rows with one id the first. Of what is written on the way the numbered rows and the numbers of those
    that stay are left.
    """
    docs, radius, spark = numbered(docs), radius_for(similarity), docs.sparkSession
    place = mark()
    often, counts = _often(docs, text_col, shingle)
    slim = docs.select(ROW, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in text_or_empty(batch, "text")]
            keys = [prefix(s, similarity, often, counts).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array(keys, pa.binary())],
                [ROW, "id", "sig", "size", "fp", "keys"],
            )

    rows = materialise(slim.mapInArrow(run, f"{ROW} long, id {dict(slim.dtypes)['id']}, sig binary, size long, fp binary, keys binary"), "similar-sets")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(ROW).alias("row")))
    nodes = rows.groupBy("sig").agg(first.alias("best"), F.first("size").alias("size"), F.first("fp").alias("fp"))
    nodes = materialise(nodes.select("best", F.col("best.row").alias("rep"), "size", "fp"), "similar-nodes")
    buckets = materialise(_buckets(rows.join(nodes.select("rep"), rows[ROW] == nodes["rep"]).select("rep", "keys")), "similar-members")
    drop_since(spark, place, keep=2)
    buckets = materialise(_described(buckets, nodes), "similar-buckets")

    texts = slim.select(ROW, "text")
    tried = materialise(_stars(buckets, similarity, radius), "similar-stars")
    links = _verified(tried, texts, similarity, shingle)
    labels = components(links)
    ties = materialise(_ties(buckets, labels, similarity, radius), "similar-ties")
    if not ties.isEmpty():
        families = materialise(components(ties.unionByName(links)), "similar-families")
        some = families.join(ties.select(F.col("a").alias("node")).unionByName(ties.select(F.col("b").alias("node"))), "node", "left_semi").select("component").distinct()
        of_family = families.join(some, "component", "left_semi").select(F.col("node").alias("rep"), F.col("component").alias("family"))
        of_family = materialise(of_family.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "similar-families")
        near = materialise(_compared(of_family.select(F.col("rep").alias("a"), F.col("rep").alias("b")), texts), "similar-texts")
        members = of_family.join(nodes.select("rep", "size", "fp"), "rep").join(near.withColumnRenamed(ROW, "rep"), "rep")
        more = materialise(_family_links(members, similarity, radius, shingle), "similar-more")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    of = nodes.join(labels, nodes["rep"] == labels["node"], "left").select("best", F.coalesce("component", "rep").alias("component"))
    stays = materialise(of.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias(ROW)), "similar-stays")
    drop_since(spark, place)
    return docs.join(stays, ROW, "left_semi").drop(ROW)
