"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every passage with block-max WAND.

The test items are the indexed collection, document passages are the queries. Statistics (document
frequencies, mean length) are taken over the whole benchmark in Spark. An index holds posting lists
in item order with the largest impact of every term and of every block of items. Impacts are divided
by the item's score for its own text, so one threshold serves all items. The block bounds of many
passages are added up at once; a passage with no block that can reach the threshold is done, the
others run WAND: the pivot is the first item that the terms up to it can lift to the threshold, and
blocks that cannot reach it are skipped. Every item at or above the threshold is retrieved, and then
verified on shingles of its question and its answer.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._chunks import ranges
from docweave.llm._shared import materialise, slices, text_or_empty

K1, B = 1.2, 0.75
BLOCK_ITEMS = 4
#: Bounds of one index, and text bytes of the indexes broadcast at once; a larger benchmark takes more passes.
INDEX_ITEMS, BROADCAST_BYTES = 4096, 4 << 20
#: Passages whose block bounds are added up at once, and text of one piece of work in a task.
PASSAGES, PIECE_BYTES = 1024, 2 << 20
#: What sums of impacts may lose to rounding.
SLACK = 1e-9

_words = re.compile(r"[^\W_]+").findall


def words_of(text: bytes) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _words(text.decode("utf-8", "replace").lower())


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    """Distinct shingles; of fewer words the whole sequence, of none nothing."""
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(size)]))


def question_and_answer(text: bytes) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; an item of one sentence gives its last third."""
    parts = [w for s in re.split(r"(?<=[.!?])\s+", text.decode("utf-8", "replace").strip()) if (w := words_of(s.encode()))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


class Index:
    """Posting lists of some test items: item numbers and impacts by term, block maxima, and the texts to verify."""

    def __init__(self, rows: list[dict]):
        self.entries = [r["entry"] for r in rows]
        self.texts = [r["text"].encode() for r in rows]
        self.reach = max(r["length"] for r in rows)
        names = sorted({t for r in rows for t in r["terms"]})
        self.terms = {t: i for i, t in enumerate(names)}
        term = np.array([self.terms[t] for r in rows for t in r["terms"]], np.int64)
        item = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
        impact = np.array([x for r in rows for x in r["impacts"]], np.float64)
        order = np.lexsort((item, term))
        self.item, self.impact = item[order].astype(np.int32), impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(names) + 1))
        self.most = np.maximum.reduceat(self.impact, self.starts[:-1])
        # the largest impact of each term in each block of items that it occurs in
        at = term[order] * self.n_blocks + self.item // BLOCK_ITEMS
        first = np.flatnonzero(np.diff(at, prepend=-1))
        self.block = (at[first] % self.n_blocks).astype(np.int32)
        self.block_most = np.maximum.reduceat(self.impact, first)
        self.block_starts = np.searchsorted(at[first] // self.n_blocks, np.arange(len(names) + 1))
        self._parts: dict[int, tuple] = {}

    @property
    def n_blocks(self) -> int:
        return -(-len(self.entries) // BLOCK_ITEMS)

    def parts(self, item: int) -> tuple[list[str], list[str], list[str]]:
        """Words of an item, of its question and of its answer."""
        if item not in self._parts:
            self._parts[item] = (words_of(self.texts[item]), *question_and_answer(self.texts[item]))
        return self._parts[item]

    def bounds(self, passage: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """What each block could score at most for each of n passages, whose different terms are (passage, terms)."""
        counts = self.block_starts[terms + 1] - self.block_starts[terms]
        at = ranges(self.block_starts[terms], counts)
        cell = np.repeat(passage, counts) * self.n_blocks + self.block[at]
        return np.bincount(cell, self.block_most[at], n * self.n_blocks).reshape(n, self.n_blocks)

    def wand(self, terms: list[int], bound: np.ndarray, threshold: float) -> Iterator[tuple[int, float]]:
        """(item, score) of every item that these terms score at least threshold, in item order."""
        live = np.flatnonzero(bound >= threshold).tolist()
        cursors = []  # [item, place, posting items, impacts, largest impact]
        for t in terms:
            cut = slice(self.starts[t], self.starts[t + 1])
            items = self.item[cut].tolist()
            cursors.append([items[0], 0, items, self.impact[cut].tolist(), float(self.most[t])])

        def advance(some: list[list], item: int) -> None:
            for c in some:
                c[1] = bisect_left(c[2], item, c[1])
                c[0] = c[2][c[1]] if c[1] < len(c[2]) else -1

        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[4]
                if total >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return
            item = cursors[pivot][0]
            at = bisect_left(live, item // BLOCK_ITEMS)
            if at == len(live):
                return
            if live[at] != item // BLOCK_ITEMS:  # the pivot's block cannot reach the threshold: on to the next that can
                advance(cursors, live[at] * BLOCK_ITEMS)
            elif cursors[0][0] == item:
                own = [c for c in cursors if c[0] == item]
                score = sum(c[3][c[1]] for c in own)
                if score >= threshold:
                    yield item, score
                advance(own, item + 1)
            else:
                advance(cursors[:pivot], item)
            cursors = [c for c in cursors if c[0] >= 0]


def retrieve(index: Index, texts: list[list[str]], threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """(text, first word of the passage, item, score) for every item at or above the threshold.

    Passages of 2 x reach words start at every reach words, so any run of reach words lies in one.
    """
    threshold -= SLACK
    get, reach = index.terms.get, index.reach
    lengths = np.array([len(t) for t in texts])
    ids = np.fromiter((get(w, -1) for t in texts for w in t), np.int64, int(lengths.sum()))
    text_of = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    per_text = np.maximum(1, -(-lengths // reach))
    base = np.cumsum(per_text) - per_text
    known = ids >= 0
    ids, text_of, place = ids[known], text_of[known], place[known]
    last = base[text_of] + place // reach
    also = place >= reach
    n_terms = len(index.terms)
    pairs = np.unique(np.concatenate([last * n_terms + ids, (last[also] - 1) * n_terms + ids[also]]))
    passages, terms = pairs // n_terms, pairs % n_terms
    starts = np.flatnonzero(np.diff(passages, prepend=-1))
    ends = np.append(starts[1:], len(passages))
    for lo in range(0, len(starts), PASSAGES):
        hi = min(lo + PASSAGES, len(starts))
        a, z = starts[lo], ends[hi - 1]
        bound = index.bounds(np.repeat(np.arange(hi - lo), ends[lo:hi] - starts[lo:hi]), terms[a:z], hi - lo)
        for p in np.flatnonzero((bound >= threshold).any(axis=1)).tolist():
            passage = int(passages[starts[lo + p]])
            text = int(np.searchsorted(base, passage, "right")) - 1
            own = terms[starts[lo + p] : ends[lo + p]].tolist()
            for item, score in index.wand(own, bound[p], threshold):
                yield text, (passage - int(base[text])) * reach, item, round(score, 9)


def verify(parts: tuple[list[str], list[str], list[str]], passage: list[str], size: int) -> tuple[float, float, float]:
    """Share of the item's, its question's and its answer's shingles that occur in the passage."""
    have = shingles(passage, size)

    def share(words: list[str]) -> float:
        if len(words) < size:
            n = len(words)
            return float(any(passage[i : i + n] == words for i in range(len(passage) - n + 1))) if n else 1.0
        own = shingles(words, size)
        return len(own & have) / len(own)

    return tuple(share(p) for p in parts)


def leaks_in(texts: list[bytes], indexes: list[Index], threshold: float, overlap: float, size: int) -> Iterator[tuple]:
    """(text, item's entry, score, overlap, question_overlap, answer_overlap), best passage per text and item."""
    split = [words_of(t) for t in texts]
    best: dict[tuple[int, int], tuple] = {}
    for index in indexes:
        for text, at, n, score in retrieve(index, split, threshold):
            parts, key = index.parts(n), (text, index.entries[n])
            shares = verify(parts, split[text][at : at + 2 * index.reach], size)
            sides = [s for s, w in zip(shares[1:], parts[1:]) if len(w) >= size]
            if shares[0] >= overlap and all(s >= 0.5 for s in sides):
                best[key] = max(best.get(key, (0.0,)), (score, *shares))
    for (text, key), row in sorted(best.items()):
        yield (text, key, *row)


def item_table(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(entry, item_id, text, length, size, terms, impacts): a written row for every test item with words.

    BM25 statistics are those of all items; impacts are shares of the item's score for itself.
    """
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = materialise(rows.withColumn("entry", F.monotonically_increasing_id()), "test-items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in text_or_empty(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["entry", "words"])

    words = rows.select("entry", "text").mapInArrow(cut, "entry long, words array<string>").where(F.size("words") > 0)
    stats = words.agg(F.count("*").alias("n_items"), F.avg(F.size("words")).alias("mean"))
    tf = words.select("entry", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("entry", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n_items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))
    scored = tf.join(df, "term").join(F.broadcast(stats)).select("entry", "length", "term", (idf * F.col("tf") * (K1 + 1) / norm).alias("impact"))
    own = scored.groupBy("entry", "length").agg(F.sort_array(F.collect_list(F.struct("term", "impact"))).alias("own"))
    whole = own.withColumn("whole", F.aggregate("own.impact", F.lit(0.0), lambda s, x: s + x))  # in the order of terms, so that reruns agree
    whole = whole.select("entry", "length", "own.term", F.transform("own.impact", lambda x: x / F.col("whole")).alias("impacts"))
    return materialise(
        rows.join(whole.withColumnRenamed("term", "terms"), "entry").withColumn("size", F.octet_length("text")), "test-index"
    )


def index_groups(items: DataFrame) -> Iterator[list[Index]]:
    """Indexes in groups of bounded size, one group at a time in the driver; one empty group where there are no items.

    The benchmark is the stated query set. Items of about the same length share an index, so that
    passages are no longer than they must be.
    """
    group: list[Index] = []
    rows: list[dict] = []
    held = 0
    grade = F.ceil(F.log2("length")).alias("grade")
    for row in items.select("entry", "text", "length", "size", "terms", "impacts", grade).orderBy("grade", "entry").toLocalIterator():
        full = held and held + row["size"] > BROADCAST_BYTES
        if rows and (full or len(rows) == INDEX_ITEMS or row["grade"] != rows[-1]["grade"]):
            group.append(Index(rows))
            rows = []
        if full:
            yield group
            group, held = [], 0
        rows.append(row.asDict())
        held += row["size"]
    if rows:
        group.append(Index(rows))
    yield group


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.5,
    overlap: float = 0.8,
    shingle: int = 5,
) -> DataFrame:
    """One row per leak: (id_col, item_id, score, overlap, question_overlap, answer_overlap).

    A leak is an item that some passage of the document scores at least threshold of the item's own
    score for, of whose shingles at least overlap occur in that passage, and half or more of those
    of its question and of its answer (a side shorter than a shingle does not decide). Null and blank
    texts and items without words leak nothing; items with a null id are items like any other, and
    their leaks have a null item_id; rows repeated under one id give one row per item id; an empty
    benchmark or table gives no rows. The benchmark is the stated query set: it is read in pieces of
    bounded size, each of which meets all rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(slim.dtypes)['id']}, entry long, score double, overlap double, question_overlap double, answer_overlap double"
    names = ["entry", "score", "overlap", "question_overlap", "answer_overlap"]
    items, out = item_table(benchmark, item_col, item_text_col), None
    for indexes in index_groups(items):
        held = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece, texts in slices(batch, "text", PIECE_BYTES):
                    found = list(leaks_in(texts, held.value, threshold, overlap, shingle))
                    at = pa.array([f[0] for f in found], pa.int64())
                    columns = [pa.array([f[i] for f in found], pa.int64() if i == 1 else pa.float64()) for i in range(1, 6)]
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(at), *columns], ["id", *names])

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.join(items.select("entry", "item_id"), "entry").groupBy(F.col("id").alias(id_col), "item_id").agg(
        *[F.max(c).alias(c) for c in ("score", "overlap", "question_overlap", "answer_overlap")]
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.5,
    overlap: float = 0.8,
    shingle: int = 5,
) -> DataFrame:
    """The rows of docs that hold no leak, all columns, nulls and blanks kept; no shuffle of docs."""
    schema = docs.schema
    for indexes in index_groups(item_table(benchmark, item_col, item_text_col)):
        held = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece, texts in slices(batch, text_col, PIECE_BYTES):
                    bad = {f[0] for f in leaks_in(texts, held.value, threshold, overlap, shingle)}
                    yield piece.filter(pa.array([i not in bad for i in range(piece.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
