"""Text in chunks, rolling hashes, and the exchange of packed pieces between chunks and buckets.

A chunk is some whole documents (a few MB) in the order of their ids. Operators send packed pieces
of chunks to buckets, each bucket answers the chunks, and the answers meet the chunks again, so
every task holds one chunk or one bucket, and a text that fills a third of the corpus is sent at
most once per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docweave.llm._shared import materialise, sorted_groups

CHUNK_BYTES = 4 << 20
#: Different runs of one minimiser that a bucket takes; those of others are cut into single windows.
HOT_RUNS = 1 << 14
BUCKET_BYTES = 4 << 20
#: Chunks are written once and moved once or twice: worth a higher compression level than pieces.
CHUNK_LEVEL = 5
NO_ID = np.iinfo(np.int64).max
MIX = np.uint64(0xFF51AFD7ED558CCD)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def squeeze(raw: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers.clear()
        for b in (_BASE, _INVERSE):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=np.uint64))
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any slices of an integer array, equal for equal slices wherever they stand."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        terms = (values.astype(np.uint64) + np.uint64(1)) * up[: len(values)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all slices of this size, by start."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def sliding_argmin(values: np.ndarray, size: int, place_bits: int = 32) -> np.ndarray:
    """Place of the smallest value (its high bits; leftmost of equals) in each window of this size.

    All arrays must give the same windows the same place, so place_bits may not depend on them.
    """
    if len(values) >> place_bits:
        raise ValueError(f"at most 2**{place_bits} values")
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << place_bits) - 1)
    keys = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= size:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = size - span
    keys = np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys
    return (keys[:n] & low).astype(np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, counts)


def equal_groups(raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Group number of each slice raw[start:end]; equal numbers exactly for equal bytes.

    order lists the slices so that equal hashes stand together; bytes are compared within them.
    """
    same = np.zeros(len(order), bool)
    same[1:] = hashes[order[1:]] == hashes[order[:-1]]
    a, b = starts[order].tolist(), ends[order].tolist()
    clash = False
    for i in np.flatnonzero(same).tolist():
        if raw[a[i] : b[i]] != raw[a[i - 1] : b[i - 1]]:
            clash = True
            break
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(~same) - 1
    if clash:  # different bytes under one hash: number the slices by their bytes
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist())], np.int64)
    return number


def pack(arrays: list[np.ndarray], text: bytes) -> bytes:
    """Arrays of equal length and a text in one compressed blob."""
    head = np.array([len(arrays[0])], np.int64).tobytes()
    return squeeze(head + b"".join(a.tobytes() for a in arrays) + text)


def unpack(blob: bytes, kinds: list[type]) -> tuple[list[np.ndarray], bytes]:
    raw = unsqueeze(blob)
    n, at, arrays = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        arrays.append(np.frombuffer(raw, kind, n, at))
        at += arrays[-1].nbytes
    return arrays, raw[at:]


def make_chunks(docs: DataFrame, id_col: str, text_col: str, tag: str, most: int = CHUNK_BYTES) -> DataFrame:
    """A written table (chunk, ids, lengths, blob, n_bytes): whole documents, by id, texts joined and compressed.

    Null text counts as empty, null ids come last. A document longer than a chunk is a chunk.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "chunk long, ids array<long>, lengths array<long>, blob binary, n_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, texts
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
            whole = b"".join(texts[i] for i in order)
            row = {
                "chunk": number, "ids": [ids[i] for i in order], "lengths": [len(texts[i]) for i in order],
                "blob": squeeze(whole, CHUNK_LEVEL), "n_bytes": len(whole),
            }
            number, ids, texts = number + 1, [], []
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                ("blob", pa.binary()), ("n_bytes", pa.int64()),
            ]))

        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                text = text or b""
                if ids and held + len(text) > most:
                    yield flush()
                    held = 0
                ids.append(key)
                texts.append(text)
                held += len(text)
        if ids:
            yield flush()

    return materialise(slim.mapInArrow(run, schema), tag)


def n_buckets(chunks: DataFrame, most: int = BUCKET_BYTES) -> int:
    """Buckets that stand for so many of the chunks' bytes each."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, math.ceil(total / most))


class Chunk:
    """A chunk in a task: the joined bytes, and for each document its id, start and end."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.raw = unsqueeze(row["blob"])
        self.ids = row["ids"]
        self.order_ids = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths


PIECES = "bucket int, chunk long, kind int, piece binary"


def pieces_of(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
        ["bucket", "chunk", "kind", "piece"],
    )


def send(chunks: DataFrame, cut: Callable[[Chunk], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """Rows (bucket, chunk, kind, piece) of cut(chunk), which gives (bucket, kind, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.slice(i, 1).to_pylist()[0])
                yield pieces_of([(b, chunk.number, k, p) for b, k, p in cut(chunk)])

    return chunks.select("chunk", "ids", "lengths", "blob").mapInArrow(run, PIECES)


def gather(pieces: DataFrame, buckets: int, meet: Callable[[list[int], list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Rows (chunk, answer): meet(chunks, kinds, pieces) of every bucket gives (chunk, answer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in sorted_groups(batches, ["bucket"]):
            answers = list(meet(rows["chunk"].to_pylist(), rows["kind"].to_pylist(), rows["piece"].to_pylist()))
            columns = list(zip(*answers)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], ["chunk", "answer"]
            )

    return (
        pieces.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk", "kind")
        .mapInArrow(run, "chunk long, answer binary")
    )


def keys_of(minimiser: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a minimiser in the high bits, and 32 of its own bits that stand for it there."""
    return (minimiser % np.uint64(buckets)) << np.uint64(32) | minimiser >> np.uint64(32)


def shared_minimisers(chunks: DataFrame, runs: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], buckets: int, hot_runs: int) -> DataFrame:
    """Rows (chunk, answer): which of a chunk's minimisers other chunks have too, and which of them are hot, for repeating().

    runs(chunk) gives the minimiser and the hash of every run of windows. Only keys of 32 bits travel,
    with the number of different runs; two minimisers with one key in a bucket are only kept in vain.
    A key is hot if more than hot_runs different runs of all chunks have it: the same short gram with
    other text around it each time, which would fill one bucket.
    """

    def own(chunk: Chunk) -> Iterator[tuple[int, int, bytes]]:
        minimiser, whole = runs(chunk)
        keys = keys_of(minimiser, buckets)
        order = np.lexsort((whole, keys))
        keys, whole = keys[order], whole[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1])]) if len(keys) else np.zeros(0, bool)
        n = np.add.reduceat(fresh.astype(np.int32), first) if len(first) else first.astype(np.int32)
        keys = keys[first]
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys))
        for a, z in zip(cuts[:-1], cuts[1:]):
            b = int(bucket[a])
            yield b, b, pack([np.diff(keys[a:z].astype(np.uint32), prepend=np.uint32(0)), n[a:z].astype(np.int32)], b"")

    def meet(numbers: list[int], kinds: list[int], pieces: list[bytes]) -> Iterator[tuple[int, bytes]]:
        sent = [unpack(p, [np.uint32, np.int32])[0] for p in pieces]
        keys = [np.cumsum(k, dtype=np.uint32) for k, _ in sent]
        every, n = np.concatenate(keys), np.concatenate([n for _, n in sent])
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.diff(every[order].astype(np.int64), prepend=-1))
        met, total = np.diff(np.append(first, len(every))), np.add.reduceat(n[order].astype(np.int64), first)
        twice, hot = every[order][first][met > 1], (total > hot_runs)[met > 1]
        for number, mine in zip(numbers, keys):
            at = np.flatnonzero(np.isin(twice, mine, assume_unique=True))
            if len(at):
                yield number, pack([twice[at].astype(np.uint64) | np.uint64(kinds[0] << 32), hot[at]], b"")

    return gather(send(chunks, own), buckets, meet)


def known_keys(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys that other chunks have, mask of the hot ones) of the answers to a chunk."""
    told = [unpack(a, [np.uint64, np.bool_])[0] for a in answers]
    keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in told)])
    hot = np.concatenate([np.zeros(0, bool), *(h for _, h in told)])
    order = np.argsort(keys)
    return keys[order], hot[order]


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Mask of the keys that are in the sorted array known."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def answer_chunks(chunks: DataFrame, answers: DataFrame, tell: Callable[[Chunk, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Every chunk with all answers to it."""

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = right.column("answer").to_pylist()
        told = [batch for row in left.to_pylist() for batch in tell(Chunk(row), got)]
        return pa.Table.from_batches(told, None if told else arrow)

    return (
        chunks.select("chunk", "ids", "lengths", "blob").groupBy("chunk")
        .cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
    )
