"""Substring deduplication over word windows by super-k-mer partitioning.

Every window of consecutive words has a minimiser, the smallest hash among the short word grams in
it. Consecutive windows with the same minimiser travel as one packed string to the minimiser's
bucket, where all windows are sorted and equal ones, compared byte for byte, are ordered by where
they start. Keys of the minimisers go first: the windows of a minimiser that is met once in all the
corpus are met once and stay. Strings that repeat within a chunk are sent once; the later ones are
answered there. A minimiser that stands in very many different strings (words that all documents
share, each time with other words around them) would fill one bucket: its strings are cut into
single windows, each of which goes to the bucket of its own hash, where equal ones still meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm._chunks import (
    BUCKET_BYTES, CHUNK_BYTES, HOT_RUNS, PIECES, Chunk, Rolling, among, answer_chunks, equal_groups, gather, keys_of, known_keys, make_chunks,
    n_buckets, pack, pieces_of, ranges, shared_minimisers, sliding_argmin, squeeze, unpack, unsqueeze,
)

#: Words of the gram whose hash is the minimiser.
GRAM = 4
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SENT, TOLD = 0, 1
#: A bucket is sorted in so many parts, so that a task holds the hashes of one part at a time.
PARTS = 8


class Words:
    """The words of a chunk: flat text with one space after each word, starts and ends, document of each."""

    def __init__(self, chunk: Chunk):
        byte = np.frombuffer(chunk.raw, np.uint8)
        space = SPACE[byte]
        first = np.zeros(len(byte), bool)  # first byte of a document
        first[chunk.starts[chunk.lengths > 0]] = True
        fresh = np.concatenate([[True], space[:-1]]) | first if len(byte) else first
        starts = np.flatnonzero(~space & fresh)
        closes = np.flatnonzero(~space & np.concatenate([fresh[1:] & ~space[1:] | space[1:], [True]]) if len(byte) else space)
        lengths = closes + 1 - starts
        self.of = np.searchsorted(chunk.ends, starts, "right")
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        flat = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
        flat[ranges(self.starts, lengths)] = byte[~space]
        self.flat = flat
        self.counts = np.bincount(self.of, minlength=len(chunk.ids))
        self.first_word = np.cumsum(self.counts) - self.counts


def super_kmers(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """(first window, number of windows, hash of the minimiser) of each run of windows, and the byte hashes."""
    rolling = Rolling(words.flat)
    hashes = rolling.of(words.starts, words.ends)
    grams = Rolling(hashes >> np.uint64(1)).windows(GRAM)
    least = sliding_argmin(grams, window - GRAM + 1)
    n = max(0, len(words.of) - window + 1)
    valid = words.of[:n] == words.of[window - 1 :][:n]
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), rolling
    least = least[at]
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(at) > 1) | (np.diff(least) != 0)
    head = np.flatnonzero(cut)
    return at[head], np.diff(np.append(head, len(at))), grams[least[head]], rolling


def _cut(chunk: Chunk, answers: list[bytes], window: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    words = Words(chunk)
    first, count, minimiser, rolling = super_kmers(words, window)
    # a minimiser met once in all chunks is that of windows met once: they stay
    key = keys_of(minimiser, buckets)
    own, met = np.unique(key, return_counts=True)
    known, hot = known_keys(answers)
    keep = np.flatnonzero(among(key, known) | among(key, own[met > 1]))
    first, count, minimiser, key = first[keep], count[keep], minimiser[keep], key[keep]
    if not len(first):
        return
    split = among(key, known[hot])
    if split.any():  # each window of a hot minimiser's runs goes by its own hash
        alone = ranges(first[split], count[split])
        own = rolling.of(words.starts[alone], words.ends[alone + window - 1])
        first, count = np.concatenate([first[~split], alone]), np.concatenate([count[~split], np.ones(len(alone), np.int64)])
        minimiser = np.concatenate([minimiser[~split], own])
        order = np.argsort(first, kind="stable")
        first, count, minimiser = first[order], count[order], minimiser[order]
    begin, end = words.starts[first], words.ends[first + count + window - 2]
    whole = rolling.of(begin, end)
    order = np.argsort(whole, kind="stable")
    number = equal_groups(words.flat.tobytes(), begin, end, whole, order)
    _, lead = np.unique(number, return_index=True)
    later = np.ones(len(first), bool)
    later[lead] = False
    # runs that stood earlier in this chunk, word for word: all their windows repeat
    told = ranges(first[later], count[later]).astype(np.int32)
    if len(told):
        yield int(chunk.number % buckets), TOLD, squeeze(told.tobytes())
    bucket = (minimiser % np.uint64(buckets)).astype(np.int64)
    part = (minimiser // np.uint64(buckets) % np.uint64(PARTS)).astype(np.int64)
    mine = np.sort(lead)
    mine = mine[np.argsort(bucket[mine] * PARTS + part[mine], kind="stable")]
    doc = words.of[first]
    cuts = np.append(np.flatnonzero(np.diff(bucket[mine], prepend=-1)), len(mine))
    for a, z in zip(cuts[:-1], cuts[1:]):
        own = mine[a:z]
        size = end[own] - begin[own] + 1
        text = words.flat[ranges(begin[own], size)].tobytes()
        rows = np.bincount(part[own], minlength=PARTS)
        head = np.concatenate([rows, np.bincount(part[own], size, PARTS).astype(np.int64)])
        # differences of rising numbers, which compress well
        arrays = [
            np.diff(chunk.order_ids[doc[own]], prepend=0),
            np.diff(words.first_word[doc[own]], prepend=0).astype(np.int32),
            np.diff(first[own], prepend=0).astype(np.int32),
            (count[own] + window - 1).astype(np.int32),
        ]
        yield int(bucket[own[0]]), SENT, pack(arrays, head.tobytes() + text)


def _meet(numbers: list[int], kinds: list[int], pieces: list[bytes], window: int) -> Iterator[tuple[int, bytes]]:
    sent = []
    for number, kind, piece in zip(numbers, kinds, pieces):
        if kind == TOLD:
            yield number, piece
        else:
            arrays, text = unpack(piece, [np.int64, np.int32, np.int32, np.int32])
            head = np.frombuffer(text, np.int64, 2 * PARTS).reshape(2, PARTS)
            rows, byte = np.pad(np.cumsum(head, axis=1), ((0, 0), (1, 0)))
            text = text[head.nbytes :]
            doc, base, place = (np.cumsum(x, dtype=np.int64) for x in arrays[:3])
            arrays = [doc, place - base, place, arrays[3]]
            sent.append((number, arrays, text, rows, byte))
    found: dict[int, list[np.ndarray]] = {}
    for part in range(PARTS):
        cut = [
            (number, [x[rows[part] : rows[part + 1]] for x in arrays], text[byte[part] : byte[part + 1]])
            for number, arrays, text, rows, byte in sent
            if rows[part] < rows[part + 1]
        ]
        if cut:
            for number, places in _repeats(cut, window):
                found.setdefault(number, []).append(places)
    for number, places in found.items():
        yield number, squeeze(np.sort(np.concatenate(places)).tobytes())


def _repeats(sent: list[tuple[int, list[np.ndarray], bytes]], window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, first words) of the windows that start earlier elsewhere among the packed strings sent."""
    doc, start, place, length = (np.concatenate(x) for x in zip(*(arrays for _, arrays, _ in sent)))
    chunk = np.concatenate([np.full(len(arrays[0]), number, np.int64) for number, arrays, _ in sent])
    raw = b"".join(text for _, _, text in sent)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    starts = np.append(0, ends[:-1] + 1)
    hashes = Rolling(Rolling(np.frombuffer(raw, np.uint8)).of(starts, ends) >> np.uint64(1)).windows(window)
    first_word = np.cumsum(length) - length
    per = length - window + 1
    run = np.repeat(np.arange(len(per)), per)
    at = ranges(first_word, per)
    off = at - first_word[run]
    order = np.argsort(hashes[at], kind="stable")
    h = hashes[at][order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    pick = order[same[:-1] | same[1:]]  # windows whose hash occurs again
    if not len(pick):
        return
    number = equal_groups(raw, starts[at[pick]], ends[at[pick] + window - 1], hashes[at[pick]], np.arange(len(pick)))
    inside = off[pick]
    when = np.lexsort((place[run[pick]] + inside, chunk[run[pick]], start[run[pick]] + inside, doc[run[pick]], number))
    again = np.zeros(len(when), bool)
    again[1:] = number[when[1:]] == number[when[:-1]]
    hit = when[again]
    runs = run[pick[hit]]
    to, places = chunk[runs], (place[runs] + inside[hit]).astype(np.int32)
    by = np.argsort(to, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(to[by], prepend=-1)), len(by))
    for a, z in zip(cuts[:-1], cuts[1:]):
        yield int(to[by[a]]), places[by[a:z]]


def dedup_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """One row per input row: (id_col long, n_words, n_removed, kept_text, kept_sha256).

    Removes each word covered by a window of that many consecutive words that also starts earlier:
    in a document with a smaller id, or earlier in the same document. Windows are judged on the
    input. Words are runs of anything but ASCII white space; kept words are joined by one space.
    Null text has no words, texts shorter than a window lose none. Null ids come last; rows repeated
    under one id are ordered by where they were read. An empty table gives no rows.
    """
    chunks = make_chunks(docs, id_col, text_col, "windows", chunk_bytes)
    buckets = n_buckets(chunks, bucket_bytes)

    def runs(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        words = Words(chunk)
        first, count, minimiser, rolling = super_kmers(words, window)
        return minimiser, rolling.of(words.starts[first], words.ends[first + count + window - 2])

    known = shared_minimisers(chunks, runs, buckets, hot_runs)

    def cut(chunk: Chunk, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        yield pieces_of([(b, chunk.number, k, p) for b, k, p in _cut(chunk, got, window, buckets)])

    answers = gather(answer_chunks(chunks, known, cut, PIECES), buckets, lambda *a: _meet(*a, window))

    def tell(chunk: Chunk, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        words = Words(chunk)
        edge = np.zeros(len(words.of) + 1, np.int32)
        for piece in got:
            at = np.frombuffer(unsqueeze(piece), np.int32)
            edge += np.bincount(at, minlength=len(edge)).astype(np.int32)
            edge -= np.bincount(np.minimum(at + window, len(edge) - 1), minlength=len(edge)).astype(np.int32)
        gone = np.cumsum(edge[:-1]) > 0
        raw = words.flat.tobytes()
        starts, ends = words.starts.tolist(), words.ends.tolist()
        texts, removed = [], []
        for a, n in zip(words.first_word.tolist(), words.counts.tolist()):
            drop = gone[a : a + n]
            removed.append(int(drop.sum()))
            if not removed[-1]:
                texts.append(raw[starts[a] : ends[a + n - 1]] if n else b"")
            else:  # runs of kept words are slices of the flat text
                keep = np.flatnonzero(np.diff(np.concatenate([[True], drop, [True]]).astype(np.int8)))
                texts.append(b" ".join(raw[starts[a + s] : ends[a + e - 1]] for s, e in zip(keep[::2], keep[1::2])))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(chunk.ids, pa.int64()), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
            ],
            [id_col, "n_words", "n_removed", "kept_text", "kept_sha256"],
        )

    schema = f"{id_col} long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return answer_chunks(chunks, answers, tell, schema)
