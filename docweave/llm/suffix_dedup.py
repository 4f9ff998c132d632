"""Suffix-array deduplication: maximal repeats from the common-prefix interval tree, over byte strings.

Every string of min_len bytes holds a minimiser (the smallest hash among its byte grams), so two
equal strings meet in their minimiser's bucket. First only 32-bit keys of the minimisers travel, and
each chunk learns which of its own occur in other chunks; then the runs of windows around repeated
minimisers travel as packed texts. A bucket builds the suffix array and common-prefix array of its
different texts and scans them with a stack: intervals of a common prefix of min_len or more whose
left neighbours differ are the maximal repeats, given with all their occurrences; a text that occurs
more than once is a leaf with several occurrences and thereby an interval of its own. A run of
windows is no longer than 2 min_len - gram bytes; longer repeats come as overlapping groups. Runs of
a minimiser that stands in very many different texts are cut into single windows, which go to the
bucket of their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm._chunks import (
    BUCKET_BYTES, CHUNK_BYTES, HOT_RUNS, PIECES, Chunk, Rolling, among, answer_chunks, equal_groups, gather, keys_of, known_keys, make_chunks,
    n_buckets, pack, pieces_of, ranges, shared_minimisers, sliding_argmin, unpack,
)

GRAM = 20
#: Bytes of whole documents whose hashes are held at once.
SEGMENT = 1 << 19
SENT, TOLD = 0, 1


def anchored_runs(chunk: Chunk, min_len: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Rolling, int]]:
    """Per segment: (first window, windows, minimiser) of each run of windows that share one, hashes, segment start."""
    byte = np.frombuffer(chunk.raw, np.uint8)
    i = 0
    while i < len(chunk.lengths):
        j = i + 1
        while j < len(chunk.lengths) and chunk.ends[j] - chunk.starts[i] <= SEGMENT:
            j += 1
        a, z = int(chunk.starts[i]), int(chunk.ends[j - 1])
        if z - a >= min_len:
            rolling = Rolling(byte[a:z])
            grams = rolling.windows(gram)
            least = sliding_argmin(grams, min_len - gram + 1)
            good = np.ones(z - a - min_len + 1, bool)  # windows inside one document
            for end in (chunk.ends[i : j - 1] - a).tolist():
                good[max(0, end - min_len + 1) : end] = False
            at = np.flatnonzero(good)
            if len(at):
                own = least[at]
                head = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(own) != 0)]))
                yield at[head], np.diff(np.append(head, len(at))), grams[own[head]], rolling, a
        i = j


def _cut(chunk: Chunk, answers: list[bytes], min_len: int, gram: int, buckets: int, every: bool = False) -> Iterator[pa.RecordBatch]:
    """Pieces of the runs that may repeat; with every, all occurrences are sent and none is told here."""
    parts, (known, hot) = [], known_keys(answers)
    for first, count, minimiser, rolling, base in anchored_runs(chunk, min_len, gram):
        key = keys_of(minimiser, buckets)
        split = among(key, known[hot])
        if split.any():  # each window of a hot minimiser's runs goes by its own hash
            alone = ranges(first[split], count[split])
            own = rolling.of(alone, alone + min_len)
            parts.append((alone + base, np.ones(len(alone), np.int64), keys_of(own, buckets), own, np.ones(len(alone), bool)))
            first, count, key = first[~split], count[~split], key[~split]
        parts.append((first + base, count, key, rolling.of(first, first + count + min_len - 1), np.zeros(len(first), bool)))
    if not parts:
        return
    first, count, key, whole, alone = (np.concatenate(x) for x in zip(*parts))
    doc = np.searchsorted(chunk.ends, first, "right")
    # keep runs whose minimiser is in another chunk, or in two documents of this one
    by = np.lexsort((doc, key))
    differs = (key[by[1:]] == key[by[:-1]]) & (doc[by[1:]] != doc[by[:-1]])
    keep = np.flatnonzero(alone | among(key, known) | among(key, np.unique(key[by[1:]][differs])))
    if not len(keep):
        return
    first, count, key, whole, doc = first[keep], count[keep], key[keep], whole[keep], doc[keep]
    end = first + count + min_len - 1
    order = np.argsort(whole, kind="stable")
    number = equal_groups(chunk.raw, first, end, whole, order)
    _, lead, number = np.unique(number, return_index=True, return_inverse=True)
    # equal runs in a later document are told at once; those of the first document travel as occurrences
    late = (chunk.order_ids[doc] > chunk.order_ids[doc[lead[number]]]) & (not every)
    rows = []
    if late.any():
        spans = merged(first[late], end[late])
        rows.append((int(chunk.number % buckets), chunk.number, TOLD, pack([s.astype(np.int32) for s in spans], b"")))
    stay = np.flatnonzero(~late)
    bucket = (key[stay] >> np.uint64(32)).astype(np.int64)
    by = np.lexsort((number[stay], bucket))
    stay, bucket = stay[by], bucket[by]
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(stay))
    byte = np.frombuffer(chunk.raw, np.uint8)
    for a, z in zip(cuts[:-1], cuts[1:]):
        own = stay[a:z]
        new = np.diff(number[own], prepend=-1) != 0
        text = byte[ranges(first[own[new]], (end - first)[own[new]])].tobytes()
        arrays = [chunk.order_ids[doc[own]], first[own].astype(np.int32), (end - first)[own].astype(np.uint16), new]
        rows.append((int(bucket[a]), chunk.number, SENT, pack(arrays, text)))
        if len(rows) >= 64:
            yield pieces_of(rows)
            rows = []
    yield pieces_of(rows)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same places as fewer spans: touching and overlapping ones become one."""
    order = np.argsort(starts, kind="stable")
    starts, upto = starts[order], np.maximum.accumulate(ends[order])
    cut = np.concatenate([[True], starts[1:] > upto[:-1]])
    return starts[cut], upto[np.append(np.flatnonzero(cut)[1:], len(starts)) - 1]


def suffix_array(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes text[start:end], and the common prefix of each with the one before it."""
    n, width = len(starts), int((ends - starts).max())
    table = np.zeros((n, width), np.uint8)
    lengths = ends - starts
    table[np.repeat(np.arange(n), lengths), ranges(np.zeros(n, np.int64), lengths)] = text[ranges(starts, lengths)]
    order = np.argsort(table.view(f"S{width}").ravel(), kind="stable")
    table = table[order]
    differ = table[1:] != table[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate([[0], np.minimum(same, np.minimum(lengths[order][1:], lengths[order][:-1]))])


def interval_tree(prefix: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All intervals (lo, hi exclusive, depth) of suffixes with a common prefix of least or more, by stack scan."""
    linked = prefix >= least
    edge = np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8))
    begins, stops = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
    if not len(begins):
        return begins, begins, begins
    within = np.stack([begins + 1, stops], axis=1).ravel()
    within = within[: len(within) - (stops[-1] == len(prefix))]
    low, high = np.minimum.reduceat(prefix, within)[::2], np.maximum.reduceat(prefix, within)[::2]
    flat = low == high  # one node holds the whole run
    out = [(begins[flat], stops[flat], low[flat])]
    deep: list[tuple[int, int, int]] = []
    for a, z in zip(begins[~flat].tolist(), stops[~flat].tolist()):
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate(prefix[a + 1 : z].tolist() + [0], a + 1):
            lo = i - 1
            while stack and stack[-1][1] > depth:
                lo, top = stack.pop()
                deep.append((lo, i, top))
            if depth and (not stack or stack[-1][1] < depth):
                stack.append((lo, depth))
    if deep:
        out.append(tuple(np.array(deep, np.int64).T))
    return tuple(np.concatenate(x) for x in zip(*out))


def repeat_groups(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """Maximal repeats among texts given as slices: (group, text, offset, length), a row per occurrence.

    An occurrence belongs to a group of common prefix length or more; groups whose occurrences all
    follow the same byte are left out, as the group one byte earlier says more. The start of a text
    counts as a difference.
    """
    empty = np.zeros(0, np.int64)
    windows = np.maximum(0, ends - starts - min_len + 1)
    owner = np.repeat(np.arange(len(starts)), windows)
    at = ranges(starts, windows)
    hashes = Rolling(text).windows(min_len)[at]
    by = np.argsort(hashes, kind="stable")
    twin = np.concatenate([[False], hashes[by[1:]] == hashes[by[:-1]], [False]])
    pick = np.sort(by[twin[:-1] | twin[1:]])  # a window met once is in no interval
    if not len(pick):
        return empty, empty, empty, empty
    owner, at = owner[pick], at[pick]
    order, prefix = suffix_array(text, at, ends[owner])
    lo, hi, depth = interval_tree(prefix, min_len)
    owner, at = owner[order], at[order]
    left = np.where(at > starts[owner], text[at - 1].astype(np.int64), -1 - np.arange(len(at)))
    changes = np.cumsum(np.diff(left, prepend=left[0]) != 0)
    diverse = changes[hi - 1] > changes[lo]
    lo, hi, depth = lo[diverse], hi[diverse], depth[diverse]
    member = ranges(lo, hi - lo)
    group = np.repeat(np.arange(len(lo)), hi - lo)
    return group, owner[member], at[member] - starts[owner[member]], np.repeat(depth, hi - lo)


@dataclass
class Groups:
    """Maximal repeats of one bucket. Rows (group, text, offset, length) and, by text, the occurrences: chunk, document, place."""

    group: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    chunk: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    by: np.ndarray
    begin: np.ndarray
    per: np.ndarray
    text: np.ndarray
    starts: np.ndarray

    def occurrences(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, occurrence) of every occurrence of these rows' texts."""
        owner = self.owner[rows]
        return np.repeat(rows, self.per[owner]), self.by[ranges(self.begin[owner], self.per[owner])]


def bucket_groups(sent: list[tuple[int, bytes]], min_len: int) -> Groups:
    """The repeats among the texts that chunks sent, each text once with all its occurrences."""
    got, texts, chunk_of = [], [], []
    for number, piece in sent:
        arrays, text = unpack(piece, [np.int64, np.int32, np.uint16, np.bool_])
        got.append(arrays)
        texts.append(text)
        chunk_of.append(np.full(len(arrays[0]), number, np.int64))
    doc, place, length, new = (np.concatenate(x) for x in zip(*got))
    length = length.astype(np.int64)
    raw = b"".join(texts)
    text = np.frombuffer(raw, np.uint8)
    of = np.cumsum(new) - 1  # text of each occurrence
    ends = np.cumsum(length[new])
    starts = ends - length[new]
    # texts that several chunks sent are one text
    whole = Rolling(text).of(starts, ends)
    number = equal_groups(raw, starts, ends, whole, np.argsort(whole, kind="stable"))
    _, lead, number = np.unique(number, return_index=True, return_inverse=True)
    starts, ends, of = starts[lead], ends[lead], number[of]
    group, owner, offset, depth = repeat_groups(text, starts, ends, min_len)
    # a leaf is a group of its own: the text itself, as often as it occurs
    leaves = np.arange(len(lead))
    n = int(group.max()) + 1 if len(group) else 0
    group, owner = np.concatenate([group, n + leaves]), np.concatenate([owner, leaves])
    offset, depth = np.concatenate([offset, np.zeros(len(lead), np.int64)]), np.concatenate([depth, ends - starts])
    per = np.bincount(of, minlength=len(lead))
    return Groups(group, owner, offset, depth, np.concatenate(chunk_of), doc, place, np.argsort(of, kind="stable"), np.cumsum(per) - per, per, text, starts)


def by_chunk(chunk: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(chunk, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(chunk[order], prepend=-1)), len(order))
    for a, z in zip(cuts[:-1], cuts[1:]):
        yield int(chunk[order[a]]), order[a:z]


def extremes(groups: Groups, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """The least (or greatest) document of each group."""
    of_text = np.full(len(groups.per), fill, np.int64)
    text_of = np.repeat(np.arange(len(groups.per)), groups.per)
    ufunc.at(of_text, text_of, groups.doc[groups.by])
    out = np.full(int(groups.group.max()) + 1 if len(groups.group) else 0, fill, np.int64)
    ufunc.at(out, groups.group, of_text[groups.owner])
    return out


NONE, ANY = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _meet(numbers: list[int], kinds: list[int], pieces: list[bytes], min_len: int) -> Iterator[tuple[int, bytes]]:
    """To every chunk the spans of its occurrences whose group has one in a smaller document."""
    sent = []
    for number, kind, piece in zip(numbers, kinds, pieces):
        if kind == TOLD:
            yield number, piece
        else:
            sent.append((number, piece))
    if not sent:
        return
    g = bucket_groups(sent, min_len)
    least, most = extremes(g, np.minimum, NONE), extremes(g, np.maximum, ANY)
    row, hit = g.occurrences(np.flatnonzero(least[g.group] < most[g.group]))
    late = g.doc[hit] > least[g.group[row]]
    row, hit = row[late], hit[late]
    start = g.place[hit] + g.offset[row]
    end = start + g.length[row]
    for number, own in by_chunk(g.chunk[hit]):
        yield number, pack([s.astype(np.int32) for s in merged(start[own], end[own])], b"")


def _tell_groups(numbers: list[int], kinds: list[int], pieces: list[bytes], min_len: int) -> Iterator[tuple[int, bytes]]:
    """To every chunk (key, start, length) of all occurrences of the groups that two documents or more share."""
    g = bucket_groups(list(zip(numbers, pieces)), min_len)
    at = g.starts[g.owner] + g.offset
    key = Rolling(g.text).of(at, at + g.length)
    row, hit = g.occurrences(np.flatnonzero((extremes(g, np.minimum, NONE) < extremes(g, np.maximum, ANY))[g.group]))
    start = g.place[hit] + g.offset[row]
    for number, own in by_chunk(g.chunk[hit]):
        yield number, pack([key[row[own]], start[own].astype(np.int32), g.length[row[own]].astype(np.int32)], b"")


def _answers(docs: DataFrame, id_col: str, text_col: str, min_len: int, gram: int, chunk_bytes: int, bucket_bytes: int, hot_runs: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """The chunks of docs, and what the buckets answer them."""
    chunks = make_chunks(docs, id_col, text_col, "suffixes", chunk_bytes)
    buckets = n_buckets(chunks, bucket_bytes)

    def runs(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        found = [(m, rolling.of(first, first + count + min_len - 1)) for first, count, m, rolling, _ in anchored_runs(chunk, min_len, gram)]
        return tuple(np.concatenate([np.zeros(0, np.uint64), *x]) for x in (zip(*found) if found else ((), ())))

    known = shared_minimisers(chunks, runs, buckets, hot_runs)
    sent = answer_chunks(chunks, known, lambda c, got: _cut(c, got, min_len, gram, buckets, every), PIECES)
    meet = _tell_groups if every else _meet
    return chunks, gather(sent, buckets, lambda *a: meet(*a, min_len))


def maximal_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 50, gram: int = GRAM,
    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """One row per occurrence of a maximal repeat: (group_key, id_col long, start, length), in bytes.

    A group is a string of min_len bytes or more that two documents or more hold, with all its
    occurrences, also several in one document; group_key is a hash of the string. A string longer
    than 2 min_len - gram bytes is given by several groups that overlap. Null texts have none.
    """
    chunks, answers = _answers(docs, id_col, text_col, min_len, gram, chunk_bytes, bucket_bytes, hot_runs, every=True)

    def tell(chunk: Chunk, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        told = [unpack(piece, [np.uint64, np.int32, np.int32])[0] for piece in got]
        key, start, length = (np.concatenate(x) for x in zip(*told)) if told else (np.zeros(0, np.uint64), *[np.zeros(0, np.int32)] * 2)
        doc = np.searchsorted(chunk.ends, start, "right")
        ids = pa.array(chunk.ids, pa.int64()).take(pa.array(doc))
        columns = [pa.array(key.view(np.int64)), ids, pa.array(start - chunk.starts[doc]), pa.array(length.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["group_key", id_col, "start", "length"])

    return answer_chunks(chunks, answers, tell, f"group_key long, {id_col} long, start long, length long").distinct()


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 50, gram: int = GRAM,
    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """One row per input row: (id_col long, n_bytes, n_removed, n_spans, kept binary, kept_sha256).

    Removes each byte covered by a string of min_len bytes that also starts in a document with a
    smaller id; strings never cross documents and are judged on the input. n_spans counts maximal
    removed runs. Null text counts as empty, shorter texts lose nothing, null ids come last and rows
    repeated under one id count as one document. An empty table gives no rows.
    """
    chunks, answers = _answers(docs, id_col, text_col, min_len, gram, chunk_bytes, bucket_bytes, hot_runs, every=False)

    def tell(chunk: Chunk, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        edge = np.zeros(len(chunk.raw) + 1, np.int32)
        for piece in got:
            (starts, ends), _ = unpack(piece, [np.int32, np.int32])
            np.add.at(edge, starts, 1)
            np.add.at(edge, ends, -1)
        gone = np.cumsum(edge[:-1]) > 0
        byte = np.frombuffer(chunk.raw, np.uint8)
        kept, removed, spans = [], [], []
        for a, z in zip(chunk.starts.tolist(), chunk.ends.tolist()):
            drop = gone[a:z]
            removed.append(int(drop.sum()))
            spans.append(int((drop & ~np.concatenate([[False], drop[:-1]])).sum()) if removed[-1] else 0)
            kept.append(byte[a:z][~drop].tobytes() if removed[-1] else chunk.raw[a:z])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(chunk.ids, pa.int64()), pa.array(chunk.lengths, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()), pa.array(kept, pa.binary()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            ],
            [id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )

    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return answer_chunks(chunks, answers, tell, schema)
