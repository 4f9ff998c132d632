"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens. It begins with one state that takes every symbol; each merge (u, v), in order,
puts its gadget into it: the state that u leads to is copied without its arc v, u leads to the copy from now
on, and each state with an arc u gets an arc uv to where v led. What is accepted in the end are the
tokenizations that the merges make, one for each word. All arcs of a token lead to one state, so a state needs
only the arcs it lacks: those taken away by gadgets and, of a token made later, those whose first part was
taken away before the token was made (see Automaton.arc).

A word is encoded along its positions: every prefix has one accepted tokenization, hence one state, and each
token that begins at a position (found in a trie of the labels) is a transition if the automaton has the arc.

The automaton has one state for each token at most, so it is broadcast (a few MB, bounded by the vocabulary).
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._shared import slices

#: Texts of about so many bytes are encoded before their ids leave the worker.
PIECE = 8 << 20
#: Entries of a worker's tables of known words and transitions; a full table begins anew.
KNOWN, ARCS = 400_000, 1_000_000
#: Symbols of a token; a longer rest of a word is not looked up as one.
LONGEST = 256
#: A decoded batch holds about so many ids.
IDS = 1 << 20


@dataclass
class Automaton:
    """Arrays of the automaton: where tokens lead, their parts, the arcs that each state lacks, and the trie of their symbols."""

    labels: list[str]  # of every id, as written in the vocabulary
    target: np.ndarray  # state that a token leads to, -1 if no text gives it
    left: np.ndarray  # first part of a token, -1 for symbols
    born: np.ndarray  # number of the merge that made a token, -1 for symbols
    starts: np.ndarray  # of each state, its first place in lacks and since
    lacks: np.ndarray  # tokens whose arc was taken away
    since: np.ndarray  # and the merge that did
    suffix: str  # marks the last symbol of a word

    def __post_init__(self) -> None:
        self._target, self._left, self._born = self.target.tolist(), self.left.tolist(), self.born.tolist()
        self._arcs: dict[int, bool] = {}
        self._lacking: dict[int, dict[int, int]] = {}
        self._tries: tuple[dict, dict, list[int]] | None = None

    def tries(self) -> tuple[dict, dict, list[int]]:
        """Tries of the tokens inside words and of whole labels at their ends, and of each token the next shorter one it begins with.

        A node leads from symbols to nodes, and from "" to the longest token that is a prefix of it.
        """
        if self._tries is None:
            inner: dict = {}
            final: dict[str, int] = {}
            short = [-1] * len(self.labels)
            # by length, so that a label's prefixes are there before it
            for token in sorted((t for t in range(len(self.labels)) if self._target[t] >= 0), key=lambda t: len(self.labels[t])):
                label = self.labels[token]
                if self.suffix and label.endswith(self.suffix):
                    final[label.removesuffix(self.suffix)] = token
                    continue
                if not self.suffix:
                    final[label] = token
                node, best = inner, -1
                for c in label:
                    best = node.get("", best)
                    node = node.setdefault(c, {})
                short[token], node[""] = best, token
            self._tries = inner, final, short
        return self._tries

    def __getstate__(self) -> dict[str, Any]:
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}

    def __setstate__(self, state: dict[str, Any]) -> None:
        vars(self).update(state)
        self.__post_init__()

    def arc(self, state: int, token: int) -> bool:
        """Whether state has an arc for token: none of its first parts was taken away before the next was made of it."""
        key = state << 32 | token
        if (known := self._arcs.get(key)) is not None:
            return known
        if (lacking := self._lacking.get(state)) is None:
            a, z = self.starts[state], self.starts[state + 1]
            lacking = self._lacking[state] = dict(zip(self.lacks[a:z].tolist(), self.since[a:z].tolist()))
        found = has_arc(lacking, token, self._left, self._born)
        if len(self._arcs) >= ARCS:
            self._arcs.clear()
        self._arcs[key] = found
        return found

    def encode(self, word: str) -> list[int]:
        """Ids of a word of symbols, by transitions from the initial state.

        A prefix has one accepted tokenization, so a position is reached in one state; where no transition leads
        on from it, the longest one before it was wrong and the next shorter is taken. A position is left for good once.
        """
        inner, final, short = self._tries or self.tries()
        if (token := final.get(word)) is not None:
            return [token]  # a transition from the initial state, which lacks no arc
        n, arcs, target = len(word), self._arcs, self._target
        out: list[int] = []
        path: list[tuple[int, int]] = []  # positions and states before the tokens of out
        dead: set[int] = set()
        at = state = 0
        while at < n:
            # the rest of the word as one token, else the longest token that it begins with
            token = final.get(word[at:], -1) if n - at <= LONGEST else -1
            end = n
            if token < 0 or not ((known := arcs.get(state << 32 | token)) or known is None and self.arc(state, token)):
                node, token, j = inner, -1, at
                while j < n - 1 and (node := node.get(word[j])) is not None:
                    j += 1
                    if (found := node.get("")) is not None:
                        token, end = found, j
            while True:
                while token >= 0:
                    if end not in dead and ((known := arcs.get(state << 32 | token)) or known is None and self.arc(state, token)):
                        break
                    token = short[token]
                    if token >= 0:
                        end = at + len(self.labels[token])
                if token >= 0:
                    break
                if not path:
                    raise ValueError(f"the vocabulary has no symbol for part of {word!r}")
                dead.add(at)
                at, state = path.pop()
                token = short[out.pop()]
                end = at + len(self.labels[token]) if token >= 0 else at
            path.append((at, state))
            out.append(token)
            at, state = end, target[token]
        return out


def keep(known: dict[str, bytes], text: str, ids: bytes) -> bytes:
    """Put ids into a table of known texts, unless the text is long, and return them."""
    if len(text) <= 64:
        if len(known) >= KNOWN:
            known.clear()
        known[text] = ids
    return ids


def has_arc(lacking: dict[int, int], token: int, left: list[int], born: list[int]) -> bool:
    """Walk down the first parts of token; limit is the merge that made what was made of the part."""
    limit = len(born)
    while token >= 0:
        if lacking.get(token, len(born) + 1) <= limit:  # as early as its own merge: both parts are the same token
            return False
        limit, token = born[token], left[token]
    return True


def compile_merges(vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> Automaton:
    """Put the gadgets of the merges, in order, into the automaton that takes every symbol.

    suffix marks the last symbol of a word. Ids may have gaps. A merge whose parts cannot meet (no state has
    the arcs) makes no token.
    """
    size = max(vocab.values(), default=-1) + 1
    labels = [""] * size
    for label, token in vocab.items():
        labels[token] = label
    left, born, target = [-1] * size, [-1] * size, [-1] * size
    made = {a + b for a, b in merges}
    for label, token in vocab.items():
        if label not in made and len(label.removesuffix(suffix) if suffix else label) == 1:
            target[token] = 0
    states: list[dict[int, int] | None] = [{}]
    users = [sum(t == 0 for t in target) + 1]  # tokens that lead to a state; the first also begins every word
    for when, (a, b) in enumerate(merges):
        u, v, uv = vocab[a], vocab[b], vocab[a + b]
        met, after = target[u], target[v]
        if met < 0 or after < 0 or not has_arc(states[met], v, left, born):
            continue
        if users[met] == 1:  # nothing else leads there: the copy takes its place
            copy, states[met] = states[met], None if u != v else dict(states[met])
        else:
            copy = dict(states[met])
        copy[v] = when
        states.append(copy)
        users.append(1)
        users[met] -= 1
        target[u] = len(states) - 1
        if target[uv] < 0:
            target[uv], left[uv], born[uv] = after, u, when
            users[after] += 1
    live = sorted({0, *(t for t in target if t >= 0)})
    number = {s: i for i, s in enumerate(live)}
    kept = [states[s] for s in live]
    return Automaton(
        labels,
        np.array([number.get(t, -1) for t in target], np.int32),
        np.array(left, np.int32),
        np.array(born, np.int32),
        np.cumsum([0, *map(len, kept)]).astype(np.int64),
        np.array([t for s in kept for t in s], np.int32),
        np.array([w for s in kept for w in s.values()], np.int32),
        suffix,
    )


@dataclass
class Tokenizer:
    """An automaton with what a tokenizer file says of splitting texts before it and of joining tokens after it."""

    automaton: Automaton
    special: dict[str, int]  # strings that are one token wherever they occur
    normalizer: Any
    splitter: Any  # the library's pre-tokenizer, or None
    by_chunk: bool  # white space never meets a token, so texts are cut there first
    joined: bool  # tokens are joined by one space, else their bytes are one text

    def __post_init__(self) -> None:
        self._known: dict[str, bytes] = {}
        self._known_words: dict[str, bytes] = {}
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {token: label for label, token in self.special.items()}
        labels = [names.get(i, label) for i, label in enumerate(self.automaton.labels)]
        labels += [names.get(i, "") for i in range(len(labels), max(names, default=-1) + 1)]
        self._labels, self._special_ids = np.array(labels, object), set(names)

    def __getstate__(self) -> dict[str, Any]:
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}

    def __setstate__(self, state: dict[str, Any]) -> None:
        vars(self).update(state)
        self.__post_init__()

    def words(self, text: str) -> list[str]:
        """Pre-split words in symbols. Chunks of Latin letters go by the file's pattern, others by the library with its own Unicode tables."""
        if self.by_chunk and max(text, default="") < PLAIN_END:
            words = WORDS.findall(text.lower())
            return words if text.isascii() and text.isprintable() else [w.encode().decode("latin-1").translate(symbol_of_byte()) for w in words]
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [w for w, _ in self.splitter.pre_tokenize_str(text)] if self.splitter else [text]

    def ids(self, text: str) -> list[int]:
        """All ids of a text."""
        return array("i", self.packed(text)).tolist()

    def packed(self, text: str) -> bytes:
        """All ids of a text as 32-bit integers."""
        out: list[bytes] = []
        for part in self._specials.split(text) if self._specials else [text]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            elif self.by_chunk:
                # str.split also cuts at four control characters that Unicode does not count as white space
                chunks = SPACE.split(part) if CONTROL.search(part) else part.split()
                found = list(map(self._known.get, chunks))
                if None in found:
                    found = [self._chunk(c) if ids is None else ids for c, ids in zip(chunks, found)]
                out += found
            else:
                out += map(self._word, self.words(part))
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        return keep(self._known, chunk, b"".join(map(self._word, self.words(chunk))))

    def _word(self, word: str) -> bytes:
        if (ids := self._known_words.get(word)) is None:
            ids = keep(self._known_words, word, array("i", self.automaton.encode(word)).tobytes())
        return ids

    def text(self, ids: Sequence[int] | np.ndarray) -> str:
        """The labels of the arcs, as the file's decoder joins them."""
        labels = self._labels[np.asarray(ids, np.int64)].tolist()
        if self.joined:
            return " ".join(labels)
        table = byte_of_symbol()
        return bytes(b for i, label in zip(ids, labels) for b in (label.encode() if i in self._special_ids else [table[c] for c in label])).decode(errors="replace")


#: The pattern that word tokenizer files cut words by. Fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = regex.compile(WORD_PATTERN)
#: Below this character all versions of Unicode agree, and nothing composes or changes its case by what stands around it.
PLAIN_END = "\u0250"
SPACE = regex.compile(r"\s+")
CONTROL = re.compile("[\x1c-\x1f]")


@lru_cache(1)
def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol stands for: printable bytes are themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(1)
def symbol_of_byte() -> dict[int, str]:
    return {b: c for c, b in byte_of_symbol().items()}


def load_tokenizer(path: str) -> Tokenizer:
    """Compile a tokenizers JSON file with a BPE model (read on the driver).

    Files with dropout, unknown tokens, a prefix for inner pieces, byte fallback, or with added tokens that are
    matched in other ways than as plain strings are refused.
    """
    from tokenizers import Tokenizer as Library

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, added = spec["model"], spec["added_tokens"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError("only plain BPE models are compiled")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added if t["content"] not in model["vocab"] or not t["special"]):
        raise ValueError("only added tokens that are plain strings are supported")
    if (decoder := spec["decoder"]) is not None and decoder["type"] != "ByteLevel":
        raise ValueError("tokens are joined by spaces or as bytes")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    library = Library.from_file(path)
    parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    by_chunk = steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": WORD_PATTERN} and parts[0]["behavior"] == "Removed"
    automaton = compile_merges(model["vocab"], merges, model.get("end_of_word_suffix") or "")
    return Tokenizer(automaton, {t["content"]: t["id"] for t in added}, library.normalizer, library.pre_tokenizer, by_chunk, decoder is None)


def encode_texts(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """The rows and columns of docs, and their texts' ids as an array of integers; with decoded_col also what the ids decode to.

    Null and empty texts give an empty array; texts of any length are encoded whole; rows are independent, so
    repeated rows and ids do not matter, an empty table gives an empty result, and other columns stay as they
    are. A column that has the name of ids_col or decoded_col is replaced.
    """
    added = {ids_col: T.ArrayType(T.IntegerType())} | ({decoded_col: T.StringType()} if decoded_col else {})
    kept = [f for f in docs.schema.fields if f.name not in added]
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            for piece, texts in slices(batch, text_col, PIECE):
                packed = [coder.packed(t.decode("utf-8", "replace")) for t in texts]
                ends = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
                ids = np.frombuffer(b"".join(packed), np.int32)
                columns = [*piece.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                if decoded_col:
                    columns.append(pa.array([coder.text(ids[a:z]) for a, z in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, *added])

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, T.StructType([*kept, *[T.StructField(n, t) for n, t in added.items()]]))


def decode_ids(rows: DataFrame, tokenizer: Tokenizer, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows and columns of rows, and the text that their ids stand for; null arrays give an empty text.

    Ids the tokenizer does not have are skipped, as are null ids. A column that has the name of text_col is replaced.
    """
    kept = [f for f in rows.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType())])
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        size = len(coder._labels)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            lengths = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()
            start = held = 0
            for i, n in enumerate([*lengths, IDS]):
                if held and held + n > IDS or i == len(lengths):
                    piece = batch.slice(start, i - start)
                    known = [np.array([x for x in ids or () if x is not None and 0 <= x < size], np.int32) for ids in piece.column(at).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(map(coder.text, known), pa.string())], names=[*piece.schema.names, text_col])
                    start, held = i, 0
                held += n

    return rows.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of rows with ids and decoded."""
    return rows.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
