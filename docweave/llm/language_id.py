"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on snippets of a bounded sample of
labelled rows. It labels every byte of every text; a document's probabilities are the means over its
positions. Texts are run in segments side by side, so a task's memory does not follow text length;
every segment is read with some bytes before and after it that only bring the states up to date, so
no position is judged without what stands around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._chunks import ranges
from docweave.llm._shared import slices

#: Bytes of a segment, and bytes read before and after it for their context alone.
SEGMENT, CONTEXT = 128, 16
LANES = 1024
PAD = 256
PIECE_BYTES = 2 << 20
UNDETERMINED = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """For each direction: input (257 x 3H: update, reset, candidate), gates (H x 2H), candidate (H x H); the read-out."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        weights = {}
        for d in "fb":
            weights |= {
                f"{d}_in": draw(257, 3 * hidden, scale=0.3),
                f"{d}_gates": draw(hidden, 2 * hidden, scale=hidden**-0.5),
                f"{d}_cand": draw(hidden, hidden, scale=hidden**-0.5),
            }
        weights |= {"out": draw(2 * hidden, len(languages), scale=hidden**-0.5), "bias": np.zeros(len(languages), np.float32)}
        return cls(languages, weights)

    def states(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H) of bytes x (T, B) read forward ("f") or backward ("b")."""
        w_in, gates, cand = (self.weights[f"{way}_{k}"] for k in ("in", "gates", "cand"))
        n, hidden = x.shape[1], len(cand)
        out = np.empty((len(x), n, hidden), np.float32)
        h = np.zeros((n, hidden), np.float32)
        real = (x != PAD).astype(np.float32)[:, :, None]
        for t in range(len(x)) if way == "f" else reversed(range(len(x))):
            a = w_in[x[t]]
            zr = sigmoid(a[:, : 2 * hidden] + h @ gates)
            z, r = zr[:, :hidden], zr[:, hidden:]
            rh = r * h
            c = np.tanh(a[:, 2 * hidden :] + rh @ cand)
            new = (h + z * (c - h)) * real[t]  # padding holds no state
            if keep is not None:
                keep.append((t, h, z, r, rh, c))
            out[t] = h = new
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities (T, B, L) of every position."""
        both = np.concatenate([self.states(x, "f"), self.states(x, "b")], axis=2)
        logits = both @ self.weights["out"] + self.weights["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over positions that are not padding."""
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.states(x, d, kept[d]) for d in "fb"], axis=2)
        logits = both @ self.weights["out"] + self.weights["bias"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(x.shape[1]), label] -= 1
        real = (x != PAD).astype(np.float32)
        p *= (real / max(1.0, float(real.sum())))[:, :, None]
        grads = {"out": np.einsum("tbh,tbl->hl", both, p), "bias": p.sum(axis=(0, 1))}
        back = p @ self.weights["out"].T
        hidden = back.shape[2] // 2
        for d in "fb":
            gates, cand = self.weights[f"{d}_gates"], self.weights[f"{d}_cand"]
            g_gates, g_cand = np.zeros_like(gates), np.zeros_like(cand)
            g_a = np.zeros((*x.shape, 3 * hidden), np.float32)
            own = back[:, :, :hidden] if d == "f" else back[:, :, hidden:]
            dh = np.zeros((x.shape[1], hidden), np.float32)
            for t, h, z, r, rh, c in reversed(kept[d]):
                dh = (dh + own[t]) * real[t][:, None]
                d_c = dh * z * (1 - c * c)
                d_rh = d_c @ cand.T
                d_zr = np.concatenate([dh * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
                g_gates += h.T @ d_zr
                g_cand += rh.T @ d_c
                g_a[t] = np.concatenate([d_zr, d_c], axis=1)
                dh = dh * (1 - z) + d_rh * r + d_zr @ gates.T
            hot = np.zeros((257, x.size), np.float32)
            hot[x.ravel(), np.arange(x.size)] = 1
            grads |= {f"{d}_in": hot @ g_a.reshape(x.size, -1), f"{d}_gates": g_gates, f"{d}_cand": g_cand}
        return grads


def train(snippets: list[bytes], labels: list[str], hidden: int | None = None, steps: int | None = None, batch: int = 128, length: int = 48, seed: int = 5) -> Network:
    """Adam over random windows of the snippets, languages drawn evenly; more languages take more units and steps."""
    languages = sorted(set(labels))
    steps = steps or 240 + 8 * max(0, len(languages) - 4)
    net = Network.fresh(languages, hidden or max(8, min(64, 2 * len(languages))), seed)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    of = [[s for s, l in zip(snippets, labels) if l == lang and s] for lang in languages]
    pools = [p or [b" "] for p in of]
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        label = rng.integers(0, len(languages), batch)
        x = np.full((length, batch), PAD, np.int64)
        for b, l in enumerate(label.tolist()):
            text = pools[l][int(rng.integers(len(pools[l])))]
            at = int(rng.integers(max(1, len(text) - length + 1)))
            cut = np.frombuffer(text[at : at + length], np.uint8)
            x[: len(cut), b] = cut
        rate = 0.02 * (1 - step / (steps + 1)) + 0.001
        for k, g in net.gradients(x, label).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.weights[k] = (
                net.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
            ).astype(np.float32)
    return net


def predict(net: Network, texts: list[bytes]) -> list[tuple[str, float]]:
    """Language and pooled probability of each text; texts without a letter are undetermined."""
    if not net.languages:
        return [(UNDETERMINED, 0.0)] * len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), counts)
    size = counts * SEGMENT + 2 * CONTEXT
    starts = np.cumsum(size) - size
    flat = np.full(int(size.sum()), PAD, np.int16)
    for text, at in zip(texts, (starts + CONTEXT).tolist()):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
    lanes = ranges(np.zeros(len(texts), np.int64), counts) * SEGMENT + starts[owner]
    span = np.arange(SEGMENT + 2 * CONTEXT)
    pooled = np.zeros((len(texts), len(net.languages)))
    for a in range(0, len(lanes), LANES):
        x = flat[lanes[a : a + LANES] + span[:, None]]
        p = net.positions(x)[CONTEXT:-CONTEXT]
        p *= (x[CONTEXT:-CONTEXT] != PAD)[:, :, None]
        np.add.at(pooled, owner[a : a + LANES], p.sum(axis=0))
    pooled /= np.maximum(1, lengths)[:, None]
    best, out = pooled.argmax(axis=1), []
    for i, text in enumerate(texts):
        if any(c.isalpha() for c in text.decode("utf-8", "replace")):
            out.append((net.languages[best[i]], float(min(1.0, pooled[i, best[i]]))))
        else:
            out.append((UNDETERMINED, 0.0))
    return out


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 400, snippet: int = 160) -> Network:
    """A network trained on a bounded sample: per_language rows of each language.

    Rows are sampled by a hash of their id; of each row a snippet from the start, the middle and the
    end is learned from. Rows without language or letters are not used.
    """
    rows = docs.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(31)).alias("h")
    ).where("lang is not null")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Network.fresh([], 1, 0)
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, 2.0 * per_language / n + 20.0 / n))])
    chosen = F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    size = F.length("text")
    pieces = [F.substring(F.col("text"), F.lit(1) + ((size * k) / 2).cast("int") - (snippet * k) // 2, F.lit(snippet)) for k in range(3)]
    sample = rows.where(chosen & F.col("text").rlike(r"\p{L}")).select("lang", "h", F.array(*pieces).alias("pieces"))
    snippets, labels, taken = [], [], {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"])):
        taken[row["lang"]] = taken.get(row["lang"], 0) + 1
        if taken[row["lang"]] <= per_language:
            for piece in row["pieces"]:
                snippets.append((piece or "").encode())
                labels.append(row["lang"])
    return train(snippets, labels)


def held_out(id_col: str):
    """Rows that are never learned from: crc32 of the id as text leaves 1 modulo 3 (null id: as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: (id_col, held_out, lang_pred, score).

    Learns from text and language of the rows that are not held out; a prediction reads nothing but
    its text. Null texts and texts without a letter are 'und' with score 0, as is everything where
    no row has a language. Repeated rows get equal results; an empty table gives no rows.
    """
    net = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(net)
    slim = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch, "text", PIECE_BYTES):
                found = predict(held.value, texts)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])],
                    [id_col, "held_out", "lang_pred", "score"],
                )

    return slim.mapInArrow(run, f"{id_col} {dict(slim.dtypes)['id']}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows of docs whose language is found with at least that score, all columns; undetermined ones go. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch, text_col, PIECE_BYTES):
                found = predict(held.value, texts)
                yield piece.filter(pa.array([f[0] != UNDETERMINED and f[1] >= least for f in found]))

    return docs.mapInArrow(run, docs.schema)
