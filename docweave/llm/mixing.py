"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length per source. A source's target is met by whole passes over it
plus a remainder; the remainder takes the same share of every length, and what is then left of the
budget is fitted by a bounded-knapsack dynamic program over the lengths still to be had. Documents
are picked by seeded hash among those of their length. Only histograms (source x length) meet in
one task; documents move as (id, source, length).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm._shared import materialise, word_count

#: Hash cells a length's documents are dealt into, so that no window holds a hot length whole.
CELLS = 512


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, cells: int = 1 << 17) -> np.ndarray:
    """How many documents of each length to take so that their words sum to nearly budget.

    Takes an even share of every length, leaves a window of the budget for the dynamic program
    (subset sums in a bit set, first item to reach each sum kept for the way back), and chooses the
    reachable sum nearest to what is left. sizes > 0; budgets past cells are fitted in coarser steps.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    window = min(budget, int(4 * sizes.max()), cells // 2)
    take = np.floor(counts * ((budget - window) / total)).astype(np.int64)
    left = budget - int((take * sizes).sum())
    # lengths from the longest down, while more than the window is left
    for i in np.argsort(-sizes, kind="stable"):
        if left <= 2 * window:
            break
        k = min(int(counts[i] - take[i]), max(0, left - window) // int(sizes[i]))
        take[i] += k
        left -= k * int(sizes[i])
    step = max(1, -(-left // cells))
    goal = int(left // step)
    top = goal + max(1, int(min(sizes[counts > take].min(), left) // step))
    mask = (1 << (top + 1)) - 1
    reached = 1
    via = np.full(top + 1, -1, np.int64)
    items: list[tuple[int, int, int]] = []
    for i in np.argsort(sizes, kind="stable"):
        w = max(1, int(round(sizes[i] / step)))
        n, lot = int(min(counts[i] - take[i], top // w)), 1
        while n > 0:
            lot = min(lot, n)
            new = ((reached << (lot * w)) & mask) & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes((top + 8) // 8, "little"), np.uint8), bitorder="little")
                via[np.flatnonzero(bits[: top + 1])] = len(items)
                reached |= new
            items.append((int(i), lot, lot * w))
            n -= lot
            lot *= 2
        if (reached >> goal) & 1:
            break
    sums = np.concatenate([[0], np.flatnonzero(via >= 0)])
    at = int(sums[np.argmin(np.abs(sums - goal))])
    while at > 0:
        i, lot, w = items[via[at]]
        take[i] += lot
        at -= w
    return take


def source_targets(totals: DataFrame, weight_cycle: tuple[int, ...], share: float, max_repeat: int) -> DataFrame:
    """Targets per source from (source, source_size): weights cycle over the sources by code point, null last.

    share x all words are dealt by weight; a source stops at max_repeat x its own words and the
    excess goes to the others by weight, which is the level at which min(cap, level x weight) sums
    to the budget. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in weight_cycle])
    ranked = totals.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(weights, ((F.col("rank") - 1) % len(weight_cycle) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * float(max_repeat)
    levels = (
        ranked.withColumn("ratio", cap / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    return levels.select(
        "source", "rank", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_cycle: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: int = 2,
    seed: int = 17,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: (id_col, source, size, source_size, target, copies, taken) and the columns named in carry.

    size is the number of words (null text: 0), copies how often the mix takes the document (at
    most max_repeat), taken = copies x size. Null sources are one source. Documents without words
    are never taken. Ties in the seeded hash fall back to the id and carry; rows repeated under one
    id are rows of their own, and rows with a null id are dealt by their text. The same rows and seed give the same mix. An empty table gives no rows.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col), F.lit(seed))).otherwise(F.xxhash64(F.col(id_col), F.lit(seed))).alias("h"),
            *carry,
        ).withColumn("cell", F.pmod(F.col("h"), F.lit(CELLS)).cast("int")),
        "mix-sizes",
    )
    cells = materialise(sized.groupBy("source", "size", "cell").agg(F.count("*").alias("n")), "mix-cells")
    lengths = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(totals, weight_cycle, share, max_repeat)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(max_repeat, int(target // total)) if total else 0
        rest = int(round(target)) - passes * total if passes < max_repeat else 0
        sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        has = sizes > 0
        order = np.flatnonzero(has)[np.argsort(sizes[has], kind="stable")]
        size, n = sizes[order], counts[order]
        took = passes * n + fit_budget(size, n, rest)
        miss = lambda t: abs(int((t * size).sum()) - target)
        if len(size) and miss(took) > size[0]:  # a few long documents: let passes over them differ from the rest
            took = min(took, fit_budget(size, n * max_repeat, int(round(target))), key=miss)
        copies = np.zeros_like(counts)
        copies[order] = took
        return pdf[["source", "size", "source_size", "target"]].assign(passes=copies // counts, extra=copies % counts)

    plan = (
        lengths.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "rank", "size", "n", "source_size", "target")
        .groupBy("rank")
        .applyInPandas(fit, f"source {dict(sized.dtypes)['source']}, size long, source_size long, target double, passes long, extra long")
    )
    plan = materialise(plan, "mix-plan")
    upto = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    dealt = cells.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    dealt = dealt.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("cell").alias("c"), "n", "before")
    plan = plan.select(F.col("source").alias("ps"), F.col("size").alias("pz"), "source_size", "target", "passes", "extra")
    dealt = dealt.join(plan, F.col("s").eqNullSafe(F.col("ps")) & (F.col("z") == F.col("pz")))
    rows = sized.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("cell") == F.col("c")))
    need = F.col("extra") - F.col("before")
    split = (need > 0) & (need < F.col("n"))
    in_cell = Window.partitionBy("source", "size", "cell").orderBy("h", "id", *carry)
    sure = rows.where(~split).withColumn("more", (need >= F.col("n")).cast("long"))
    edge = rows.where(split).withColumn("more", (F.row_number().over(in_cell) <= need).cast("long"))
    return (
        sure.unionByName(edge)
        .withColumn("copies", F.col("passes") + F.col("more"))
        .select(
            F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"), *carry,
        )
    )
