"""Joins by containment: which short strings stand inside which long ones, through their rarest pieces.

A string stands inside another only if all its pieces of Q characters do, so it is looked up by the one of its
pieces that the fewest long strings have, and then compared. Rows that share no piece never meet; there is no
nested loop. Strings shorter than Q are looked up by themselves, as pieces of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.graph import checkpoint

#: Characters of a piece.
Q = 4
#: Different pieces of long strings that are sent to every task; more are joined.
FEW = 10_000


def pieces(text: Column, length: Column | int) -> Column:
    """Different pieces of that many characters; none where the text is shorter."""
    n = F.lit(length) if isinstance(length, int) else length
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def contained(short: DataFrame, long: DataFrame, q: int = Q) -> DataFrame:
    """(short_id, long_id) for all pairs of short(short_id, s) and long(long_id, t) where s stands inside t.

    Null and empty strings stand in nothing. Strings are compared as given: lower both for a join without
    regard to case. Ids may repeat; their pairs come once for each different row. Equal strings, short or long,
    are looked up once and take their ids again at the end, so that the work grows with the different strings; a
    long string is sent once for each of its pieces that some short string is looked up by.
    """
    short, lengths = short.where("s <> ''"), F.least(F.length("s"), F.lit(q))
    sizes = [r[0] for r in short.select(lengths.alias("l")).distinct().collect()]  # q at most
    rows = long.where("t <> ''").select("t").distinct()
    if not sizes:
        return short.select("short_id").limit(0).crossJoin(long.select("long_id").limit(0))
    spread = rows.select("t", F.explode(F.concat(*[pieces(F.col("t"), n) for n in sorted(sizes)])).alias("piece"))
    held = spread.select("piece").distinct()
    if held.limit(FEW + 1).count() <= FEW:
        # few texts: short strings whose first or last piece none of them has go before anything is moved
        for end in (F.substring("s", F.lit(1), lengths), F.substring("s", F.length("s") - lengths + 1, lengths)):
            short = short.join(F.broadcast(held), end == held["piece"], "left_semi")
        short = checkpoint(short.select("short_id", "s").distinct())
    needles = short.select("s").distinct()
    candidates = needles.select("s", F.explode(pieces(F.col("s"), lengths)).alias("piece"))
    asked = candidates.select("piece").distinct()
    # how many long strings have a piece that is asked for; a piece that none has sends nothing
    counts = spread.select("piece").join(asked, "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = candidates.join(counts, "piece", "left").groupBy("s").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), F.col("piece"))).alias("piece"))
    met = spread.join(rarest, "piece").where(F.contains("t", "s")).select("s", "t")  # a piece is once in a text: no pair twice
    return met.join(short.select("short_id", "s").distinct(), "s").join(long.select("long_id", "t"), "t").select("short_id", "long_id").distinct()
