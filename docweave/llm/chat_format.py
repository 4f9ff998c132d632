"""Chat formatting over reply trees: paths by self-joins, branches ranked by score, one string per path.

DataFrame functions only. Paths are built by pointer doubling over rows (leaf, node, distance), so a
chain of n turns takes log2(n) rounds and n rows; nothing holds a path until it is formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm._shared import materialise

#: The template: <|turn|>role\ntext<|end|>\n for each turn. Control strings of this and of other
#: common templates all hold "<" or "[", so those two characters and the escape itself are escaped.
OPEN, BREAK, CLOSE = "<|turn|>", "\n", "<|end|>\n"
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "%0A"))


def escape(text: Column, table: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """Replace what could be read as a control string; unescape() gives the text back exactly."""
    for raw, safe in table:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column, table: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for raw, safe in reversed(table):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def reply_paths(nodes: DataFrame, top_paths: int | None = None) -> DataFrame:
    """The nodes of the root-to-leaf paths of the reply trees in nodes(conv, node, parent, score).

    Returns (conv, leaf, branch, path_score, pos, node): pos counts from the root, path_score is the
    mean of the path's scores (null scores count as 0), branch the rank of the path in its
    conversation by score, then leaf. A parent that is null or missing makes its node a root. Nodes
    on a cycle have no root and give no path. A node id that is repeated is one node, with the least
    parent and the largest score. conv must not be null (chat_format sees to it).

    Round k joins what is known of each leaf (its nearest 2**k nodes) to the pointers 2**k nodes up,
    and those pointers to themselves, so a path of n nodes takes log2(n) rounds and n rows.
    """
    nodes = nodes.groupBy("conv", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    known = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = nodes.join(known, ["conv", "parent"], "left").select(
        "conv", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score")
    )
    state = materialise(state, "chat-nodes")
    inner = state.select("conv", F.col("up").alias("node")).where("node is not null").distinct()
    steps = state.join(inner, ["conv", "node"], "left_anti").select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    jumps = state.where("up is not null").select("conv", "node", "up")
    most = state.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    for k in range(max(most, 1).bit_length()):
        if jumps.isEmpty():
            break
        further = steps.join(jumps, ["conv", "node"]).select("conv", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        steps = materialise(steps.unionByName(further), "chat-steps")
        beyond = jumps.select("conv", F.col("node").alias("up"), F.col("up").alias("next"))
        jumps = materialise(jumps.join(beyond, ["conv", "up"]).select("conv", "node", F.col("next").alias("up")), "chat-jumps")
    own = steps.join(state, ["conv", "node"])
    paths = own.groupBy("conv", "leaf").agg(F.avg("score").alias("path_score"), F.max("back").alias("last"), F.bool_or(F.col("up").isNull()).alias("rooted")).where("rooted")
    ranked = Window.partitionBy("conv").orderBy(F.col("path_score").desc(), "leaf")
    paths = paths.withColumn("branch", F.row_number().over(ranked))
    paths = paths if top_paths is None else paths.where(F.col("branch") <= top_paths)
    return steps.join(paths, ["conv", "leaf"]).select("conv", "leaf", "branch", "path_score", (F.col("last") - F.col("back")).alias("pos"), "node")


def chat_format(
    messages: DataFrame,
    conv_col: str = "conv_id",
    role_col: str = "role",
    text_col: str = "text",
    node_col: str | None = None,
    parent_col: str | None = None,
    turn_col: str | None = "turn",
    score_col: str | None = None,
    loss_role: str = "assistant",
    top_paths: int | None = None,
) -> DataFrame:
    """One row per chosen root-to-leaf path: (conv_id, branch, path_score, n_turns, formatted, loss_spans).

    Messages either name their parent (node_col, parent_col) or are a chain ordered by turn_col
    (ties: role, then text; null turns first). formatted holds every turn under the template with
    control strings escaped; loss_spans are (start, length) in code points of formatted, one for
    each text of loss_role in order. Null role and text count as empty; a null conversation id is a
    conversation of its own; messages that repeat a node id are turns one after another, by role and
    text. Empty input gives no rows; other columns are ignored.
    """
    base = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("conv"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
        (F.col(score_col).cast("double") if score_col else F.lit(0.0)).alias("score"),
        *(
            [F.col(node_col).alias("node"), F.col(parent_col).alias("parent")]
            if node_col
            else [F.col(turn_col).alias("turn")]
        ),
    )
    if not node_col:
        chain = Window.partitionBy("conv").orderBy("turn", "role", "text")
        base = base.withColumn("node", F.row_number().over(chain)).withColumn(
            "parent", F.when(F.col("node") > 1, F.col("node") - 1)
        )
    base = materialise(base, "chat-messages")
    steps = reply_paths(base.select("conv", "node", "parent", "score"), top_paths).drop("leaf")
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(BREAK))
    turns = (
        steps.join(base, ["conv", "node"])
        .withColumn("head", head)
        .withColumn("body", escape(F.col("text")))
        .withColumn("length", F.length("head") + F.length("body") + F.lit(len(CLOSE)))
    )
    before = Window.partitionBy("conv", "branch").orderBy("pos", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)) + F.length("head"))
    turn = F.struct(
        "pos",
        F.col("start").alias("at"),
        F.concat("head", "body", F.lit(CLOSE)).alias("said"),
        F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")).alias("span"),
        (F.col("role") == loss_role).alias("learn"),
    )
    whole = turns.groupBy("conv", "branch").agg(
        F.first("conv_id").alias("conv_id"),
        F.first("path_score").alias("path_score"),
        F.array_sort(F.collect_list(turn)).alias("turns"),
    )
    return whole.select(
        "conv_id",
        "branch",
        "path_score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["span"]).alias("loss_spans"),
    )


def parse_turns(formatted: Column) -> Column:
    """Read a formatted conversation back: array of (role, text)."""
    said = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda t: t.startswith(OPEN))
    return F.transform(
        said,
        lambda t: F.struct(
            unescape(F.regexp_extract(t, r"^<\|turn\|>([^\n]*)\n", 1), ROLE_ESCAPES).alias("role"),
            unescape(F.regexp_replace(t, r"^<\|turn\|>[^\n]*\n", "")).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    under = F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return unescape(F.array_join(under, ""))


def digest(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, per conversation and branch."""
    turns, under = parse_turns(F.col("formatted")), masked_text(F.col("formatted"), F.col("loss_spans"))
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return (
        formatted.withColumn("turns", turns)
        .withColumn("under", under)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(told, 256).alias("turns_sha256"),
            F.length("under").cast("long").alias("loss_chars"),
            F.sha2(F.col("under"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
