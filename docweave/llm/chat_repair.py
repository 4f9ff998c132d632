"""Repair of conversation structure by the cheapest edits, ties broken by the least string of edit letters.

A conversation's rows in order are levels of a graph whose nodes are (level, state of the role pattern
(s?(ua)+)?); edits are arcs: K(eep), R(ole changed), D(elete), I(nsert). Minimum costs from the start and to the
end tell which arcs lie on a cheapest path (the tight ones); from the start, the least letter among the tight
arcs of the frontier is taken until the end.

Conversations may be longer than a task should hold. Rows are sorted by range over all conversations and cut
into blocks. A block's costs from each state to each are a 4 x 4 matrix under (min, +), so a long conversation
is solved from its blocks' matrices: products of them give each block the costs before and after it, and each
block its paths for every state it may be entered in. Repeated rows are one row with a number, so copies
neither meet in one task nor lengthen a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._shared import materialise

#: A block holds so many rows and characters at most (a longer row is a block of its own).
ROWS, CHARS = 1024, 1 << 19
#: States of the role pattern: nothing yet, after s, after u, after a. Conversations end in 0 or 3.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that a changed or inserted row takes in each state, and the state after it.
TAKES = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")

Vector = list[int]


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults by crc32 of conv_id:turn, modulo 20.

    0 drops a row, 1 empties its text, 2 removes its . ! ?, 3 repeats it, 4 sets the role user. Nulls count as
    one space, but a null conv_id or turn stays null as a value.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), blank), F.coalesce(F.col("text"), blank)
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("int"))).alias("copy"),
    )
    return rows.drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """Different rows (conv_id, turn, role, text) with their number n and whether role and text were not seen before."""
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = materialise(rows.withColumn("h", F.sha2("text", 256)), "repair-rows")
    order = F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))
    first = rows.groupBy("conv_id", "role", "h").agg(F.min(order)["turn"].alias("turn")).select(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "h", "turn")])
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("conv_id", "role", "h", "turn")]
    return rows.join(first, same[0] & same[1] & same[2] & same[3], "left").select("conv_id", "turn", "role", "text", "n", F.col("f_h").isNotNull().alias("fresh"))


def inserts(f: Vector) -> Vector:
    """Costs from the start, with inserted rows."""
    user = min(f[USER], f[START] + INSERT, f[SYSTEM] + INSERT, f[ASSISTANT] + INSERT)
    return [f[START], f[SYSTEM], user, min(f[ASSISTANT], user + INSERT)]


def inserts_back(b: Vector) -> Vector:
    """Costs to the end, with inserted rows."""
    user, assistant = min(b[USER], INSERT + b[ASSISTANT]), min(b[ASSISTANT], INSERT + b[USER])
    return [min(b[START], INSERT + user), min(b[SYSTEM], INSERT + user), user, assistant]


Row = tuple[str, str, int, int]  # role, text, copies, fault: 0 none, 1 truncated, 2 to be deleted


def arcs(row: Row) -> list[tuple[str, int, int, int]]:
    """(letter, state, next state, cost) of a row, in the order of the letters; its copies beyond the first are deleted."""
    role, _, n, fault = row
    out = [("D", q, q, DELETE * n) for q in range(4)]
    if fault < 2:
        more = DELETE * (n - 1) + TRUNCATED * fault
        out += [("K", q, to, more) for q, to in NEXT.get(role[:1], {}).items()]
        out += [("R", q, TAKES[q][1], REROLE + more) for q in range(4)]
    return out


def onward(f: Vector, row: Row) -> Vector:
    out = [FAR] * 4
    for _, q, to, cost in arcs(row):
        out[to] = min(out[to], f[q] + cost)
    return out


def backward(b: Vector, row: Row) -> Vector:
    out = [FAR] * 4
    for _, q, to, cost in arcs(row):
        out[q] = min(out[q], b[to] + cost)
    return out


def matrix(rows: list[Row]) -> list[int]:
    """Costs of a block from each state to each, row by row."""
    out = []
    for q in range(4):
        f = [0 if p == q else FAR for p in range(4)]
        for row in rows:
            f = onward(inserts(f), row)
        out += f
    return out


END = [0, FAR, FAR, 0]
BEGIN = [0, FAR, FAR, FAR]


def paths(rows: list[Row], before: Vector, after: Vector, last: bool) -> list[tuple[int, int, str, list[tuple[str, str]]] | None]:
    """For each state that a block may be entered in: state it is left in, cost, letters and repaired rows, or None.

    before are the least costs from the start to each state at the block's first row, after those from each state
    behind its last row to the end.
    """
    ahead = [before := inserts(before)]
    for row in rows:
        ahead.append(inserts(onward(ahead[-1], row)))
    back = [inserts_back(after)]
    for row in reversed(rows):
        back.append(inserts_back(backward(back[-1], row)))
    back.reverse()
    total = min(f + b for f, b in zip(ahead[0], back[0]))
    moves = [arcs(row) for row in rows]

    def tight(level: int, frontier: set[int]) -> Iterator[tuple[str, int, int, int]]:
        """Arcs on a cheapest path out of the frontier: (letter, cost, next level, next state)."""
        for q in frontier:
            if ahead[level][q] + INSERT + back[level][TAKES[q][1]] == total:
                yield "I", INSERT, level, TAKES[q][1]
            for letter, from_, to, cost in moves[level] if level < len(rows) else ():
                if from_ == q and ahead[level][q] + cost + back[level + 1][to] == total:
                    yield letter, cost, level + 1, to

    out: list[tuple[int, int, str, list[tuple[str, str]]] | None] = []
    for entry in range(4):
        if ahead[0][entry] + back[0][entry] != total:
            out.append(None)
            continue
        level, frontier, letters, made, spent = 0, {entry}, [], [], 0
        while level < len(rows) or last and not any(END[q] == 0 and ahead[level][q] == total for q in frontier):
            found = list(tight(level, frontier))
            letter = min(f[0] for f in found)
            (cost, to_level), frontier = next((f[1], f[2]) for f in found if f[0] == letter), {f[3] for f in found if f[0] == letter}
            letters.append(letter)
            spent += cost
            if letter == "I":
                made.append(("user" if frontier == {USER} else "assistant", ""))
            else:
                role, text, n, fault = rows[level]
                if letter != "D":
                    made.append((role if letter == "K" else "user" if frontier == {USER} else "assistant", text))
                letters.append("D" * (n - 1))
            level = to_level
        out.append((min(frontier), spent, "".join(letters), made))
    return out


PATH = pa.struct([("leave", pa.int32()), ("cost", pa.int64()), ("edits", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
PATH_DDL = "struct<leave:int,cost:bigint,edits:string,repaired:array<struct<role:string,text:string>>>"


def as_paths(found: list[tuple[int, int, str, list[tuple[str, str]]] | None]) -> list[dict[str, Any] | None]:
    return [p and {"leave": p[0], "cost": p[1], "edits": p[2], "repaired": [{"role": r, "text": t} for r, t in p[3]]} for p in found]


def blocks(rows: DataFrame) -> DataFrame:
    """Cut the sorted rows of faults() into blocks.

    A block that is a whole conversation is solved here (path); of others, a conversation that may go on before or
    behind the block, the rows and the matrix are given.
    """
    key = ["conv_id", "turn", "role", "text"]
    sorted_rows = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())
    kind = dict(rows.dtypes)["conv_id"]
    schema = (
        f"conv_id {kind}, part int, seq int, {', '.join(f'{c} bigint' for c in COUNTS)}, low bigint, high bigint, first string, last string, "
        f"path {PATH_DDL}, matrix array<bigint>, roles array<string>, texts array<string>, copies array<bigint>, marks array<int>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict[str, Any]] = []
        held: list[Row] = []
        turns: list[int | None] = []
        conv: Any = None
        conv_type, part, seq, size, convs, cut = None, 0, 0, 0, 0, False

        def close(ends: bool) -> None:
            """Turn what is held into a block; ends: a further conversation of this task follows."""
            nonlocal held, turns, seq, size, cut
            whole = ends and not cut and convs > 1
            numbers = [t for t in turns if t is not None]
            blank = sum(r[2] for r in held if not r[1].strip(SPACES))
            repeated = sum(r[2] if r[3] == 2 else r[2] - 1 for r in held if r[1].strip(SPACES))
            wrong = sum(r[2] - 1 for r in held) + sum(not legal(a[0], b[0]) for a, b in zip(held, held[1:]))
            block = {"conv_id": conv, "part": part, "seq": seq, "blank": blank, "duplicate": repeated, "truncated": sum(r[3] == 1 for r in held), "illegal": wrong}
            block |= {"turns": len(set(numbers)), "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None, "first": held[0][0], "last": held[-1][0]}
            if whole:
                block["path"] = as_paths(paths(held, BEGIN, END, True))[START]
            else:
                block |= {"matrix": matrix(held), "roles": [r[0] for r in held], "texts": [r[1] for r in held], "copies": [r[2] for r in held], "marks": [r[3] for r in held]}
            made.append(block)
            held, turns, size, seq, cut = [], [], 0, seq + 1, not ends

        def emit() -> pa.RecordBatch:
            nonlocal made
            fields = [("conv_id", conv_type), ("part", pa.int32()), ("seq", pa.int32()), *[(c, pa.int64()) for c in (*COUNTS, "low", "high")], ("first", pa.string()), ("last", pa.string()), ("path", PATH)]
            fields += [("matrix", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("marks", pa.list_(pa.int32()))]
            out, made = pa.RecordBatch.from_pylist(made, pa.schema(fields)), []
            return out

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for row in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fresh", "part")]):
                this, turn, role, text, n, fresh, part_ = row
                if convs and this != conv:
                    close(ends=True)
                if not convs or this != conv:
                    conv, convs = this, convs + 1
                elif len(held) >= ROWS or size + len(text) > CHARS:
                    close(ends=False)
                part = part_
                seen = text.strip(SPACES)
                held.append((role, text, n, 2 if not seen or not fresh else int(seen[-1] not in ".!?")))
                turns.append(turn)
                size += len(text)
            if made:
                yield emit()
        if held:
            close(ends=False)
        if made:
            yield emit()

    return sorted_rows.mapInArrow(run, schema)


def legal(role: str, then: str) -> bool:
    return role[:1] + then[:1] in ("su", "ua", "au")


def by_conversation(df: DataFrame, step: Callable[[list[dict[str, Any]]], list[dict[str, Any]]], schema: str, types: Callable[[pa.DataType], pa.Schema]) -> DataFrame:
    """step over the blocks of each conversation, in order. Blocks are few: a conversation has one for each ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, Any]] = []
        kind = None
        for batch in batches:
            kind = types(batch.schema.field("conv_id").type)
            done: list[dict[str, Any]] = []
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[0]["conv_id"]:
                    done += step(held)
                    held = []
                held.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, kind)
        if held:
            yield pa.RecordBatch.from_pylist(step(held), kind)

    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, schema)


def bounds(parts: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """For each block of one conversation the costs before and after it, and what its border with the block before adds."""
    out, f = [], BEGIN
    for p in parts:
        m = p["matrix"]
        out.append({"part": p["part"], "seq": p["seq"], "before": f})
        f = [min(f[q] + m[4 * q + to] for q in range(4)) for to in range(4)]
        f = [min(x, FAR) for x in f]
    b = inserts_back(END)
    for i in range(len(parts) - 1, -1, -1):
        m, o = parts[i]["matrix"], out[i]
        o |= {"after": b, "final": i == len(parts) - 1, "wrong": int(i > 0 and not legal(parts[i - 1]["last"], parts[i]["first"]))}
        b = [min(FAR, *(m[4 * q + to] + b[to] for to in range(4))) for q in range(4)]
    high = None
    for p, o in zip(parts, out):
        o["shared"] = int(high is not None and p["low"] == high)
        high = p["high"] if p["high"] is not None else high
    return out


def entries(parts: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The state that each block of one conversation is entered in."""
    out, q = [], START
    for p in parts:
        out.append({"part": p["part"], "seq": p["seq"], "entry": q})
        q = p["leaves"][q]
    return out


def repair(turns: DataFrame) -> DataFrame:
    """Blocks of repaired conversations: (conv_id, part, seq, blank, duplicate, truncated, illegal, turns, low, high, cost, edits, repaired).

    A conversation's blocks follow each other by part, then seq; edits are the letters, repaired the rows (role,
    text) of the block; the numbers add up over the blocks (turns: different turns; low and high: the least and
    largest). turns needs conv_id, turn (null or a whole number), role and text, other columns are ignored; null
    role and text count as empty. Rows are taken by turn (nulls first), then role and text, so that equal rows
    stand together; a null conv_id is one conversation. An empty table gives an empty result.
    """
    empty = F.lit("")
    plain = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    cut = materialise(blocks(materialise(faults(plain), "repair-faults")), "repair-blocks")
    numbers = [F.col(c) for c in (*COUNTS, "low", "high")]
    place = ["conv_id", "part", "seq"]
    whole = cut.where("path is not null").select(*place, *numbers, "path.cost", "path.edits", "path.repaired")
    kind = dict(cut.dtypes)["conv_id"]
    open_ = cut.where("path is null")

    vector = pa.list_(pa.int64())
    limits = by_conversation(
        open_.select(*place, "matrix", "first", "last", "low", "high"),
        bounds,
        "part int, seq int, before array<bigint>, after array<bigint>, final boolean, wrong bigint, shared bigint",
        lambda _: pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", vector), ("after", vector), ("final", pa.bool_()), ("wrong", pa.int64()), ("shared", pa.int64())]),
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a block of up to CHARS characters
                row = batch.slice(i, 1).to_pylist()[0]
                found = as_paths(paths(list(zip(row["roles"], row["texts"], row["copies"], row["marks"])), row["before"], row["after"], row["final"]))
                fields = [batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in (*place, *COUNTS, "low", "high")]
                yield pa.RecordBatch.from_arrays(
                    [*fields, pa.array([found], pa.list_(PATH)), pa.array([[p and p["leave"] for p in found]], pa.list_(pa.int32()))],
                    names=[*place, *COUNTS, "low", "high", "paths", "leaves"],
                )

    named = f"conv_id {kind}, part int, seq int, {', '.join(f'{c} bigint' for c in (*COUNTS, 'low', 'high'))}, paths array<{PATH_DDL}>, leaves array<int>"
    joined = open_.join(limits, ["part", "seq"])
    joined = joined.withColumns({"illegal": F.col("illegal") + F.col("wrong"), "turns": F.col("turns") - F.col("shared")})
    solved = materialise(joined.mapInArrow(solve, named), "repair-paths")
    ways = by_conversation(
        solved.select(*place, "leaves"), entries, "part int, seq int, entry int", lambda _: pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("entry", pa.int32())])
    )
    chosen = F.col("paths")[F.col("entry")]
    picked = solved.join(ways, ["part", "seq"]).select(*place, *numbers, chosen["cost"].alias("cost"), chosen["edits"].alias("edits"), chosen["repaired"].alias("repaired"))
    return whole.unionByName(picked)


def repaired_turns(found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: (conv_id, part, seq, position, role, text), in that order."""
    return found.select("conv_id", "part", "seq", F.posexplode("repaired").alias("position", "row")).select("conv_id", "part", "seq", "position", "row.role", "row.text")


def digest(found: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation of turns: gaps, faults, cost, audit (all letters) and repaired_sha256 (role:text, joined by newlines).

    A conversation's pieces are hashed one after the other as they come in order; none holds all of its text.
    """
    kind = dict(found.dtypes)["conv_id"]
    line = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    pieces = found.select(F.col("conv_id"), "part", "seq", *COUNTS, "low", "high", "cost", "edits", F.when(F.size("repaired") > 0, F.array_join(line, "\n")).alias("piece"))
    schema = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, now = None, None

        def done(now: dict[str, Any]) -> pa.RecordBatch:
            gaps = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
            row = {"conv_id": now["conv_id"], "gaps": gaps, **{c: now[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}}
            row |= {"audit": "".join(now["edits"]), "repaired_sha256": now["hash"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], types)

        for batch in batches:
            names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
            types = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            piece = batch.column(batch.schema.get_field_index("piece"))
            for i, row in enumerate(batch.drop_columns(["piece"]).to_pylist()):
                if now and now["conv_id"] != row["conv_id"]:
                    yield done(now)
                    now = None
                if now is None:
                    now = {"conv_id": row["conv_id"], "low": None, "high": None, "edits": [], "hash": hashlib.sha256(), "any": False, "cost": 0, **dict.fromkeys(COUNTS, 0)}
                for c in (*COUNTS, "cost"):
                    now[c] += row[c]
                now["low"] = row["low"] if now["low"] is None else now["low"]
                now["high"] = now["high"] if row["high"] is None else row["high"]
                now["edits"].append(row["edits"])
                if piece[i].is_valid:
                    now["hash"].update(b"\n" * now["any"] + piece[i].as_py().encode())
                    now["any"] = True
        if now:
            yield done(now)

    solved = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, schema)
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = every.join(solved, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )

