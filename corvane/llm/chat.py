"""Chat formatting by minimum-cost role repair.

Legal conversations are an automaton: an optional system turn, then user and
assistant turns in alternation, ending with the assistant. Every turn can be
kept, relabelled, or merged into the turn before it, and empty turns can be
inserted; dynamic programming over (turn, state) finds the cheapest legal
sequence, which is then rendered. Long conversations are repaired in parts of
equal numbers of turns: each part's costs from every state to every state are a
small matrix, matrices are combined by min-plus products up a tree, and down
the tree every part learns where it begins and ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, claim, counted, cut, narrow

ROLES = ("system", "user", "assistant")
START = 3
#: States after each state: 0 to 2 after a turn of that role, 3 before any.
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
ENDS = (2, START)
#: A turn relabelled against its name costs more than a merge and an empty turn together.
KEEP, MERGE, RELABEL, INSERT, UNNAMED = 0, 1, 4, 2, 1
#: Other names of the roles.
NAMES = {"human": 1, "prompter": 1, "gpt": 2, "bot": 2, "model": 2, "ai": 2} | {r: i for i, r in enumerate(ROLES)}
#: Turns of a part of a conversation, and parts, or groups of them, of a node of the tree.
PART, FAN = 1024, 1024
#: Bytes of a rendered conversation up to which its parts become one row.
WHOLE = 1 << 27
FAR = 1 << 40


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest insertions that lead from a state to one from which a role may follow."""
    found = {}
    for state in (0, 1, 2, START):
        for role in (0, 1, 2):
            trail, seen = [(state, ())], {state}
            for s, path in trail:
                if role in NEXT[s]:
                    found[state, role] = path
                    break
                trail += [(t, (*path, t)) for t in NEXT[s] if t not in seen and not seen.add(t)]
    return found


PATHS = _paths()
#: What closes a conversation from each state.
CLOSING = {s: () if s in ENDS else next(((t,) for t in NEXT[s] if t in ENDS), (1, 2)) for s in (0, 1, 2, START)}


def role_of(name: str | None) -> int | None:
    return None if name is None else NAMES.get(name.strip().lower())


def _steps(role: int | None) -> list[tuple[int, int, int, bool]]:
    """(state before, role given, cost, merged) of every way to take a turn; cheaper and earlier ways first among equals."""
    out = []
    for state in (0, 1, 2, START):
        for given in (0, 1, 2):
            label = 0 if given == role else UNNAMED if role is None else RELABEL
            if state == given:
                out.append((state, given, label + MERGE, True))
            if (state, given) in PATHS:
                out.append((state, given, label + KEEP + INSERT * len(PATHS[state, given]), False))
    return sorted(out, key=lambda s: (s[2], not s[3], s[1], s[0]))


STEPS = {role: _steps(role) for role in (None, 0, 1, 2)}


def costs(roles: list[int | None]) -> np.ndarray:
    """The cheapest way from each state to each state over some turns: a 4 x 4 matrix."""
    table = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(table, 0)
    for role in roles:
        after = np.full((4, 4), FAR, np.int64)
        for state, given, cost, _ in STEPS[role]:
            after[:, given] = np.minimum(after[:, given], table[:, state] + cost)
        table = after
    return table


def repair(roles: list[int | None], first: int = START, last: int | None = None) -> tuple[int, list[tuple[int, list[int]]]]:
    """Cost and the repaired turns, (role, places of the turns merged into it), from a state to a state (None: to the cheapest legal end)."""
    best = {first: 0}
    back: list[dict[int, tuple[int, bool]]] = []
    for role in roles:
        after: dict[int, int] = {}
        how: dict[int, tuple[int, bool]] = {}
        for state, given, cost, merged in STEPS[role]:
            if state in best and best[state] + cost < after.get(given, FAR):
                after[given], how[given] = best[state] + cost, (state, merged)
        best = after
        back.append(how)
    if last is None:
        end = min(best, key=lambda s: (best[s] + INSERT * len(CLOSING[s]), s))
        total, closing = best[end] + INSERT * len(CLOSING[end]), CLOSING[end]
    else:
        end, total, closing = last, best[last], ()
    turns: list[tuple[int, list[int]]] = [(r, []) for r in reversed(closing)]
    state, pending = end, []
    for place in range(len(roles) - 1, -1, -1):
        before, merged = back[place][state]
        pending.append(place)
        if not merged:
            turns.append((state, pending[::-1]))
            turns += [(r, []) for r in reversed(PATHS[before, state])]
            pending = []
        elif place == 0:
            turns.append((state, pending[::-1]))  # goes on with the part before
        state = before
    return total, turns[::-1]


def clean(text: str | None) -> str:
    """Content that can't be taken for markup of the template."""
    return (text or "").replace("<|", "< |")


def render(role: int, contents: list[str], opens: bool = True, closes: bool = True) -> str:
    """A turn in the template; a turn that goes on in another part is opened or closed there."""
    return (f"<|im_start|>{ROLES[role]}\n" if opens else "\n\n") + "\n\n".join(contents) + ("<|im_end|>\n" if closes else "")


def _groups(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows whose first columns are equal, across batches."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, run in groupby(rows, key=lambda r: r[:width]):
        yield key, [r[width:] for r in run]


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, tables = [], []
    for key, rows in _groups(batches, 2):
        keys.append(key)
        tables.append(costs([role_of(r[0]) for r in rows]).ravel().tolist())
    if keys:
        number, part = zip(*keys)
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(part, pa.int64()), pa.array(tables, pa.list_(pa.int64()))], names=["no", "part", "costs"])


def _tables(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.array(c).reshape(4, 4) for c in rows["costs"]]


def _product(rows: pd.DataFrame) -> pd.DataFrame:
    """The costs of several parts, one after the other, as one: a min-plus product."""
    table, *others = _tables(rows.sort_values("part"))
    for t in others:
        table = (table[:, :, None] + t[None]).min(1)
    return pd.DataFrame({"no": rows["no"].iloc[:1], "part": rows["above"].iloc[:1], "costs": [table.ravel().tolist()]})


def _chain(rows: pd.DataFrame, within: pd.DataFrame) -> pd.DataFrame:
    """Where each part begins and ends on the cheapest way through them all, from the state and to the state given, if one is: else to the cheapest legal end."""
    rows = rows.sort_values("part")
    first, last, final = within[["first", "last", "final"]].iloc[0]
    tables, best = _tables(rows), [np.full(4, FAR)]
    best[0][int(first)] = 0
    for t in tables:
        best.append((best[-1][:, None] + t).min(0))
    closing = np.array([INSERT * len(CLOSING[s]) for s in range(4)])
    state = int((best[-1] + closing).argmin()) if last < 0 else int(last)
    ends = [state]
    for t, before in zip(reversed(tables), reversed(best[:-1])):
        state = int((before + t[:, state]).argmin())
        ends.append(state)
    ends.reverse()
    n = len(tables)
    return pd.DataFrame({"no": rows["no"], "part": rows["part"], "first": ends[:-1], "last": ends[1:], "final": [bool(final) and i == n - 1 for i in range(n)]})


def _states(matrices: DataFrame, parts: int) -> DataFrame:
    """First and last state of every part, and whether it is the last one, by a tree over the parts."""
    levels, size = [matrices], parts
    while size > FAN:
        above = levels[-1].withColumn("above", F.expr(f"part div {FAN}"))
        levels.append(cut(above.groupBy("no", "above").applyInPandas(_product, "no long, part long, costs array<long>"), "products"))
        size = -(-size // FAN)
    states = levels[-1].select("no").distinct().selectExpr("no", "0L AS part", f"{START} AS first", "-1 AS last", "true AS final")
    for level in reversed(levels):
        below = level.withColumn("above", F.expr(f"part div {FAN}"))
        states = below.groupBy("no", "above").cogroup(states.groupBy("no", "part")).applyInPandas(_chain, "no long, part long, first int, last int, final boolean")
        states = cut(states, "states")
    return states


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partition and each row's place in it among those of its conversation, which are sorted."""
    part, current, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        place = np.empty(len(numbers), np.int64)
        starts = np.append(0, np.flatnonzero(numbers[1:] != numbers[:-1]) + 1) if len(numbers) else []
        for start, end in zip(starts, [*starts[1:], len(numbers)]):
            at = at if numbers[start] == current else 0
            place[start:end] = np.arange(at, at + end - start)
            current, at = numbers[start], at + end - start
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(numbers), part)), pa.array(place)], names=[*batch.schema.names, "pid", "at"])


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    """Add ``rank``, the place of a turn in its conversation, which may be spread over many partitions."""
    order = ["no", "unnumbered", "turn", "role", "text", "salt"]
    rows = rows.withColumn("unnumbered", F.col("turn").isNull()).withColumn("salt", F.monotonically_increasing_id())
    ranged = rows.select("no", "conv_id", "turn", "role", "text", "unnumbered", "salt").repartitionByRange(n // (64 * PART) + 8, *order).sortWithinPartitions(*order)
    ranged = ranged.select("no", "conv_id", "turn", "role", "text")
    ranged = cut(ranged.mapInArrow(_numbered, "no long, conv_id long, turn long, role string, text string, pid long, at long"), "ranged")
    counts = ranged.groupBy("no", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select("no", "pid", before.alias("before")), "before")
    return ranged.join(counts, ["no", "pid"]).withColumn("rank", F.col("before") + F.col("at")).drop("pid", "at", "before")


_OUT = "conv_id long, part long, turns_in long, turns_out long, cost long, merged long, relabelled long, inserted long, roles array<string>, rendered string"


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("chat")
    out: list[tuple] = []
    for (conv, part), rows in _groups(batches, 2):
        first, last, final = rows[0][2:]
        first = START if first is None else first
        roles = [role_of(r[0]) for r in rows]
        # A part in the middle ends in a state; the last one, and a whole conversation, is closed.
        cost, turns = repair(roles, first, None if final is None or final else last)
        text = ""
        goes_on = bool(turns and turns[0][1] and _merges_back(first, turns))
        for i, (role, places) in enumerate(turns):
            opens = not (i == 0 and goes_on)
            closes = final is None or final or i < len(turns) - 1
            before = "<|im_end|>\n" if i == 0 and opens and first != START else ""  # closes the part before
            text += before + render(role, [clean(rows[p][1]) for p in places], opens, closes)
        taken = [(role, p) for role, places in turns for p in places]
        merged = len(taken) - sum(1 for _, places in turns if places) + goes_on
        out.append((conv, part, len(rows), len(turns) - goes_on, cost, merged, sum(roles[p] != role for role, p in taken), sum(not places for _, places in turns), [ROLES[r] for r, _ in turns], text))
        if len(out) >= 2000:
            yield _out_batch(out)
            out = []
    if out:
        yield _out_batch(out)


def _merges_back(first: int, turns: list) -> bool:
    """Whether the first turn is merged into the last one of the part before: it has the role of the state and none is inserted between."""
    return first == turns[0][0]


def _out_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (*[pa.int64()] * 8, pa.list_(pa.string()), pa.string())
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as training texts: conv_id, part, turns_in, turns_out, cost, merged, relabelled, inserted, roles, rendered.

    Turns go by number, null last, ties by role and text; repeated rows are
    turns of their own. A conversation has one row, unless it renders to more
    than WHOLE bytes: then it has one for each PART turns, numbered from 0 and
    to be read in that order, since one conversation may hold a third of all
    turns and a string no more than two gigabytes. Unknown and null roles may become any
    role at a small cost; null texts are empty; rows without conv_id are one
    conversation. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(turns.sparkSession)
    rows = narrow(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    given = {"first": "int", "last": "int", "final": "boolean"}
    long = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PART)
    long, n_long = counted(long.select(F.col("conv_id").alias("_conv"), "n"), "long")
    short, same = rows, F.col("conv_id").eqNullSafe(F.col("_conv"))
    parts = None
    if n_long:
        long = long.withColumn("no", F.monotonically_increasing_id())
        short = rows.join(long, same, "left_anti")
        own, n = counted(rows.join(long.select("_conv", "no"), same).drop("_conv"), "turns")
        parts = _ranked(own, n).withColumn("part", F.expr(f"rank div {PART}"))
        matrices = parts.repartition("no", "part").sortWithinPartitions("no", "part", "rank").select("no", "part", "role").mapInArrow(_matrices, "no long, part long, costs array<long>")
        most = long.agg(F.max("n")).first()[0]
        states = _states(cut(matrices, "matrices"), -(-most // PART))
        parts = parts.join(states, ["no", "part"]).drop("no")
    rows = _rendered(short.withColumn("part", F.lit(0).cast("long")).withColumn("rank", F.lit(0).cast("long")).withColumns({c: F.lit(None).cast(t) for c, t in given.items()}))
    return rows if parts is None else rows.unionByName(_whole(cut(_rendered(parts), "rendered")))


def _rendered(rows: DataFrame) -> DataFrame:
    """Every part repaired and rendered."""
    key = ["conv_id", "part"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, "rank", F.asc_nulls_last("turn"), "role", "text")
    return rows.select(*key, "role", "text", "first", "last", "final").mapInArrow(_repaired, _OUT)


def _whole(parts: DataFrame) -> DataFrame:
    """The parts of conversations that aren't too large for it as one row each, the others as they are."""
    sizes = parts.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum(F.octet_length("rendered")).alias("_bytes"))
    sized = parts.join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    # A turn that goes on from the part before is named there already.
    roles = F.when(F.size("roles") > F.col("turns_out"), F.slice("roles", 2, F.greatest(F.size("roles"), F.lit(2)))).otherwise(F.col("roles"))
    small = sized.filter(F.col("_bytes") <= WHOLE).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", roles.alias("roles"), "rendered"))).alias("p"), *[F.sum(c).alias(c) for c in ("turns_in", "turns_out", "cost", "merged", "relabelled", "inserted")])
    joined = small.select("conv_id", F.lit(0).cast("long").alias("part"), "turns_in", "turns_out", "cost", "merged", "relabelled", "inserted", F.flatten("p.roles").alias("roles"), F.array_join("p.rendered", "").alias("rendered"))
    return joined.unionByName(sized.filter(F.col("_bytes") > WHOLE).drop("_bytes"))
