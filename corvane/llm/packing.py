"""Best-fit packing of documents into fixed-length sequences, by hierarchical residual packing.

Every task tokenizes its documents and cuts those that are longer than a
sequence. The pieces, without their texts, are dealt by hash into leaves, so
that leaves are alike however the table is ordered. A leaf packs its pieces
best-fit in order of decreasing length and emits the bins that are nearly full.
The other bins rise as items of their own length: each node of a tree packs the
bins of its children best-fit, emits what is nearly full, and the root emits all.
No bin is left behind, and still a node holds little: bins of equal fill are
alike, so that what rises is a count for each fill, and what a node finds is
runs of equal bins. From the root down, runs then say where the bins of a leaf
have gone, and the pieces of risen bins are moved there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, digest_long, narrow, runs, trim
from .tokens import chunk_tokenizer

CAPACITY, END_ID = 4096, 1
#: A bin with no more room than this is nearly full. Children of a node. Pieces of a leaf, about: they are dealt by hash.
SLACK, FAN, LEAF = 32, 16, 1 << 15
#: Texts tokenized at once, and bytes of them.
TEXTS, BYTES = 500, 1_500_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A packed piece: the bin's sequence, or (fill > 0) its rank among the risen bins of that fill.
_PACKED = f"{_PIECE}, leaf long, fill long, at long, offset long"
_PLACED = f"{_PIECE}, sequence_id long, offset long"
#: Bins of a child from a rank on: where they begin in their new bin, and that bin's sequence, or (up > 0) its rank among those of fill up.
_RUN = "node long, child long, fill long, rank long, n long, offset long, up long, at long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit in order of decreasing length: each item's bin and offset, each bin's fill.

    Open bins are stacked by the room they have; the bits of one integer say
    which rooms exist, so that the tightest fit is its lowest bit from a place.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += need
        room -= need
        if room:
            if not open_bins[room]:
                rooms |= 1 << room
            open_bins[room].append(b)
    return bins, offsets, np.array(fills, np.int64)


def best_fit_runs(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The same packing from the number of items of each length: runs, sorted, groups of bins with room, and the number of bins.

    A run (length, rank, n, bin, offset): n items of a length from a rank on go
    one each into the bins from one on, at an offset. A group (fill, bin, n):
    n bins from one on. A bin that takes an item is the tightest for the next of
    that length, if that still fits: bins of equal room are filled alike.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0

    def put(room: int, first: int, n: int) -> None:
        nonlocal rooms
        if room and n:
            open_bins[room].append((first, n))
            rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    rooms ^= 1 << room
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = room // length
            # Bins that take all they can, then one that takes the last items, then bins that take none.
            for bins, items in ((min(n, left // each), each), (1, left % each)):
                if bins and items and n and left:
                    for i in range(items):
                        runs.append((length, rank, bins, first, capacity - room + i * length))
                        rank += bins
                    put(room - items * length, first, bins)
                    first, n, left = first + bins, n - bins, left - bins * items
            put(room, first, n)
    groups = [(capacity - room, first, n) for room, bins in enumerate(open_bins) for first, n in bins]
    return np.array(sorted(runs), np.int64).reshape(-1, 5), np.array(sorted(groups), np.int64).reshape(-1, 3), made


def placed(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of items by length and rank."""
    _, start, _, first, offset = runs[np.searchsorted((runs[:, 0] << 48) + runs[:, 1], (length << 48) + rank, "right") - 1].T
    return first + rank - start, offset


def ranked(kind: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many items come before each group of n among those of its kind, in the order given."""
    order = np.argsort(kind, kind="stable")
    before = np.cumsum(n[order]) - n[order]
    first = np.searchsorted(kind[order], kind[order])
    out = np.empty(len(kind), np.int64)
    out[order] = before - before[first] if len(kind) else before
    return out


def overlaps(kind: np.ndarray, start: np.ndarray, n: np.ndarray, kinds: np.ndarray, starts: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where ranges [start, start + n) of a kind meet other, disjoint and sorted ranges of that kind: places in both, first, and number."""
    keys = (kinds << 48) + starts
    a = np.maximum(np.searchsorted(keys, (kind << 48) + start, "right") - 1, 0)
    b = np.searchsorted(keys, (kind << 48) + start + n)
    count = np.maximum(b - a, 0)
    left = np.repeat(np.arange(len(kind)), count)
    right = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
    first = np.maximum(start[left], starts[right])
    size = np.minimum(start[left] + n[left], starts[right] + ns[right]) - first
    met = (size > 0) & (kind[left] == kinds[right])
    return left[met], right[met], first[met], size[met]


def sequence(level: int, node: int, leaf: int, fan: int) -> int:
    """The first sequence of a node: nodes of a level are further apart than they have items."""
    return (level << 58) + node * 4 * leaf * fan**level


def destinations(groups: np.ndarray, made: int, base: int, capacity: int, root: bool) -> np.ndarray:
    """All bins of a node as sorted ranges (bin, n, up, at): emitted ones with their sequences, risen ones with their fill and rank."""
    up = groups[(groups[:, 0] < capacity - SLACK) & (not root)]
    rows = np.stack([up[:, 1], up[:, 2], up[:, 0], ranked(up[:, 0], up[:, 2])], 1)
    rows = rows[np.argsort(rows[:, 0])]
    gap = np.append(0, rows[:, 0] + rows[:, 1])
    length = np.append(rows[:, 0], made) - gap
    emitted = np.stack([gap, length, np.zeros_like(gap), base + gap], 1)[length > 0]
    rows = np.concatenate([rows, emitted])
    return rows[np.argsort(rows[:, 0])]


def cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of a document's ids: piece, start, length, crc32."""
    step = 4 * capacity
    for piece, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def _tokenize(path: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = chunk_tokenizer(path), np.array([END_ID], "<u4").tobytes()
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, whole = batch.column(0).to_pylist(), [t.as_py() or b"" for t in batch.column(1)]
            for part_of in runs([len(t) for t in whole], BYTES, TEXTS):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[part_of], tokenizer.ids(whole[part_of])):
                    rows.extend((doc_id, *p) for p in cut_pieces(ids + end, capacity))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                number = pa.array(np.arange(made, made + len(rows)))
                made += len(rows)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), part, np.int32)), number], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "row"])
        trim()

    return run


def _pack_leaf(capacity: int, leaf: int, fan: int, root: bool):
    def run(pieces: pa.Table) -> pa.Table:
        length, part, row = (pieces[c].to_numpy() for c in ("length", "part", "row"))
        order = np.lexsort((row, part, length))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(length[order], length[order])
        found, groups, made = best_fit_runs({int(k): int(n) for k, n in zip(*np.unique(length, return_counts=True))}, capacity)
        bins, offset = placed(found, length, rank)
        node = pieces["leaf"][0].as_py()
        ranges = destinations(groups, made, sequence(0, node, leaf, fan), capacity, root)
        first, _, up, at = ranges[np.searchsorted(ranges[:, 0], bins, "right") - 1].T
        more = {"leaf": pieces["leaf"], "fill": up, "at": at + bins - first, "offset": offset}
        return pa.table({c: pieces[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | more)

    return run


def _pack_node(capacity: int, leaf: int, fan: int, level: int, root: bool):
    """Counts (node, child, fill, n) of the bins that reach a node to runs: where those of each child go."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fill", "child"], ignore_index=True)
        node, child, fill, n = (rows[c].to_numpy() for c in ("node", "child", "fill", "n"))
        before = ranked(fill, n)
        found, groups, made = best_fit_runs({int(f): int(c) for f, c in rows.groupby("fill")["n"].sum().items()}, capacity)
        ranges = destinations(groups, made, sequence(level, int(node[0]), leaf, fan), capacity, root)
        # The bins of each child and fill meet the runs of that fill; the new bins of those meet the ranges of bins.
        i, j, start, size = overlaps(fill, before, n, found[:, 0], found[:, 1], found[:, 2])
        new = found[j, 3] + start - found[j, 1]
        zero, zeros = np.zeros_like(new), np.zeros(len(ranges), np.int64)
        k, r, first, size = overlaps(zero, new, size, zeros, ranges[:, 0], ranges[:, 1])
        rank = start[k] - before[i[k]] + first - new[k]
        return pd.DataFrame({"node": node[0], "child": child[i[k]], "fill": fill[i[k]], "rank": rank, "n": size, "offset": found[j[k], 4], "up": ranges[r, 2], "at": ranges[r, 3] + first - ranges[r, 0]})

    return run


def _resolve(runs: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Runs of a node whose bins rise, by the runs of their new bins in the node above, which all end in sequences."""
    above = above.sort_values(["fill", "rank"], ignore_index=True)
    i, j, first, size = overlaps(*(runs[c].to_numpy() for c in ("up", "at", "n")), *(above[c].to_numpy() for c in ("fill", "rank", "n")))
    runs, above = runs.iloc[i].reset_index(drop=True), above.iloc[j].reset_index(drop=True)
    return runs.assign(rank=runs["rank"] + first - runs["at"], n=size, offset=runs["offset"] + above["offset"], up=0, at=above["at"] + first - above["rank"])


def _move(pieces: pa.Table, above: pa.Table) -> pa.Table:
    """Pieces of a leaf's risen bins to the sequences where those went."""
    fill, rank, at, offset = (above[c].to_numpy() for c in ("fill", "rank", "at", "offset"))
    keys = (fill << 48) + rank
    order = np.argsort(keys)
    found = order[np.searchsorted(keys[order], (pieces["fill"].to_numpy() << 48) + pieces["at"].to_numpy(), "right") - 1]
    more = {"sequence_id": at[found] + pieces["at"].to_numpy() - rank[found], "offset": pieces["offset"].to_numpy() + offset[found]}
    return pa.table({c: pieces[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | more)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its whole text (null: empty) and the end id.
    Only documents longer than the capacity are cut, at its multiples; every
    piece lies whole in one sequence and the pieces of a sequence follow each
    other without gaps. Pieces of equal length are alike: which of them goes where
    follows from their place in the table. Texts of any length are read whole.
    Rows that repeat an id are documents of their own, null ids are allowed, an
    empty table gives no rows and other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    pieces = cut(rows.mapInArrow(_tokenize(tokenizer, capacity), f"{_PIECE}, part int, row long"), "pieces")
    nodes = max(1, -(-pieces.count() // leaf))
    dealt = pieces.withColumn("leaf", F.pmod(digest_long("part", "row", seed=21), F.lit(nodes))).repartition(nodes // 8 + 8, "leaf")
    packed = cut(dealt.groupBy("leaf").applyInArrow(_pack_leaf(capacity, leaf, fan, nodes == 1), _PACKED), "packed")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    result = packed.filter("fill = 0").select(*columns, F.col("at").alias("sequence_id"), "offset")
    if nodes == 1:
        return result
    counts = packed.filter("fill > 0 AND offset = 0").groupBy(F.col("leaf").alias("child"), "fill").agg(F.count(F.lit(1)).alias("n"))
    levels: list[DataFrame] = []
    while nodes > 1:
        nodes = -(-nodes // fan)
        grouped = counts.withColumn("node", F.expr(f"child div {fan}")).groupBy("node")
        levels.append(cut(grouped.applyInPandas(_pack_node(capacity, leaf, fan, len(levels) + 1, nodes == 1), _RUN), "runs"))
        # Every risen bin holds exactly one item at its beginning.
        counts = levels[-1].filter("up > 0 AND offset = 0").groupBy(F.col("node").alias("child"), F.col("up").alias("fill")).agg(F.sum("n").alias("n"))
    above = levels.pop()
    while levels:
        level = levels.pop()
        moved = level.filter("up > 0").groupBy("node").cogroup(above.groupBy("child")).applyInPandas(_resolve, _RUN)
        above = cut(level.filter("up = 0").unionByName(moved), "resolved")
    moved = packed.filter("fill > 0").groupBy("leaf").cogroup(above.groupBy("child")).applyInArrow(_move, _PLACED)
    return result.unionByName(moved)
