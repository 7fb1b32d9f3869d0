"""Exact deduplication by Patricia-trie owners.

Every task first inserts its own texts into a compressed radix trie, so that a
text with any number of copies leaves the task once. What is left is dealt by
length and content hash; there a second trie over the full byte strings finds
the owner of each text, the smallest identifier, and the number of copies. A
trie that outgrows its budget spills its largest subtree to the task's
temporary files and settles it afterwards.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bounded_batches, claim, cut, narrow, trim

#: Bytes of text that a trie holds before it flushes (local) or spills (owners).
LOCAL_BUDGET, OWNER_BUDGET = 16 << 20, 64 << 20
_NODE = 200  # bytes of a node besides its edge, roughly
_WHITE = b" \t\n\x0b\x0c\r"


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space as one space; the bytes.split() white space is exactly that set."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return b" " * (text[0] in _WHITE) + b" ".join(words) + b" " * (text[-1] in _WHITE)


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _shared(edge: bytes, key: bytes, at: int) -> int:
    """How many bytes of the edge the key has from a place on."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """A compressed trie over bytes. A node is [edge, children, owner, count]; count 0 is no terminal."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None, 0]
        self.held, self.terminals = 0, 0

    def insert(self, key: bytes, owner: int | None, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = child = [key[at:], {}, None, 0]
                self.held += len(key) - at + _NODE
                at = len(key)
            elif key.startswith(child[0], at):
                at += len(child[0])
            else:
                n = _shared(child[0], key, at)
                stem = [child[0][:n], {child[0][n]: child}, None, 0]
                child[0] = child[0][n:]
                node[1][key[at]] = child = stem
                self.held += _NODE
                at += n
            node = child
        if node[3]:
            node[2] = _least(node[2], owner)
        else:
            node[2], self.terminals = owner, self.terminals + 1
        node[3] += count

    def take(self, first: int | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """The terminals (below one first byte, then they are removed): key, owner, count."""
        start = self.root if first is None else self.root[1].pop(first)
        stack = [(start, b"")]
        while stack:
            node, before = stack.pop()
            key = before + node[0]
            if first is not None:
                self.held -= len(node[0]) + _NODE
                self.terminals -= node[3] > 0
            if node[3]:
                yield key, node[2], node[3]
            stack.extend((child, key) for child in node[1].values())


def owners(items: Iterable[tuple[bytes, int | None, int]], budget: int) -> Iterator[tuple[bytes, int | None, int]]:
    """Merge equal keys: smallest owner, sum of counts; memory stays near the budget."""
    trie, spilled, weight = RadixTrie(), {}, {}
    for key, owner, count in items:
        first = key[0] if key else None
        if first in spilled:
            _spill(spilled[first], key, owner, count)
            continue
        trie.insert(key, owner, count)
        weight[first] = weight.get(first, 0) + len(key) + _NODE
        if trie.held > budget and trie.terminals > 1:
            heaviest = max((k for k in weight if k is not None), key=weight.get)
            spilled[heaviest] = {"file": tempfile.TemporaryFile(), "prefix": None}
            for entry in trie.take(heaviest):
                _spill(spilled[heaviest], *entry)
            weight = {k: w for k, w in weight.items() if k != heaviest}
    yield from trie.take()
    del trie
    for subtree in spilled.values():
        prefix = subtree["prefix"]
        below = owners(_unspill(subtree["file"], len(prefix)), budget)
        yield from ((prefix + key, owner, count) for key, owner, count in below)
        subtree["file"].close()


def _spill(subtree: dict, key: bytes, owner: int | None, count: int) -> None:
    pickle.dump((key, owner, count), subtree["file"])
    prefix = key if subtree["prefix"] is None else subtree["prefix"]
    subtree["prefix"] = prefix if key.startswith(prefix) else prefix[: _shared(prefix, key, 0)]


def _unspill(file, skip: int) -> Iterator[tuple[bytes, int | None, int]]:
    file.seek(0)
    while True:
        try:
            key, owner, count = pickle.load(file)
        except EOFError:
            return
        yield key[skip:], owner, count


_PARTIAL = "length long, hash long, body binary, owner long, n long"
_OWNERS = "sha256 string, owner long, n long"


def _partial_batch(trie: RadixTrie) -> pa.RecordBatch:
    keys, ids, counts = map(list, zip(*trie.take()))
    return pa.RecordBatch.from_arrays(
        [pa.array([len(k) for k in keys], pa.int64()), pa.array([zlib.crc32(k) for k in keys], pa.int64()), pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())],
        names=["length", "hash", "body", "owner", "n"],
    )


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("exact_dedup")
    trie = RadixTrie()
    for batch in batches:
        for owner, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            trie.insert(normalise(body.as_py() or b""), owner, 1)
            if trie.held > LOCAL_BUDGET:
                yield _partial_batch(trie)
                trie = RadixTrie()
    if trie.terminals:
        yield _partial_batch(trie)
    del trie
    trim()


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def items():
        for batch in batches:
            for body, owner, n in zip(batch.column("body"), batch.column("owner").to_pylist(), batch.column("n").to_pylist()):
                yield body.as_py(), owner, n

    claim("exact_dedup")
    out: list[tuple[str, int | None, int]] = []
    for key, owner, n in owners(items(), OWNER_BUDGET):
        if n > 1:
            out.append((hashlib.sha256(key).hexdigest(), owner, n))
        if len(out) >= 20_000:
            yield _owner_batch(out)
            out = []
    if out:
        yield _owner_batch(out)
    trim()


def _owner_batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), (pa.string(), pa.int64(), pa.int64()))], names=["sha256", "owner", "n"])


def shared_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts that several rows have: sha256 of the normalised text, owner, n."""
    bounded_batches(docs.sparkSession)
    rows = narrow(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("binary"))
    partial = rows.mapInArrow(_local, _PARTIAL)
    return partial.repartition("length", "hash").mapInArrow(_settle, _OWNERS)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``exact_dedup``, and ``repeated``: whether rows repeat the id that stays, with its text.

    Rows stay as they are, whatever they repeat: only counts and smallest
    numbers of rows, combined in each task, meet by text and id.
    """
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), BLANKS, " ")
    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    several = cut(shared_texts(docs, id_col, text_col), "owners").withColumnRenamed("sha256", "text_sha256")
    again = rows.groupBy(F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("first")).filter("times > 1")
    several = several.join(again, (F.col("text_sha256") == F.col("_sha")) & F.col("owner").eqNullSafe(F.col("_id")), "left").select("text_sha256", "owner", "n", "first")
    joined = rows.join(cut(several, "shared"), "text_sha256", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("owner"))
    kept = F.col("doc_id").eqNullSafe(keep) & (F.col("first").isNull() | (F.col("row") == F.col("first")))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "text_sha256", F.col("first").isNotNull().alias("repeated"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became
    one space; null counts as empty. The smallest id of a group stays (null
    ids rank last). Of rows that repeat that id with that text, one stays. An
    empty table gives no rows; other columns are ignored.
    """
    return _marked(docs, id_col, text_col).drop("repeated")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; rows that repeat an id and its text stay once."""
    marks = cut(_marked(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "repeated"), "kept")
    names = docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    here = F.col(f"_{names.index(id_col)}").cast("long")
    text = F.regexp_replace(F.coalesce(F.col(f"_{names.index(text_col)}").cast("string"), F.lit("")), BLANKS, " ")
    once, again = marks.filter("NOT repeated"), marks.filter("repeated")
    same_id = here.eqNullSafe(F.col("_id"))
    same = same_id & (F.sha2(text.cast("binary"), 256) == F.col("_sha"))
    kept = flat.join(once, same, "left_semi")
    if not again.isEmpty():
        # Hashed by all their columns: equal rows meet in one task only after they were combined in each.
        kept = kept.unionByName(flat.join(again, same, "left_semi").dropDuplicates([f"_{names.index(id_col)}", f"_{names.index(text_col)}"]))
    return kept.toDF(*names)
