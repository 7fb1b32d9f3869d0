"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is the weighted set of its word shingles. Hashed darts fall onto each
shingle's region of weight by rank, a Poisson process that is the same for the
shingle in every text; a dart counts when its weight lies below the shingle's
and its rank below the text's limit, and the earliest dart of each coordinate
is kept. A text of n shingles thus costs about n + k log k darts instead of
n times k hashes. Texts that agree on a band of coordinates are joined with one
of them, the pivot; candidates that agree on enough coordinates are compared
exactly, and links become classes. Bands that then still hold several classes
get other pivots, so that large groups of near copies fall together in linear
time. What is left over is joined completely: texts that agree on enough
coordinates share one of their rarest ones (the prefix of a set join), so that
coordinates which many texts have from a common passage join nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bounded_batches, claim, counted, cut, digest_long, narrow, new_folder, runs, scratch, trim
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Standard deviations that a pair's agreement may lie below the similarity's.
SLACK = 4.0
#: Further pivots of a band that holds several classes, before such members are joined completely.
PIVOTS = 2
#: Members of a coordinate compared in one group; ids broadcast at most, beyond that the join shuffles.
BLOCK, BROADCAST_IDS = 512, 200_000
#: Pairs of signatures compared at once.
PAIRS = 8192
#: Texts, and characters of them, signed at once.
TEXTS, CHARS = 300, 600_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


_WORDS = _WordHashes()


def shingles(texts: list[str], length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's text and hash. Words are lower-case and end at white space; a text of fewer words is one shingle, one without words has none."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    hashes = np.fromiter((_WORDS[w] for ws in words for w in ws), np.uint64, int(n.sum()))
    short = np.flatnonzero((n > 0) & (n < length))
    starts = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(hashes) - length + 1, 0), np.uint64)
        for j in range(length):
            rolled = rolled * _GOLD + _mix(hashes[j : j + len(rolled)])
        count = np.maximum(n - length + 1, 0)
        of = np.repeat(np.arange(len(texts)), count)
        at = np.arange(int(count.sum())) - (np.cumsum(count) - count)[of] + starts[of]
        out = _mix(rolled[at])
        extra = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short):
            for h in hashes[starts[t] : starts[t] + n[t]]:
                extra[i] = extra[i] * _GOLD + _mix(h)
    return np.concatenate([of, short]), np.concatenate([out, _mix(extra)])


def dart_signatures(of: np.ndarray, element: np.ndarray, weight: np.ndarray | None, texts: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures (texts, k) of weighted sets; weight None: 1 each, and repeated elements count once.

    The share of equal coordinates estimates the weighted Jaccard similarity.
    Texts without elements get zeros.
    """
    with np.errstate(over="ignore"):
        if weight is None:
            slab = np.zeros(len(of))
        else:  # one region for each unit of weight
            units = np.ceil(weight).astype(np.int64)
            slab = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
            of, element, weight = np.repeat(of, units), np.repeat(element, units), np.repeat(weight, units)
            element = _mix(element + slab.astype(np.uint64) * _GOLD)
        mass = np.bincount(of, weight, texts)
        limit = (np.log(k) + 3) / np.maximum(mass, 1e-9)
        signature = np.zeros(texts * k, np.uint32)
        pending, distinct = mass > 0, False
        while pending.any():
            live = pending[of]
            text, seed, low = of[live], element[live], slab[live]
            high = None if weight is None else weight[live]
            rank = np.zeros(len(text))
            darts = []
            turn = np.uint64(1)
            while len(text):
                x = _mix(seed + turn * _GOLD)
                rank = rank - np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / k
                near = rank <= limit[text]
                text, seed, rank, low, x = text[near], seed[near], rank[near], low[near], x[near]
                y = _mix(x ^ _GOLD)
                cell = text * k + (y >> np.uint64(32)).astype(np.int64) % k
                if high is None:
                    darts.append((cell, rank, y))
                else:
                    high = high[near]
                    inside = low + (y & np.uint64(0xFFFFFF)).astype(float) * 2.0**-24 < high
                    darts.append((cell[inside], rank[inside], y[inside]))
                turn += np.uint64(1)
            cell, rank, y = (np.concatenate(c) for c in zip(*darts))
            earliest = np.full(texts * k, np.inf)
            np.minimum.at(earliest, cell, rank)
            first = rank == earliest[cell]
            mark = _mix(y[first] + _GOLD).astype(np.uint32)
            signature[cell[first]] = mark
            missed = np.isinf(earliest).reshape(texts, k).any(1) & pending
            pending = missed
            limit[missed] *= 2
            if weight is None and missed.any() and not distinct:
                # Few kinds of elements, many times each: from here on once each, or every copy would throw all the darts again.
                live = missed[of]
                of, element, slab = of[live], element[live], slab[live]
                order = np.lexsort((element, of))
                of, element = of[order], element[order]
                fresh = np.ones(len(of), bool)
                fresh[1:] = (of[1:] != of[:-1]) | (element[1:] != element[:-1])
                of, element, slab = of[fresh], element[fresh], slab[: fresh.sum()]
                kinds = np.bincount(of, minlength=texts)
                limit[missed] = np.maximum(limit[missed], (np.log(k) + 3) / kinds[missed])
                distinct = True
    return signature.reshape(texts, k)


def _counted(of: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles and how often it has them."""
    order = np.lexsort((element, of))
    of, element = of[order], element[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (element[1:] != element[:-1])
    first = np.flatnonzero(fresh)
    return of[first], element[first], np.diff(np.append(first, len(of)))


def _sign(weighted: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup", _WORDS.clear)
        for batch in batches:
            whole = [t.as_py() or "" for t in batch.column(2)]
            for part in runs([len(t) for t in whole], CHARS, TEXTS):
                texts, some = whole[part], batch.slice(part.start, part.stop - part.start)
                of, element = shingles(texts)
                filled = np.bincount(of, minlength=len(texts)) > 0
                weight = None
                if weighted:
                    of, element, weight = _counted(of, element)
                signature = dart_signatures(of, element, None if weight is None else weight.astype(float), len(texts))
                binary = [s.tobytes() if f else None for s, f in zip(signature, filled)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(binary, pa.binary())], names=["id", "sha", "signature"])
        trim()

    return run


def _agreeing(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((left == right).sum(1) >= least))

    return run


def _sets(weighted: bool):
    """Sets of shingles; weighted: a shingle as often as the text has it, each time as another element."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup", _WORDS.clear)
        for batch in batches:
            whole = [t.as_py() or "" for t in batch.column(1)]
            for part in runs([len(t) for t in whole], CHARS, TEXTS):
                texts, some = whole[part], batch.slice(part.start, part.stop - part.start)
                of, element, count = _counted(*shingles(texts))
                if weighted:
                    time = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    of, element = np.repeat(of, count), np.repeat(element, count)
                    with np.errstate(over="ignore"):
                        element = _mix(element + time.astype(np.uint64) * _GOLD)
                parts = np.split(element, np.cumsum(np.bincount(of, minlength=len(texts)))[:-1])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([np.unique(p).tobytes() for p in parts], pa.binary())], names=["row", "elements"])

    return run


def _similar(similarity: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True)) if similarity * max(len(x), len(y)) <= min(len(x), len(y)) else 0
                keep.append(both > 0 and both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


_MEMBER = "token long, c int, i long, j long, row long, component long, block long, coords array<int>, signature binary"
_PLACE = ["token", "i", "j"]


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of sorted rows, batches of whole block pairs and the places where these begin, and end. There may be very many small ones."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = np.stack([batch.column(c).to_numpy() for c in _PLACE])
        starts = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1)
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts
        rest = batch.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


class _Members:
    """The members of some block pairs as arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        column = lambda name: batch.column(name).to_numpy()
        self.row, self.component, self.block, self.c = column("row"), column("component"), column("block"), column("c")
        self.i, self.j = column("i"), column("j")
        self.signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
        n = pa.compute.list_value_length(batch.column("coords")).to_numpy()
        self.prefix = np.zeros(self.signature.shape, bool)
        self.prefix[np.repeat(np.arange(len(n)), n), batch.column("coords").flatten().to_numpy()] = True

    def candidates(self, start: int, end: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a block pair that agree on enough coordinates, are of different classes, and meet in no earlier coordinate of both prefixes."""
        within = self.i[start] == self.j[start]
        here = np.arange(start, end)
        left, right = (here, here) if within else (here[self.block[start:end] == self.i[start]], here[self.block[start:end] != self.i[start]])
        found = [(left[:0], left[:0])]
        step = max(1, PAIRS // max(1, len(right)))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            equal = self.signature[some][:, None] == self.signature[right][None]
            fits = (equal.sum(2) >= least) & (self.component[some][:, None] != self.component[right][None])
            if within:
                fits &= some[:, None] < right[None]
            x, y = np.nonzero(fits)
            first = (equal[x, y] & self.prefix[some[x]] & self.prefix[right[y]]).argmax(1) == self.c[start]
            found.append((some[x[first]], right[y[first]]))
        return tuple(np.concatenate(f) for f in zip(*found))


def _open(least: int):
    """The members of block pairs that are candidates of any other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _groups(batches):
            members, some = _Members(batch), np.zeros(batch.num_rows, bool)
            for start, end in zip(bounds, bounds[1:]):
                for side in members.candidates(start, end, least):
                    some[side] = True
            yield batch.filter(pa.array(some))

    return run


def _bridges(similarity: float, least: int):
    """Links of block pairs that join classes: compared exactly, one for two classes that no link before has joined."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _groups(batches):
            members, found = _Members(batch), []
            sets = [np.frombuffer(e.as_py(), np.uint64) for e in batch.column("elements")]
            sizes = np.array([len(e) for e in sets])
            for start, end in zip(bounds, bounds[1:]):
                root: dict[int, int] = {}

                def find(c: int, root: dict[int, int] = root) -> int:
                    while root.setdefault(c, c) != c:
                        root[c] = c = root[root[c]]
                    return c

                left, right = members.candidates(start, end, least)
                near = np.minimum(sizes[left], sizes[right]) >= similarity * np.maximum(sizes[left], sizes[right])
                for x, y in zip(left[near].tolist(), right[near].tolist()):
                    a, b = find(int(members.component[x])), find(int(members.component[y]))
                    if a != b:
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if both >= similarity * (sizes[x] + sizes[y] - both) - 1e-9:
                            root[max(a, b)] = min(a, b)
                            found.append((members.row[x], members.row[y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


class _Texts:
    """The texts of some rows, found by id; where ids repeat, by id and content."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, weighted: bool) -> None:
        self.rows, self.nodes, self.weighted = rows, nodes, weighted

    def sets(self, wanted: DataFrame) -> DataFrame:
        """The shingle sets of rows: row, elements; written."""
        wanted, n = counted(self.nodes.join(wanted.distinct(), "row", "left_semi").select("row", F.col("id").alias("_id"), F.col("sha").alias("_sha")), "wanted")
        # No key of the join, so that only texts whose ids are wanted are hashed.
        same = F.coalesce(text_key(F.col("text")) == F.col("_sha"), F.lit(False))
        texts = self.rows.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, F.col("id").eqNullSafe(F.col("_id")) & same)
        sets, found = counted(texts.select("row", "text").mapInArrow(_sets(self.weighted), "row long, elements binary"), "sets")
        return sets if found == n else cut(sets.dropDuplicates(["row"]), "sets")  # rows that repeat an id and its text


def _verified(pairs: DataFrame, texts: _Texts, signatures: DataFrame, similarity: float, least: int) -> tuple[DataFrame, int]:
    """Those of the pairs (a, b) whose shingle sets are similar enough, written, and their number."""
    near = pairs.join(signatures.select(F.col("row").alias("a"), F.col("signature").alias("x")), "a")
    near = near.join(signatures.select(F.col("row").alias("b"), F.col("signature").alias("y")), "b")
    pairs, n = counted(near.select("a", "b", "x", "y").mapInArrow(_agreeing(least), "a long, b long"), "near")
    if not n:
        return pairs, 0
    sets = texts.sets(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))))
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("elements").alias("y")), "b")
    return counted(both.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long"), "similar")


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (row, component) after further links: these join the classes of their ends."""
    of = lambda end: F.coalesce(F.col(f"component_{end}"), F.col(end)).alias(end)
    for end in ("a", "b"):
        links = links.join(classes.select(F.col("row").alias(end), F.col("component").alias(f"component_{end}")), end, "left")
    joined = components(links.select(of("a"), of("b")))
    moved = classes.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    return cut(moved.select("row", F.coalesce("to", "component").alias("component")).unionByName(joined.select(F.col("id").alias("row"), "component")), "classes")


def _labelled(members: DataFrame, classes: DataFrame) -> DataFrame:
    return members.join(classes, "row", "left").withColumn("component", F.coalesce("component", "row"))


def _prefixes(nodes: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """Of each node the coordinates among whose rarest one any two nodes that agree on enough coordinates meet: row, component, prefix."""
    token = "posexplode(transform(sequence(0, {}), c -> xxhash64(c, substring(signature, 1 + 4 * c, 4)))) AS (c, token)".format(COORDINATES - 1)
    tokens = cut(nodes.join(signatures, "row").selectExpr("row", "component", token), "tokens")
    known = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), (F.min("component") < F.max("component")).alias("several")).filter("n > 1")
    shared = tokens.join(known, "token").groupBy("row", "component").agg(F.sort_array(F.collect_list(F.struct("n", "token", "c", "several"))).alias("shared"))
    # Coordinates that no other node shares come first.
    return cut(shared.selectExpr("row", "component", f"slice(shared, 1, greatest(0, size(shared) - {least} + 1)) AS prefix").filter("size(prefix) > 0"), "prefixes")


def _block_pairs(members: DataFrame) -> DataFrame:
    """Members (token, c, row, component) of several classes dealt into pairs of blocks: the largest class of a token meets all others, but not itself."""
    per_class = members.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    main = per_class.groupBy("token").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    main = cut(main.selectExpr("token", "main.component AS main", f"CAST(ceil((n - main.n) / {BLOCK}) AS BIGINT) AS others", f"CAST(ceil(main.n / {BLOCK}) AS BIGINT) AS mains"), "mixed")
    rows = members.join(main, "token").withColumn("h", digest_long("row", seed=31))
    rows = rows.withColumn("block", F.expr("if(component = main, others + pmod(h, mains), pmod(h, others))"))
    rows = rows.withColumn("k", F.expr("explode(sequence(0L, if(component = main, others, others + mains) - 1))"))
    return rows.selectExpr("token", "c", "least(block, k) AS i", "greatest(block, k) AS j", "row", "component", "block")


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Block pairs side by side, in partitions by the number of rows: their comparisons cost far more than their bytes tell."""
    return rows.repartition(n // BLOCK + 8, *_PLACE).sortWithinPartitions(*_PLACE, "row")


def _joined(nodes: DataFrame, texts: _Texts, signatures: DataFrame, similarity: float, least: int) -> tuple[DataFrame, int]:
    """Links (a, b) between nodes (row, component) that join their classes, written, and their number."""
    prefixes = _prefixes(nodes, signatures, least)
    members = prefixes.selectExpr("row", "component", "explode(prefix) AS t").filter("t.several").selectExpr("t.token AS token", "t.c AS c", "row", "component")
    blocks, n = counted(_block_pairs(cut(members, "prefixed")), "blocks")
    if not n:
        return blocks.select(F.col("row").alias("a"), F.col("row").alias("b")), 0
    about = prefixes.selectExpr("row", "transform(prefix, t -> t.c) AS coords").join(signatures, "row")
    columns = [c.split()[0] for c in _MEMBER.split(", ")]
    candidates, n = counted(_dealt(blocks.join(about, "row").select(*columns), n).mapInArrow(_open(least), _MEMBER), "candidates")
    if not n:
        return candidates.select(F.col("row").alias("a"), F.col("row").alias("b")), 0
    members = candidates.join(texts.sets(candidates.select("row")), "row")
    return counted(_dealt(members, n).mapInArrow(_bridges(similarity, least), "a long, b long").distinct(), "bridges")


def _classes(docs: DataFrame, similarity: float, id_col: str, text_col: str, weighted: bool) -> DataFrame:
    """One row per document: id, sha of its text, copy_of, class_id, class_sha, links; written, while the tables on the way are removed."""
    spark = docs.sparkSession
    path = new_folder(spark, "classes")
    with scratch(spark):
        found = _assigned(docs, similarity, id_col, text_col, weighted)
        found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def _assigned(docs: DataFrame, similarity: float, id_col: str, text_col: str, weighted: bool) -> DataFrame:
    """One row per document: id, sha of its text, copy_of, class_id, class_sha, links."""
    bounded_batches(docs.sparkSession)
    least = int(np.floor(COORDINATES * similarity - SLACK * np.sqrt(COORDINATES * similarity * (1 - similarity))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = narrow(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), text_key(text).alias("sha"), text.alias("text"))
    # Rows are told apart by their number in the written table: ids may repeat or be null.
    signed = cut(rows.mapInArrow(_sign(weighted), "id long, sha string, signature binary").withColumn("row", F.monotonically_increasing_id()), "signed")
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    first = signed.groupBy("sha").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = cut(first.selectExpr("sha", "first.row AS first", "first.id AS copy_of"), "copied")
    rest = signed.select("row", "sha").join(first, "sha").filter("row <> first").select("row")
    signatures = cut(signed.filter("signature IS NOT NULL").join(rest, "row", "left_anti"), "signatures")
    nodes = signatures.select("row", "id", "sha")
    signatures = signatures.select("row", "signature")
    texts = _Texts(rows.select("id", "text"), nodes, weighted)

    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", 1 + width * b, width)) for b in range(BANDS)])
    bands = signatures.select("row", F.explode(keys).alias("band"))
    shared = cut(bands.groupBy("band").agg(F.min("row").alias("pivot"), F.max("row").alias("last")).filter("pivot < last").drop("last"), "shared")
    members = cut(bands.join(shared, "band"), "members")
    pairs = cut(members.filter("row <> pivot").select(F.col("pivot").alias("a"), F.col("row").alias("b")).distinct(), "pairs")
    links, n = _verified(pairs, texts, signatures, similarity, least)
    classes = components(links).withColumnRenamed("id", "row")

    members = members.select("band", "row")
    labelled = cut(_labelled(members, classes), "labelled")
    pivots = [F.min_by(F.struct("row", "component"), digest_long("row", seed=41 + k)) for k in range(PIVOTS)]
    mixed = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.array(*pivots).alias("pivots")).filter("x < y").select("band", "pivots")
    members, n = counted(labelled.join(mixed, "band").select("band", "row", "component", "pivots"), "mixed")
    if n:
        pairs = members.select("row", "component", F.explode("pivots").alias("pivot")).filter("component <> pivot.component")
        pairs = cut(pairs.select(F.least("row", "pivot.row").alias("a"), F.greatest("row", "pivot.row").alias("b")).distinct(), "pairs")
        found, n = _verified(pairs, texts, signatures, similarity, least)
        if n:
            links, classes = links.unionByName(found), _merged(classes, found)
        labelled = cut(_labelled(members.select("band", "row"), classes), "labelled")
        mixed = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("band")
        unsettled, n = counted(labelled.join(mixed, "band", "left_semi").select("row", "component").distinct(), "unsettled")
        found, n = _joined(unsettled, texts, signatures, similarity, least) if n else (None, 0)
        if n:
            links, classes = links.unionByName(found), _merged(classes, found)

    degree = links.select(F.col("a").alias("row")).unionByName(links.select(F.col("b").alias("row"))).groupBy("row").agg(F.count(F.lit(1)).alias("links"))
    linked = cut(degree.join(classes, "row", "left").withColumn("component", F.coalesce("component", "row")).join(nodes, "row"), "linked")
    name = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("sha").alias("sha"))).alias("name")
    names = linked.groupBy("component").agg(name).selectExpr("component", "name.id AS class_id", "name.sha AS class_sha")
    known = cut(linked.select("row", "component", "links").join(names, "component").select(F.col("row").alias("first"), "links", "class_id", "class_sha"), "known")
    out = signed.select("row", "id", "sha").join(first, "sha", "left").withColumn("copy_of", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("copy_of")))
    out = out.withColumn("first", F.coalesce("first", "row")).join(known, "first", "left")
    alone = F.col("class_sha").isNull()
    return out.select(
        "id", "sha", "copy_of", F.when(alone, F.col("copy_of")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_sha", "sha").alias("class_sha"), F.coalesce("links", F.lit(0).cast("long")).alias("links"),
    )


def text_key(text: Column) -> Column:
    """A hash of a text, equal for texts that differ in white space only."""
    return F.sha2(F.regexp_replace(text, BLANKS, " ").cast("binary"), 256)


_KEPT = "id <=> class_id AND sha = class_sha"


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id, kept, copy_of, links.

    Two texts are linked when the Jaccard similarity of their sets of five-word
    shingles is at least the given one (weighted: of the shingles with their
    numbers, least over greatest); a class is a connected component and is
    named by its smallest id, null last, ties by content; the document with
    that id and text stays. Texts that differ in white space only are copies of
    their smallest id, ``copy_of``, which stands for them; ``links`` counts its
    links to other texts that were found: to the pivots of its bands, or
    joining two classes. Null counts as empty; texts without a word are like no
    other but their copies. Rows that repeat an id are texts of their own, and
    those that repeat an id and its text stay or go together; of a class
    without any id, the text with the least hash stays. An empty table gives no
    rows; other columns are ignored.
    """
    found = _classes(docs, similarity, id_col, text_col, weighted)
    return found.select(F.col("id").alias("doc_id"), "class_id", F.expr(_KEPT).alias("kept"), "copy_of", "links")


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False) -> DataFrame:
    """The documents that stay in their class, with all their columns.

    Rows that repeat an id are told apart by their texts; those that repeat
    both stay or go together. Nulls, empty texts and empty tables are as in
    near_classes, and other columns may have any name.
    """
    names = docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    gone = cut(_classes(docs, similarity, id_col, text_col, weighted).filter(f"NOT ({_KEPT})").select(F.col("id").alias("_gone"), F.col("sha").alias("_sha")).distinct(), "gone")
    here, text = F.col(f"_{names.index(id_col)}").cast("long"), F.coalesce(F.col(f"_{names.index(text_col)}").cast("string"), F.lit(""))
    # As in _Texts: the content is no key of the join.
    same = here.eqNullSafe(F.col("_gone")) & F.coalesce(text_key(text) == F.col("_sha"), F.lit(False))
    return flat.join(gone, same, "left_anti").toDF(*names)
