"""Deduplication, leak removal between splits, and limits."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_order, strip, text_hash, text_of
from ..shared import checkpointed
from ..shipping import ship
from .components import components
from .ranks import first_rows, hash_ranks

DEDUP_ON = ("none", "id", "text", "id_and_text")
SPLITS = ("train", "dev", "test")


def dedup(df: DataFrame, on: str | None = "none", ident: str = "id", text: str = "text", pos: str = "pos", key: str | None = None) -> DataFrame:
    """The first row by position of each id, each text, or each pair of both. Unknown modes do nothing.

    Texts are compared by the hash of their key, which is computed from the
    text or stands in the key column already.
    """
    own, same = strip(text_of(F.col(ident).cast("string"))), F.col(key) if key else text_hash(text)
    keys = {"id": [own], "text": [same], "id_and_text": [own, same]}.get((on or "none").strip().lower(), [])
    return first_rows(df, keys, pos) if keys else df


def split_rank(split: str = "split") -> Column:
    out = F.when(F.col(split) == SPLITS[0], 0)
    for i, name in enumerate(SPLITS[1:], 1):
        out = out.when(F.col(split) == name, i)
    return out.otherwise(len(SPLITS))


def leak_marks(df: DataFrame, ident: str = "id", text: str = "text", pos: str = "pos", split: str = "split", key: str | None = None) -> DataFrame:
    """Add ``leaked``: the id, or the text of a row that stays, occurs earlier in split and position.

    With a key column of text hashes no text is needed, let alone shuffled.
    This is the greedy walk: null and blank ids are never equal, and a row
    that leaks by its text leaves its id to later ones. Where ids are unique,
    the first row of each text stays and one pass will do; where they repeat,
    see ``walked``. Positions must be unique in a split.
    """
    order = F.struct(split_rank(split).alias("s"), F.col(pos).alias("p"))
    own = strip(text_of(F.col(ident).cast("string")))
    rows = df.withColumn("_order", order).withColumn("_hash", F.col(key) if key else text_hash(text))
    walk = rows.select("_order", F.when(own != "", own).alias("_id"), "_hash")
    if walk.filter("_id IS NOT NULL").groupBy("_id").count().filter("count > 1").isEmpty():
        stays = walk.groupBy("_hash").agg(F.min("_order").alias("_stays")).select("_stays")
    else:
        stays = walked(walk)
    marked = rows.join(stays, F.col("_order") == F.col("_stays"), "left")
    return marked.withColumn("leaked", F.col("_stays").isNull()).drop("_order", "_hash", "_stays")


#: Rows of ids, hashes and places that one task walks through.
WALK = 1 << 20


def walked(rows: DataFrame, most: int = WALK) -> DataFrame:
    """The rows (_order, _id, _hash) that a walk in order keeps, as _stays.

    Rows that are first of their id and of their text stay, and what shares
    either with them goes. While that halves the rest it goes on; what then is
    left are chains of rows that decide each other. Rows that no chain links
    don't, so each of their connected components, of ids and texts, is walked
    by one task, several small ones together. Of a component of more rows than
    a task takes, the first ones in order are walked, and the rest begins anew
    without what they have decided. Whole components of any length thus take a
    number of jobs that grows with the logarithm of their rows, up to the most
    rows, and by one walk for each further ``most`` rows.
    """
    ship(rows.sparkSession)
    place = rows.schema["_order"].dataType["p"].dataType.simpleString()
    # Of rows with the same id and text only the first can stay; hot ones meet as a minimum.
    left, kept = checkpointed(rows.groupBy("_id", "_hash").agg(F.min("_order").alias("_order"))), []
    n = left.count()
    while n > most:
        first, rest = _firsts(left)
        kept.append(first.select(F.col("_order").alias("_stays")))
        left, before = rest, n
        n = left.count()
        if most < n and 2 * n > before:
            found, left = _by_component(left, n, most, place)
            kept.append(found)
            n = left.count()
    kept.append(_walk(left.withColumn("_unit", F.lit(0)), place))
    return reduce(DataFrame.unionByName, kept)


def _without(left: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows that share neither text nor id with kept ones, nor are such."""
    rest = left.join(kept.select("_hash"), "_hash", "left_anti")
    return rest.join(kept.filter("_id IS NOT NULL").select("_id"), "_id", "left_anti").select("_order", "_id", "_hash")


def _firsts(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that are first of both their id and their text, and what they leave."""
    by_id = left.filter("_id IS NOT NULL").groupBy(F.col("_id").alias("_i")).agg(F.min("_order").alias("_first_id"))
    by_text = left.groupBy(F.col("_hash").alias("_h")).agg(F.min("_order").alias("_first_text"))
    placed = left.join(by_text, F.col("_hash") == F.col("_h")).join(by_id, F.col("_id") == F.col("_i"), "left")
    placed = placed.withColumn("_stays", (F.col("_order") == F.col("_first_text")) & F.coalesce(F.col("_order") == F.col("_first_id"), F.lit(True)))
    placed = checkpointed(placed.select("_order", "_id", "_hash", "_stays"))
    first = placed.filter("_stays")
    return first, checkpointed(_without(placed.filter("NOT _stays"), first))


def _walk(rows: DataFrame, place: str) -> DataFrame:
    """The walk through each unit, a few whole components: places (_stays) of the rows that stay."""

    def walk(part: pa.Table) -> pa.Table:
        part = part.sort_by([("s", "ascending"), ("p", "ascending")])
        ids: set = set()
        texts: set = set()
        stays = []
        for ident, text in zip(part["_id"].to_pylist(), part["_hash"].to_pylist()):
            free = text not in texts and (ident is None or ident not in ids)
            if free:
                texts.add(text)
                ids.add(ident)
            stays.append(free)
        return part.filter(pa.array(stays, pa.bool_())).select(["s", "p"])

    flat = rows.select("_unit", "_order.s", "_order.p", "_id", "_hash")
    return flat.groupBy("_unit").applyInArrow(walk, f"s int, p {place}").select(F.struct("s", "p").alias("_stays"))


def _by_component(left: DataFrame, n: int, most: int, place: str) -> tuple[DataFrame, DataFrame]:
    """Walk all components of at most so many rows and the beginnings of larger ones; what stays, and the rows that are still open."""
    # Equal hashes of two keys would only walk two components together.
    text, ident = F.xxhash64(F.lit("text"), "_hash"), F.xxhash64(F.lit("id"), "_id")
    found = components(left.filter("_id IS NOT NULL").select(text.alias("a"), ident.alias("b")))
    left = left.withColumn("_text", text).join(found, F.col("_text") == F.col("id"), "left").withColumn("_component", F.coalesce("component", "_text")).drop("id", "component", "_text")
    left = checkpointed(left)
    sizes = left.groupBy(F.col("_component").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    left = left.join(sizes, F.col("_component") == F.col("_c")).drop("_c")
    small = left.filter(F.col("_n") <= most).withColumn("_unit", F.pmod(F.xxhash64("_component"), F.lit(-(-n // most))))
    kept = _walk(small, place)
    large = left.filter(F.col("_n") > most)
    # Beginnings of about the most rows: of a component's first split, up to a quantile of its places.
    halves = [2.0**-k for k in range(41)]
    spans = large.groupBy(F.col("_component").alias("_c"), F.col("_order.s").alias("_s")).agg(F.count(F.lit(1)).alias("_m"), F.percentile_approx("_order.p", halves, 1_000_000).alias("_q"))
    spans = spans.groupBy("_c").agg(F.min(F.struct("_s", "_m", "_q")).alias("_f"))
    steps = F.least(F.greatest(F.ceil(F.log2(F.col("_f._m") / F.lit(most))), F.lit(0)), F.lit(40)).cast("int")
    spans = spans.select("_c", F.col("_f._s").alias("_s"), F.col("_f._q")[steps].alias("_p"))
    large = large.join(spans, F.col("_component") == F.col("_c")).withColumn("_begins", (F.col("_order.s") == F.col("_s")) & (F.col("_order.p") <= F.col("_p")))
    large = checkpointed(large.select("_order", "_id", "_hash", "_component", "_begins"))
    if large.isEmpty():
        return checkpointed(kept), large.select("_order", "_id", "_hash")
    begun = checkpointed(_walk(large.filter("_begins").withColumn("_unit", F.col("_component")), place))
    stay = large.join(begun, F.col("_order") == F.col("_stays"), "left_semi")
    return checkpointed(kept.unionByName(begun)), checkpointed(_without(large.filter("NOT _begins"), stay))


def remove_leaks(df: DataFrame, **columns: str) -> DataFrame:
    return leak_marks(df, **columns).filter("not leaked").drop("leaked")


def _first_in_order(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first n rows in the order of some keys.

    Only keys are ordered, n of them at most in one task; whole rows are then
    filtered by the last one.
    """
    rows = df.withColumn("_k", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    last = rows.select("_k").orderBy("_k").limit(n).agg(F.max("_k").alias("k"), F.count(F.lit(1)).alias("n")).first()
    if last["n"] < n:
        return df
    end = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last["k"], rows.schema["_k"].dataType)])
    below = rows.filter(F.col("_k") < end)
    # Rows that repeat the last keys are alike in this order: as many as are missing.
    ties = rows.filter(F.col("_k").eqNullSafe(end)).limit(n - below.count())
    return below.unionByName(ties).drop("_k")


def limit(df: DataFrame, n: int, mode: str = "head", seed: int = 42, ident: str = "id", pos: str = "pos") -> DataFrame:
    """The first n rows by position, or a seeded sample of n; n of 0 keeps all."""
    if n <= 0:
        return df
    if mode in ("random", "shuffle"):
        return _first_in_order(df, n, hash_order(seed, "limit", ident), F.col(ident))
    return _first_in_order(df, n, F.col(pos))


def subsample(df: DataFrame, n: int = 1000, seed: int = 42, ident: str = "id", pos: str = "pos") -> DataFrame:
    """A seeded sample in the original order."""
    return limit(df, n, "random", seed, ident, pos).orderBy(pos)


def shuffled_head(df: DataFrame, n: int, seed: int = 42, ident: str = "id") -> DataFrame:
    """The hardware cap: the first n rows in shuffled order."""
    return _first_in_order(df, n, hash_order(seed, "shuffle", ident), F.col(ident)) if n else df


def sample_where(df: DataFrame, condition: Column, n: int, seed: int = 52, ident: str = "id") -> DataFrame:
    """A seeded sample of n of the rows that meet a condition, and all the others."""
    rows = df.withColumn("_c", F.coalesce(condition, F.lit(False))).withColumn("_h", hash_order(seed, "plot", ident))
    ranked = hash_ranks(rows, ["_c"], "_h", [ident], "_r")
    return ranked.filter(~F.col("_c") | (F.col("_r") <= n)).drop("_c", "_h", "_r")
