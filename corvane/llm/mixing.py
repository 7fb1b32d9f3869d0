"""Mixing sources to target weights, in DataFrame and SQL functions only.

The documents of a source are dealt by hash into blocks. A source's target
becomes a number of whole passes over its blocks and a rest: blocks in permuted
order up to the one in which the rest ends, of which documents are taken in the
order of a hash as far as they fit, and whatever room then is left is filled
with other documents of the source, the largest that fits first. The blocks
taken of all sources are spread over output shards by a splitting tree: each
node divides its quotas between its halves by exact multivariate-hypergeometric
draws, as if the whole mix had been shuffled and cut. A shard draws its blocks
from the source's permutation and orders the documents by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, cut, digest_long, narrow

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of a block, and the most blocks of a source: both bound what one window or task holds.
BLOCK_ROWS, MOST_BLOCKS = 512, 1 << 16
#: Sources in one array of the tree; more are split in groups of groups.
FAN = 64
#: Rows that are broadcast at most; documents of a piece of a shard, about.
BROADCAST_ROWS, PIECE_ROWS = 500_000, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(stats: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Add ``sid``, ``weight`` and ``target`` to rows (source, source_size), one per source.

    Sources by code point, null last, take the weights in turn. With the
    sources in order of cap over weight, what is left for each, if all before
    it stop at their caps, rises up to the common level and falls after it.
    """
    everything = Window.partitionBy()
    in_order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    rows = stats.withColumn("sid", F.row_number().over(in_order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("sid") % len(weights) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "sid")
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weighing = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - capped) / weighing)
    level = F.max("level").over(everything)
    return rows.withColumn("target", F.least(F.col("cap"), level * F.col("weight")).cast("double")).drop("level", "cap")


def _draw(q: str, population: str, left: str, u: str) -> str:
    """SQL: a hypergeometric draw by inversion over 12 standard deviations around the mode.

    How many of the q marked among the population fall into the left ones.
    """
    return f"""aggregate(array(named_struct('q', CAST({q} AS DOUBLE), 'n', CAST({population} AS DOUBLE), 'l', CAST({left} AS DOUBLE))), 0L, (z, p) ->
      aggregate(array(named_struct('mode', floor((p.q + 1) * (p.l + 1) / (p.n + 2)),
                'half', ceil(12 * sqrt(greatest(0D, p.q * (p.l / greatest(p.n, 1D)) * (1 - p.l / greatest(p.n, 1D)) * (p.n - p.q) / greatest(p.n - 1, 1D)))) + 12)), 0L, (y, c) ->
        aggregate(array(named_struct('a', CAST(greatest(0D, p.q + p.l - p.n, c.mode - c.half) AS BIGINT), 'b', CAST(least(p.q, p.l, c.mode + c.half) AS BIGINT))), 0L, (x, r) ->
          aggregate(array(aggregate(sequence(r.a, r.b), named_struct('w', 1D, 's', 0D),
              (t, k) -> named_struct('w', t.w * (p.q - k) * (p.l - k) / ((k + 1) * (p.n - p.q - p.l + k + 1)), 's', t.s + t.w), t -> t.s)), 0L, (v, total) ->
            aggregate(sequence(r.a, r.b), named_struct('w', 1D, 's', 0D, 'k', r.a),
              (t, k) -> named_struct('w', t.w * (p.q - k) * (p.l - k) / ((k + 1) * (p.n - p.q - p.l + k + 1)), 's', t.s + t.w,
                                     'k', if(t.s + t.w <= {u} * total, least(k + 1, r.b), t.k)), t -> t.k)))))"""


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """The splitting tree: one row (sid, quota) per source becomes rows (sid, shard, quota).

    Totals of the shards differ by one at most per level; quotas stay exact.
    Sources are numbered from 0. A node draws for groups of sources, then for
    the sources of each group with what the group has drawn, so that an array
    holds FAN entries however many sources there are.
    """
    nodes = quotas.selectExpr("0 AS first", f"{shards} AS width", "sid", "quota")
    most, depth, widest = quotas.agg(F.max("sid")).first()[0] or 0, 1, shards
    while FAN**depth <= most:
        depth += 1
    half, at = "(width div 2)", ["first", "width"]
    while widest > 1:
        split = nodes.filter("width > 1")
        left = split.groupBy(*at).agg(F.sum("quota").alias("n")).selectExpr(*at, "0L AS parent", "n", f"CAST(floor(n * {half} / width) AS BIGINT) AS l")
        for j in reversed(range(depth)):
            of = split.selectExpr(*at, f"sid div {FAN**j} AS g", "quota").groupBy(*at, "g").agg(F.sum("quota").alias("q"))
            of = of.groupBy(*at, F.expr(f"g div {FAN}").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("g", "q"))).alias("of"))
            u = f"(pmod(xxhash64({seed}, first, width, {j}, s.g), 9007199254740992L) / 9007199254740992D)"
            fold = f"""aggregate(of, named_struct('n', n, 'l', l, 'x', CAST(array() AS ARRAY<BIGINT>)),
                (a, s) -> aggregate(array({_draw("s.q", "a.n", "a.l", u)}), a, (o, d) -> named_struct('n', o.n - s.q, 'l', o.l - d, 'x', concat(o.x, array(d)))), a -> a.x)"""
            drawn = of.join(left, [*at, "parent"]).selectExpr(*at, "of", f"{fold} AS d")
            drawn = drawn.selectExpr(*at, "explode(zip_with(of, d, (s, k) -> named_struct('g', s.g, 'q', s.q, 'd', k))) AS z")
            left = drawn.selectExpr(*at, "z.g AS parent", "z.q AS n", "z.d AS l")
        halves = left.selectExpr("first", "width", "parent AS sid", "n", "l")
        low = halves.selectExpr("first", f"{half} AS width", "sid", "l AS quota")
        high = halves.selectExpr(f"first + {half} AS first", f"width - {half} AS width", "sid", "n - l AS quota")
        nodes = cut(nodes.filter("width = 1").unionByName(low).unionByName(high), "tree")
        widest = (widest + 1) // 2
    return nodes.selectExpr("sid", "first AS shard", "quota")


def _fill(units: DataFrame, gaps: DataFrame) -> DataFrame:
    """Units (sid, block, h, words) that fill the gaps of their sources, the largest that fits first: (sid, block, h).

    Greedy by size needs no more of the units than how many there are of each
    size. Which ones of a size are taken goes by block and hash.
    """
    fit = units.join(gaps, "sid").filter("words > 0 AND words <= gap")
    sizes = fit.groupBy("sid", "gap", "words").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("sid", "gap").agg(F.sort_array(F.collect_list(F.struct("words", "n")), asc=False).alias("sizes"))
    take = sizes.selectExpr("sid", """explode(aggregate(sizes, named_struct('gap', gap, 'got', CAST(array() AS ARRAY<STRUCT<words: BIGINT, wanted: BIGINT>>)),
        (a, x) -> if(a.gap >= x.words, named_struct('gap', a.gap - least(x.n, a.gap div x.words) * x.words, 'got', concat(a.got, array(named_struct('words', x.words, 'wanted', least(x.n, a.gap div x.words))))), a), a -> a.got)) AS t""")
    take = cut(take.selectExpr("sid", "t.words AS words", "t.wanted AS wanted"), "fill")
    wanted = units.join(take, ["sid", "words"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sid", "words").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = wanted.groupBy("sid", "words", "wanted", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("open", F.col("wanted") - before)
    blocks = cut(blocks.filter("open > 0").select("sid", "words", "block", "open"), "fill_blocks")
    rank = F.row_number().over(Window.partitionBy("sid", "words", "block").orderBy("h"))
    return units.join(blocks, ["sid", "words", "block"]).withColumn("rank", rank).filter("rank <= open").select("sid", "block", "h")


class _Plan:
    """What decides the copies of a document: its source, its block, and the hash of its id and text."""

    def __init__(self, sized: DataFrame, share: float, most: float, weights: tuple, shards: int, seed: int) -> None:
        self.seed, self.shards = seed, shards
        stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
        stats = source_targets(stats, share, most, weights)
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        stats = stats.withColumn("passes", F.least(passes, F.lit(int(most))).cast("long")).withColumn("most", F.lit(int(most)))
        stats = stats.withColumn("rest", F.greatest(F.floor(F.col("target") - F.col("passes") * F.col("source_size")), F.lit(0)).cast("long"))
        stats = stats.withColumn("blocks", F.least(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(MOST_BLOCKS)).cast("long"))
        self.sources, self.n_sources = counted(stats.withColumnRenamed("source", "_source"), "sources")

        keyed = self.keyed(sized)
        per_block = keyed.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"), F.first("most").alias("most"))
        permuted = Window.partitionBy("sid").orderBy(digest_long("sid", "block", seed=seed + 2), "block").rowsBetween(Window.unboundedPreceding, 0)
        per_block = per_block.withColumn("until", F.sum("words").over(permuted)).withColumn("room", F.col("rest") - (F.col("until") - F.col("words")))
        whole, ending = F.col("until") <= F.col("rest"), (F.col("room") > 0) & (F.col("until") > F.col("rest"))
        per_block = cut(per_block.select("sid", "block", "passes", "most", "room", whole.alias("whole"), ending.alias("ending")), "blocks")

        # Of the block in which the rest ends, units in order as far as they fit; then the gap.
        units = keyed.groupBy("sid", "block", "h").agg(F.sum("size").alias("words"))
        last = units.join(per_block.filter("ending").select("sid", "block", "room"), ["sid", "block"])
        in_order = Window.partitionBy("sid").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
        last = cut(last.withColumn("until", F.sum("words").over(in_order)).withColumn("fits", F.col("until") <= F.col("room")), "last")
        gaps = last.groupBy("sid").agg((F.first("room") - F.coalesce(F.max(F.when(F.col("fits"), F.col("until"))), F.lit(0))).alias("gap")).filter("gap > 0")
        fits = last.filter("fits").select("sid", "block", "h")
        others = units.join(per_block.filter("NOT whole").select("sid", "block"), ["sid", "block"]).join(fits, ["sid", "block", "h"], "left_anti")
        extra = fits.unionByName(_fill(others, cut(gaps, "gaps")))
        self.extra, self.n_extra = counted(extra, "extra")

        # Which shard gets which pass over which block.
        partly = self.extra.select("sid", "block").distinct().withColumn("partly", F.lit(True))
        instances = per_block.join(partly, ["sid", "block"], "left").withColumn("taken", _copies(F.col("whole") | F.coalesce("partly", F.lit(False)))).filter("taken > 0")
        instances = cut(instances.select("sid", "block", F.explode(F.sequence(F.lit(1), "taken")).alias("copy")), "instances")
        quotas = split_quotas(cut(instances.groupBy("sid").agg(F.count(F.lit(1)).alias("quota")), "quotas"), shards, seed)
        bounds = quotas.withColumn("upto", F.sum("quota").over(Window.partitionBy("sid").orderBy("shard"))).groupBy("sid").agg(F.sort_array(F.collect_list("upto")).alias("bounds"))
        drawn = Window.partitionBy("sid").orderBy(digest_long("sid", "block", "copy", seed=seed + 3), "block", "copy")
        instances = instances.withColumn("rank", F.row_number().over(drawn)).join(bounds, "sid")
        instances = instances.selectExpr("sid", "block", "copy", "size(filter(bounds, b -> b < rank)) AS shard")
        spread = instances.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("spread"))
        blocks = per_block.join(spread, ["sid", "block"], "left").selectExpr("sid", "block", "whole", "transform(coalesce(spread, array()), x -> x.shard) AS spread")
        self.blocks, self.n_blocks = counted(blocks, "spread")

    def keyed(self, rows: DataFrame) -> DataFrame:
        """Rows (source, h, ...) with what is known of their source, and their block."""
        rows = rows.join(_small(self.sources, self.n_sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return rows.withColumn("block", F.pmod(digest_long("h", seed=self.seed + 1), F.col("blocks")))

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows (source, h, ...) with copies and, for each copy, its shard."""
        rows = self.keyed(rows).join(_small(self.blocks, self.n_blocks), ["sid", "block"])
        extra = self.extra.select("sid", "h").withColumn("extra", F.lit(True))
        rows = rows.join(_small(extra, self.n_extra), ["sid", "h"], "left")
        rows = rows.withColumn("copies", _copies(F.col("whole") | F.coalesce("extra", F.lit(False))))
        return rows.withColumn("shards", F.expr("slice(spread, 1, copies)"))


def _small(rows: DataFrame, n: int) -> DataFrame:
    """Broadcast if the rows, whose number is known, are few; else the join shuffles."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _copies(extra: Column) -> Column:
    """Passes, and one more; a document without words is no exception to the most that there may be."""
    return F.least(F.col("passes") + F.when(extra, 1).otherwise(0), F.col("most")).cast("int")


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _hash(ident: Column, text: Column, seed: int) -> Column:
    """Tells documents apart by id and text; rows that repeat both are one unit."""
    return digest_long(ident.cast("long"), F.coalesce(text.cast("string"), F.lit("")), seed=seed + 4)


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = narrow(docs, doc_id=id_col, source=source_col, text=text_col)
    return cut(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size"), _hash(F.col("doc_id"), F.col("text"), seed).alias("h")), "sized")


def mix_plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, shards.

    A size is the number of words (null: 0). ``taken`` is size times copies, a
    copy being the whole document; ``shards`` names the output shard of each
    copy. The taken words of a source end below its target by less than its
    smallest document that isn't taken once more. Which documents the rest gets
    depends on hashes of their ids and texts, so reruns agree; rows that repeat
    an id and its text are taken alike, as one unit of their summed size, rows
    that repeat an id only are documents of their own. Null sources are one
    source, null ids are allowed, an empty table gives no rows and other
    columns are ignored. One row for each source goes through one task.
    """
    sized = _sized(docs, seed, id_col, text_col, source_col)
    rows = _Plan(sized, share, most, weights, shards, seed).placed(sized)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "shards")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, in_shards: bool = False, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, shards: int = 16) -> DataFrame:
    """The mix itself: every document once per copy, with all its columns; with in_shards, also ``shard``.

    Rows are dealt by shard and locally shuffled, ready to be written; a shard
    is dealt into pieces of about PIECE_ROWS. Copies are those of mix_plan,
    for nulls, repeats and empty tables too.
    """
    sized = _sized(docs, seed, id_col, text_col, source_col)
    plan = _Plan(sized, share, most, weights, shards, seed)
    names = docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    ident, text, source = (F.col(f"_{names.index(c)}") for c in (id_col, text_col, source_col))
    rows = plan.placed(flat.withColumn("source", source.cast("string")).withColumn("h", _hash(ident, text, seed)))
    rows = rows.withColumn("_shard", F.explode("shards")).withColumn("_order", digest_long("h", "_shard", seed=seed + 5))
    pieces = sized.count() // (shards * PIECE_ROWS) + 1
    rows = rows.repartition(shards * pieces, "_shard", F.pmod("_order", F.lit(pieces))).sortWithinPartitions("_shard", "_order")
    kept = [F.col(f"_{i}").alias(name) for i, name in enumerate(names)]
    return rows.select(*kept, F.col("_shard").alias("shard")) if in_shards else rows.select(*kept)
