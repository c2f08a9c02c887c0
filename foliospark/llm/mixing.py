"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sources, by code point with null last, weigh 3, 1, 2, repeating; together they get 150 % of all words.
   No target exceeds twice its source's words; the excess is shared again by weight (closed form: with
   sources sorted by words / weight, the first ones are at their limit).
2. All blocks of `BLOCK` words are apportioned to sources by the highest quotients target / (2k + 1), and a
   source's blocks to its shards in the same way. Only the few seats around the exact share can change
   hands, so only those quotients are ranked.
3. A shard's documents stand one after another in a seeded order, and blocks are cut from that row of words.
   A shard's quota takes whole passes over its blocks, and then blocks in a seeded order. A document's
   `taken` is the number of its words that lie in taken blocks, repeats counted.

Null texts have size 0. Rows with equal ids, or without one, stay apart; equal rows may swap places, which changes
nothing. A null source is a source of its own, after all others.
A shard has about `SHARD` words, more only where a source would have over `SHARDS` shards, and no window holds
more than one shard's documents, whatever a source's share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import NON_SPACE, row_key, stored

BLOCK, SHARD, SHARDS, SEED = 256, 1 << 18, 1 << 16, 20

# Weights of the sources in order, and the share of all words that the mix has.
WEIGHTS, SHARE = (3, 1, 2), 1.5


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", more: list[str] = ()) -> DataFrame:
    """doc_id, source, size, and a hash of the text that tells rows without an id apart; `more` columns come along."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(NON_SPACE)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("t"), *more)


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row a source. The windows hold sources only."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # code point order is the order of UTF-8 bytes, which Spark's string order is
    w = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, whole = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumns({
        "before": F.coalesce(F.sum("source_size").over(upto), F.lit(0)),
        "weight_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
        "all": F.sum("source_size").over(whole),
        "rank": F.row_number().over(by_limit),
    })
    # what the sources from here on get for each unit of weight, if all before are at their limit (times 2)
    w = w.withColumn("twice_rest", 3 * F.col("all") - 4 * F.col("before"))
    w = w.withColumn("limited", F.col("twice_rest") * F.col("weight") >= 4 * F.col("source_size") * F.col("weight_left"))
    first = F.min(F.when(~F.col("limited"), F.struct("rank", "twice_rest", "weight_left"))).over(whole)
    w = w.withColumn("first", first)
    own = F.col("weight") * F.col("first.twice_rest") / (2 * F.col("first.weight_left"))
    target = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), 2.0 * F.col("source_size")).otherwise(own)
    return w.select("source", "source_size", target.cast("double").alias("target"))


def apportion(df: DataFrame, group: list[str], key: list[str], share: str, seats: str) -> DataFrame:
    """Add `quota`: seats of each group dealt to its rows by the highest quotients share / (2k + 1).

    With v = seats * share / sum, the divisor's change is at most rows / seats, so a row's seats stay within
    v * rows / seats + 2 of v: below that they are certain, and only the others are ranked.
    """
    g, nulls = Window.partitionBy(*group), F.lit(0)
    d = df.withColumns({"_sum": F.sum(share).over(g), "_rows": F.count("*").over(g)})
    d = d.withColumn("_v", F.when(F.col("_sum") > 0, F.col(seats) * F.col(share) / F.col("_sum")).otherwise(0.0))
    slack = F.when(F.col("_sum") > 0, F.col("_rows") * F.col(share) / F.col("_sum")).otherwise(0.0) + 2
    d = d.withColumns({"_low": F.greatest(nulls, F.floor(F.col("_v") - slack)).cast("long"), "_high": F.ceil(F.col("_v") + slack).cast("long")})
    d = d.withColumn("_open", F.col(seats) - F.sum("_low").over(g))
    ranked = d.where(f"{share} > 0").withColumn("_k", F.explode(F.sequence("_low", "_high")))
    best = Window.partitionBy(*group).orderBy((F.col(share) / (2 * F.col("_k") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], "_k")
    name = lambda k: F.struct(F.col(k).isNull(), F.coalesce(F.col(k).cast("string"), F.lit("")))
    won = ranked.withColumn("_rank", F.row_number().over(best)).where("_rank <= _open").groupBy(*[name(k).alias(f"_{k}") for k in [*group, *key]]).agg(F.count("*").alias("_won"))
    return d.join(won, [name(k) == F.col(f"_{k}") for k in [*group, *key]], "left").withColumn("quota", F.col("_low") + F.coalesce("_won", nulls)).select(*df.columns, "quota")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: a row for each row of docs."""
    return _mix(sizes(docs, id_col, text_col, source_col)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs from which the mix takes words, with all columns and size, source_size, target, taken after them.

    `taken` over `size` is the weight of a row in the mix. Columns of docs with one of these four names are replaced.
    """
    keyed = docs.withColumns(row_key(docs))
    key = ["_row_a", "_row_b"]
    found = _mix(sizes(keyed, id_col, text_col, source_col, key)).where("taken > 0").select(*key, "size", "source_size", "target", "taken")
    names = [f"`{c}`" for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    # equal rows are one row here and as many as they were after the join
    return keyed.select(*names, *key).dropDuplicates(key).join(found, key).select(*names, "size", "source_size", "target", "taken")


def _mix(narrow: DataFrame) -> DataFrame:
    own = stored(narrow)
    goal = stored(targets(own.groupBy("source").agg(F.sum("size").alias("source_size"))))
    total = goal.agg(F.sum("target")).first()[0] or 0.0
    seats = goal.withColumns({"_all": F.lit(1), "_seats": F.lit(round(total / BLOCK)).cast("long")})
    per_source = stored(apportion(seats, ["_all"], ["source"], "target", "_seats").select("source", "source_size", "target", F.col("quota").alias("blocks"), F.greatest(F.lit(1), F.least(F.lit(SHARDS), F.ceil(F.col("source_size") / SHARD))).cast("int").alias("shards")))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    d = own.join(per_source, same(own, per_source)).select(own["*"], "source_size", "target", "blocks", F.pmod(F.xxhash64("doc_id", "t", F.lit(SEED)), "shards").cast("int").alias("shard"))
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", "t", F.lit(SEED + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = stored(d.withColumn("stop", F.sum("size").over(line)))
    shards = d.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    shards = apportion(shards, ["source"], ["shard"], "words", "blocks").withColumn("n", F.greatest(F.lit(1), F.round(F.col("words") / BLOCK)).cast("long"))
    # n equal blocks in a shard: block b ends at word floor((b + 1) * words / n)
    shards = shards.withColumn("quota", F.least(F.col("quota"), 2 * F.col("n"))).where("words > 0")
    blocks = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    seeded = Window.partitionBy("source", "shard").orderBy(F.xxhash64("source", "shard", "block", F.lit(SEED + 2)), "block")
    blocks = blocks.withColumn("copies", F.expr("quota div n") + (F.row_number().over(seeded) <= F.col("quota") % F.col("n")).cast("long"))
    # words taken from the shard's start up to each block's start
    upto = Window.partitionBy("source", "shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"start": F.expr("block * words div n"), "end": F.expr("(block + 1) * words div n")})
    blocks = blocks.withColumn("before", F.coalesce(F.sum((F.col("end") - F.col("start")) * F.col("copies")).over(upto), F.lit(0)))
    # a merge join: before the explode this table is small, and would be taken for small after it
    blocks = blocks.hint("merge").select(F.col("source").alias("bs"), F.col("shard").alias("bh"), "block", "start", "copies", "before")
    sized = shards.select(F.col("source").alias("ss"), F.col("shard").alias("sh"), "words", "n")
    d = d.join(sized, d["source"].eqNullSafe(sized["ss"]) & (d["shard"] == sized["sh"]), "left")
    # each document needs the blocks at its two ends only: taken up to its stop, less taken up to its start
    of = lambda x: F.least(F.expr(f"({x} * n) div words"), F.col("n") - 1)
    d = d.withColumn("begin", F.col("stop") - F.col("size")).withColumns({"b0": of("begin"), "b1": of("stop")})
    for b, x, to in (("b0", "begin", "t0"), ("b1", "stop", "t1")):
        d = d.join(blocks, d["source"].eqNullSafe(blocks["bs"]) & (d["shard"] == blocks["bh"]) & (d[b] == blocks["block"]), "left")
        d = d.withColumn(to, F.col("before") + (F.col(x) - F.col("start")) * F.col("copies")).drop("bs", "bh", "block", "start", "copies", "before")
    return d.withColumn("taken", F.when(F.col("size") > 0, F.col("t1") - F.col("t0")).otherwise(0).cast("long"))
