"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, stash

#: Documents of a source's block, over which they are dealt by hash; more only where a source would have over MOST_BLOCKS.
BLOCK, MOST_BLOCKS = 256, 1 << 16
#: Sources up to which what is known of each is broadcast: some 100 bytes for each.
FEW_SOURCES = 100_000
#: Output shards, a power of two.
SHARDS = 16
#: A source's words are taken at most so many times.
MOST = 3
WEIGHTS = (1, 2, 3)


def targets(docs: DataFrame) -> DataFrame:
    """source key, size and target of each source: weights by code point of the name, null last, filled up to MOST times the size.

    The level L at which targets are least(MOST * size, weight * L) is found by going through the sources in
    order of the level at which each is full. One row for each source passes through one task, never documents.
    """
    sized = docs.groupBy("_sk").agg(F.sum("_size").alias("_source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy(F.col("_sk").asc())) - 1) % len(WEIGHTS) + 1).cast("int"))
    w = sized.withColumn("_w", weight).withColumn("_full", F.col("_source_size") * MOST)
    by_level = Window.orderBy(F.col("_full") / F.col("_w"), "_sk")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.select(
        "*",
        F.row_number().over(by_level).alias("_at"),
        (F.sum("_source_size").over(everything) - F.coalesce(F.sum("_full").over(before), F.lit(0))).alias("_left"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_w_left"),
    ).withColumn("_level", F.col("_left") / F.col("_w_left"))
    open_ = F.when(F.col("_level") <= F.col("_full") / F.col("_w"), F.struct("_at", "_level"))
    w = w.withColumn("_level", F.min(open_).over(everything)["_level"])
    return w.select("_sk", "_source_size", F.least(F.col("_full").cast("double"), F.col("_w") * F.col("_level")).alias("_target"))


def _hypergeometric(white: Column, total: Column, draws: Column, *names: Column) -> Column:
    """White balls among draws without replacement, exactly distributed; the same for the same names.

    The largest of log-probability plus Gumbel noise over the possible counts is a draw from the distribution.
    The counts run over 12 standard deviations to both sides, beyond which less than 1e-30 is left.
    """
    mean = draws * white / total
    spread = 12 * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - white / total) * (total - draws) / F.greatest(total - 1, F.lit(1)))) + 12
    least = F.greatest(F.lit(0).cast("bigint"), draws + white - total, F.floor(mean - spread))
    most = F.greatest(least, F.least(white, draws, F.ceil(mean + spread)))

    def noise(k: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(*names, k), 12) + 0.5) / float(1 << 52)
        return -F.log(-F.log(u))

    def step(acc: Column, k: Column) -> Column:
        score = acc["log"] + noise(k)
        odds = ((white - k) * (draws - k)).cast("double") / ((k + 1) * (total - white - draws + k + 1)).cast("double")
        return F.struct(
            F.when(odds > 0, acc["log"] + F.log(odds)).otherwise(acc["log"]).alias("log"),
            F.greatest(acc["best"], score).alias("best"),
            F.when(score > acc["best"], k).otherwise(acc["k"]).alias("k"),
        )

    start = F.struct(F.lit(0.0).alias("log"), F.lit(float("-inf")).alias("best"), least.alias("k"))
    return F.when(total > 0, F.aggregate(F.sequence(least, most), start, step, lambda acc: acc["k"])).otherwise(F.lit(0).cast("bigint"))


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """_sk, shard, quota: the block quotas (_sk, _quota) of all sources parted exactly among shards.

    Each node of the tree halves its draws at random, as if its blocks were shuffled and cut in two. A node's
    row holds one number for each source.
    """
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("_sk", F.col("_quota").cast("bigint").alias("q")))).alias("all")).withColumn("node", F.lit(1))
    empty = F.array().cast("array<bigint>")
    level = 1
    while level < shards:
        total = F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + x["q"])
        node = node.withColumn("total", total).withColumn("half", F.floor((F.col("total") + F.col("node") % 2) / 2))

        def one(acc: Column, x: Column) -> Column:
            drawn = _hypergeometric(x["q"], acc["total"], acc["draws"], F.lit(seed), F.col("node"), x["_sk"])
            # Bound once: a fold's step would otherwise repeat the draw for each field that uses it.
            bound = F.transform(F.array(drawn), lambda h: F.struct((acc["total"] - x["q"]).alias("total"), (acc["draws"] - h).alias("draws"), F.concat(acc["out"], F.array(h)).alias("out")))
            return bound[0]

        start = F.struct(F.col("total").alias("total"), F.col("half").alias("draws"), empty.alias("out"))
        node = node.withColumn("left", F.aggregate("all", start, one, lambda acc: acc["out"]))
        node = node.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        part = F.zip_with("all", "left", lambda x, h: F.struct(x["_sk"].alias("_sk"), F.when(F.col("side") == 0, h).otherwise(x["q"] - h).alias("q")))
        node = node.select(part.alias("all"), (F.col("node") * 2 + F.col("side")).alias("node"))
        level *= 2
    return node.select((F.col("node") - shards).alias("shard"), F.explode("all").alias("x")).select(F.col("x._sk").alias("_sk"), "shard", F.col("x.q").alias("quota"))


def _sized(docs: DataFrame, carry: list[str], seed: int) -> DataFrame:
    """The rows' keys and sizes, written once: no text is read again, or dealt out, to plan the mixture."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    source = F.col("source").cast("string")
    key = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
    rows = docs.select(*_row_key(), F.struct(*carry).alias("row"), F.col("doc_id").cast("string").alias("_id"), size.alias("_size"), key.alias("_sk"))
    return stash(rows.withColumn("_hash", F.xxhash64(F.lit(seed), F.col("_id"), F.col("_size"))), "sizes")


def _row_key() -> list[Column]:
    """A row's doc_id, and its text and source by hash: rows alike in these are interchangeable."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k1"), F.xxhash64(F.col("text").cast("string"), F.col("source").cast("string")).alias("k2")]


def _plan(docs: DataFrame, carry: list[str], seed: int, shards: int, block_size: int) -> DataFrame:
    rows = _sized(docs, carry, seed)
    sources = stash(rows.groupBy("_sk").agg(F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.count(F.lit(1)) / block_size))).cast("int").alias("_blocks")), "sources")
    few = sources.count() <= FEW_SOURCES
    sized = rows.join(F.broadcast(sources) if few else sources, "_sk")
    sized = sized.withColumn("_block", F.pmod(F.col("_hash"), F.col("_blocks")).cast("int")).drop("_blocks")
    words = sized.groupBy("_sk", "_block").agg(F.sum("_size").alias("_words"))
    goal = targets(words.withColumnRenamed("_words", "_size"))
    goal = goal.withColumn("_goal", F.round("_target").cast("bigint"))
    passes = F.when(F.col("_source_size") > 0, F.floor(F.col("_goal") / F.col("_source_size"))).otherwise(F.lit(0)).cast("bigint")
    goal = goal.withColumn("_passes", passes).withColumn("_rest", F.col("_goal") - F.col("_passes") * F.col("_source_size"))
    permuted = Window.partitionBy("_sk").orderBy(F.xxhash64(F.lit(seed), F.lit("pass"), F.col("_passes"), F.col("_block")), "_block")
    begin = F.coalesce(F.sum("_words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = words.join(goal, "_sk").withColumn("_begin", begin)
    block = block.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_rest") - F.col("_begin"))))
    # One row for each draw of a block: whole passes, then the last one.
    drawn = block.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_passes"))))
    drawn = drawn.where(((F.col("_pass") < F.col("_passes")) | (F.col("_part") > 0)) & (F.col("_words") > 0))
    in_turn = Window.partitionBy("_sk").orderBy("_pass", F.xxhash64(F.lit(seed), F.lit("pass"), F.col("_pass"), F.col("_block")), "_block")
    drawn = drawn.withColumn("_turn", F.row_number().over(in_turn))
    quota = split_quotas(drawn.groupBy("_sk").agg(F.count(F.lit(1)).alias("_quota")), shards, seed)
    ends = quota.withColumn("_end", F.sum("quota").over(Window.partitionBy("_sk").orderBy("shard")))
    ends = ends.groupBy("_sk").agg(F.sort_array(F.collect_list("_end")).alias("_ends"))
    shard = F.size(F.filter("_ends", lambda e: e < F.col("_turn")))
    shards_of = drawn.join(ends, "_sk").groupBy("_sk", "_block").agg(F.sort_array(F.collect_list(F.struct("_pass", shard.alias("_shard")))).alias("_turns"))
    block = block.join(shards_of, ["_sk", "_block"], "left").select("_sk", "_block", "_source_size", "_target", "_passes", "_part", "_turns")
    # Long documents first: what overlaps the end of the last block's part is then one of its shorter ones.
    within = Window.partitionBy("_sk", "_block").orderBy(F.col("_size").desc(), "_hash", "_id").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.join(block, ["_sk", "_block"]).withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    # Whole documents: the one that overlaps is taken if that comes nearer to the part.
    last = 2 * F.col("_before") + F.col("_size") <= 2 * F.col("_part")
    taken = F.col("_size") * (F.col("_passes") + last.cast("bigint"))
    draws = F.transform("_turns", lambda t: F.struct(t["_pass"].alias("copy"), t["_shard"].alias("shard")))
    draws = F.filter(F.coalesce(draws, F.array().cast("array<struct<copy:bigint,shard:int>>")), lambda d: (F.col("_size") > 0) & ((d["copy"] < F.col("_passes")) | last))
    return out.select("k1", "k2", "row", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), draws.alias("draws"))


def mix(docs: DataFrame, carry: list[str], seed: int = 0, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """row (struct of the columns to carry along), size, source_size, target, taken (words, repeats counted) and draws.

    draws is an array of copy and shard for each row of docs.

    A source's documents are dealt over blocks by hash, of about block documents; its target is drawn as whole passes
    over the blocks and then blocks in an order permuted for each pass, the last of them in part. Documents are taken
    whole, so that a source's words differ from its target by up to half of one document, a short one of that block.
    Which shard gets which draws is settled by split_quotas. All sorts are within a source's blocks or one block.

    A null text has size 0 and is never drawn; null sources are one source, the last; repeated rows are documents of
    their own. Other columns only go along. An empty table, or one without words, gives draws for no row.
    """
    return _plan(docs, carry, seed, shards, block).drop("k1", "k2")


def materialise(docs: DataFrame, seed: int = 0, shards: int = SHARDS, block: int = BLOCK, shard_column: str | None = None) -> DataFrame:
    """The mixture itself: docs' rows, whole, once for each draw, in a random order within each shard.

    Nulls, repeated rows and empty tables as in mix(); docs' columns stay as they are, whatever their names.
    """
    alike = Window.partitionBy("k1", "k2").orderBy(F.lit(0))
    drawn = _plan(docs, ["doc_id"], seed, shards, block).where(F.size("draws") > 0).select("k1", "k2", "draws")
    drawn = drawn.withColumn("nth", F.row_number().over(alike))
    # The whole row is one column, so that no column of docs meets another of its name.
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_row_key()).withColumn("nth", F.row_number().over(alike))
    met = rows.join(drawn, ["k1", "k2", "nth"]).select("row", "k1", "k2", "nth", F.explode("draws").alias("draw"))
    order = F.xxhash64(F.lit(seed), F.lit("order"), F.col("k1"), F.col("k2"), F.col("nth"), F.col("draw.copy"))
    placed = met.select("row", F.col("draw.shard").alias("shard"), order.alias("order"))
    return placed.repartition("shard", "order").sortWithinPartitions("shard", "order").select("row.*", *([F.col("shard").alias(shard_column)] if shard_column else []))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (of each draw) of every document, by mix() with its defaults."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix(docs, ["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))
