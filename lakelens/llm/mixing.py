"""Mixing sources to target weights by Sainte-Lague apportionment.

All built from DataFrame expressions.  Sources in code point order, null last,
weigh 3, 1, 2 in turn.  They share ``percent`` of all words by weight; a target
stops at ``repeats`` times its source's size and the excess is shared anew, which
has a closed form over sources ordered by size against weight.

The mix is drawn in blocks of equally many words.  Sainte-Lague's quotients
target / (2 * seats + 1) give each source an integer number of blocks, and again,
with a source's sizes per shard as votes, each shard of a source its quota.  Only
quotients near the last seat need comparing, so the candidates are a few times
the parties, not the seats, and blocks may be as small as the data ask for: at most
1 / ``grain`` of the smallest target and, within a source, of its mean shard.  So
rounding a quota to blocks, and stopping it at ``repeats`` times its stream, costs a
source less than 2 / ``grain`` of its target at any ratio of sources and shards.

The tables of sources are ordered as a whole: a row of a few numbers a source.

Within a shard of a source, documents stand in seeded order as one stream of
words.  A quota of one or more times the stream takes it whole that often; the
rest is a run of blocks around the stream, taken as a ring, from a seeded start.
A document's words in the chosen blocks are what the mix takes of it.

Defined cases: a null text has no words; documents without words take none; a
null source is a source of its own, last in order; sources without words have a
target of 0; rows that repeat are documents of their own; an empty table gives
an empty result.  Only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.common import Scratch, fresh


@dataclass(frozen=True)
class Params:
    """weights: of the sources in turn; percent: of all words that the mix has; repeats:
    times a document may be taken; blocks: the mix is divided into so many at least;
    shard_rows: documents a shard of a source should hold; grain: blocks in the smallest
    target and in a source's mean shard, at least; seed: of all choices."""

    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    repeats: int = 2
    blocks: int = 65536
    shard_rows: int = 2000
    grain: int = 256
    seed: int = 17


_WORD = r"[^\x20\x09-\x0D]+"


def _apportion(parties: DataFrame, by: list[str], votes: Column, seats: Column, keys: list[str]) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` (equal within ``by``) by highest quotients.

    For the divisor that fills the seats, votes / divisor and the fair share differ by
    a factor of at most 1 +- parties / (2 * seats).  Seats surely won are given at once
    and only those in between compete.
    """
    whole = Window.partitionBy(*by)
    p = parties.withColumn("_v", votes.cast("double")).withColumn("_k", seats.cast("double"))
    p = p.withColumn("_sum", F.sum("_v").over(whole)).withColumn("_n", F.sum(F.when(F.col("_v") > 0, 1).otherwise(0)).over(whole))
    fair = F.when(F.col("_sum") > 0, F.col("_v") * F.col("_k") / F.col("_sum")).otherwise(F.lit(0.0))
    slack = F.when(F.col("_k") > 0, F.col("_n") / (2 * F.col("_k"))).otherwise(F.lit(0.0))
    p = p.withColumn("_lo", F.greatest(F.lit(0), F.floor(fair * (1 - slack) - 1)).cast("long"))
    p = p.withColumn("_hi", F.when(F.col("_v") > 0, F.ceil(fair * (1 + slack) + 1)).otherwise(F.col("_lo")).cast("long"))
    p = p.withColumn("_left", F.col("_k").cast("long") - F.sum("_lo").over(whole))
    seat = p.where("_hi > _lo").withColumn("_s", F.explode(F.expr("sequence(_lo, _hi - 1)")))
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("_v") / (2 * F.col("_s") + 1)), *keys)
    won = seat.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_left"))
    won = won.groupBy(*dict.fromkeys([*by, *keys])).agg(F.count("*").alias("_won"))
    out = p.join(won, list(dict.fromkeys([*by, *keys])), "left")
    out = out.withColumn("quota", F.col("_lo") + F.coalesce("_won", F.lit(0)))
    return out.drop("_v", "_k", "_sum", "_n", "_lo", "_hi", "_left", "_won")


def mix(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``."""
    p = params
    scratch = Scratch(spark, "mixing")
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").isNull().alias("no_source"),
        name.alias("source"),
        F.xxhash64("doc_id", "text", F.lit(p.seed)).alias("draw"),
    )
    sized = scratch.keep(sized, "sized")
    # a row a source
    sources = scratch.keep(
        sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "sources"
    )
    every = Window.partitionBy(F.lit(1))
    turn = F.row_number().over(every.orderBy("no_source", "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (F.pmod(turn, F.lit(len(p.weights))) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * p.repeats).cast("double"))
    s = s.withColumn("total", F.sum("source_size").over(every) * (p.percent / 100))
    # sources reach their caps in the order of cap / weight: before one does, those so far
    # stand at their caps and the rest share what is left by weight.  That level rises as
    # long as sources are capped and falls after, so the settled one is the highest
    rising = every.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    so_far = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0)))
                     / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("target", F.least("cap", F.max("level").over(every) * F.col("weight")))
    mixed = F.ceil(F.sum("target").over(every))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    s = s.withColumn("block", F.greatest(F.lit(1), F.floor(F.least(mixed / p.blocks, least / p.grain))).cast("long"))
    s = s.withColumn("seats", F.round(F.sum("target").over(every) / F.col("block")).cast("long"))
    s = s.withColumn("one", F.lit(1))
    s = _apportion(s, ["one"], F.col("target"), F.col("seats"), ["no_source", "source"]).withColumnRenamed("quota", "blocks")
    s = s.withColumn("shards", F.ceil(F.col("docs") / p.shard_rows).cast("int"))
    # within a source a block is at most 1 / grain of its mean shard
    fine = F.greatest(F.lit(1), F.least("block", F.floor(F.col("source_size") / F.col("shards") / p.grain))).cast("long")
    s = s.withColumn("fine", fine).withColumn("blocks", F.round(F.col("blocks") * F.col("block") / F.col("fine")).cast("long"))
    s = s.drop("block").withColumnRenamed("fine", "block")
    s = scratch.keep(s.select("no_source", "source", "source_size", "target", "block", "blocks", "shards"), "targets")
    key = ["no_source", "source"]
    placed = sized.join(s, key).withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("shards")).cast("int"))
    placed = scratch.keep(placed.drop("shards"), "placed")
    # a row a shard of a source
    streams = placed.groupBy(*key, "shard").agg(
        F.sum("size").alias("words"), F.first("block").alias("block"), F.first("blocks").alias("blocks")
    )
    streams = _apportion(streams, key, F.col("words"), F.col("blocks"), ["shard"])
    words = F.least(F.col("quota") * F.col("block"), F.col("words") * p.repeats)
    whole = F.when(F.col("words") > 0, F.floor(words / F.col("words"))).otherwise(0).cast("long")
    streams = (
        streams.withColumn("whole", whole)
        .withColumn("rest", words - F.col("whole") * F.col("words"))
        .withColumn("begin", F.when(F.col("words") > 0, F.pmod(F.xxhash64("source", "shard", F.lit(p.seed)), F.col("words"))).otherwise(0))
    )
    streams = scratch.keep(streams.select(*key, "shard", "words", "whole", "rest", "begin"), "streams")
    order = Window.partitionBy(*key, "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = placed.withColumn("hi", F.sum("size").over(order)).withColumn("lo", F.col("hi") - F.col("size"))
    d = d.join(streams, [*key, "shard"])
    end = F.col("begin") + F.col("rest")
    over = lambda a, z: F.greatest(F.lit(0), F.least("hi", z) - F.greatest("lo", a))
    part = over(F.col("begin"), F.least(end, F.col("words"))) + over(F.lit(0), end - F.col("words"))
    return d.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("whole") + part).cast("long").alias("taken"), "draw"
    )


def take(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document as often as the mix takes
    it, to the nearest whole number, so that no text is cut."""
    found = mix(spark, docs, params)
    times = found.withColumn("times", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int"))
    draw, many = fresh(docs, "_draw", "_times")
    times = Scratch(spark, "mixing-take").keep(
        times.where("times > 0").groupBy(F.col("draw").alias(draw)).agg(F.max("times").alias(many)), "times"
    )
    own = F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(params.seed))
    drawn = docs.withColumn(draw, own).join(times, draw)
    copies = F.explode(F.sequence(F.lit(1), F.col(many)))
    return drawn.select(*docs.columns, copies.alias(many)).drop(many)
