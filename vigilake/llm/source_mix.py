"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets come from filling by weight up to each source's cap. Blocks of equally many words then go to sources by the
highest quotients weight / (2k + 1), and within a source to its shards in the same way, which gives every shard an
integer quota; what a source's target has beyond whole blocks, or lacks, falls to its first shard with words. A shard's documents
lie one after another in a seeded order, cut into blocks; the quota takes the whole shard as often as it goes in, and
then its blocks in a seeded order, the last of them in part. Only the few quotients near the divisor are ever listed.

Texts are read once; what is known of each document is written down. Documents without words lie nowhere, and a shard has
a bounded number of words and of rows, so that no window grows with a source.

Defined results: null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; rows are
dealt and ordered by id, text and, where these are equal, by number, so that one id or one text on many rows fills shards
like any others; texts of any length are counted whole; an empty table gives an empty table; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, settle

# Fixed values of the task: the weights, repeating over the ordered sources, the share of all words, and the cap.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Words of a block, words and rows of a shard of a source, and the seed of the orders within a shard.
BLOCK, SHARD, ROWS, SEED = 256, 1_000_000, 10_000, "mix-2"


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\t to \\r."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: (source, source_size, ...). Adds target: by weight, stopped at ``cap`` times the size, the excess reshared.

    In ascending order of cap / weight, the sources before some place are at their caps and the rest share what is
    left: one pass of running sums instead of repeated resharing. The table has a row for each source."""
    ordered = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    x = x.withColumn("all_", F.sum("source_size").over(every) * F.lit(share))
    x = x.withColumn("left", F.col("all_") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    x = x.withColumn("level", F.col("left") / F.col("w_left")).withColumn("free", F.col("cap") / F.col("w") >= F.col("level"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"]
    return x.withColumn("target", F.least(F.col("cap"), F.col("w") * level)).withColumn("target", F.round(F.coalesce("target", "cap"), 6)).select(*sizes.columns, "target")


def apportion(claims: DataFrame, within: list[str], claim: str, seats: str, ties: list[str]) -> DataFrame:
    """Adds ``quota``: whole seats of each ``within`` group by the highest quotients claim / (2k + 1).

    With T claims in sum, N seats and S claimants, every seat whose quotient clears the divisor T / (N - S/2) is
    certainly won, and no seat below T / (N + S/2) is: what lies between, at most about 2 S seats, is ranked."""
    group = W.partitionBy(*within)
    c, n = F.col(claim), F.col(seats)
    x = claims.withColumn("__t", F.sum(c).over(group)).withColumn("__s", F.count("*").over(group))
    # shares of seats first: claim / divisor, rounded half down (a seat k is won while claim / divisor > k - 1/2)
    sure = F.greatest(F.ceil(c * F.greatest(n - F.col("__s") / 2, F.lit(0.0)) / F.nullif(F.col("__t"), F.lit(0.0)) - 0.5), F.lit(0))
    most = F.greatest(F.ceil(c * (n + F.col("__s") / 2 + 1) / F.nullif(F.col("__t"), F.lit(0.0)) + 0.5), F.lit(0))
    x = x.withColumn("__sure", F.coalesce(sure, F.lit(0)).cast("long")).withColumn("__most", F.coalesce(most, F.lit(0)).cast("long"))
    x = x.withColumn("__open", n - F.sum("__sure").over(group))
    rivals = x.where("__most > __sure").withColumn("__k", F.explode(F.sequence(F.col("__sure"), F.col("__most") - 1)))
    rank = F.row_number().over(group.orderBy(F.desc(c / (2 * F.col("__k") + 1)), *[F.asc_nulls_last(t) for t in ties]))
    won = rivals.withColumn("__rank", rank).where("__rank <= __open").groupBy(*[F.col(t).alias(f"__tie_{t}") for t in ties]).agg(F.count("*").alias("__won"))
    same = [F.col(t).eqNullSafe(F.col(f"__tie_{t}")) for t in ties]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return x.join(won, cond, "left").withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0))).select(*claims.columns, "quota")


def words_of(shards: DataFrame, block: int, cap: float) -> DataFrame:
    """shards: (sid, shard, shard_size, quota, beyond). Adds whole, how often the shard is taken as a whole, and rest, words of it taken once more."""
    first = F.min("shard").over(W.partitionBy("sid"))
    words = F.col("quota") * block + F.when(F.col("shard") == first, F.col("beyond")).otherwise(F.lit(0))
    words = F.least(F.greatest(words, F.lit(0)), F.col("shard_size") * F.lit(int(cap)))
    x = shards.withColumn("whole", F.floor(words / F.col("shard_size")).cast("long"))
    return x.withColumn("rest", words - F.col("whole") * F.col("shard_size"))


def laid_blocks(shards: DataFrame, block: int, seed: str) -> DataFrame:
    """shards: (sid, shard, shard_size, rest). (sid, shard, b, cut, upto): words taken of each block, and of those before it.

    Blocks are chosen in a seeded order until the rest is met."""
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("shard_size") / block).cast("long") - 1))
    x = shards.where("rest > 0").select("sid", "shard", "rest", "shard_size", b.alias("b")).withColumn("len", F.least(F.lit(block).cast("long"), F.col("shard_size") - F.col("b") * block))
    key = F.md5(F.concat_ws(":", F.lit(seed), "sid", "shard", "b").cast("binary"))
    chosen = W.partitionBy("sid", "shard").orderBy("key", "b").rowsBetween(W.unboundedPreceding, -1)
    place = W.partitionBy("sid", "shard").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("key", key).withColumn("cut", F.least(F.greatest(F.col("rest") - F.coalesce(F.sum("len").over(chosen), F.lit(0)), F.lit(0)), F.col("len")))
    return x.select("sid", "shard", "b", "cut", F.coalesce(F.sum("cut").over(place), F.lit(0)).alias("upto"))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, shard_rows: int = ROWS, seed: str = SEED, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``."""
    read = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"))
    # equal rows fold, on the map side too, and are numbered as they unfold
    numbered = read.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "tie", F.col("copy").cast("string")).cast("binary"))
    rows = settle(numbered.select("doc_id", "source", "size", key.alias("key"), "tie"))
    of_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_rows")), weights, share, cap)
    blocks = of_source.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))))
    blocks = blocks.withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")).withColumn("all_", F.lit(1))
    sources = apportion(blocks, ["all_"], "target", "seats", ["sid"]).withColumnRenamed("quota", "source_quota")
    sources = sources.withColumn("beyond", F.round("target").cast("long") - F.col("source_quota") * block)
    sources = settle(sources.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard), F.ceil(F.col("n_rows") / shard_rows), F.lit(1)).cast("long")).drop("all_", "seats", "n_rows"))
    dealt = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    dealt = dealt.withColumn("shard", F.conv(F.substring("key", 25, 8), 16, 10).cast("long") % F.col("shards"))
    solid = dealt.where("size > 0")
    of_shard = solid.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("beyond").alias("beyond")).withColumn("claim", F.col("shard_size").cast("double"))
    quotas = settle(words_of(apportion(of_shard, ["sid"], "claim", "source_quota", ["sid", "shard"]), block, cap).select("sid", "shard", "shard_size", "whole", "rest"))
    cuts = settle(laid_blocks(quotas, block, seed))
    before = W.partitionBy("sid", "shard").orderBy("key", "tie").rowsBetween(W.unboundedPreceding, -1)
    laid = solid.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("end", F.col("start") + F.col("size"))
    laid = laid.join(quotas.drop("shard_size"), ["sid", "shard"])

    def taken_before(x: DataFrame, place: str) -> DataFrame:
        """Adds ``place``_words: words of the rest that lie before a place of the shard; all of it where no block follows."""
        c = cuts.withColumnsRenamed({"cut": "cut_", "upto": "upto_"})
        x = x.withColumn("b", F.floor(F.col(place) / block).cast("long")).join(c, ["sid", "shard", "b"], "left")
        return x.withColumn(f"{place}_words", F.coalesce(F.col("upto_") + F.least(F.col("cut_"), F.col(place) % block), F.col("rest"))).drop("b", "cut_", "upto_")

    out = taken_before(taken_before(laid, "start"), "end")
    out = out.withColumn("taken", (F.col("whole") * F.col("size") + F.col("end_words") - F.col("start_words")).cast("long"))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    result = settle(out.select(cols).unionByName(dealt.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(cols)))
    discard(rows, sources, quotas, cuts)
    return result
