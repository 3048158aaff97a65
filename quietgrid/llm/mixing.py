"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: the sources' weights share the total size; a source's target stops at ``most`` times its size
and the excess goes to the others by weight.  Every source is cut into shards of a bounded number of
documents by a seeded hash.  The blocks are given to the shards by highest quotients target / (2k + 1):
rounding target / block to the nearest integer gives the seats at that divisor, and the few seats that
are then missing or over are settled by ranking the next or last quotients.  The ranking is a search: of
the quotients, dealt to ranges, only those of the range where the last seat falls are ranked one by one.
Inside a shard documents stand in seeded order; a shard whose quota is above its number of blocks repeats
all of them, and the first blocks in that order once more for the rest.  Only DataFrame functions are used.

Null and empty texts have size 0 and take nothing; null sources are one source, the last; repeated rows
are documents of their own, and those of one id and text stand next to each other in a shard; a document
takes ``most`` times its size at the most; empty tables give empty results.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import durable, spread_join

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 16
SHARD_DOCS = 5000
SEED = "mix-1"


def _highest(tried: DataFrame, lacks: DataFrame, ranges: int = 256, rounds: int = 8) -> DataFrame:
    """The rows with the |lack| highest quotients; equal ones by rank, shard and k.

    Ranges of quotients are counted and the one where the last seat falls is cut again, until it holds few
    rows or quotients that are all the same; no task ranks more than those.
    """
    bounds = lacks.select(F.abs("lack").alias("want")).first()
    want = bounds[0] or 0 if bounds else 0
    q = F.col("quotient")
    low, high, n = tried.agg(F.min("quotient"), F.max("quotient"), F.count("*")).first()
    if not n or not want:
        return tried.limit(0)
    above = 0  # rows over ``high``, all of them chosen
    for _ in range(rounds):
        if n <= 10_000 or not high > low:
            break
        step = (high - low) / ranges
        place = F.least(F.greatest(F.floor((q - low) / step), F.lit(0)), F.lit(ranges - 1)).alias("r")
        found = tried.where(q.between(low, high)).groupBy(place).agg(F.count("*").alias("n"), F.min("quotient").alias("a"), F.max("quotient").alias("b"))
        for r in sorted(found.collect(), key=lambda r: -r.r):  # ``ranges`` rows at most
            if above + r.n >= want:
                low, high, n = r.a, r.b, r.n
                break
            above += r.n
    place = F.row_number().over(Window.orderBy(F.desc("quotient"), "rank", "shard", "k"))
    last = tried.where(q.between(low, high)).withColumn("place", place).where(F.col("place") <= want - above).drop("place")
    return tried.where(q > high).unionByName(last)


def mix_sources(docs: DataFrame, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken) of each row of ``docs``."""
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    draw = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    sized = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw.alias("draw")))

    # targets: the sources that stop at their limit are a prefix by limit / weight
    by_name, by_limit = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    sources = sources.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy(F.lit(1))
    sources = sources.withColumn("total", F.sum("source_size").over(everything)).withColumn("level", (F.col("total") - F.coalesce(F.sum(most * F.col("source_size")).over(by_limit), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0))))
    sources = sources.withColumn("level", F.min_by(F.when(F.col("ratio") > F.col("level"), F.col("level")), F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank"))).over(everything))
    sources = durable(sources.select("source", "rank", "source_size", "total", F.ceil(F.col("n_docs") / F.lit(shard_docs)).alias("shards"), F.coalesce(F.least(F.col("level") * F.col("weight"), F.lit(most).cast("double") * F.col("source_size")), F.lit(0.0)).alias("target")))

    number = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    # the key of a source, so that a null is one too; the documents of a large source are dealt to parts
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("name")
    placed = spread_join(sized.select("*", named), sources.select(named, "rank", "source_size", "total", "target", "shards"), ["name"], "draw")
    placed = durable(placed.select("id", "source", "size", "draw", "rank", "source_size", "total", "target", F.pmod(number, "shards").alias("shard")))
    cells = placed.groupBy("rank", "shard").agg(F.sum("size").alias("cell_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("total").alias("total"))
    cells = cells.where("cell_size > 0").withColumn("share", F.col("target") * F.col("cell_size") / F.col("source_size"))
    cells = durable(cells.withColumn("seats", F.floor(F.col("share") / block + 0.5)))

    # the seats missing (or over) at this divisor go to the highest next (or from the lowest last) quotients
    lacks = cells.agg((F.floor(F.max("total") / block) - F.sum("seats")).alias("lack"), F.count("*").alias("n_cells"))
    tried = cells.crossJoin(F.broadcast(lacks)).where("lack <> 0").withColumn("k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("share") / F.col("total") * (F.abs("lack") + F.col("n_cells"))) + 1).cast("int"))))
    tried = tried.withColumn("quotient", F.when(F.col("lack") > 0, F.col("share") / (2 * (F.col("seats") + F.col("k")) + 1)).otherwise(-F.col("share") / (2 * (F.col("seats") - F.col("k")) - 1))).where("lack > 0 or seats > k")
    tried = durable(tried)
    settled = _highest(tried, lacks)
    settled = settled.groupBy("rank", "shard").agg(F.sum(F.signum("lack")).cast("long").alias("more"))
    quotas = cells.join(settled.hint("merge"), ["rank", "shard"], "left").select("rank", "shard", "cell_size", (F.col("seats") + F.coalesce("more", F.lit(0))).alias("quota"))

    blocks = F.ceil(F.col("cell_size") / F.lit(block))
    upto = F.sum("size").over(Window.partitionBy("rank", "shard").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    extra = F.greatest(F.lit(0), F.least(F.col("upto"), F.pmod("quota", "blocks") * block) - (F.col("upto") - F.col("size")))
    taken = F.coalesce(F.least(F.floor(F.col("quota") / F.col("blocks")) * F.col("size") + extra, most * F.col("size")), F.lit(0)).cast("long")
    out = placed.withColumn("upto", upto).join(quotas.withColumn("blocks", blocks).hint("merge"), ["rank", "shard"], "left")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"))
