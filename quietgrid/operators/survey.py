"""Survey ratings: sessions, items, checks, summaries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import same_answer
from .order import running_sum, seeded_place
from .sizes import dealt
from .tables import durable


def completed_sessions(df: DataFrame, rule: str) -> DataFrame:
    """Completed sessions; three rules.

    ``insights``: a completion time, or all of some assigned items answered.  ``counts``: a completion
    time, or answered or stored rows reach the number assigned.  ``server``: answered reaches assigned.
    """
    done, a, n = F.col("completed_at").isNotNull(), F.coalesce("answered", F.lit(0)), F.coalesce("assigned", F.lit(0))
    return df.where({"insights": done | ((a >= n) & (n > 0)), "counts": done | (F.greatest(a, F.coalesce("rows", F.lit(0))) >= n), "server": a >= n}[rule])


def exclude_flows(df: DataFrame, fields: dict[str, str], words: tuple[str, ...] = ("child", "school", "classroom")) -> DataFrame:
    """Flows of none of the excluded populations: no field equals its excluded value, no text names them."""
    out = df
    for f, v in fields.items():
        out = out.where(~F.col(f).eqNullSafe(F.lit(v)))
    return out.where(~F.lower(F.to_json(F.struct(*df.columns))).rlike("|".join(words)))


def scope_items(items: DataFrame, current: DataFrame, previous: DataFrame, schema: str) -> DataFrame:
    """Items whose schema is new: in the current set and not in the previous one."""
    return items.join(current.select(schema).subtract(previous.select(schema)), schema, "left_semi")


def enrich_responses(responses: DataFrame, sessions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Responses whose empty fields are filled from their session."""
    s = sessions.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return responses.join(s, key, "left").withColumns({f: F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.col(f"_{f}").cast("string")) for f in fields}).drop(*[f"_{f}" for f in fields])


def lookup_context(df: DataFrame, contexts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the context value found under the first of several ids."""
    long = contexts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.col(k).cast("string").alias("id")) for i, k in enumerate(keys)])).alias("x"), value).select("x.id", "x.o", value)
    first = long.where("id is not null").groupBy("id").agg(F.min_by(value, F.struct("o", value)).alias(value))
    return df.withColumn("id", F.col("id").cast("string")).join(first.hint("merge"), "id", "left")


def rating_summary(df: DataFrame, groupings: list[list[str]], rating: str, participant: str, item: str) -> DataFrame:
    """(keys, level, rows, participants, items, mean, median, sd, share_high) of several groupings.

    ``level`` is the grouping id of the keys, which tells a key that is null from one that is rolled up.
    Ratings are counted by keys and value, and participants and items taken once for their keys, before any
    grouping, so the groupings work on those small tables.
    """
    keys = list(dict.fromkeys(k for g in groupings for k in g))
    sets = [[F.col(k) for k in x] for x in groupings]
    level = F.grouping_id(*keys).cast("int").alias("level")
    x = F.col(rating).cast("double")
    counts = df.groupBy(*keys, rating).agg(F.count("*").alias("n"))
    n, total, squares = F.sum(F.when(x.isNotNull(), F.col("n"))), F.sum(x * F.col("n")), F.sum(x * x * F.col("n"))
    spread = F.when(n > 1, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))))
    high = F.sum(F.when(x >= 4, F.col("n")).otherwise(F.when(x.isNotNull(), 0))) / n
    out = counts.groupingSets(sets, *keys).agg(level, F.sum("n").alias("rows"), (total / n).alias("mean"), F.percentile(rating, F.lit(0.5), F.col("n")).alias("median"), spread.alias("sd"), high.alias("share_high"))
    for column, name in ((participant, "participants"), (item, "items")):
        # rows of a value are dealt together, so what each grouping leaves of them is made distinct where it stands, in any number of tasks
        held = dealt(df.select(*keys, column), column).distinct()
        each = []
        for g in groupings:
            own = held.select(*g, column).distinct().groupBy(*g).agg(F.count(column).alias(name))
            rolled = sum(1 << i for i, k in enumerate(reversed(keys)) if k not in g)
            each.append(own.select(*[F.col(k) if k in g else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], F.lit(rolled).alias("level"), name))
        once = reduce(DataFrame.unionAll, each)
        same = [out["level"] == once["level"], *[out[k].eqNullSafe(once[k]) for k in keys]]
        out = out.join(once.hint("merge"), same).select(*[out[c] for c in out.columns], once[name])
    return out.select(*keys, "level", "rows", "participants", "items", "mean", "median", "sd", "share_high")


def _uniform(*parts: Column | str) -> Column:
    """A seeded number from 0 to 1, of 48 bits."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def split_draws(spark: SparkSession, iterations: int, k: int, levels: int, seed: int) -> DataFrame:
    """(it, bucket, draws): how many of the k draws of each iteration fall to each of 2**levels buckets of 1..k.

    Draws are split down a tree: of a node's draws the left half gets a binomial share by the halves' sizes.  Fewer
    than 64 draws are dealt one by one; more by the binomial's mean and deviation and a seeded normal number.  Bucket b
    holds the places from ceil(b k / 2**levels) on.  No rows are moved.
    """
    nodes = spark.range(1, iterations + 1).select(F.col("id").cast("int").alias("it"), F.lit(0).cast("long").alias("bucket"), F.lit(k).cast("long").alias("draws"))
    for level in range(levels):
        width = 1 << (levels - level)
        start = lambda b: F.expr(f"({b} * {k}L + {(1 << levels) - 1}) div {1 << levels}")
        low, middle, high = start(f"bucket * {width}"), start(f"(bucket * {width} + {width // 2})"), start(f"(bucket + 1) * {width}")
        p, n, at = (middle - low) / F.greatest(high - low, F.lit(1)), F.col("draws"), (F.lit(seed), "it", F.lit(level), "bucket")
        one_by_one = F.size(F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda d: (d <= n) & (_uniform(*at, d) < p))).cast("long")
        normal = F.sqrt(-2 * F.log(_uniform(*at, F.lit("a")))) * F.cos(2 * math.pi * _uniform(*at, F.lit("b")))
        share = F.least(n, F.greatest(F.lit(0), F.floor(n * p + normal * F.sqrt(n * p * (1 - p)) + 0.5))).cast("long")
        left = F.when(n < 64, one_by_one).otherwise(share)
        nodes = nodes.select("it", "bucket", "draws", left.alias("left"))
        sides = F.array(F.struct((F.col("bucket") * 2).alias("bucket"), F.col("left").alias("draws")), F.struct((F.col("bucket") * 2 + 1).alias("bucket"), (n - F.col("left")).alias("draws")))
        nodes = nodes.select("it", F.inline(sides))
    return nodes.where("draws > 0")


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, iterations: int = 1000, seed: int = 13, per_bucket: int = 1024) -> DataFrame:
    """(mean, low, high): the mean of a value and its 2.5 and 97.5 percentiles over resamples of whole clusters.

    Clusters stand in seeded order and are cut into buckets of about ``per_bucket``, 1024 buckets at most; how many
    draws of an iteration a bucket makes comes from ``split_draws``, and it makes them itself, each a seeded digest.  What
    is shuffled is the clusters, once, and a sum for each iteration and bucket.
    """
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    numbered = seeded_place(sums, cluster, seed, "i")
    k, mean = sums.agg(F.count("*"), F.sum("s") / F.sum("n")).first()
    levels = max(0, min(10, int(math.floor(math.log2(max(1, k) / per_bucket)))))
    place = F.expr(f"(i * {1 << levels}L) div {max(1, k)}").alias("bucket")
    buckets = numbered.groupBy(place).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s", "n"))), lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"))).alias("own"))
    draws = split_draws(df.sparkSession, iterations, k, levels, seed).join(buckets.hint("shuffle_hash"), "bucket")
    draws = draws.select("it", "bucket", "own", F.explode(F.sequence(F.lit(1).cast("long"), "draws")).alias("d"))
    which = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "it", "bucket", "d").cast("binary")), 1, 8), 16, 10).cast("long"), F.size("own"))
    drawn = draws.select("it", "bucket", F.get("own", which.cast("int")).alias("x")).groupBy("it", "bucket").agg(F.sum("x.s").alias("s"), F.sum("x.n").alias("n"))
    means = drawn.groupBy("it").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.agg(F.lit(mean).cast("double").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def session_qc(sessions: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """(key, assigned, answered, checks, failed, accuracy, minutes) of each session."""
    r = responses.groupBy(key).agg(F.count("*").alias("answered"), F.count("correct").alias("checks"), F.count_if(F.col("correct") == 0).alias("failed"))
    out = sessions.select(key, "assigned", (F.col("elapsed_ms") / 60000.0).alias("minutes")).join(r, key, "left").fillna(0, ["answered", "checks", "failed"])
    return out.withColumn("accuracy", F.try_divide((F.col("checks") - F.col("failed")).cast("double"), F.col("checks").cast("double")))


def item_summary(df: DataFrame, item: str, rating: str) -> DataFrame:
    """(item, n, n1..n5, mean, median, sd) of each item, rounded half-even to three digits."""
    by = [F.count_if(F.col(rating) == k).alias(f"n{k}") for k in range(1, 6)]
    return df.groupBy(item).agg(F.count("*").alias("n"), *by, F.bround(F.avg(rating), 3).alias("mean"), F.bround(F.median(rating), 3).alias("median"), F.bround(F.stddev_samp(rating), 3).alias("sd"))


def study_overview(sessions: DataFrame, responses: DataFrame, participant: str, key: str) -> DataFrame:
    """One row: sessions, participants, responses, check accuracy in percent, sessions with a failed check."""
    r = responses.agg(F.count("*").alias("responses"), (100 * F.avg(F.col("correct").cast("double"))).alias("check_accuracy"), F.countDistinct(F.when(F.col("correct") == 0, F.col(key))).alias("sessions_failing"))
    return sessions.agg(F.count("*").alias("sessions"), F.countDistinct(participant).alias("participants")).crossJoin(r)  # two single rows


def participant_counts(sessions: DataFrame, participant: str, completed: str, elapsed: str) -> DataFrame:
    """(participant, sessions, completed, mean_ms): sessions of each participant, and the mean time of the completed ones."""
    done = F.col(completed).isNotNull()
    return sessions.groupBy(participant).agg(F.count("*").alias("sessions"), F.count(completed).alias("completed"), F.avg(F.when(done, F.col(elapsed))).alias("mean_ms"))


def comments_by(df: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """(key, comments): the free texts of a key that are not blank, in order."""
    return df.where(F.trim(F.coalesce(text, F.lit(""))) != "").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]).alias("comments"))


def build_items(runs: DataFrame, key: list[str], method: str, order: str) -> DataFrame:
    """(key, methods): runs with the same output collapse to one item; its methods once each in order."""
    return runs.groupBy(*key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, method))), lambda x: x[method])).alias("methods"))


def changed_fields(df: DataFrame, by: str, order: list[str], fields: list[str]) -> DataFrame:
    """Rows with ``changed``: the fields that differ from the item before, none on the first."""
    w = Window.partitionBy(by).orderBy(*order)
    first = F.row_number().over(w) == 1
    diffs = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.lag(f).over(w)), F.lit(f)) for f in fields]))
    return df.withColumn("changed", F.when(first, F.array().cast("array<string>")).otherwise(diffs))


def score_checks(df: DataFrame, expected: str, answer: str) -> DataFrame:
    return df.withColumn("correct", F.when(F.col(expected).isNotNull(), same_answer(F.col(expected), F.col(answer)).cast("int")))


def assign_split(df: DataFrame, key: str, fractions: dict[str, float], seed: int, stratum: str | None = None) -> DataFrame:
    """(key, split): groups in seeded order take the splits' shares, in each stratum.

    The first group is in the first split and, of two groups or more, the last is in the last split.
    """
    groups = df.groupBy(key).agg(F.coalesce(F.min(stratum).cast("string"), F.lit("")).alias("_s") if stratum else F.lit(0).alias("_s"))
    sizes = groups.groupBy("_s").agg(F.count("*").alias("_size"))  # one row a stratum
    placed = seeded_place(groups, key, seed, "_place", ["_s"]).join(sizes.hint("merge"), "_s")
    names, upto = list(fractions), 0.0
    split = F.lit(names[-1])
    edges = []
    for name, share in list(fractions.items())[:-1]:
        upto += share
        edges.append((upto, name))
    for edge, name in reversed(edges):
        split = F.when(F.col("_place") / F.col("_size") < edge, name).otherwise(split)
    last = (F.col("_size") > 1) & (F.col("_place") == F.col("_size") - 1)
    return placed.select(key, F.when(last, names[-1]).otherwise(split).alias("split"))


def _use_level(levels: DataFrame, most: int, want: int, low: int, high: int) -> int:
    """The least level at which the blocks' uses, each between its bounds, reach ``want``; 64 levels are tried in a pass."""
    while low < high:
        step = -(-(high - low) // 64)
        tried = [x for x in range(low, high, step)]
        uses = [F.sum(F.col("n") * F.least(F.greatest(F.lit(x) - F.col("used"), F.lit(0)), F.lit(most))).alias(f"u{i}") for i, x in enumerate(tried)]
        blocks = levels.groupBy("_k").agg(F.first("least").alias("least"), F.first("most").alias("most"), *uses)
        totals = blocks.agg(*[F.sum(F.least(F.greatest(f"u{i}", "least"), "most")) for i in range(len(tried))]).first()
        enough = [x for x, total in zip(tried, totals, strict=True) if total >= want]
        high = enough[0] if enough else high
        low = max([x + 1 for x, total in zip(tried, totals, strict=True) if total < want], default=low)
    return high


def assign_items(items: DataFrame, counts: DataFrame, sessions: DataFrame, k: int, m: int, text: str | None = None) -> DataFrame:
    """(session, item, place): k items for each session, at most m of a block, no visible text twice, the least used first and seeded by session and item.

    Items of one ``text`` (a column of ``items``; null is a text of its own) are shown as one: the text stands in the
    block of its least used item, and the sessions that get it take turns over its items in that block.  There must be
    as many texts as k, or a session gets all texts.  See ``_assign_units`` for the rest.
    """
    used = items.join(counts.select("item", "used").hint("merge"), "item", "left").fillna(0, ["used"])
    own = F.concat(F.lit("item|"), F.col("item").cast("string"))
    shown = F.coalesce(F.concat(F.lit("text|"), F.col(text).cast("string")), own) if text else own
    used = durable(used.select("item", F.struct("block").alias("_k"), F.col("used").cast("long").alias("used"), shown.alias("shown")), "used")
    if not text:
        return _assign_units(used.select("item", "_k", "used"), sessions, k, m)
    first = F.min(F.struct("used", F.xxhash64("item").alias("h"), "item", "_k")).alias("f")
    homes = used.groupBy("shown").agg(first).select("shown", F.col("f._k").alias("_home"), F.col("f.item").alias("unit"), F.col("f.used").alias("least"))
    homes = durable(homes, "homes")
    held = used.join(homes.hint("merge"), "shown").where(F.col("_k") == F.col("_home"))
    turn = F.row_number().over(Window.partitionBy("unit").orderBy("used", "item")) - 1
    held = durable(held.select("unit", "item", turn.alias("turn"), F.count("*").over(Window.partitionBy("unit")).alias("n")), "turns")
    units = homes.select(F.col("unit").alias("item"), F.col("_home").alias("_k"), F.col("least").alias("used"))
    found = _assign_units(units, sessions, k, m).withColumnRenamed("item", "unit")
    sizes = held.where("turn = 0").select("unit", "n")
    found = found.join(sizes.hint("merge"), "unit").withColumn("turn", F.pmod(F.xxhash64("session", "unit"), F.col("n")).cast("int"))
    return found.join(held.select("unit", "turn", "item").hint("merge"), ["unit", "turn"]).select("session", "item", "place")


def sorted_place(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows with ``name``: their place from 0 in the order of ``by``, from a sort in ranges and the ranges' sizes."""
    ordered = durable(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.call_function("shiftright", F.col("_at"), F.lit(33)).alias("_part")
    sizes = ordered.groupBy(part).agg(F.count("*").alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    inside = F.col("_at") - F.call_function("shiftleft", F.col("_part"), F.lit(33))
    return ordered.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(name, inside + F.col("_before")).drop("_at", "_part", "_before")


def assign_sequential(items: DataFrame, sessions: DataFrame, k: int, order: list[str], seed: str = "seq") -> DataFrame:
    """(session, item, place): k items in a row for each session, from a seeded place of the items' order on and round its end; all items if there are fewer."""
    placed = durable(sorted_place(items.select("item", *order), [*order, "item"], "at").select("item", "at"), "placed")
    n = placed.count()
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("session").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(max(1, n)))
    asked = sessions.select("session", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(max(0, min(k, n) - 1)))).alias("place"))
    asked = asked.where(F.lit(n > 0 and k > 0)).withColumn("at", F.pmod(F.col("start") + F.col("place"), F.lit(max(1, n))))
    return asked.join(placed.hint("merge"), "at").select("session", "item", "place")


def _assign_units(used: DataFrame, sessions: DataFrame, k: int, m: int) -> DataFrame:
    """(session, item, place) of items (item, _k: their block, used).

    All items take part.  Uses go to the items of the lowest counts, a session being one use, until each
    session has k; a block has at most m uses a session.  Where the blocks are too few or too small for
    that, sessions take m of each block, or all it has, and the rest from the least used items of any block.  A session has
    an item once, so it gets all items if there are fewer than k.

    The uses lie in a line, those of a block and of an item side by side, and session p of S takes the
    places p, p + S, p + 2 S and so on, which holds these bounds.
    """
    m = m if m > 0 else k
    levels = used.groupBy("_k", "used").agg(F.count("*").alias("n"))
    sizes = levels.groupBy("_k").agg(F.sum("n").alias("size"))
    every = sessions.count()
    n_items, capped = sizes.agg(F.sum("size"), F.sum(F.least("size", F.lit(m)))).first()
    if not every or not n_items:
        return sessions.limit(0).select("session").crossJoin(used.limit(0).select("item")).withColumn("place", F.lit(0))
    wanted, relax = every * min(k, n_items), capped < min(k, n_items)
    cap = F.least("size", F.lit(m)) * F.lit(every)
    sizes = sizes.select("_k", (cap if relax else F.lit(0).cast("long")).alias("least"), (F.col("size") * F.lit(every) if relax else cap).alias("most"))
    levels = durable(levels.join(sizes.hint("merge"), "_k"), "levels")
    lowest, highest = levels.agg(F.min("used"), F.max("used")).first()
    level = _use_level(levels, every, wanted, lowest, highest + every)

    # the uses of each block: all below the last level, and of the last as many as are left, block by block
    upto = lambda x: F.least(F.greatest(F.sum(F.col("n") * F.least(F.greatest(F.lit(x) - F.col("used"), F.lit(0)), F.lit(every))), F.first("least")), F.first("most"))
    blocks = levels.groupBy("_k").agg(upto(level - 1).alias("sure"), upto(level).alias("last"))
    left = wanted - blocks.agg(F.sum("sure")).first()[0]
    blocks = running_sum(blocks.select("_k", "sure", (F.col("last") - F.col("sure")).alias("more")).withColumn("_one", F.lit(0)), ["_one"], "_k", "more", "before")
    blocks = blocks.select("_one", "_k", (F.col("sure") + F.least(F.greatest(F.lit(left) - F.col("before"), F.lit(0)), "more")).alias("uses")).where("uses > 0")
    blocks = durable(running_sum(blocks, ["_one"], "_k", "uses", "start").drop("_one"), "uses")

    # the level of each block: uses grow from an item's count until every session has it
    turns = levels.select("_k", F.explode(F.array(F.struct(F.col("used").alias("x"), F.col("n").alias("d")), F.struct((F.col("used") + every).alias("x"), (-F.col("n")).alias("d")))).alias("t"))
    turns = turns.groupBy("_k", "t.x").agg(F.sum("t.d").alias("d"))
    w = Window.partitionBy("_k").orderBy("x")
    turns = turns.withColumns({"slope": F.sum("d").over(w), "moment": F.sum(F.col("d") * F.col("x")).over(w)}).withColumn("have", F.col("slope") * F.col("x") - F.col("moment"))
    at = turns.join(blocks.hint("merge"), "_k").where("have < uses").groupBy("_k", "uses", "start").agg(F.max_by(F.struct("x", "slope", "have"), "x").alias("t"))
    full = F.expr("t.x + (uses - t.have - 1) div t.slope")  # the highest level that leaves some uses
    at = at.withColumn("full", full).select("_k", "start", "full", (F.col("uses") - F.col("t.have") - F.col("t.slope") * (F.col("full") - F.col("t.x"))).alias("over"))

    shares = used.join(at.hint("merge"), "_k").withColumn("sure", F.least(F.greatest(F.col("full") - F.col("used"), F.lit(0)), F.lit(every)))
    shares = shares.withColumn("open", ((F.col("used") <= F.col("full")) & (F.col("sure") < every)).cast("long"))
    shares = running_sum(durable(shares, "open"), ["_k"], "item", "open", "before")
    shares = shares.withColumn("uses", F.col("sure") + F.when((F.col("open") == 1) & (F.col("before") < F.col("over")), 1).otherwise(0)).where("uses > 0")
    shares = durable(running_sum(durable(shares.select("_k", "item", "used", "start", "uses"), "shares"), ["_k"], "item", "uses", "inner"), "line")
    lots = shares.withColumn("lot", F.explode(F.expr("sequence(0L, (uses - 1) div 4096)")))  # so that no array grows with the sessions
    line = lots.select("item", "used", (F.col("start") + F.col("inner")).alias("from"), F.explode(F.expr("sequence(lot * 4096, least(uses, (lot + 1) * 4096) - 1)")).alias("use"))
    numbered = running_sum(sessions.select("session", F.lit(1).alias("_one")), [], "session", "_one", "_p", 13)
    pairs = line.withColumn("_p", F.pmod(F.col("from") + F.col("use"), F.lit(every))).join(durable(numbered, "numbered").hint("merge"), "_p")
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("used", F.xxhash64("session", "item"), "item"))).select("session", "item", "place")


def privacy_class(output_type: Column) -> Column:
    """Raw media, redacted media, identifying text, or derived labels."""
    return F.when(output_type.endswith("x-raw"), "raw_media").when(output_type.rlike("redacted|filtered|silhouette"), "redacted_media").when(output_type.contains("text"), "text").otherwise("derived")
