"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Tokens are words, counted in blocks of equal size. Sources get blocks by the highest quotients
target / (2 * seats + 1), all those of half a block or more; so each source has its target to the nearest
block. A source's blocks go to its shards (seeded, of bounded size) in the same way, by the number of
blocks. In a shard, documents stand in a seeded order, the words so lined up are cut into blocks, and a
seeded draw of every so-manieth block takes as many as the shard's quota asks; what the quota asks beyond
whole shards and whole blocks is the beginning of one block more. So a source is sampled evenly, no group of
documents meets in one task, and a rerun takes the same, however the input is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.llm.common import WORD, fresh, shared_table


def apportion(votes: Column, seats: Column) -> Column:
    """Sainte-Laguë: array<struct<id: long, votes: double>> to array<struct<id: long, seats: long>>.

    The seats at a divisor d are votes / d, rounded; bisection finds the least d that gives no more than
    `seats`. Those left over, for equal quotients, go by quotient and then id. Without votes all get 0.
    """
    at = lambda d: F.aggregate(votes, F.lit(0).cast("long"), lambda n, x: n + F.floor(x["votes"] / d + 0.5).cast("long"))
    top = F.aggregate(votes, F.lit(0.0), lambda m, x: F.greatest(m, x["votes"]))
    low, high = (lambda s: s["low"]), (lambda s: s["high"])
    mid = lambda s: (s["low"] + s["high"]) / 2
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(70)),
        F.struct(F.lit(0.0).alias("low"), (2 * top + 1).alias("high")),
        lambda s, _: F.when(at(mid(s)) > seats, F.struct(mid(s).alias("low"), high(s).alias("high"))).otherwise(F.struct(low(s).alias("low"), mid(s).alias("high"))),
        high,
    )
    # one-element arrays hold what is used more than once
    given = F.transform(F.array(found), lambda d: F.transform(votes, lambda x: F.struct(x["id"].alias("id"), x["votes"].alias("votes"), F.floor(x["votes"] / d + 0.5).cast("long").alias("seats"))))[0]
    rank = lambda x: F.struct((-x["votes"] / (2 * x["seats"] + 1)).alias("q"), x["id"].alias("id"))

    def rest(g: Column) -> Column:
        left = (seats - F.aggregate(g, F.lit(0).cast("long"), lambda n, x: n + x["seats"])).cast("int")
        last = F.when(left > 0, F.get(F.array_sort(F.transform(g, rank)), left - 1))
        return F.transform(F.array(last), lambda m: F.transform(g, lambda x: F.struct(x["id"].alias("id"), (x["seats"] + F.when(rank(x) <= m, 1).otherwise(0)).alias("seats"))))[0]

    return F.when(top > 0, F.transform(F.array(given), rest)[0]).otherwise(F.transform(votes, lambda x: F.struct(x["id"].alias("id"), F.lit(0).cast("long").alias("seats"))))


def draws(*parts: Column) -> tuple[Column, Column]:
    """Two seeded whole numbers of 60 bits, of the same bits in every system: both ends of an MD5."""
    digest = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return number(1), number(18)


def ranked(df: DataFrame, order: list[Column], sums: dict[str, str], parts: int) -> DataFrame:
    """df with `rank` (from 1) in the order and, for each name in sums, the sum of its column over all rows
    before. Rows are dealt by range, so that no task has them all; only a row for each range is ordered in one."""
    dealt = shared_table(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    each = dealt.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), *[F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in sums])
    inside = Window.partitionBy("__part").orderBy(*order)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    # the running sums are read from the rows before they are joined, one window for all
    out = dealt.withColumns({"rank": F.row_number().over(inside).cast("long"), **{name: F.coalesce(F.sum(c).over(above), F.lit(0)) for name, c in sums.items()}})
    out = out.join(F.broadcast(each), "__part")
    return out.withColumns({"rank": F.col("rank") + F.col("__n"), **{name: F.col(name) + F.col(f"__{name}") for name in sums}}).select(*df.columns, "rank", *sums)


def source_targets(sized: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """One row a source: source, place (from 1, by code point, null last), source_size, n (documents), target.

    Targets share all sizes by weight; a target over limit * source_size stops there and its excess is shared
    out again. In the order of limit * size / weight the stopped ones come first, so running sums give the
    level at which the others stand. Sources may be as many as documents: both orders are dealt by range."""
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    s = ranked(s, [F.col("source").asc_nulls_last()], {}, parts).withColumnRenamed("rank", "place")
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (1 + (F.col("place") - 1) % len(weights)).cast("int")).cast("long"))
    # whole numbers, so that sums don't depend on their order
    s = s.withColumns({"cap": F.col("source_size") * limit, "room": F.col("source_size") * limit / F.col("weight")})
    s = ranked(s, [F.col("room"), F.col("place")], {"caps": "cap", "heavy": "weight"}, parts)
    whole = s.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("all_weight"))
    s = shared_table(s.join(F.broadcast(whole)), "levels").withColumn("level", (F.col("all") - F.col("caps")) / (F.col("all_weight") - F.col("heavy")))
    stand = s.where("room > level").agg(F.min(F.struct("rank", "level"))["level"].alias("stand"))
    return s.join(F.broadcast(stand)).select("source", "place", "source_size", "n", F.coalesce(F.least("cap", F.col("weight") * F.col("stand")), F.col("cap").cast("double")).alias("target"))


def _quotas(parts: DataFrame, limit: int) -> DataFrame:
    """(place, shard) with `quota` words: the source's seats (blocks) by Sainte-Laguë over its shards. What a shard
    can't give, being at limit, is asked of the source's other shards. A source's shards meet in one row, of a
    bound that `shards` sets."""
    votes = F.collect_list(F.struct(F.col("shard").alias("id"), F.col("shard_size").cast("double").alias("votes")))
    seats = parts.groupBy("place").agg(votes.alias("votes"), F.first("seats").alias("seats"))
    seats = seats.select("place", F.explode(apportion(F.col("votes"), F.col("seats"))).alias("s")).select("place", F.col("s.id").alias("shard"), F.col("s.seats").alias("won"))
    q = parts.join(seats, ["place", "shard"]).withColumn("top", F.col("shard_size") * limit)
    q = q.withColumn("first", F.least(F.col("won") * F.col("block"), "top"))
    source = Window.partitionBy("place")
    q = q.withColumn("lack", F.greatest(F.lit(0), F.least(F.col("wanted"), F.sum("top").over(source)) - F.sum("first").over(source)))
    before = F.coalesce(F.sum(F.col("top") - F.col("first")).over(source.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("lack") - before, F.col("top") - F.col("first")))
    return q.withColumn("quota", F.col("first") + more)


def taken_before(x: Column, words: Column, left: Column, block: Column, draw: Column) -> Column:
    """Of a shard's first x words, how many are taken when `left` (fewer than words) are to be. Of its whole
    blocks every so-manieth is drawn, from a seeded start; the rest begins the first block not drawn, or
    the part of a block at the end where all are."""
    count = F.floor(words / block).cast("long")
    some = F.floor(left / block).cast("long")
    start = F.when(count > 0, F.pmod(draw, F.greatest(F.lit(1), count))).otherwise(0)
    drawn = lambda k: F.when(count > 0, F.floor((k * some + start) / F.greatest(F.lit(1), count))).otherwise(0).cast("long")
    k = F.least(F.floor(x / block).cast("long"), count)
    spare = F.when(count > some, F.floor(start / F.greatest(F.lit(1), count - some))).otherwise(count).cast("long")
    inner = F.when(k < count, (x - k * block) * (drawn(k + 1) - drawn(k))).otherwise(0)
    return drawn(k) * block + inner + F.least(F.greatest(x - spare * block, F.lit(0)), left - some * block)


def _draws(docs: DataFrame, seed: int) -> list[Column]:
    draw, turn = draws(F.lit(seed), docs["doc_id"].cast("long"), docs["text"])
    return [draw.alias("draw"), turn.alias("turn")]


def _mix(docs: DataFrame, weights: tuple[int, ...], limit: int, block: int, seed: int, shards: int, shard_rows: int) -> DataFrame:
    """One row for each group of equal rows (doc_id, source, text): m (how many), start (words before the group in
    its shard), and what the shard takes: turns times all its words, and `left` words more."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), *_draws(docs, seed))
    # equal rows are one row with a count, so repeats of one row can't fill a shard
    sized = shared_table(slim.groupBy("doc_id", "source", "size", "draw", "turn").agg(F.count("*").alias("m")), "sized")
    sources = shared_table(source_targets(sized, weights, limit), "sources")
    totals = sources.agg(F.sum("n").alias("__rows"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("__least"))
    # a block is at most a sixteenth of the least target, so that each source comes near its own
    unit = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.coalesce("__least", F.lit(1.0)) / 16))).cast("long")
    many = F.greatest(F.lit(float(shard_rows)), F.col("__rows") / shards)
    sources = sources.join(F.broadcast(totals)).select("source", "place", "source_size", "target", unit.alias("block"), F.ceil(F.col("n") / many).cast("long").alias("parts"))
    sources = sources.withColumn("seats", F.floor(F.col("target") / F.col("block") + 0.5).cast("long"))
    sources = sources.withColumn("wanted", F.least(F.col("seats") * F.col("block"), F.col("source_size") * limit))

    dealt = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(sized["*"], "place", "source_size", "target", "block", "seats", "wanted", F.pmod("draw", "parts").alias("shard"))
    parts = dealt.groupBy("place", "shard").agg(F.sum(F.col("size") * F.col("m")).alias("shard_size"), *[F.first(c).alias(c) for c in ("block", "seats", "wanted")])
    quotas = shared_table(_quotas(parts, limit).select("place", "shard", "shard_size", "quota"), "quotas")

    # the order in the shard doesn't follow the draw that chose the shard
    order = Window.partitionBy("place", "shard").orderBy("turn", "draw", "doc_id")
    placed = dealt.withColumn("start", F.sum(F.col("size") * F.col("m")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") * F.col("m")).join(quotas, ["place", "shard"])
    return placed.withColumn("turns", F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long")).withColumn("left", F.col("quota") - F.col("turns") * F.col("shard_size"))


OPTIONS = {"weights": (5, 2, 1), "limit": 3, "block": 64, "seed": 11, "shards": 4096, "shard_rows": 64}


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size (words), source_size, target, taken (words the mix takes, repeats counted); a row for each row.

    options: weights of the sources in order, repeating; limit: no document is taken more often; block: the
    greatest size of a block (a sixteenth of the least target where that is less, one word at least); seed;
    shards: a source has a shard for each `shard_rows` documents, or more documents a shard where there would be
    over about `shards` shards in all. A shard may have 3 * 10**9 blocks (beyond, the job fails).

    A null text has size 0 and takes nothing; a null source is a source of its own, the last; rows without doc_id
    count like others, each by its text. Repeated rows count each and stand side by side. Very long texts only
    count. An empty table gives an empty result. Other columns are not read.
    """
    o = OPTIONS | options
    placed = _mix(docs, **o)
    each = placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    each = each.withColumn("start", F.col("start") + F.col("at") * F.col("size"))
    before = lambda x: taken_before(x, F.col("shard_size"), F.col("left"), F.col("block"), draws(F.lit(o["seed"]), F.col("place"), F.col("shard"))[0])
    return each.select("doc_id", "size", "source_size", "target", (F.col("turns") * F.col("size") + before(F.col("start") + F.col("size")) - before(F.col("start"))).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, whole (0 to `limit` times); columns unchanged.

    The words of a shard are taken from its start, by whole documents, until its quota is nearest. Each row is
    decided by its doc_id, source and text; rows equal in all three are taken equally often. Rows without
    doc_id or source are mixed like others. Documents without words have nothing to be weighed by and stay, once."""
    o = OPTIONS | options
    placed = _mix(docs, **o)
    all_ = F.col("size") * F.col("m")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("turns") + F.when(F.col("start") + all_ / 2 < F.col("left"), 1).otherwise(0))
    names = {c: fresh(docs, c) for c in ("mix_id", "mix_source", "mix_draw", "mix_turn", "mix_copies", "mix_copy")}
    chosen = placed.select(F.col("doc_id").alias(names["mix_id"]), F.col("source").alias(names["mix_source"]), F.col("draw").alias(names["mix_draw"]), F.col("turn").alias(names["mix_turn"]), F.least(copies, F.lit(o["limit"])).cast("int").alias(names["mix_copies"])).where(F.col(names["mix_copies"]) > 0)
    draw, turn = draws(F.lit(o["seed"]), docs["doc_id"].cast("long"), docs["text"])
    same = (draw == F.col(names["mix_draw"])) & (turn == F.col(names["mix_turn"])) & docs["doc_id"].cast("long").eqNullSafe(F.col(names["mix_id"])) & docs["source"].eqNullSafe(F.col(names["mix_source"]))
    return docs.join(chosen, same).withColumn(names["mix_copy"], F.explode(F.sequence(F.lit(1), F.col(names["mix_copies"])))).select(*[docs[c] for c in docs.columns])
