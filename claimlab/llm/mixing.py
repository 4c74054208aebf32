"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations.

Each source's documents are shuffled by a seeded hash and queue up, as often as the cap
allows.  A serving's virtual finish time is the words its source has queued up to its
end, divided by the source's target.  All servings are sorted by virtual finish time in
ranges of it, their words are summed up in that order, and the mix ends where the sum
reaches the budget, the sum of the targets in whole words.

All sources that still have words progress at the same virtual speed, so the budget ends
at virtual time 1.  The serving that a source has in service then is parted there into
two packets, so that what was served of it comes before the cut and each source has its
target to the word.

Queued words and the sums over the order are prefix sums in three steps - over groups of
buckets, over the buckets of a group, inside a bucket - so no task holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, unused

SEED = 20_240_607
WORD = r"[^\x20\x09-\x0D]+"
#: Rows a bucket holds on average, and buckets a group.
BUCKET_ROWS, GROUP = 512, 4_096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bases(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bucket, base: the words of all earlier buckets of the same keys.  ``sums``
    has keys, bucket, words, one row per bucket."""
    grouped = sums.withColumn("group", F.floor(F.col("bucket") / GROUP).cast("long"))
    before = lambda part, by: F.coalesce(F.sum("words").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy(*keys, "group").agg(F.sum("words").alias("words"))
    groups = groups.select(*keys, "group", before(keys, "group").alias("earlier"))
    inside = grouped.select(*keys, "group", "bucket", before([*keys, "group"], "bucket").alias("own"))
    return inside.join(groups, [*keys, "group"]).select(*keys, "bucket", (F.col("earlier") + F.col("own")).alias("base"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source, rank, source_size, n, target.

    Sources by code point, null last, take the weights in turn.  Targets are
    min(cap x size, weight x level).  The level at which they share the budget is found
    by letting all sources share, taking out those that are full at that level, and so
    on until no other is.  A source's rank is its place in its sorted partition after
    the rows of the partitions before: the sources themselves, which may be as many as
    there are hosts, are in no single task and never at the driver.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    placed = materialise(per_source.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("rows"))
    parts = parts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (placed.withColumn("part", F.shiftright("at", 33)).join(parts, "part")
              .withColumn("rank", F.col("earlier") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("weight", weight).withColumn("most", cap * F.col("source_size")))
    ranked = materialise(ranked.select("source", "rank", "source_size", "n", "weight", "most"), "ranked")
    budget, level, full = (ranked.agg(share * F.sum("source_size")).first()[0] or 0.0), 0.0, -1
    while True:
        is_full = F.col("most") <= F.col("weight") * level
        n, taken, weight_left = ranked.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not weight_left:
            break
        full, level = n, (budget - taken) / weight_left
    targets = materialise(ranked.select("source", "rank", "source_size", "n", F.least("most", F.col("weight") * F.lit(level)).alias("target")), "targets")
    discard(placed, ranked)
    return targets


def servings(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The queue - one row per row: doc_id, size, source_size, target, rank, bucket, nr -
    and the mix: rank, bucket, nr, serving, words, finish, before, taken, one row per
    packet of a serving that the sources queue.

    ``before`` are the words of all packets with an earlier (finish, rank, serving,
    place); ``taken`` those of the packet that the budget still has.
    """
    passes = math.ceil(cap)
    sizes = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                    word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col)).alias("place")), "sizes")
    sources = source_targets(sizes, weights, share, cap)
    rows, budget = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()
    bits = max(0, round(math.log2(max(1, rows / BUCKET_ROWS))))
    queued = (sizes.join(sources.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its", "source", "n")
              .withColumn("bucket", F.shiftrightunsigned(F.col("place"), 64 - bits) if bits else F.lit(0).cast("long")))
    # Places compare as unsigned, as their leading bits do.
    in_bucket = Window.partitionBy("rank", "bucket").orderBy(F.shiftrightunsigned("place", 1), "place", "doc_id", "size")
    queued = queued.withColumn("nr", F.row_number().over(in_bucket)).withColumn("inside", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    queued = materialise(queued, "queued")
    sums = queued.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    begun = queued.join(bases(sums, ["rank"]), ["rank", "bucket"]).withColumn("queued", F.col("base") + F.col("inside"))

    each = begun.where("size > 0 AND target > 0").withColumn("serving", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    each = each.withColumn("begin", F.col("queued") + F.col("serving") * F.col("source_size"))
    in_time = F.least(F.greatest(F.floor("target") - F.col("begin"), F.lit(0)), F.col("size")).cast("long")
    packet = lambda begin, words: F.struct(words.alias("words"), ((begin + words) / F.col("target")).alias("finish"))
    parted = F.array(packet(F.col("begin"), in_time), packet(F.col("begin") + in_time, F.col("size") - in_time))
    packets = each.withColumn("p", F.explode(parted)).where("p.words > 0")
    packets = packets.select("rank", "bucket", "nr", "serving", "p.words", "p.finish")
    # Words pass at an even rate of virtual time, so ranges of it hold alike many.
    packets = materialise(packets.withColumn("range", F.floor(F.col("finish") * F.lit(max(1.0, passes * rows / BUCKET_ROWS))).cast("long")), "packets")
    by_range = bases(packets.groupBy("range").agg(F.sum("words").alias("words")).withColumnRenamed("range", "bucket"), []).withColumnRenamed("bucket", "range")
    order = Window.partitionBy("range").orderBy("finish", "rank", "serving", "bucket", "nr")
    before = F.col("base") + F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    mixed = packets.join(by_range, "range").withColumn("before", before)
    mixed = mixed.withColumn("taken", F.least(F.greatest(F.lit(budget) - F.col("before"), F.lit(0)), F.col("words")))
    return queued.select("doc_id", "size", "source_size", "target", "rank", "bucket", "nr"), mixed.drop("base")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row: doc_id, size, source_size, target, taken.

    ``taken`` counts repeats and is at most ``cap`` times the size, rounded up to whole
    servings.  Null text has size 0, null source is a source; rows that are wholly equal
    have their queue places in either order; an empty table gives an empty result.
    Other columns are ignored.
    """
    queued, mixed = servings(docs, **options)
    took = mixed.groupBy("rank", "bucket", "nr").agg(F.sum("taken").alias("taken"))
    return queued.join(took, ["rank", "bucket", "nr"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, whole, as often as the mix takes them: ``taken / size``
    rounded (half up), so a document in service at the cut is in if half of it was, and
    a source is off its target by half a document at most.  Columns are those of
    ``docs``; documents without words are never taken; of rows that share an id each is
    taken as often as its own text is."""
    its, times, nr, words, theirs, size = unused(docs, "its", "times", "nr", "words", "theirs", "size")
    took = mix(docs, **options).select(F.col("doc_id").alias(its), F.col("size").alias(words), F.floor(F.try_divide("taken", "size") + 0.5).cast("int").alias(times))
    took = materialise(took.where(F.col(times) > 0), "taken")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(its))
    if not took.groupBy(its).count().where("count > 1").limit(1).count():
        joined = docs.join(took.hint("merge"), same)
    else:
        # Rows of one id and size change places without loss.
        mine = Window.partitionBy("doc_id", words).orderBy("text")
        ranked = docs.withColumn(words, word_count(F.col("text"))).where(F.col(words) > 0).withColumn(nr, F.row_number().over(mine))
        place = took.withColumn(theirs, F.row_number().over(Window.partitionBy(its, words).orderBy(F.col(times).desc()))).withColumnRenamed(words, size)
        joined = ranked.join(place, same & (F.col(words) == F.col(size)) & (F.col(nr) == F.col(theirs)))
    return joined.withColumn(nr, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
