"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is a number of words.  Complete epochs come first: every
document of a source is taken ``floor(target / size)`` times.  The rest of the
target is a weighted sample without replacement: each document has the key
``-ln(u) / quality`` and the smallest keys are taken until their words fill it.

No source is sorted as a whole.  Keys fall into buckets of equal expected
number; the buckets' words are summed per source, and only the one bucket in
which the sum passes the target is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of a source's keys.
BUCKETS = 4096
#: A document is taken this often at most.
MAX_EPOCHS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Quality weight from 0.25 to 1: the share of a text's characters that are no punctuation, digits or signs."""
    n = F.length(text)
    plain = F.length(F.regexp_replace(text, r"[\x21-\x40\x5B-\x60\x7B-\x7E]+", ""))
    return F.when(n > 0, F.lit(0.25) + F.lit(0.75) * plain / n).otherwise(F.lit(0.25))


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``__rank``, from 0: by code point, null last.  Sources are sorted by ranges, so that no task has them all."""
    order = [F.col("source").isNull(), F.col("source")]
    s = materialize(sizes.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    # A row a partition, not a source.
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    start = s.groupBy(F.col("__part").alias("p")).agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return s.join(F.broadcast(start), F.col("__part") == F.col("p")).withColumn("__rank", own + F.col("start")).drop("p", "start", "__part")


def sources_to_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sizes(source, source_size)`` -> with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share all
    words.  A target stops at MAX_EPOCHS times its source's size; what is above
    goes to the others by weight until none is above.  A round of sharing is one
    sum over the sources; each fills at least one more, so rounds end.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")).cast("double")
    t = materialize(_ranked(sizes).select("source", "source_size", weight.alias("__w")))
    cap = float(MAX_EPOCHS) * F.col("source_size")
    share, full = 0.0, -1
    while True:
        over = F.col("__w") * share > cap
        r = t.agg(
            F.sum("source_size").alias("all"), F.count_if(over).alias("full"),
            F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("__w"))).alias("open"),
        ).first()
        if r["full"] == full or not r["open"]:
            break
        share, full = (float(r["all"]) - (r["capped"] or 0.0)) / r["open"], r["full"]
    over = F.col("__w") * share > cap
    return t.select("source", "source_size", F.when(over, cap).otherwise(F.col("__w") * share).alias("target"))


def _drawn(docs: DataFrame, seed: int, quality, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """Size, bucket, and what orders a source's documents: the key first."""
    text, doc = F.col(text_col), F.col(id_col).cast("long")
    # Without an id the text draws, lest all such rows draw alike.
    own = F.coalesce(doc.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(F.md5(F.concat(own, F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    weight = F.greatest(F.coalesce(quality(text).cast("double"), F.lit(0.01)), F.lit(0.01))
    key = -F.log(u) / weight
    # Keys of a source spread as exponential ones do, about: this brings them near equal numbers in each bucket.
    bucket = F.least(F.floor(F.lit(BUCKETS) * (1 - F.exp(-key))).cast("int"), F.lit(BUCKETS - 1))
    return n_words(text), bucket, F.struct(key.alias("key"), F.coalesce(doc, F.lit(-1)).alias("doc"), F.xxhash64(text).alias("tie"))


def _plan(drawn: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``drawn(source, size, bucket, rank)`` -> per source what decides on each of its documents; a few columns, a row a source.

    Rows that nothing tells apart are one row with a number here: of the last
    such group that the sample reaches, ``__mix_some`` of ``__mix_equal`` are taken.
    """
    t = sources_to_targets(drawn.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    t = t.select(
        F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"),
        F.least(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0), F.lit(MAX_EPOCHS)).cast("int").alias("__mix_epochs"),
    ).withColumn("__mix_room", F.col("__mix_target") - F.col("__mix_epochs") * F.col("__mix_source_size"))
    same = F.col("source").eqNullSafe(F.col("__mix_source"))
    sums = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words")).join(t, same)
    run = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(run)).where("upto >= __mix_room")
    cut = sums.groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
    t = t.join(cut.select("source", F.col("c.bucket").alias("__mix_cut"), F.col("c.before").alias("__mix_before")), same, "left").drop("source")
    t = materialize(t)
    edge = drawn.where("size > 0").join(_small(t), same & (F.col("bucket") == F.col("__mix_cut")))
    edge = edge.groupBy("source", "rank").agg(F.first("size").alias("size"), F.count("*").alias("equal"), F.first("__mix_before").alias("b"), F.first("__mix_room").alias("room"))
    before = F.sum(F.col("size") * F.col("equal")).over(Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("room") - F.col("b") - F.coalesce(before, F.lit(0))
    edge = edge.withColumn("some", F.least(F.floor(left / F.col("size") + 0.5), F.col("equal"))).where("some > 0 and room > 0")
    last = edge.groupBy("source").agg(F.max(F.struct("rank", "some", "equal")).alias("l"))
    last = last.select("source", F.col("l.rank").alias("__mix_last"), F.col("l.some").alias("__mix_some"), F.col("l.equal").alias("__mix_equal"))
    return materialize(t.join(last, same, "left").drop("source"))


def _small(plan: DataFrame) -> DataFrame:
    """Broadcast up to 100,000 sources; more are joined by shuffle."""
    return F.broadcast(plan) if plan.count() <= 100_000 else plan


def _decided(rows: DataFrame, source: Column, plan: DataFrame) -> DataFrame:
    """``rows`` (with __mix_bucket, __mix_rank, __mix_size) with ``__mix_times``."""
    rows = rows.join(_small(plan), source.eqNullSafe(F.col("__mix_source")), "left")
    below = (F.col("__mix_bucket") < F.col("__mix_cut")) | (F.col("__mix_bucket") == F.col("__mix_cut")) & (F.col("__mix_rank") <= F.col("__mix_last"))
    more = F.when(F.col("__mix_cut").isNull(), F.col("__mix_room") > 0).otherwise(F.coalesce(below, F.lit(False)))
    times = lambda more: F.col("__mix_epochs") + F.when(more & (F.col("__mix_size") > 0), 1).otherwise(0)
    if plan.where("__mix_some < __mix_equal").isEmpty():  # no group of equal rows is taken in part
        return rows.withColumn("__mix_times", times(more))
    split = F.coalesce((F.col("__mix_some") < F.col("__mix_equal")) & (F.col("__mix_rank") == F.col("__mix_last")) & (F.col("__mix_bucket") == F.col("__mix_cut")), F.lit(False))
    # Equal rows are numbered where they lie, after being written; any of them will do.
    part = materialize(rows.where(split).withColumn("__mix_part", F.spark_partition_id()))
    counts = part.groupBy(F.col("__mix_source").alias("s"), F.col("__mix_part").alias("p")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("s", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__mix_start"))
    part = part.join(starts, F.col("__mix_source").eqNullSafe(F.col("s")) & (F.col("__mix_part") == F.col("p"))).drop("s", "p")
    number = F.row_number().over(Window.partitionBy("__mix_source", "__mix_part").orderBy("__mix_size")) + F.col("__mix_start")
    part = part.withColumn("__mix_number", number).withColumn("__mix_times", times(F.col("__mix_number") <= F.col("__mix_some")))
    return rows.where(~split).withColumn("__mix_times", times(more)).unionByName(part.drop("__mix_part", "__mix_start", "__mix_number"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, quality=letter_share, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken, times)`` of every row.

    ``times`` is how often the mix takes the document and ``taken`` its words
    times that; the last document of a sample is taken if at least half of it
    fits.  The random numbers come from an MD5 of id and seed, so reruns agree.
    A null text has size 0, a row without an id draws by its text, and null is a
    source of its own, the last.  Of rows alike in id and text as many are taken
    as fit, any of them.  Documents without words are taken with the epochs
    only.  A quality that is null or below 0.01 counts as 0.01.  No rows in, no
    rows out; other columns are left out.
    """
    size, bucket, rank = _drawn(docs, seed, quality, id_col, text_col)
    d = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), bucket.alias("bucket"), rank.alias("rank")))
    plan = _plan(d, weights)
    d = d.withColumnsRenamed({"bucket": "__mix_bucket", "rank": "__mix_rank"}).withColumn("__mix_size", F.col("size"))
    d = _decided(d, F.col("source"), plan)
    taken = (F.col("size") * F.col("__mix_times")).alias("taken")
    return d.select("doc_id", "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), taken, F.col("__mix_times").alias("times"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, quality=letter_share) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (``mixed`` says what of nulls, ties and repeats); columns as they came.

    Texts are not shuffled, but for equal rows that are taken in part.  A column
    of ``docs`` may not begin with ``__mix_``.
    """
    size, bucket, rank = _drawn(docs, seed, quality, "doc_id", "text")
    plan = _plan(materialize(docs.select("source", size.alias("size"), bucket.alias("bucket"), rank.alias("rank"))), weights)
    d = docs.withColumns({"__mix_bucket": bucket, "__mix_rank": rank, "__mix_size": size})
    d = _decided(d, F.col("source"), plan)
    return d.withColumn("__mix_time", F.explode(F.array_repeat(F.lit(1), F.col("__mix_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
