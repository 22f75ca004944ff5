"""Mixing sources to target weights by Poisson replication (operator 10, DataFrame functions only).

Each source has a target repetition rate: its share of the target mixture over
its share of the corpus.  A document's count is drawn by inverting the Poisson
distribution with that mean at a uniform number hashed from its id and a seed, so
a rerun, on any partitioning, draws the same counts.  A rate above ``LARGEST_MEAN``
is dealt into equal parts that are drawn one by one (a sum of Poisson numbers is
one), so the distribution's table stays short whatever the rate.  Documents are
exploded by their counts and dealt out in a global pseudo-random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, shuffle_partitions

#: Sources are broadcast if the names and the tables of their distributions have at most so many bytes; more are joined by shuffle.
MOST_BROADCAST = 8 << 20
#: Largest mean that is inverted at once.
LARGEST_MEAN = 16
#: Copies that one array holds at most.
COPIES = 4096
#: Fixed-point scale that makes the sum of weights independent of the order of addition.
SCALE = 1_000_000


def uniform(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 digest of the seed and the columns."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far into the upper tail, for a mean up to ``LARGEST_MEAN``."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    zero = F.struct((-mean).alias("log_p"), F.array(F.exp(-mean)).alias("below"))

    def step(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(mean) - F.log(k.cast("double"))
        return F.struct(log_p.alias("log_p"), F.concat(state["below"], F.array(F.element_at(state["below"], -1) + F.exp(log_p))).alias("below"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s["below"])


def rates(docs: DataFrame, source_col: str, size: Column, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """One row per source: its target repetition rate.

    ``weights`` are relative target shares (an unlisted source gets 0).  Without
    them a source's share is its size to the power ``1 / temperature``.  A source
    without mass has rate 0.
    """
    sizes = materialise(docs.groupBy(source_col).agg(F.sum(size).alias("mass")), "source-sizes")  # the corpus is counted once
    if weights is None:
        share = F.pow(F.col("mass").cast("double"), F.lit(1.0 / temperature))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col(source_col) == name, F.lit(float(weight))).otherwise(share)
    shares = sizes.withColumn("share", F.floor(share * SCALE).cast("long"))
    all_share, all_mass = shares.agg(F.sum("share"), F.sum("mass")).first()
    wanted = F.col("share").cast("double") / F.lit(float(all_share or 1)) * F.lit(float(all_mass or 0)) / F.col("mass").cast("double")
    return shares.select(source_col, F.when(F.col("mass") > 0, wanted).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Documents replicated to the target mixture: all columns of ``docs`` plus ``copy`` (from 0) and ``rate``.

    Mass is counted in characters.  A null source is a source of its own; null or
    empty text has no mass but is drawn like its source's other documents; a source
    whose texts are all empty has rate 0, so none of its documents is drawn; rows with
    equal ids (null ones too) draw equal counts; an empty table gives no rows.
    Where ``docs`` has a column of the name ``copy`` or ``rate`` the new one gets
    underscores after its name.
    """
    copy, rate, source, below, parts, n, start = fresh(docs, "copy", "rate", "mixed_source", "below", "parts", "n_copies", "copy_start")
    per_source = rates(docs, source_col, F.coalesce(F.length(text_col), F.lit(0)), weights, temperature)
    dealt = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("long")
    means = per_source.select(F.col(source_col).alias(source), F.col("rate").alias(rate), dealt.alias(parts))
    mean = F.col(rate) / F.col(parts)
    table = means.withColumn(below, F.when(F.col(rate) > 0, cumulative(mean)).otherwise(F.array(F.lit(2.0))))
    size = table.agg(F.sum(F.coalesce(F.octet_length(F.col(source).cast("string")), F.lit(0)) + 8 * F.size(below) + 64)).first()[0]
    if (size or 0) <= MOST_BROADCAST:
        table = F.broadcast(table)
    drawn = docs.join(table, docs[source_col].eqNullSafe(table[source])).drop(source)

    def one(part: Column) -> Column:
        """A part's number; the first is hashed from the id alone."""
        u = uniform(seed, F.col(id_col), *([] if part is None else [part]))
        return F.size(F.filter(below, lambda x: u >= x)).cast("long")

    more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col(parts) - 1), F.lit(0).cast("long"), lambda total, part: total + one(part))
    counted = drawn.withColumn(n, one(None) + F.when(F.col(parts) > 1, more).otherwise(0)).drop(below, parts).where(F.col(n) > 0)
    # in two steps, so that no array holds all copies of a document
    starts = counted.withColumn(start, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(COPIES).cast("long"))))
    copies = starts.withColumn(copy, F.explode(F.sequence(F.col(start).cast("int"), (F.least(F.col(start) + COPIES, F.col(n)) - 1).cast("int")))).drop(start, n)
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col(copy))
    return copies.repartition(shuffle_partitions(docs.sparkSession), place).sortWithinPartitions(place)
