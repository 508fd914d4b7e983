"""Problem 8: mixing sources to target weights.

Each source's target is its share of the weights times the size of all documents in tokens. A source gets
whole copies of all its documents as often as they fit (certain, at most max_repeats); the rest is a sample
without replacement, drawn by Pareto order sampling with inclusion probabilities p in proportion to a
document's size. Documents for which that would exceed 1 are certain too, and the others share what is left
of the missing size (inclusion). Documents are ranked by (u / (1 - u)) / (p / (1 - p)), u being a hash of the
document, and the sample is the beginning of that order that comes closest to the missing size.

The order is never sorted in one task: ranks fall into buckets, of which only sums are gathered; documents
of full buckets are taken, and only the bucket in which a source's target falls is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvartal.session import checkpointed

#: Buckets of the Pareto order per source.
BUCKETS = 4096
SEED = 20_240_601


def _clean_targets(targets: DataFrame) -> DataFrame:
    """One row per source: weights of repeated rows add up, the largest max_repeats holds. Rows without a
    source or a positive weight are left out."""
    own = targets.where("source IS NOT NULL AND weight > 0").select("source", F.col("weight").cast("double").alias("weight"), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("long").alias("repeats"))
    own = own.groupBy("source").agg(F.sum("weight").alias("weight"), F.greatest(F.max("repeats"), F.lit(0)).alias("repeats"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("weight").alias("_all")))).select("source", (F.col("weight") / F.col("_all")).alias("share"), "repeats")


def inclusion(docs: DataFrame) -> DataFrame:
    """source, _certain, _rate: documents of _certain tokens or more are taken for certain, the others with probability
    _rate times their tokens, so that the expected size is the missing one. docs: source, n_tokens, _missing (the
    same for all documents of a source).

    Works on the distinct sizes of a source, which are no more than the tokens of its longest document: from
    the largest down, the first size at which the rest's probabilities stay below 1 ends the certain ones.
    """
    sizes = docs.groupBy("source", "n_tokens").agg(F.count("*").alias("_n"), F.first("_missing").alias("_missing"))
    down = Window.partitionBy("source").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.desc("n_tokens")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = F.col("n_tokens").cast("double")
    held = F.coalesce(F.sum(F.col("_n") * s).over(down), F.lit(0.0))
    rate = (F.col("_missing") - held) / F.sum(F.col("_n") * s * s).over(rest)
    rated = sizes.withColumn("_rate", rate).where((F.col("_rate") > 0) & (F.col("_rate") * s < 1))
    best = rated.groupBy("source").agg(F.max(F.struct("n_tokens", "_rate")).alias("x"))
    return best.select("source", (F.col("x.n_tokens") + 1).alias("_certain"), F.col("x._rate").alias("_rate"))


def plan_copies(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """key, source, n_tokens, copies: how often each document stands in the mix; documents that are not in it
    give no row.

    sizes: key, source, n_tokens of every document. A document without source or of a source that isn't
    listed has no share, but its tokens count for the size of the whole. Documents without tokens are not
    sampled. Repeated rows are documents of their own.
    """
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("_total"))
    per_source = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("_size"))
    plan = _clean_targets(targets).join(per_source, "source").crossJoin(total)
    target = F.col("share") * F.col("_total")
    whole = F.least(F.floor(target / F.col("_size")), F.col("repeats"))
    missing = F.when(whole < F.col("repeats"), target - whole * F.col("_size")).otherwise(0.0)
    # One row per listed source.
    plan = F.broadcast(checkpointed(plan.select("source", whole.cast("int").alias("_whole"), missing.alias("_missing"))))
    held = sizes.where("n_tokens > 0").join(plan, "source")
    held = held.join(F.broadcast(checkpointed(inclusion(held.where("_missing > 0")))), "source", "left")
    # Without a rate all of them are missing but less than the smallest document, or all are certain.
    sure = F.coalesce(F.col("n_tokens") >= F.col("_certain"), F.lit(False))
    p = F.least(F.greatest(F.coalesce(F.col("_rate") * F.col("n_tokens"), F.lit(1e-9)), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("source")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    q = (u / (1 - u)) / (p / (1 - p))
    docs = held.withColumn("_rank", F.when(sure, 0.0).otherwise(q / (1 + q))).withColumn("_bucket", F.floor(F.col("_rank") * BUCKETS).cast("int"))
    # Buckets before the one that crosses the target are taken whole.
    sums = docs.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_in"), F.first("_missing").alias("_missing"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("_before", before).where("_before <= _missing AND _before + _in > _missing").select("source", F.col("_bucket").alias("_edge"), F.col("_before").alias("_held"))
    docs = docs.join(F.broadcast(checkpointed(edge)), "source", "left")
    at_edge = F.coalesce((F.col("_missing") > 0) & (F.col("_bucket") == F.col("_edge")), F.lit(False))
    taken = (F.col("_missing") > 0) & (F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge")))
    clear = docs.where(~at_edge).withColumn("_extra", taken.cast("int"))
    order = Window.partitionBy("source", "_bucket").orderBy("_rank", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The document that crosses the target is taken if that comes closer than leaving it.
    nearer = F.col("_held") + F.sum("n_tokens").over(order) - F.col("n_tokens") / 2.0 <= F.col("_missing")
    drawn = clear.unionByName(docs.where(at_edge).withColumn("_extra", nearer.cast("int")))
    return drawn.select(key, "source", "n_tokens", (F.col("_whole") + F.col("_extra")).cast("int").alias("copies")).where("copies > 0")


def mix_report(sizes: DataFrame, targets: DataFrame, copies: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, documents, most_copies of every listed source."""
    total = copies.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")), F.lit(0)).alias("_total"))
    got = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    out = _clean_targets(targets).join(got, "source", "left").crossJoin(F.broadcast(total))
    tokens = F.coalesce(F.col("tokens"), F.lit(0))
    return out.select(
        "source", F.col("share").alias("target_share"), F.when(F.col("_total") > 0, tokens / F.col("_total")).otherwise(0.0).alias("actual_share"),
        tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )


def sized(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, source, n_tokens of every document, computed once."""
    from kvartal.llm.tokenize import count_tokens

    return checkpointed(count_tokens(documents, [key, "source"]))
