"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and stand in a queue, up to three
times over. A document's virtual finish time is the source's tokens up to and with
it, divided by the source's target; the whole queue is range-sorted by that time and
cut where the total budget is used up. Running sums are offsets per range plus a
sum inside the range, so a source with most of the rows is no task of its own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, raw, spread_rank, table

def _sizes(batches):
    for batch in batches:
        n = [len(t.split()) if t else 0 for t in raw(batch["text"])]
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), pa.array(n, pa.int64())], names=[*names, "size"])


def targets(sources: DataFrame, budget: float, times: int = 3) -> DataFrame:
    """`sources` (source, n, w) with `target`: the budget by weight; who would pass `times` its size
    stops there and the rest is shared again, until none is above. Only the level, words for
    each weight, comes to the driver; it rises from round to round until no source more stops."""
    full = F.lit(float(times)) * F.col("n")
    level, stopped = 0.0, -1
    while True:
        stops = full < F.lit(level) * F.col("w")
        row = sources.agg(F.sum(F.when(stops, full)), F.sum(F.when(~stops, F.col("w"))), F.count(F.when(stops, 1))).first()
        if row[2] == stopped:
            break
        stopped, left = row[2], budget - (row[0] or 0.0)
        level = left / row[1] if row[1] else float("inf")
    return sources.withColumn("target", F.when(stops, full).otherwise(F.lit(level) * F.col("w")))


def weighted(sizes: DataFrame, weights: dict | None) -> DataFrame:
    """source, n and w: 1, 2, 3, repeating, by code point with null last, or the given weights."""
    if weights is not None:
        given = sizes.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "_s string, w double")
        return sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = spread_rank(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"])
    per = placed.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(F.broadcast(per.select("_p", before.alias("before"))), F.col("_part") == F.col("_p"))
    return placed.select("source", "n", (1 + (F.col("before") + F.col("_at")) % 3).cast("double").alias("w"))


def _running(spread: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """`spread` with ``_sum``: the running sum of `value` in each group, its own row
    included. The order is that of spread_rank, whose first columns are the groups."""
    per = spread.groupBy("_part", *groups).agg(F.sum(value).alias("_in"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in").withColumnRenamed("_part", "_p")
    for i, g in enumerate(groups):
        per = per.withColumnRenamed(g, f"_g{i}")
    inside = Window.partitionBy("_part", *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = spread.withColumn("_own", F.sum(value).over(inside))
    same = own["_part"] == per["_p"]
    for i, g in enumerate(groups):
        same = same & own[g].eqNullSafe(per[f"_g{i}"])
    drop = ["_p", "_own", "_before", *(f"_g{i}" for i in range(len(groups)))]
    return own.join(per, same).withColumn("_sum", F.col("_own") + F.col("_before")).drop(*drop)


def mix(docs: DataFrame, weights=None, share: float = 1.0, times: int = 3, seed: int = 0) -> DataFrame:
    """What each document gives to the mix.

    docs: doc_id (integer), source, text. Size: words between ASCII white space, 0
    for a null. `weights`: source to weight; by default 1, 2, 3, repeating, over the
    sources by code point with null, a source like any other, last. The budget is
    `share` of all words. Each row is a document, repeated rows too; their order in
    the queue is by hash, then doc_id, so reruns agree. Returns doc_id, source, size,
    source_size, target, taken; the words of as many whole passes as finish in time.
    A source without words has target and taken 0; who ties at the cut shares the others' fate. Sources
    without a given weight are left out. Other columns are ignored; an empty table gives an empty mix.
    """
    cols = docs.select("doc_id", "source", "text").mapInArrow(_sizes, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, size long")
    sized = materialize(cols.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))))
    sizes = materialize(sized.groupBy("source").agg(F.sum("size").alias("n")))
    budget = share * (sizes.agg(F.sum("n")).first()[0] or 0)
    of = materialize(targets(materialize(weighted(sizes, weights)), budget, times)).select(F.col("source").alias("_source"), F.col("n").alias("source_size"), "target")
    queue = spread_rank(sized, ["source", "_h", "doc_id", "size"])
    queue = _running(queue, "size", ["source"]).join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_part", "_at")
    queue = materialize(queue)
    # Every pass is ranked: when documents are large against their target, the cut may fall at any time.
    turn = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("turn")
    finish = (F.col("turn") * F.col("source_size") + F.col("_sum")) / F.col("target")
    served = queue.where("size > 0 AND target > 0").select("_sum", "source_size", "target", "size", turn).select(finish.alias("finish"), "size")
    line = _running(spread_rank(served, ["finish", "size"]), "size", [])
    # Who would finish when the budget is passed, or later, is not served; equal times share their fate.
    over = line.where(F.col("_sum") > budget).agg(F.min("finish")).collect()[0][0]
    # None: all passes together stay within the budget, and all are served.
    over = float("inf") if over is None else over
    passes = sum((F.when((F.lit(t) * F.col("source_size") + F.col("_sum")) / F.col("target") < F.lit(over), 1).otherwise(0) for t in range(times)), F.lit(0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * passes).otherwise(F.lit(0)).cast("long")
    return queue.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op5(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
