"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected onto a few random axes, several times, each time shifted and
ordered along a Hilbert curve. The orderings are dealt by ranges of the curve; a query goes to the
ranges that its window on the curve touches and meets their rows in blocks. In the orderings a
vector is a row of bytes, about an eighth of its doubles: what is near by them, merged over the
curves, is reranked by the exact distance of the original vectors. Ranges and window come from a
bounded sample, the orderings hold every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, parts, table

#: Orderings, axes of each, bits of an axis.
CURVES, AXES, DEPTH = 8, 8, 7
#: Rows of the sample that fits the axes' quantiles, the ranges and the window; queries among them.
SAMPLE, PROBES = 6000, 300
#: Recall on the sample that the window must reach, the shares of a curve that are tried, and the least rows of it.
RECALL, SHARES, LEAST = 0.97, (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.065, 0.08, 0.1, 0.13, 0.17, 0.25, 0.35, 0.5), 256
#: Rows of a block, queries that meet a block at once, and candidates beyond k that a query keeps for the rerank.
BLOCK, QUERIES, MORE = 1 << 15, 1 << 16, 30


def hilbert(cells: np.ndarray, depth: int) -> np.ndarray:
    """Place of each row of cell numbers on the Hilbert curve with `depth` bits an axis."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    top = 1 << (depth - 1)
    q = top
    while q > 1:
        low, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(len(x)):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros(len(cells), np.uint64), top
    while q > 1:
        turn = np.where((x[-1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    key = np.zeros(len(cells), np.uint64)
    for bit in range(depth - 1, -1, -1):
        for v in x:
            key = (key << np.uint64(1)) | (((v ^ turn) >> np.uint64(bit)) & np.uint64(1))
    return key


class Curves:
    """Axes, quantiles of the sample on them, shifts of each ordering, and the ranges."""

    def __init__(self, sample: np.ndarray, k: int, n: int, queries: int, seed: int = 0):
        draw = np.random.default_rng(seed)
        dim = sample.shape[1]
        axes = min(AXES, dim)
        self.axes = [np.linalg.qr(draw.normal(size=(dim, dim)))[0][:, :axes] for _ in range(CURVES)]
        self.shift = draw.random((CURVES, axes)) / 2
        self.steps = [np.sort(sample @ a, axis=0) for a in self.axes]
        self.order = [np.sort(self.keys(sample, c)) for c in range(CURVES)]
        size = len(sample)
        share = max(self.share(sample, k), LEAST / max(1, n))
        #: Places are ranks in the sample; the window is a number of them on either side.
        self.window = min(size, int(np.ceil(share * size)))
        self.ranges = max(1, min(size, -(-n // BLOCK)))
        # A range with too many rows, as of a vector that is everywhere, is dealt to several blocks by id.
        of = [np.bincount(self.range(self.places(sample, c)), minlength=self.ranges) for c in range(CURVES)]
        self.blocks = [np.maximum(1, np.ceil(x / size * n / BLOCK)).astype(np.int64) for x in of]
        self.most = int(max(x.max() for x in self.blocks))
        self.batches = max(1, int(np.ceil(queries * min(1.0, 2 * share + 1 / self.ranges) / QUERIES)))

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        y, steps = x @ self.axes[curve], self.steps[curve]
        u = np.stack([np.searchsorted(steps[:, i], y[:, i]) for i in range(y.shape[1])], 1) / max(1, len(steps))
        cells = ((u + 2 * self.shift[curve]) / 2 * (1 << DEPTH)).astype(np.int64)
        return hilbert(np.minimum(cells, (1 << DEPTH) - 1), DEPTH).astype(np.int64)

    def places(self, x: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.order[curve], self.keys(x, curve))

    def range(self, place: np.ndarray) -> np.ndarray:
        return np.clip(place, 0, len(self.order[0])) * self.ranges // (len(self.order[0]) + 1)

    def unit(self, curve: int, at: np.ndarray, block: np.ndarray, batch: np.ndarray) -> np.ndarray:
        return ((curve * self.ranges + at) * self.most + block) * self.batches + batch

    def share(self, x: np.ndarray, k: int) -> float:
        """The least share of a curve, on either side, with enough recall on the sample."""
        probes = np.arange(0, len(x), max(1, len(x) // PROBES))
        k = min(k, len(x) - 1)
        if k < 1:
            return SHARES[-1]
        d = (x**2).sum(1)[None] - 2 * x[probes] @ x.T
        d[np.arange(len(probes)), probes] = np.inf
        near = np.argpartition(d, k - 1, 1)[:, :k]
        gap = np.full(near.shape, len(x))
        for c in range(CURVES):
            place = self.places(x, c)
            gap = np.minimum(gap, np.abs(place[near] - place[probes][:, None]))
        return next((s for s in SHARES if (gap <= s * len(x)).mean() >= RECALL), 1.0)


def _row(dim: int) -> np.dtype:
    """A row of an ordering: id, squared length, step of the bytes, place, whether it asks, bytes."""
    return np.dtype([("id", "<i8"), ("square", "<f8"), ("step", "<f8"), ("place", "<i4"), ("asks", "u1"), ("bytes", "i1", (dim,))])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _spread(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)).astype(np.int64)


def _order(shared, dim: int):
    def run(batches):
        curves = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch["embedding"], dim), batch["vec_id"].to_numpy()
            rows = np.zeros(len(x), _row(dim))
            rows["id"] = ids
            with np.errstate(over="ignore", invalid="ignore"):
                rows["square"] = (x * x).sum(1)
                rows["step"] = np.abs(x).max(1) / 127
                rows["bytes"] = np.rint(x / np.maximum(rows["step"], 5e-324)[:, None])
                places = [curves.places(x, c) for c in range(CURVES)]
            spread = _spread(ids)
            asks = np.flatnonzero(batch["asks"].to_numpy(zero_copy_only=False))
            for c, place in enumerate(places):
                rows["place"], rows["asks"] = place, 0
                at = curves.range(place)
                block = spread % curves.blocks[c][at]
                for b in range(curves.batches):
                    yield _units(curves.unit(c, at, block, b), rows)
                if not len(asks):
                    continue
                rows["asks"] = 1
                low, high = curves.range(place[asks] - curves.window), curves.range(place[asks] + curves.window)
                for step in range(int((high - low).max()) + 1):
                    there = low + step <= high
                    on, mine = low[there] + step, asks[there]
                    for block in range(int(curves.blocks[c][on].max()) if len(on) else 0):
                        some = block < curves.blocks[c][on]
                        yield _units(curves.unit(c, on[some], block, spread[mine[some]] // 7 % curves.batches), rows[mine[some]])

    return run


def _units(unit: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    raw = pa.py_buffer(rows.tobytes())
    body = pa.Array.from_buffers(pa.binary(rows.dtype.itemsize), len(rows), [None, raw])
    return pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), body.cast(pa.binary())], names=["unit", "row"])


def _meet(keep: int, window: int, dim: int):
    exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of products are whole numbers

    def run(met: pa.Table) -> pa.Table:
        rows = np.unique(np.frombuffer(b"".join(met["row"].to_pylist()), np.dtype((np.void, _row(dim).itemsize)))).view(_row(dim))
        q, x = rows[rows["asks"] == 1], rows[rows["asks"] == 0]
        x = x[np.argsort(x["id"], kind="stable")]
        ids, again = x["id"], len(np.unique(x["id"])) < len(x)
        bytes_ = x["bytes"].astype(exact)
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for at in range(0, len(q) if len(x) else 0, 64):
            part = q[at : at + 64]
            with np.errstate(over="ignore", invalid="ignore"):
                d = (part["bytes"].astype(exact) @ bytes_.T).astype(np.float64)
                d *= -2 * part["step"][:, None] * x["step"]
                d += part["square"][:, None]
                d += x["square"]
            # Lengths beyond the range of doubles: as far as can be.
            d[~np.isfinite(d)] = np.finfo(np.float64).max
            d[(np.abs(x["place"] - part["place"][:, None]) > window) | (ids == part["id"][:, None])] = np.inf
            for i in range(len(part)):
                mine = d[i]
                if keep < len(mine) and not again:
                    last = np.partition(mine, keep - 1)[keep - 1]
                    some = np.flatnonzero((mine <= last) & (mine < np.inf))
                else:
                    some = np.flatnonzero(mine < np.inf)
                some = some[np.lexsort((ids[some], mine[some]))]
                if again:
                    some = some[np.sort(np.unique(ids[some], return_index=True)[1])]
                some = some[:keep]
                out[0].append(np.full(len(some), part["id"][i]))
                out[1].append(ids[some])
                out[2].append(mine[some])
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "near": np.concatenate(out[2])})

    return run


def _distance(x: Column, y: Column) -> Column:
    """Euclidean distance in double precision; the differences are scaled where their squares leave its range."""
    gaps = F.zip_with(x, y, lambda a, b: a.cast("double") - b.cast("double"))
    most = F.array_max(F.transform(gaps, F.abs))
    plain = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    scaled = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + (g / most) * (g / most))
    fits = (plain > F.lit(1e-290)) & (plain < F.lit(float("inf")))
    return F.when(most == 0, F.lit(0.0)).when(fits, F.sqrt(plain)).otherwise(most * F.sqrt(scaled))


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The `k` nearest found of each query, by Euclidean distance.

    vectors: vec_id (integer) and embedding (array of numbers); other columns are ignored. Queries:
    rows whose vec_id is divisible by `every`; candidates: all rows but those of the query's own
    vec_id. Vectors that are null, empty or zero, or hold a null or a non-finite
    number, take no part, nor do rows with a null id or of another length than most (of lengths equally
    frequent, the shortest). An id that stands for several vectors is as near as the nearest of
    them, and is listed once, as is a row that repeats. Ties go to the smaller vec_id. Vectors too
    long for their square to be a double are found after all others. Returns query_id, rank (from
    1), vec_id, score; no rows for an empty table. All candidates come if there are fewer than k.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    if vectors.schema["embedding"].dataType.elementType.simpleString() not in ("float", "double"):
        e = e.cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    id_ = F.col("vec_id").cast("long")
    valid = vectors.select(id_.alias("vec_id"), e.alias("embedding"), (id_ % every == 0).alias("asks")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)
    sizes = valid.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asks"))
    size = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, asks = size[0]
    valid = valid.where(F.size("embedding") == dim)
    taken = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    with np.errstate(over="ignore", invalid="ignore"):
        curves = Curves(_matrix(taken, dim), k, n, asks)
    keep = k + MORE
    rows = valid.mapInArrow(_order(spark.sparkContext.broadcast(curves), dim), "unit long, row binary")
    units = int(sum(x.sum() for x in curves.blocks)) * curves.batches
    met = rows.repartition(max(parts(spark), units), "unit").groupBy("unit").applyInArrow(_meet(keep, curves.window, dim), "query_id long, vec_id long, near double")
    met = met.groupBy("query_id", "vec_id").agg(F.min("near").alias("near"))
    best = met.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "vec_id"))).where(F.col("at") <= keep)
    best = materialize(best.select("query_id", F.col("vec_id").alias("found")))
    theirs = best.join(valid.select("vec_id", F.col("embedding").alias("x")), F.col("found") == F.col("vec_id")).select("query_id", "found", "x")
    own = valid.where("asks").select(F.col("vec_id").alias("asked"), F.col("embedding").alias("y"))
    both = theirs.join(own, F.col("query_id") == F.col("asked"))
    out = both.groupBy("query_id", F.col("found").alias("vec_id")).agg(F.min(_distance(F.col("y"), F.col("x"))).alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))
