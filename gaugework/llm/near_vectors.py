"""Near-duplicate embeddings by counting collisions in one-dimensional projections.

Every vector is projected on two sets of random directions. A direction's sorted list holds the
vectors for which it is among their few strongest of its set, and lists are kept for pairs of
directions, one of either set, so that they stay short while the sets grow only with the square
root of the number of vectors. In each sorted list a window is centred on every vector; vectors in
it collide. Pairs are verified in double precision if they collide at least as often as all but a
small share of pairs at the threshold do, which is found by simulation.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, pick, ready_python, stage, table

#: Directions of either set in which a vector is listed at least and at most, and vectors of a list on average.
STRONGEST, MOST, LIST_ROWS = 6, 40, 16
#: Half width of a window, in standard deviations of the projected difference of a pair at the threshold.
WINDOW = 2.5
#: Share of pairs at the threshold that the count must let pass, and simulated pairs.
RECALL, SIMULATED = 0.97, 4000
#: Rows of a list that meet in one block of a cell, and pairs of one batch.
BLOCK, PAIRS = 2048, 1 << 18
SEED = 11


@lru_cache(maxsize=2)
def directions(dim: int, count: int) -> np.ndarray:
    """Both sets of random directions, side by side; set members also stand for their opposites. Made once for each process."""
    return np.random.Generator(np.random.PCG64([SEED, dim, count])).standard_normal((dim, 2 * count), dtype=np.float32)


def set_size(rows: int, listed: int = STRONGEST) -> int:
    """Directions of a set, so that lists have LIST_ROWS vectors on average."""
    return max(listed + 2, math.ceil(math.sqrt(rows * listed**2 / LIST_ROWS) / 2))


def strongest(unit: np.ndarray, count: int, listed: int = STRONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(list keys, projections) of unit vectors, listed ** 2 each."""
    seen = unit.astype(np.float32) @ directions(unit.shape[1], count)
    names, values = [], []
    for half in (seen[:, :count], seen[:, count:]):
        top = np.argpartition(-np.abs(half), listed - 1, axis=1)[:, :listed]
        value = np.take_along_axis(half, top, axis=1)
        names.append(2 * top + (value < 0))
        values.append(np.abs(value))
    keys = (names[0][:, :, None].astype(np.int64) * (2 * count) + names[1][:, None, :]).reshape(len(unit), -1)
    return keys, np.repeat(values[0], listed, axis=1)


def collisions(dim: int, count: int, cosine: float, listed: int, pairs: int, seed: int) -> tuple[np.ndarray, float]:
    """(collisions of simulated pairs of this cosine, half width of a window)."""
    random = np.random.Generator(np.random.PCG64([SEED, dim, count, seed]))
    width, hits = WINDOW * math.sqrt(2 - 2 * cosine), []
    while pairs > 0:
        n = min(pairs, max(16, (1 << 24) // count))
        pairs -= n
        x = random.standard_normal((n, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = random.standard_normal((n, dim))
        z -= (z * x).sum(axis=1, keepdims=True) * x
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        y = cosine * x + math.sqrt(1 - cosine * cosine) * np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
        (kx, vx), (ky, vy) = strongest(x, count, listed), strongest(y, count, listed)
        for a, v, b, w in zip(kx, vx, ky, vy):
            _, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            hits.append(int((np.abs(v[at] - w[bt]) <= width).sum()))
    return np.array(hits), width


@lru_cache(maxsize=8)
def calibrate(dim: int, rows: int, cosine: float) -> tuple[int, int, int, float]:
    """(directions of a set, lists of a vector in a set, least collisions, half width of a window) for so many vectors.

    The count to pass is the one that RECALL of the simulated pairs at the threshold reach. Lists grow
    with the table, so pairs share fewer of them; a vector then stands in more, until the count is at
    least one. If that isn't enough, the promise can't be kept and this raises.
    """
    for listed in range(STRONGEST, min(MOST, max(STRONGEST, 64 * dim)) + 1):
        count = set_size(rows, listed)
        hits, width = collisions(dim, count, cosine, listed, SIMULATED, 1)
        least = int(np.quantile(hits, 1 - RECALL, method="lower"))
        if least >= 1:
            return count, listed, least, width
    raise ValueError(f"{rows} vectors of {dim} dimensions can't be compared with a recall of {RECALL}")


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def near_vectors(embeddings: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors are one vector with a multiplicity until the end. Vectors that are null, empty,
    zero or have a null or non-finite component link with nothing, as do vectors of different lengths
    and rows with a null vec_id (whose component is null and kept false). Repeated rows stay and count
    as links. Extra columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    ready_python(spark)
    rows = pick(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    reps = stage(rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding")), "vectors")
    dims = [(r[0], r[1]) for r in reps.groupBy("dim").count().collect()]
    links = None
    for dim, n in sorted(dims):
        found = _links(reps.where(F.col("dim") == dim), dim, n, cosine)
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    # One id could stand for two different vectors; its rows then share links and component.
    links = stage(links.where("a != b").distinct(), "links")
    copies = reps.groupBy("id").agg(F.sum("copies").alias("copies"))
    ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = ends.join(copies.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "id")
    whole = reps.join(counted, "id", "left").join(components(links), "id", "left")
    whole = whole.select(F.col("embedding").alias("e"), F.col("id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    out = rows.withColumn("sound", sound).join(whole, F.col("sound") & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _links(reps: DataFrame, dim: int, n: int, cosine: float) -> DataFrame:
    count, lists_each, least, width = calibrate(dim, n, cosine)

    def listed(batches):
        for batch in batches:
            if len(batch):
                x = _vectors(batch, "embedding")
                x = x / np.abs(x).max(axis=1, keepdims=True)
                keys, values = strongest(x / np.linalg.norm(x, axis=1, keepdims=True), count, lists_each)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(values.ravel()), batch.column("id").take(pa.array(np.repeat(np.arange(len(x)), keys.shape[1])))], ["key", "value", "id"])

    lists = reps.select("id", "embedding").mapInArrow(listed, "key long, value float, id long")
    # Only lists too long for one block are counted apart, so that a long one is never a task of its own.
    lists = stage(lists, "lists")
    long = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).alias("k"))
    lists = lists.join(long, "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    lists = lists.withColumn("block", F.pmod(F.xxhash64("id"), "k"))
    cells = lists.select("key", "value", "id", "block", F.explode(F.expr("sequence(0L, k - 1)")).alias("other"))
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "value", "id")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "value")

    def collide(batches):
        held = None
        for batch in batches:
            got = pa.Table.from_batches([batch])
            held = got if held is None else pa.concat_tables([held, got])
            starts = begins(held)
            if len(held) - starts[-1] < len(held) // 2 or len(held) > 4 * BLOCK:
                yield from pairs(held.slice(0, starts[-1]))
                held = held.slice(starts[-1]).combine_chunks()
        if held is not None:
            yield from pairs(held)

    def begins(t):
        keys = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
        return np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if len(t) else np.zeros(1, dtype=np.int64)

    def pairs(t):
        if not len(t):
            return
        starts = begins(t)
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(t)]))
        value, ids, block = (t.column(c).to_numpy() for c in ("value", "id", "block"))
        same = t.column("i").to_numpy() == t.column("j").to_numpy()
        # Values are sorted within a group; a step beyond any value between groups makes one sorted line.
        line = value.astype(np.float64) + group * 1e3
        until = np.searchsorted(line, line + width, side="right")
        reach = until - np.arange(len(line)) - 1
        done = 0
        while done < len(line):
            upto = max(done + 1, int(np.searchsorted(np.cumsum(reach[done:]), PAIRS, side="right")) + done)
            n_here = reach[done:upto]
            left = np.repeat(np.arange(done, upto), n_here)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n_here) - n_here, n_here)
            ok = same[left] | (block[left] != block[right])
            a, b = ids[left[ok]], ids[right[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            done = upto

    often = cells.mapInArrow(collide, "a long, b long").groupBy("a", "b").count().where(F.col("count") >= least).select("a", "b")
    vectors = reps.select("id", "embedding")
    both = often.join(vectors.select(F.col("id").alias("a"), F.col("embedding").alias("x")), "a").join(vectors.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")

    def verify(batches):
        for batch in batches:
            if len(batch):
                x, y = _vectors(batch, "x"), _vectors(batch, "y")
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                near = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= cosine
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of cosine 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
