"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's target is a number of words: whole passes over all its documents and a rest. Documents
are dealt into blocks by a keyed hash and the blocks of a source are put in a keyed permutation; the
rest is the first blocks of it, the last one cut within a block and a document so that the words
taken are the target's. Block copies go to output shards by quotas that a splitting tree draws: each
node parts the block counts of all sources between its halves, without replacement, so every shard
has an exact share and no block copy is in two shards. Within a shard rows are ordered by a keyed hash.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, stage, table

# Fixed values of the standard mix: weights of the sources in order, share of all words, most repeats.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), Fraction(3, 2), 2
#: Documents of a block and words of an output shard, on average; shards are no more than SHARDS.
BLOCK_ROWS, SHARD_WORDS, SHARDS = 256, 1 << 22, 4096
#: Blocks of a stripe, within which the block is looked for at which a source's share ends.
STRIPE_BLOCKS = 1024
#: With more sources than this, their figures are joined by a shuffle and not broadcast.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, repeats: int = REPEATS) -> list[Fraction]:
    """Words for each source: by weight, no more than `repeats` times its size, the excess shared anew."""
    total, out, open_ = share * sum(sizes), [Fraction(0)] * len(sizes), list(range(len(sizes)))
    while open_:
        rest = total - sum(out[k] for k in range(len(sizes)) if k not in open_)
        for k in open_:
            out[k] = rest * weights[k] / sum(weights[x] for x in open_)
        above = [k for k in open_ if out[k] > repeats * sizes[k]]
        if not above:
            break
        for k in above:
            out[k] = Fraction(repeats * sizes[k])
        open_ = [k for k in open_ if k not in above]
    return out


def splitting_tree(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Quotas by (shard, source) that sum to counts; shards differ by one block in all at most."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)

    def part(left: int, right: int, have: np.ndarray) -> None:
        if right - left == 1:
            out[left] = have
            return
        middle = (left + right) // 2
        draws = int(have.sum()) * (middle - left) // (right - left)
        random = np.random.Generator(np.random.PCG64([seed, left, right]))
        mine = random.multivariate_hypergeometric(have, draws, method="marginals")
        part(left, middle, mine)
        part(middle, right, have - mine)

    part(0, shards, np.array(counts, dtype=np.int64))
    return out


def _number(seed: int, *parts) -> int:
    return int.from_bytes(hashlib.sha256(repr((seed, *parts)).encode()).digest()[:7], "big")


def plan_mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, repeats: int = REPEATS, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole repeats), part (words of one more), taken, shards and key of every row.

    Sources stand in code point order, null last, and take the weights in turn. The driver learns one
    row for each source. Reruns agree: draws depend on the seed, doc_id, the text and counts only, and
    rows equal in those are interchangeable. Documents without words are taken with their block, as
    zero words. Null texts have size 0; a source without words has target 0; an empty table gives no
    rows. Extra columns are ignored.
    """
    spark = documents.sparkSession
    rows = pick(documents, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("key"))
    rows = stage(rows, "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [r[1] for r in found]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(found))], share, repeats)
    info = []
    for k, (r, t) in enumerate(zip(found, goal)):
        blocks = max(1, r[2] // BLOCK_ROWS)
        step = _number(seed, "step", k) % blocks or 1
        while math.gcd(step, blocks) > 1:
            step += 1
        passes = int(t // sizes[k]) if sizes[k] else 0
        info.append((r[0], sizes[k], float(t), passes, round(t) - passes * sizes[k], blocks, step % blocks if blocks > 1 else 1, _number(seed, "shift", k) % blocks))
    schema = "source string, source_size long, target double, passes int, rest long, blocks long, step long, shift long"
    spread = F.broadcast if len(info) <= BROADCAST_SOURCES else (lambda df: df)
    of = spread(spark.createDataFrame(info, schema)).alias("of")
    joined = rows.alias("r").join(of, F.col("r.source").eqNullSafe(F.col("of.source")), "left").drop(F.col("of.source"))
    block = F.pmod(F.col("key"), F.col("blocks"))
    joined = joined.withColumn("rank", F.pmod(block * F.col("step") + F.col("shift"), F.col("blocks")))
    # Words before each block in its source's permutation; then documents are counted only within the block that is cut.
    totals = joined.groupBy("source", "rank").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    totals = totals.withColumn("stripe", F.floor(F.col("rank") / STRIPE_BLOCKS))

    def last_before(rows, at):
        """The last row of each source, in order of `at`, before which the words aren't yet the rest."""
        ahead = F.sum("words").over(Window.partitionBy("source").orderBy(at)) - F.col("words") + F.col("start")
        rows = rows.withColumn("before", ahead).where("before < rest")
        return rows.groupBy("source").agg(F.max(F.struct(at, "before")).alias("m")).select("source", f"m.{at}", "m.before")

    # First among stripes of blocks, then among the blocks of one, so that no task gets all blocks of a source.
    stripes = totals.groupBy("source", "stripe").agg(F.sum("words").alias("words"), F.first("rest").alias("rest")).withColumn("start", F.lit(0))
    stripe = last_before(stripes, "stripe").withColumnsRenamed({"source": "of_source", "stripe": "of_stripe", "before": "start"})
    cut = last_before(totals.join(stripe, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("stripe") == F.col("of_stripe"))), "rank").withColumnRenamed("rank", "cut")
    cuts = {r[0]: (r[1], r[2]) for r in cut.collect()}
    copies = [i[3] * i[5] + (cuts[i[0]][0] + 1 if i[0] in cuts else 0) for i in info]
    shards = min(SHARDS, max(1, int(sum(goal)) // SHARD_WORDS))
    ends = np.cumsum(splitting_tree(copies, shards, seed), axis=0) if info else np.zeros((1, 0), dtype=np.int64)
    ends_of = [(i[0], cuts.get(i[0], (-1, 0))[0], cuts.get(i[0], (0, 0))[1], ends[:, k].tolist()) for k, i in enumerate(info)]
    at = spread(spark.createDataFrame(ends_of, "source string, cut long, before long, ends array<long>")).alias("at")
    joined = joined.alias("r").join(at, F.col("r.source").eqNullSafe(F.col("at.source")), "left").drop(F.col("at.source"))
    inside = joined.where("rank = cut")
    running = F.sum("size").over(Window.partitionBy("source", "rank").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - running + F.col("size"))))
    outside = joined.where("rank != cut").withColumn("extra", F.when(F.col("rank") < F.col("cut"), F.col("size")).otherwise(0))
    both = outside.unionByName(inside)
    whole = F.col("passes") + ((F.col("extra") == F.col("size")) & (F.col("rank") <= F.col("cut")) & ((F.col("size") > 0) | (F.col("rank") < F.col("cut")))).cast("int")
    part = F.when((F.col("extra") > 0) & (F.col("extra") < F.col("size")), F.col("extra")).otherwise(0)
    place = lambda c: F.size(F.filter("ends", lambda e: e <= c * F.col("blocks") + F.col("rank")))
    both = both.withColumn("copies", whole).withColumn("part", part.cast("long"))
    pieces = F.col("copies") + (F.col("part") > 0).cast("int")
    places = F.when(pieces > 0, F.transform(F.sequence(F.lit(0), pieces - 1), place)).otherwise(F.array().cast("array<int>"))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", "part", (F.col("size") * F.col("passes") + F.col("extra")).alias("taken"), places.alias("shards"), "key")


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of documents (doc_id, text, lang, source, n_chars), a row for each copy.

    Rows of a shard come in one partition, in a keyed order. Of the one document at which a source's
    share ends, the last copy has the words that still belong to the share, parted by single spaces.
    Rows equal in doc_id and text are taken alike.
    """
    rows = pick(documents, "doc_id", "text", "lang", "source", "n_chars")
    plan = plan_mix(documents, **options)
    seed = options.get("seed", 7)
    plan = plan.select("doc_id", "key", "copies", "part", "shards").where(F.size("shards") > 0).dropDuplicates(["doc_id", "key"])
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text", F.lit(seed))).alias("d")
    plan = plan.alias("p")
    both = rows.join(plan, (F.col("d.key") == F.col("p.key")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))).select("d.*", "p.copies", "p.part", F.posexplode("p.shards").alias("copy", "shard"))
    cut = (F.col("part") > 0) & (F.col("copy") == F.col("copies"))
    blanks = F.lit(" \t\n\x0b\x0c\r")
    words = F.array_join(F.slice(F.split(F.btrim("text", blanks), r"[\x20\x09-\x0D]+"), F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    both = both.withColumn("text", F.when(cut, words).otherwise(F.col("text")))
    both = both.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return both.repartition("shard").sortWithinPartitions("shard", F.xxhash64("key", "copy")).select("doc_id", "text", "lang", "source", "n_chars")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the standard mix takes of every document."""
    return plan_mix(table(spark, sf_dir, "documents")).drop("key")
