"""Set-similarity self join of documents on word n-grams, by universe partitioning and the pigeonhole principle.

Set sizes are cut into bands so that partners stand in the same or in neighbouring bands. For each
band the universe of shingles is hashed into segments. Two similar sets differ in at most H shingles,
so with budgets that sum to H + 1 + E over the segments (1: the segment must agree, 2: it may lack one
shingle) at least one segment of each similar pair stays within its budget, and, E spare segments
allowing for empty ones, a segment that isn't empty. The segments that an index holds, exact ones and
one-deletion neighbourhoods, are chosen for each band by a cost model over the band's row count.

Candidates are never written out pair by pair. Each document first meets the smallest member of its
groups; what that links becomes one component. Then the groups are compared in square cells of
bounded size by a lower bound on the symmetric difference (parity bitmaps), and each cell gives only
a forest of its likeliest pairs between components, no more than it has members. Those are verified
on the sets themselves, and the cells are looked at again, knowing what was refuted, with ever more
forests, until no pair of different components is left that the bound allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, pick, ready_python, stage, table, unstage
from .hashing import shingle_set, splitmix

#: Rows of a group that meet in one block of a cell.
BLOCK = 256
#: Disjoint forests of pairs that a cell gives in each round; after these rounds it gives all pairs that are left.
FORESTS = (1, 8, 64)
#: Bits of the filter that picks texts for verification; its broadcast has this size at any scale.
FILTER_BITS = 1 << 24


def band_of(percent: int, upto: int) -> list[tuple[int, int]]:
    """Sizes (low, high) of the bands up to a largest set size."""
    out, low = [], 1
    while low <= upto:
        high = max(low, 100 * low // percent)
        out.append((low, high))
        low = high + 1
    return out


def most_errors(percent: int, high: int) -> int:
    """Largest symmetric difference of a similar pair whose smaller set has at most `high` shingles."""
    return (100 - percent) * (high + 100 * high // percent) // (100 + percent)


def allocate(errors: int, size: float, rows: int) -> tuple[int, int, int]:
    """(exact segments, one-deletion segments, spare E) of the least modelled cost for a band.

    Costs are index rows of a document plus its chance partners: pairs that both have more than E
    empty segments, and pairs whose one-deletion segments agree by being nearly empty.
    """
    best = (math.inf, errors + 1, 0, 0)
    halves = {0, (errors + 1) // 2, *(1 << k for k in range((errors + 1).bit_length()))}
    for spare in range(9):
        for double in sorted(h for h in halves if 2 * h <= errors + 1):
            exact = errors + 1 + spare - 2 * double
            if exact == 0 and spare:
                continue
            load = size / (exact + double)
            p, q, term = math.exp(-load), 1.0, (1 - math.exp(-load)) ** exact
            for k in range(min(spare, exact) + 1):  # binomial tail: more than `spare` empty segments
                q -= term
                term *= (exact - k) / (k + 1) * p / max(1e-300, 1 - p)
            chance = rows / 2 * (max(q, 0.0) ** 2 * (exact > 0) + double * p * p * (1 + 2 * load))
            cost = exact + double * (1 + load) + chance
            if cost < best[0]:
                best = (cost, exact, double, spare)
    return best[1:]


def signatures(shingles: np.ndarray, band: int, exact: int, double: int, spare: int) -> np.ndarray:
    """Keys under which a set stands in the index of a band."""
    count = exact + double
    place = (splitmix(shingles ^ np.uint64(band * 7919 + 1)) >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
    place = place.astype(np.int64)
    value = splitmix(shingles + np.uint64(band))
    total = np.zeros(count, dtype=np.uint64)
    np.add.at(total, place, value)
    name = splitmix(np.arange(count, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(band << 32))
    filled = np.bincount(place, minlength=count)[:exact] > 0
    at = np.flatnonzero(filled) if (~filled).sum() <= spare and filled.any() else np.arange(exact)
    keys = [splitmix(total[at] ^ name[at]), splitmix(total[exact:] ^ name[exact:])]
    if double:
        mine = place >= exact
        keys.append(splitmix((total[place[mine]] - value[mine]) ^ name[place[mine]]))
    return np.concatenate(keys)


def parity_bits(shingles: np.ndarray) -> bytes:
    """Bit k tells whether an odd number of shingles hash to k; two to four bits a shingle.

    The bits in which two sets differ are never more than their symmetric difference.
    """
    size = 1 << max(6, (2 * len(shingles) - 1).bit_length() if len(shingles) else 6)
    at = (splitmix(shingles) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None]]:
    return enumerate(batch.column("text").to_pylist())


def _i64(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _sizes(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (content key)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for _, t in _texts(batch)]
            one = np.array([x.sum(dtype=np.uint64) for x in sets], dtype=np.uint64)
            two = np.array([splitmix(x ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) for x in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(_i64(one)), pa.array(_i64(two))],
                ["doc_id", "n", "k1", "k2"],
            )

    return documents.mapInArrow(run, "doc_id long, n long, k1 long, k2 long")


def _index(documents: DataFrame, words: int, plan: list[tuple[int, int, int, int]], percent: int) -> DataFrame:
    """doc_id and sigs, its keys in its own band and in the one below, where smaller partners stand. plan: (high, exact, double, spare) by band."""
    highs = np.array([p[0] for p in plan], dtype=np.int64)

    def run(batches):
        for batch in batches:
            ends, keys = [0], [np.zeros(0, dtype=np.uint64)]
            for _, text in _texts(batch):
                x = shingle_set(text, words)
                home = int(np.searchsorted(highs, len(x)))
                for band in (home, home - 1) if len(x) and home < len(plan) else ():
                    if band >= 0 and 100 * plan[band][0] >= percent * len(x):
                        keys.append(signatures(x, band, *plan[band][1:]))
                        ends[-1] += len(keys[-1])
                ends.append(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array([0, *ends[:-1]], pa.int32()), pa.array(_i64(np.concatenate(keys))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "sigs"])

    return documents.mapInArrow(run, "doc_id long, sigs array<long>")


def _chosen(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id may be among `ids`, by a filter of a fixed number of bits; a few others come along."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bits = ids.select(spot("id").alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    rows = documents.withColumn("at", spot("doc_id"))
    rows = rows.withColumn("bucket", F.expr("bitmap_bucket_number(at)")).withColumn("pos", F.expr("bitmap_bit_position(at)"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("pos") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), "bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(pos % 8 as int))")) != 0).select("doc_id", "text")


def _bits(documents: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, n and bits of the documents of these ids (and of a few others) that have a set."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for _, t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity_bits(x) for x in sets], pa.binary())], ["id", "n", "bits"])

    return _chosen(documents, ids).mapInArrow(run, "id long, n long, bits binary").where("n > 0")


def _verified(documents: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar, decided on the whole sets."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingle_set(t, words).tobytes() for _, t in _texts(batch)], pa.binary())], ["id", "shingles"])

    known = _chosen(documents, ids).mapInArrow(sets, "id long, shingles binary")
    both = pairs.join(known.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(known.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and len(x) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _cells(rows: DataFrame, percent: int, forests: int | None) -> DataFrame:
    """f1, f2, a, b: for each cell so many disjoint forests (None: all) of pairs of different components that the lower bound allows, likeliest pairs first.

    rows: f1, f2, i, j (the cell), block, id, comp, n, bits, gone (ids it was refuted with), sorted by
    cell within partitions. A cell has two blocks at most; cells are handled one by one, whatever
    batches they come in.
    """

    def compare(block, ids, comp, n, bits, gone, same):
        width = min(len(b) for b in bits)
        words = np.stack([fold(np.frombuffer(b, np.uint8), width) for b in bits]).view(np.uint64)
        left, right, margin = [], [], []
        for k in range(len(ids) - 1):
            rest = slice(k + 1, None)
            small, large = np.minimum(n[rest], n[k]), np.maximum(n[rest], n[k])
            apart = np.bitwise_count(words[rest] ^ words[k]).sum(axis=1, dtype=np.int64)
            room = (100 - percent) * (small + large) - (100 + percent) * apart
            ok = (comp[rest] != comp[k]) & (100 * small >= percent * large) & (room >= 0)
            if not same:
                ok &= block[rest] != block[k]
            hit = np.flatnonzero(ok)
            left.append(np.full(len(hit), k))
            right.append(hit + k + 1)
            margin.append(room[hit] / (small + large)[hit])
        left, right = np.concatenate(left), np.concatenate(right)
        order = np.argsort(-np.concatenate(margin), kind="stable")
        left, right = left[order].tolist(), right[order].tolist()
        refuted, names, known = [set(g) if g else () for g in gone], comp.tolist(), ids.tolist()
        rest, out = [(a, b) for a, b in zip(left, right) if known[b] not in refuted[a]], []
        for _ in range(len(rest) if forests is None else forests):
            if forests is None:
                out, rest = rest, []
            if not rest:
                break
            up: dict[int, int] = {}

            def find(x):
                while up.get(x, x) != x:
                    up[x] = x = up.get(up[x], up[x])
                return x

            again = []
            for a, b in rest:
                x, y = find(names[a]), find(names[b])
                if x != y:
                    up[x] = y
                    out.append((a, b))
                else:
                    again.append((a, b))
            rest = again
        return [(min(known[a], known[b]), max(known[a], known[b])) for a, b in out]

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            got = pa.Table.from_batches([batch])
            held = got if held is None else pa.concat_tables([held, got])
            keys = np.stack([held.column(c).to_numpy() for c in ("f1", "f2", "i", "j")])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            yield from emit(held, starts, len(starts) - 1)
            held = held.slice(starts[-1]).combine_chunks()
        if held is not None and len(held):
            keys = np.stack([held.column(c).to_numpy() for c in ("f1", "f2", "i", "j")])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            yield from emit(held, starts, len(starts))

    def emit(held, starts, upto):
        ends = np.r_[starts[1:], len(held)]
        f1, f2, i, j, block, ids, comp, n = (held.column(c).to_numpy() for c in ("f1", "f2", "i", "j", "block", "id", "comp", "n"))
        bits, gone = held.column("bits").to_pylist(), held.column("gone").to_pylist()
        out = []
        for s, e in zip(starts[:upto].tolist(), ends[:upto].tolist()):
            if e - s > 1:
                out += [(f1[s], f2[s], a, b) for a, b in compare(block[s:e], ids[s:e], comp[s:e], n[s:e], bits[s:e], gone[s:e], i[s] == j[s])]
        if out:
            pairs = np.array(out, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(4)], ["f1", "f2", "a", "b"])

    return rows.mapInArrow(run, "f1 long, f2 long, a long, b long")


def jaccard_join(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, over links of 100 * common >= percent * union.

    A set has the distinct shingles of so many words; fewer words make one shingle. Texts that are
    null or without words have an empty set, link with nothing and are their own component. Repeated
    rows each give a row; rows that share a doc_id share a component. A null doc_id links with
    nothing and has a null component. Extra columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    ready_python(spark)
    passing: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Staged until the end of the join."""
        passing.append(stage(df, name))
        return passing[-1]

    rows = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = kept(_sizes(rows, words), "sizes")
    whole = sizes.where("n > 0 and doc_id is not null")
    reps = whole.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    known = stage(sizes.join(reps, ["n", "k1", "k2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "known")
    mine = known.where("doc_id = rep and n > 0").select("doc_id", "n").distinct()
    top = mine.agg(F.max("n")).first()[0] or 0
    bands = band_of(percent, top)
    # A row for each band, so as many as the logarithm of the largest size.
    edge = F.array(*[F.lit(b[1]) for b in bands])
    counts = {r[0]: (r[1], r[2]) for r in mine.groupBy(F.size(F.filter(edge, lambda h: h < F.col("n"))).alias("band")).agg(F.count(F.lit(1)), F.avg("n")).collect()} if bands else {}
    plan = []
    for k, (low, high) in enumerate(bands):
        near = [counts[x] for x in (k, k + 1) if x in counts]
        errors = most_errors(percent, high)
        plan.append((high, *allocate(errors, (low + high) / 2, sum(x[0] for x in near) or 1)))
    # Joined after the keys are made, which are smaller than the texts, and by shuffle at every size.
    index = _index(rows.where("doc_id is not null"), words, plan, percent).join(mine.select("doc_id").hint("merge"), "doc_id", "left_semi")
    index = index.select(F.col("doc_id").alias("id"), F.explode("sigs").alias("sig"))
    sig = Window.partitionBy("sig")
    groups = index.select("sig", "id", F.min("id").over(sig).alias("least"), F.max("id").over(sig).alias("most"), F.bit_xor(F.xxhash64("id")).over(sig).alias("f1"), F.bit_xor(F.xxhash64("id", F.lit(1))).over(sig).alias("f2"))
    groups = kept(groups.where("least < most").select("f1", "f2", "id", "least").distinct(), "groups")
    first = groups.where("id != least").groupBy(F.col("id").alias("b")).agg(F.min("least").alias("a"))
    links = kept(_verified(rows, first, words, percent), "links")
    # What cells compare: size and bits of the documents that share a group with another.
    bits = kept(_bits(rows, groups.select("id"), words), "bits")
    refuted, comps, turn = None, components(links), 0
    while True:
        now = groups.select("f1", "f2", "id").join(comps, "id", "left").select("f1", "f2", "id", F.coalesce("component", "id").alias("comp"))
        group = Window.partitionBy("f1", "f2")
        now = now.withColumn("low", F.min("comp").over(group)).withColumn("high", F.max("comp").over(group)).withColumn("k", F.ceil(F.count(F.lit(1)).over(group) / BLOCK)).where("low < high")
        now = now.select("f1", "f2", "id", "comp", "k", F.pmod(F.xxhash64("id"), "k").alias("block")).join(bits, "id")
        if refuted is None:
            now = now.withColumn("gone", F.lit(None).cast("array<bigint>"))
        else:
            ends = refuted.union(refuted.select(F.col("b").alias("a"), F.col("a").alias("b")))
            now = now.join(ends.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("gone")), "id", "left")
        now = now.select("*", F.explode(F.expr("sequence(0L, k - 1)")).alias("other")).select("f1", "f2", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp", "n", "bits", "gone")
        now = now.repartition("f1", "f2", "i", "j").sortWithinPartitions("f1", "f2", "i", "j")
        given = kept(_cells(now, percent, FORESTS[turn] if turn < len(FORESTS) else None), "pairs")
        if given.isEmpty():
            break
        pairs = given.select("a", "b").distinct()
        # The bound doesn't change, so groups that gave no pair never will.
        groups = kept(groups.join(given.select("f1", "f2").distinct(), ["f1", "f2"], "left_semi"), "groups")
        found = kept(_verified(rows, pairs, words, percent), "links")
        lost = pairs.join(found, ["a", "b"], "left_anti")
        refuted = kept(lost if refuted is None else refuted.union(lost), "refuted")
        turn += 1
        if found.isEmpty():
            continue
        comps = components(found, known=comps)
    # Rows with one doc_id and different texts belong together.
    split = known.where("n > 0").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    split = known.join(split.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    split = kept(split, "split")
    final = comps if split.isEmpty() else components(split, known=comps)
    for done in passing:
        unstage(done)
    out = known.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their three-word shingles."""
    return jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90)
