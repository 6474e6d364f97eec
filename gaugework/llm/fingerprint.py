"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

The shingles of a text are hashed once. The top bits of a hash name its bin, and the smallest hash
of each bin is kept. One more value per bin, the largest it can hold, is sorted in with the hashes:
the first value of each bin is then its minimum or, where that largest value comes first, the sign
that the bin is empty. Empty bins take over the value of the first filled bin in a fixed probe order
of their own (optimal densification). The low bits of each value are stored as hexadecimal digits,
and likeness corrects the share of equal bins for chance agreement of low bits.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blank, pick, table

#: Bins of a fingerprint (a power of two), bits stored for each, and words of a shingle.
BINS, BITS, WORDS = 128, 8, 5
_SHIFT = 64 - BINS.bit_length() + 1
_FULL = (1 << _SHIFT) - 1
#: Rows that one stretch of the descending order holds on average, and the most stretches.
STRETCH_ROWS, STRETCHES = 1000, 4096


def bound_to(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _probes() -> Column:
    """For each bin, all bins in the fixed order in which it looks for a filled one."""
    order = lambda b: sorted(range(BINS), key=lambda c: hashlib.sha256(f"{b} {c}".encode()).digest())
    # One literal that Spark folds to a constant, instead of one for each number.
    return F.from_json(F.lit(json.dumps([order(b) for b in range(BINS)])), "array<array<int>>")


def _shingles(text: Column) -> Column:
    """Hashes of all shingles of a text; fewer words make one shingle, no words none."""
    blanks = " \t\n\x0b\x0c\r"
    words = F.split(F.btrim(text, F.lit(blanks)), r"[\x20\x09-\x0D]+")
    hashes = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))

    def rows(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS))))
        few = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= WORDS, many).otherwise(few)

    return bound_to(hashes, rows)


def minima(text: Column) -> Column:
    """The low bits of every bin's value after densification, as an array of BINS numbers; null for texts without words."""
    ends = F.lit([((b - BINS // 2) << _SHIFT) + _FULL for b in range(BINS)]).cast("array<bigint>")
    bin_of = lambda x: F.shiftright(x, _SHIFT)
    empty = lambda x: x.bitwiseAND(F.lit(_FULL)) == F.lit(_FULL)
    probes = _probes()

    def first_of_bin(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))

    def dense(d: Column) -> Column:
        def borrowed(b: Column) -> Column:
            look = lambda start, n: F.get(F.filter(F.slice(F.get(probes, b), start, n), lambda c: ~empty(F.get(d, c))), F.lit(0))
            return F.get(d, F.coalesce(look(1, 4), look(5, 12), look(17, BINS)))

        return F.transform(d, lambda x, b: F.when(empty(x), borrowed(b)).otherwise(x).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))

    def of(h: Column) -> Column:
        return F.when(F.size(h) > 0, bound_to(bound_to(F.sort_array(F.concat(h, ends)), first_of_bin), dense))

    return bound_to(_shingles(text), of)


def packed(values: Column) -> Column:
    """A fingerprint as hexadecimal digits, BITS / 4 for each bin; empty for texts without words."""
    top = 1 << BITS
    return F.coalesce(F.array_join(F.transform(values, lambda x: F.substring(F.hex(x.bitwiseOR(F.lit(top))), 2, BITS // 4)), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles, 0 to 1. Two empty texts are alike, an empty and another one aren't."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / BINS
    chance = 2.0**-BITS
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def fingerprint(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a column `fingerprint`; a null text counts as empty. A column of that name is replaced."""
    return documents.withColumn("fingerprint", packed(minima(blank(F.col(text)))))


def _stretches(rows: DataFrame) -> DataFrame:
    """Deal rows out to stretches of the descending doc_id order; the first row of each also goes to the end of the one before.

    Adds stretch and guest. What the driver learns is a bounded number of borders and of first rows.
    """
    count = rows.count()
    parts = min(STRETCHES, max(1, count // STRETCH_ROWS))
    borders = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    borders = sorted(set(borders))
    place = F.when(F.col("doc_id").isNull(), len(borders) + 1).otherwise(F.size(F.filter(F.lit(borders).cast("array<bigint>"), lambda b: b >= F.col("doc_id"))))
    rows = rows.withColumn("stretch", place).withColumn("tie", F.xxhash64("text"))
    # The order within a stretch: doc_id falling, then tie rising; rows equal in both are the same text.
    heads = {r[0]: (r[1], r[2]) for r in rows.groupBy("stretch").agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("t"))).alias("m")).select("stretch", "m.doc_id", F.bitwise_not("m.t")).collect()}
    order = sorted(heads)
    if not order:
        return rows.withColumn("guest", F.lit(False))
    before = {s: order[k - 1] for k, s in enumerate(order)}
    full = range(len(borders) + 2)
    ids, ties = F.lit([heads.get(s, (None, 0))[0] for s in full]).cast("array<bigint>"), F.lit([heads.get(s, (0, None))[1] for s in full]).cast("array<bigint>")
    to = F.lit([before.get(s, 0) for s in full]).cast("array<int>")
    leads = F.get(ids, F.col("stretch")).eqNullSafe(F.col("doc_id")) & (F.get(ties, F.col("stretch")) == F.col("tie"))
    target = F.when(leads, F.array(F.col("stretch"), F.get(to, F.col("stretch")))).otherwise(F.array(F.col("stretch")))
    return rows.select("doc_id", "text", "tie", F.posexplode(target).alias("pos", "stretch")).withColumn("guest", F.col("pos") == 1).drop("pos")


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The order is doc_id falling, null ids last; rows with one doc_id are ordered by a hash of their
    text. Repeated rows are documents of their own. Null texts count as empty. An only row is its own
    next. Extra columns are ignored; an empty table gives no rows.
    """
    rows = _stretches(pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), blank(F.col("text")).alias("text")))
    order = Window.partitionBy("stretch").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie")
    rows = rows.withColumn("next", F.lead("text").over(order))
    half = (F.char_length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.char_length("text") - half), F.left(blank(F.col("next")), half))
    rows = rows.select("doc_id", "stretch", "guest", "tie", F.char_length("text").cast("long").alias("n_chars"), minima(F.col("text")).alias("own"), F.when(~F.col("guest"), F.struct(F.sha2(edited, 256).alias("sha"), minima(edited).alias("values"))).alias("edit"))
    rows = rows.withColumn("then", F.lead("own").over(order)).where(~F.col("guest"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.col("edit.sha").alias("edited_sha256"),
        packed(F.col("own")).alias("fingerprint"),
        packed(F.col("edit.values")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit.values")).alias("near_edited"),
        likeness(F.col("own"), F.col("then")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
