"""Toxicity scores by a classifier regularised with counterfactuals.

Features are the words of a text and the beginnings of words, each once for occurring and once more
for occurring again. A logistic model is fitted to a bounded sample of labelled rows. Sentences of
the sample that name a group of people are repeated with the names swapped for others of their kind,
and the squared change of a text's score under the swap is added to the loss, so that naming a group
can't carry weight by itself.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, ready_python, stage, table, unstage

#: Labelled rows that the model is fitted to at most, and features that it has.
FIT_ROWS, FEATURES = 12_000, 4096
#: Parts that the sample is written in.
SAMPLE_PARTS = 48
#: Weight of the counterfactual term and of the ridge, and steps of the fit.
SWAP_WEIGHT, RIDGE, STEPS = 4.0, 2e-4, 400
#: Words remembered by a Python worker; beyond it the memory starts anew.
KEPT_WORDS = 300_000
STARTS = (3, 4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?\n])")

# Names of groups of people, by kind and language, our own choice; a swap stays within a line.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus"),
    ("schwule", "lesben", "heteros"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
_SWAP = {w: line[(k + 1) % len(line)] for line in reversed(IDENTITY) for k, w in enumerate(line)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts_of(word: str) -> list[str]:
    """A word and, marked by ^, its beginnings."""
    return [word, *(word[:n] + "^" for n in STARTS if len(word) > n)]


def swapped(text: str | None) -> str | None:
    """The text with every group name replaced by another of its kind, sentence by sentence; None if it has none."""
    done, changed = [], False
    for sentence in _SENTENCE.split(text or ""):
        if any(w in _SWAP for w in words_of(sentence)):
            sentence = _WORD.sub(lambda m: _SWAP.get(m[0].lower(), m[0]), sentence)
            changed = True
        done.append(sentence)
    return "".join(done) if changed else None


class Features:
    """Feature numbers of texts under a chosen vocabulary."""

    def __init__(self, names: dict[str, int]):
        self.names, self.known, self.count = names, {}, len(names)

    def of(self, text: str | None) -> list[int]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        found: Counter = Counter()
        for word, n in Counter(words_of(text)).items():
            at = self.known.get(word)
            if at is None:
                at = self.known[word] = tuple(self.names[p] for p in parts_of(word) if p in self.names)
            for k in at:
                found[k] += n
        return sorted([*found, *(self.count + k for k, n in found.items() if n > 1)])


def fit(texts: list[list[int]], labels: list[int], pairs: list[tuple[list[int], list[int]]], size: int, swap_weight: float = SWAP_WEIGHT) -> np.ndarray:
    """Weights, the last one the constant, of a logistic model; pairs are features of a text before and after its swap."""

    def flat(rows):
        n = np.array([len(r) + 1 for r in rows], dtype=np.int64)
        at = np.concatenate([np.array([*r, size], dtype=np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        return at, n, np.r_[0, np.cumsum(n)[:-1]] if rows else np.zeros(0, np.int64)

    def score(w, x):
        return 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[x[0]], x[2]), -30, 30))) if len(x[0]) else np.zeros(0)

    def back(x, error):
        return np.bincount(x[0], weights=np.repeat(error, x[1]), minlength=size + 1)

    main, before, after = flat(texts), flat([p[0] for p in pairs]), flat([p[1] for p in pairs])
    y, w = np.array(labels, dtype=float), np.zeros(size + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    ridge = np.r_[np.full(size, RIDGE), 0.0]
    for step in range(1, STEPS + 1):
        p = score(w, main)
        slope = back(main, p - y) / max(1, len(y)) + ridge * w
        if pairs:
            a, b = score(w, before), score(w, after)
            gap = 2 * swap_weight * (a - b) / len(pairs)
            slope += back(before, gap * a * (1 - a)) - back(after, gap * b * (1 - b))
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


def train(documents: DataFrame, labels: DataFrame, swap_weight: float = SWAP_WEIGHT) -> tuple[dict[str, int], np.ndarray]:
    """The chosen features and their weights.

    Only labelled rows whose crc32(doc_id as text) mod 5 isn't 0 are learned from, FIT_ROWS of them at
    most, in order of a hash. A doc_id with several labels counts as toxic if any says so; null ids and
    labels are left out. Without a labelled row every score is one half.
    """
    spark = documents.sparkSession
    ready_python(spark)
    chosen = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = pick(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # FIT_ROWS rows
    # Written once, in a few parts, so that the documents are read once for the sample.
    rows = stage(rows.repartition(SAMPLE_PARTS, "doc_id").select("text", "toxic"), "sample")

    def count(batches):
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for part in {p for w in set(words_of(text)) for p in parts_of(w)}:
                    found.setdefault(part, [0, 0])[1 if toxic else 0] += 1
            if len(found) > 400_000:
                yield rows_of(found)
                found = {}
        if found:
            yield rows_of(found)

    def rows_of(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], ["part", "clean", "toxic"])

    counts = rows.mapInArrow(count, "part string, clean long, toxic long").groupBy("part").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 3")
    clean, toxic = rows.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") != 0)).first()
    share = F.lit(toxic / max(1, clean + toxic))
    seen = F.col("clean") + F.col("toxic")
    strength = F.abs(F.col("toxic") - seen * share) / F.sqrt(seen * share * (1 - share) + 0.5)
    best = [r[0] for r in counts.orderBy(strength.desc(), "part").limit(FEATURES).select("part").collect()]
    names = {p: k for k, p in enumerate(dict.fromkeys([*best, *(w for line in IDENTITY for w in line)]))}

    def features(batches):
        make = Features(names)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            other = [swapped(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([make.of(t) for t in texts], pa.list_(pa.int32())), pa.array([None if t is None else make.of(t) for t in other], pa.list_(pa.int32()))],
                ["toxic", "mine", "other"],
            )

    got = rows.mapInArrow(features, "toxic int, mine array<int>, other array<int>").collect()  # FIT_ROWS rows of feature numbers
    unstage(rows)
    got.sort(key=lambda r: (r[1], r[0]))
    mine = [list(r[1]) for r in got]
    pairs = [(m, list(r[2])) for m, r in zip(mine, got) if r[2] is not None]
    return names, fit(mine, [int(r[0] != 0) for r in got], pairs, 2 * len(names), swap_weight)


def score_documents(documents: DataFrame, model: tuple[dict[str, int], np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score (0 to 1) of every row. Null and empty texts get the score of no features; repeated rows stay; an empty table gives no rows."""
    spark = documents.sparkSession
    ready_python(spark)
    shared = spark.sparkContext.broadcast(model)  # FEATURES names and weights
    if "score" in keep:
        raise ValueError("score is a column of the result")
    rows = pick(documents, *dict.fromkeys([*keep, "text"]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        names, weights = shared.value
        make = Features(names)
        for batch in batches:
            z = np.array([weights[make.of(t)].sum() + weights[-1] for t in batch.column("text").to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*keep, "score"])

    return rows.mapInArrow(run, f"{kinds}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score and decision for every document; a fifth of the documents is held out from learning."""
    documents = table(spark, sf_dir, "documents")
    scored = score_documents(documents, train(documents, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
