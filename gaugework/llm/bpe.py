"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array. In every round each word merges its
lowest-ranked pair at all its places (left to right, not overlapping), and the ranks of the pairs
touched are looked up anew by binary search over the sorted pair keys. Words that are done leave
the array. Results are kept by word, up to a fixed number of words per Python worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import pick, ready_python, table

# The pre-tokenisation pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a Python worker; beyond it the memory starts anew.
KEPT_WORDS = 150_000
_NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Read a tokenizer file on the driver into the arrays that encoding and decoding need; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    tokens: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for word, k in vocab.items():
        tokens[k] = bytes(letters[c] for c in word)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for word, k in added.items():
        tokens[k] = word.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    single = {b: c for c, b in letters.items()}
    return {"keys": keys[order], "ranks": order.astype(np.int64), "merged": merged, "bytes": np.array([vocab[single[b]] for b in range(256)], dtype=np.int64), "tokens": tokens, "added": added}


class Bpe:
    """An encoder and decoder over a loaded vocabulary."""

    def __init__(self, vocabulary: dict):
        self.__dict__.update(vocabulary)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        out: list[bytes] = [b""] * len(raw)
        word = np.repeat(np.arange(len(raw)), sizes)
        symbol = self.bytes[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        rank = np.full(len(symbol), _NONE)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same] = self._rank(symbol[same], symbol[same + 1])
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(word)])
            least = np.minimum.reduceat(rank, first)
            done = least == _NONE
            if done.any():
                ids, ends = symbol.astype("<u4").tobytes(), (first + count) * 4
                for k in np.flatnonzero(done).tolist():
                    out[word[first[k]]] = ids[first[k] * 4 : ends[k]]
                stay = ~np.repeat(done, count)
                word, symbol, rank = word[stay], symbol[stay], rank[stay]
                count, least = count[~done], least[~done]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            beside = np.diff(hit) == 1
            if beside.any():  # a run of one symbol: every other pair, from the left
                run = np.r_[True, ~beside]
                start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            symbol[hit] = self.merged[rank[hit]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[hit + 1] = False
            hit = (np.cumsum(stay) - 1)[hit]
            word, symbol, rank = word[stay], symbol[stay], rank[stay]
            touched = np.unique(np.r_[hit, hit[hit > 0] - 1])
            rank[touched] = _NONE
            touched = touched[touched + 1 < len(word)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self._rank(symbol[touched], symbol[touched + 1])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text; strings of added tokens become those tokens; null counts as empty."""
        split: list[list[str]] = []
        fresh: set[str] = set()
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        for text in texts:
            words: list[str] = []
            for part in self.special.split(text or "") if self.special else [text or ""]:
                if part in self.added:
                    self.known[part] = int(self.added[part]).to_bytes(4, "little")
                    words.append(part)
                elif part:
                    words += self.pattern.findall(part)
            split.append(words)
            fresh.update(words)
        fresh -= self.known.keys()
        if fresh:
            new = list(fresh)
            self.known.update(zip(new, self.encode_words(new)))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids, added tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_ready: dict[int, Bpe] = {}


def _bpe(shared) -> Bpe:
    """The worker's own encoder; it outlives a task where workers are reused."""
    if shared.id not in _ready if hasattr(shared, "id") else True:
        _ready.clear()
        _ready[getattr(shared, "id", 0)] = Bpe(shared.value)
    return _ready[getattr(shared, "id", 0)]


def _chunks(texts: list[str | None], chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """Parts of a batch with so many characters at most, or a single longer text."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        if part and size + len(t or "") > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def encode_documents(documents: DataFrame, vocabulary_path: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Encode every text, and decode what was encoded.

    Returns the kept columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary,
    little-endian unsigned 32-bit integers). One row per input row: repeated rows and null ids stay,
    null texts count as empty, texts of any length are taken whole, an empty table gives no rows.
    The broadcast is the vocabulary of the tokenizer file, whose size the data don't change.
    """
    spark = documents.sparkSession
    ready_python(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    if {"n_tokens", "ids_sha256", "decoded_sha256", "ids"} & set(keep):
        raise ValueError("a kept column has a name of the result")
    rows = pick(documents, *keep, "text") if "text" not in keep else pick(documents, *keep)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column("text").to_pylist()):
                ids = bpe.encode(texts)
                columns = [batch.column(c).slice(at, len(texts)) for c in keep] + [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
                ]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
