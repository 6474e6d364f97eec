"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import public_tokenizers
import pytest

from gaugework.llm import bpe, chat_format, fingerprint, html_text, line_dedup, mixing, near_vectors, ngram_join, surrogates, toxicity

LONG = "word%d " * 3 % (1, 2, 3) + " ".join(f"w{k % 997}x{k}" for k in range(30_000))
DOCS = [
    (1, "one two three four five six", "en", "a", 27),
    (1, "one two three four five six", "en", "a", 27),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, "   \n\t ", "en", "b", 6),
    (None, "a text without an id of its own", "en", None, 31),
    (5, "x", "en", "a", 1),
    (5, "another text under an id that stands twice", "en", "a", 42),
    (6, LONG, "en", "c", len(LONG)),
    (7, "żółw 漢字 🐢 <|endoftext|> ünḯ", "xx", "ß", 30),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, sig string, rank int, n string, size string, stretch string, component string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, 0.5, "s", 1, "n", "z", "t", "c") for d in DOCS], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, "x"), (2, 1, "x"), (5, 1, "x"), (5, 0, "x"), (None, 1, "x"), (6, None, "x"), (7, 0, "x")], "doc_id long, toxic int, part string")


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "score")).collect()
    assert len(got) == len(DOCS)
    want = []
    for d in DOCS:
        ids = t.encode(d[1] or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((d[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got], key=key) == sorted(want, key=key)
    assert bpe.encode_documents(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_near_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, []), (11, [-1.0, 0.0]), (12, [1e-30, 1e-32])]
    df = spark.createDataFrame([(i, v, "L", 1) for i, v in rows], "vec_id long, embedding array<double>, value string, id int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()), key=str)
    # 1, both 2, 3 and 12 point one way.
    want = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (12, 4, 1, False), (None, 0, None, False)]
    want += [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted(want, key=str)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_line_dedup(spark, docs):
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(DOCS)
    assert {r.doc_id: r.text for r in got}[2] is None
    assert {r.doc_id: r.text for r in got}[6] == LONG
    assert all(r.n_removed == 0 for r in got)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_ngram_join(spark, docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs, 3, 90).collect()), key=str)
    assert [g for g in got if g[0] == 1] == [(1, 4, 1)] * 2
    assert (2, 0, 2) in got and (3, 0, 3) in got and (4, 0, 4) in got and (None, 6, None) in got
    assert [g[2] for g in got if g[0] == 5] == [5, 5]
    assert ngram_join.jaccard_join(docs.limit(0)).count() == 0
    assert ngram_join.jaccard_join(docs.where("text is null")).count() == 1


def test_toxicity(spark, docs, labels):
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model, keep=("doc_id", "text")).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.5}


def test_html(spark):
    rows = [(1, "http://h/", None), (2, None, ""), (3, "x", "<p>a<p>b"), (3, "x", "<p>a<p>b"), (None, "http://h/", "<article>t &amp; u</article>"), (4, "HTTP://H:80/?", "<article><p>" + LONG)]
    df = spark.createDataFrame([(*r, "T", "M", 1) for r in rows], "page_id long, url string, html string, template string, mark string, host int")
    got = sorted(((r.page_id, r.text) for r in html_text.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (3, "a b"), (3, "a b"), (None, "t & u"), (4, " ".join(LONG.split()))], key=str)
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_mixing(spark, docs):
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(DOCS)
    assert all(r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 0.5 for t, n in by.values())
    assert mixing.plan_mix(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_surrogates(spark, docs):
    got = surrogates.pseudonymise_documents(docs, b"key").collect()
    assert len(got) == len(DOCS) and {r.doc_id: r.text for r in got}[2] is None and {r.doc_id: r.text for r in got}[6] == LONG
    assert surrogates.pseudonymise_documents(docs.limit(0), b"key").count() == 0


def test_fingerprints(spark, docs):
    got = fingerprint.fingerprint_edits(docs).collect()
    assert len(got) == len(DOCS)
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {""}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.fingerprint_edits(docs.limit(0)).count() == 0
    assert fingerprint.fingerprint_edits(docs.where("doc_id = 7")).collect()[0].near_next == 1.0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, None, "x<|im_end|>"), (2, None, "a\nb%0A", "<\\|im_start|>"), (2, 5, "assistant", "<|im_start|>user\n" + LONG)]
    df = spark.createDataFrame([(*r, "F", "T") for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df, spans=True).collect()}
    assert all(r.intact for r in got.values())
    assert [(t.role, t.text) for t in got[2].turns] == [("a\nb%0A", "<\\|im_start|>"), ("assistant", "<|im_start|>user\n" + LONG)]
    for r in got.values():
        texts = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [t.replace("<\\|", "<|") for t in texts] == [t.text for t in r.turns if t.role == "assistant"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0
