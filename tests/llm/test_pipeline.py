"""The pipeline stage by stage, each against a plain version over its own input."""

import hashlib

import brute
import public_tokenizers

import corpus_pipeline
from gaugework.llm import common, mixing

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs, kept = common.table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stage(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "toxicity":
            gone = before.join(docs, "doc_id", "left_anti").join(common.table(spark, SF, "labels"), "doc_id").collect()
            assert sum(r.toxic for r in gone) >= 0.95 * len(gone) and len(gone) > 30
        if name == "line_dedup":
            lines = [x for r in docs.select("text").collect() for x in (r.text or "").split("\n") if len(x.split()) >= 5]
            assert len(lines) == len(set(lines))
        if name == "ngram_join":
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            want = brute.jaccard_components(rows, 5, 80)
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(i for i, c in want.items() if i == c)
        if name == "mixing":
            plan = mixing.plan_mix(before).collect()
            assert docs.count() == sum(len(r.shards) for r in plan)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in kept["mixing"].select("text").collect())
    rows = kept["bpe"].collect()
    assert sorted(r.decoded_sha256 for r in rows) == texts
    for r in rows[:50]:
        ids = [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
        assert t.encode(t.decode(ids), add_special_tokens=False).ids == ids and len(ids) == r.n_tokens


def test_one_of_repeated_rows_stays(spark):
    row = ("a b c d e f g", "en", "s", 13)
    docs = spark.createDataFrame([(1, *row), (1, *row), (2, *row), (3, None, "en", "s", 0), (None, "x y z", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, (r.doc_id for r in corpus_pipeline.remove_near_copies(spark, docs, SF).collect()))) == ["1", "3", "None"]
