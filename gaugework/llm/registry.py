"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat_format, fingerprint, html_text, line_dedup, mixing, near_vectors, ngram_join, surrogates, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_near_vectors": near_vectors.op2_near_vectors,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_html_text": html_text.op6_html_text,
    "op7_mixing": mixing.op7_mixing,
    "op8_surrogates": surrogates.op8_surrogates,
    "op9_fingerprints": fingerprint.op9_fingerprints,
    "op10_chat_format": chat_format.op10_chat_format,
}
ORACLE = {**chat_format.ORACLE}
