"""The queries of the training-data operators and their SQL; an operator without SQL has brute-force tests instead."""

from __future__ import annotations

from . import chat, cuckoo, fmindex, mixing, ngram_join, quality, secrets, sharding, suffix, wrappers

QUERIES = {
    "op1_quality": quality.query,
    "op2_sharding": sharding.query,
    "op3_chat_format": chat.query,
    "op4_html_text": wrappers.query,
    "op5_exact_dedup": cuckoo.query,
    "op6_source_mix": mixing.query,
    "op7_ngram_join": ngram_join.query,
    "op8_secret_scan": secrets.query,
    "op9_suffix_dedup": suffix.query,
    "op10_decontaminate": fmindex.query,
}
SQL = {
    "op3_chat_format": chat.SQL,
    "op4_html_text": wrappers.SQL,
    "op5_exact_dedup": cuckoo.SQL,
    "op6_source_mix": mixing.SQL,
    "op8_secret_scan": secrets.SQL,
    "op10_decontaminate": fmindex.SQL,
}
