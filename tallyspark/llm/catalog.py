"""Registered queries of the training-data operators: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from . import (decontaminate, fragment_bpe, jaccard_join, language_kernel, lexical_search,
               line_quality, merkle_manifest, secret_ledger, suffix_dedup, token_files, toxicity,
               url_cascade, warc)

QUERIES = {
    "op1_token_files": (token_files.op1_token_files, None),
    "op2_secret_ledger": (secret_ledger.op2_secret_ledger, None),
    "op3_language_kernel": (language_kernel.op3_language_kernel, None),
    "op4_line_quality": (line_quality.op4_line_quality, None),
    "op5_fragment_bpe": (fragment_bpe.op5_fragment_bpe, None),
    "op6_jaccard_join": (jaccard_join.op6_jaccard_join, None),
    "op7_toxicity": (toxicity.op7_toxicity, None),
    "op8_suffix_dedup": (suffix_dedup.op8_suffix_dedup, None),
    "op9_decontaminate": (decontaminate.op9_decontaminate, None),
    "op10_url_filter": (url_cascade.op10_url_filter, url_cascade.OP10_SQL),
    "op11_ranked_search": (lexical_search.op11_ranked_search, lexical_search.OP11_SQL),
    "op12_merkle_manifest": (merkle_manifest.op12_merkle_manifest, merkle_manifest.OP12_SQL),
    "op13_warc": (warc.op13_warc, warc.OP13_SQL),
}
