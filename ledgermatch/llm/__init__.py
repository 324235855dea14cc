"""Operators of a training-data pipeline (token counts, chat formatting, token-id shards,
URL filters, embedding and SimHash near-duplicates, source mixing, byte-level BPE,
language id, document fingerprints).

Nothing outside this folder and ``corpus_pipeline.py`` imports it.  Every operator is a
function from DataFrames to DataFrames or to a Column; ``queries.py`` derives the
registered ``opN_*`` queries from them.

Columns an operator adds replace input columns of the same name; its own helper columns
start with ``__lm_``.
"""
