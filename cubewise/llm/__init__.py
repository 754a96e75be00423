"""Operators of a training-data pipeline: packing, licence scans, language
identification, decontamination, near-duplicates, vector search, token counts,
chat formatting, quality scores, tokenizer alignment, fingerprints and
fill-in-middle texts.

Nothing else in the library imports this package. Functions that run inside
Python workers are pickled by reference, so the package must be importable on
the executors (installed there, or shipped with ``--py-files``).
"""
