"""Operators of a training-data pipeline: dedup, sharding, quality, mixing,
token output, language-model scores, secret and license scans, decontamination.

Nothing outside this subpackage imports it, except the driver's entry module
and ``corpus_pipeline.py``.
"""
