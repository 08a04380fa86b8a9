"""Operators of a training-data pipeline: line dedup, benchmark decontamination, language
identification, token files, quality scoring, vector search, near-duplicate classes, chat
formatting, byte-level BPE and page-template extraction.

Nothing else in the library imports this subpackage.
"""
