"""Training-data operators: tokenising, deduplication, filters, packing.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
