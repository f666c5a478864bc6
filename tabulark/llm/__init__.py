"""Training-data operators: packing, deduplication, tokenisation, archives, sharding, fingerprints.

Every operator takes and returns DataFrames, keeps its own general interface, and is registered
with production parameters in :mod:`tabulark.llm.queries`.
"""
