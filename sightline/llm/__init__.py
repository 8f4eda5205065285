"""Training-data operators: deduplication, quality, decontamination, formatting, mixing, archives.

Nothing outside this folder imports it.  Every operator takes and returns DataFrames; the queries
that apply them to whole tables are in :mod:`sightline.llm.queries`.
"""
