"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the
``opN_*`` queries in :mod:`tessera.llm.queries` are thin wrappers that fix parameters and columns.
"""
