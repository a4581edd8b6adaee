"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Operator modules hold the general
interfaces; :mod:`sortkit.llm.queries` registers the thin ``opN_*`` queries.
"""
