"""Operators of a large-scale training-data pipeline, one module each.

Nothing outside this subpackage imports it; its queries are registered by
``entries`` and picked up by the top-level entry module when present.
"""
