"""Operators for preparing training corpora: packing, filtering, mixing, near-duplicate joins, search.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
