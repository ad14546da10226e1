"""Training-data operators: quality, dedup, filtering, mixing, sharding, packing, search.

Nothing else in the library imports this subpackage. ``registry`` holds the
queries ``op1_*`` .. ``op10_*`` and their DuckDB oracles."""
