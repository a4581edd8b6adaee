"""Column expressions: keys, buckets, units and measures of divergence."""
