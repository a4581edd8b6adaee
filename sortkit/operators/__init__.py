"""Sorting, partitioning, validation, aggregation, shuffling and trace operators."""
