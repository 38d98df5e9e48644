"""Compositions of operators: published projections, read queries, the release build."""
