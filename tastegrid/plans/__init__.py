"""Distributed plan building blocks: skew-safe lookups, top-n, exact percentiles, blocked products."""
