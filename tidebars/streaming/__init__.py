"""Structured Streaming versions of resampling, features, regimes and signals."""
