"""Operators that prepare training data: dedup, fingerprints, scans, packing, models."""
