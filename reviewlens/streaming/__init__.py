"""Streaming: incremental re-analysis of stores as review files land."""
