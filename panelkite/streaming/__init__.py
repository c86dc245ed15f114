"""Structured Streaming counterparts of the resampling and stateful operators."""
