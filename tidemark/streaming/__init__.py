"""Structured Streaming jobs: bars from ticks, stateful regimes."""
