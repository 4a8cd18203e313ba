"""Streams: all mora functions are stateless, so they work on a stream as on a table."""

from hakuspark.streaming.counts import mora_stream, windowed_mora_counts

__all__ = ["mora_stream", "windowed_mora_counts"]
