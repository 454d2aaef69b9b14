"""Structured Streaming entry points.

The reference has no streaming operators; this package only runs the
batch inference (C5) incrementally over corpus files arriving in a
directory.
"""

from aspectspark.streaming.inference import stream_predictions  # noqa: F401
