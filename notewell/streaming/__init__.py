"""Structured Streaming: the batch column functions over streams."""
