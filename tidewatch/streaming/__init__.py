"""Structured Streaming: scoring with resume, and count windows of unbounded streams."""
