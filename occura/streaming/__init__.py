"""Structured Streaming forms of the telemetry and state operators."""
