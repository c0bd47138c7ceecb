"""Structured Streaming forms of what grows from run to run."""
