"""Structured Streaming forms of the control loops."""
