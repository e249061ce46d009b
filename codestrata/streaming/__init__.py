"""Structured Streaming forms of the rolling reports."""
