"""Structured Streaming forms of the status, quote, bar and risk operators."""
