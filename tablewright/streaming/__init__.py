"""Fitted steps on Structured Streaming."""
