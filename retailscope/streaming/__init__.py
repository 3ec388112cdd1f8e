"""Requests that arrive as a stream."""
