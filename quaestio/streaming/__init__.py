"""Streaming entry points: the stateless post and question stages on a streaming DataFrame."""
