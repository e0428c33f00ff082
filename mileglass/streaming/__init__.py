"""Streaming layers over the file source and the file sink."""
