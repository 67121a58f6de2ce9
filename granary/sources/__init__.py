"""Readers and writers: landing zone, layered stores, paged and nested JSON."""
