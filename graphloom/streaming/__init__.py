"""Streams of contributions."""
