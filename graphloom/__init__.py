"""Typed property graphs as DataFrame plans."""
