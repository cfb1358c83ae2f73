"""Whole queries: the verbs, their text forms and the driver queries."""
