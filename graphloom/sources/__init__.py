"""Readers and writers: documents, catalogues, configuration, relational projections."""
