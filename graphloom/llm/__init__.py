"""Training-data operators: quality, tokens, duplicates, decontamination, licences.

Nothing else in the library imports this subpackage.
"""
