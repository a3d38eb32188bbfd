"""Training-data operators: scoring, secrets, tokens, licences, decontamination, near copies.

Nothing else in the library imports this subpackage.
"""
