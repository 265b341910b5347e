"""Scalar expressions: canonical forms, digests, spellings of absence."""
