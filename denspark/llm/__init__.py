"""Operators for large training corpora: quality, privacy, duplicates, leaks, licences, mixing, toxicity, audits, fill-in-middle."""
