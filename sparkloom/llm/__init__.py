"""Training-data operators: language ID, near-duplicates, decontamination, PII, tokens, WARC and more.

Nothing outside this subpackage imports it; it may be deleted without touching the rest of the library.
"""
