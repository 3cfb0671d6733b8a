"""Training-data operators: deduplication, fingerprints, scans, language ID, WARC, token files, decontamination.

Nothing outside this subpackage imports it.
"""
