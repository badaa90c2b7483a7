"""Training-data operators: decontamination, language id, near-duplicates, quality,
tokenisation, URL filters, license scans, chat formatting and substring dedup.

Nothing outside this subpackage imports it.
"""
