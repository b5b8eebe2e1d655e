"""Training-data operators: packing, fingerprints, media, joins, dedup, language, mixing, quality, PII.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered ``opN_<name>`` queries.
"""
