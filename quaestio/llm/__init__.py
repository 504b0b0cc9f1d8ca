"""Training-data operators: mixing, quality rules, packing, language id, nearest
neighbours, line dedup, WARC, secret scans, n-gram Jaccard join, LM scoring.

Nothing else in the library imports this subpackage.
"""
