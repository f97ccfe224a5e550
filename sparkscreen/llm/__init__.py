"""Training-data operators (chat, URL, language model, decontamination, quality, WARC, line, mixing, licence, near-duplicate).

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries and ``oracles.py`` their SQL.
"""
