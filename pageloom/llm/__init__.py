"""Training-data operators: language, duplicates, personal data, secrets, licences, media, packing.

Nothing outside this subpackage imports it. ``registry.queries()`` and ``registry.oracle_sql()``
hold the thin ``opN_<name>`` queries; each operator lives in a module of its own with a general
interface (real texts, spans, files), and the query derives the digest columns from that.
"""
