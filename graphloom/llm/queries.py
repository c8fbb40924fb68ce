"""All queries of this subpackage and their SQL."""

from . import bpe, dual_tree, exact_dedup, language_id, line_dedup, media, packing, periodic_runs, pieces, quality, sharding, simhash, url_filter

MODULES = (media, sharding, packing, bpe, simhash, exact_dedup, language_id, url_filter, quality, line_dedup, periodic_runs, pieces, dual_tree)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
