"""All queries of the subpackage."""

from citeflow.llm import encodings, leaks, names, scanned, tokens, truncation, works

_PARTS = [encodings, leaks, names, scanned, tokens, truncation, works]
QUERIES = {name: q for p in _PARTS for name, q in p.QUERIES.items()}
SQL = {name: sql for p in _PARTS for name, sql in p.SQL.items()}
