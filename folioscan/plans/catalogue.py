"""All queries of the retrieval operators and their SQL twins, by name."""

from folioscan.plans import answers, composed, documents, language, notes, retrieval, workflow

_PARTS = (retrieval, documents, workflow, answers, composed, notes, language)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
