"""All queries of the library's own operators, with the SQL that checks them."""

from loamwork.plans import queries_activity, queries_corpus, queries_graph, queries_planning, queries_rules, queries_vectors

MODULES = (queries_activity, queries_corpus, queries_graph, queries_planning, queries_rules, queries_vectors)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: f for m in MODULES for k, f in m.SQL.items()}
