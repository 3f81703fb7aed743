"""The registered queries outside the ``llm`` subpackage, and their SQL."""

from quillspark.plans import catalog_queries, contract_queries, detail_queries, eval_queries, log_queries, search_queries, source_queries

_PLANS = (search_queries, log_queries, eval_queries, catalog_queries, detail_queries, contract_queries, source_queries)

QUERIES = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _PLANS for k, v in p.SQL.items()}
FLAGSHIP = "search_top_k"
