"""All queries of the library proper, and DuckDB SQL for each."""

from . import arm_queries, chain_queries, check_queries, diagram_queries, dispatch_queries, fact_queries, flow_queries, generic_queries, graph_queries, hint_queries, model_queries, scenario_queries, slice_queries, text_queries, value_queries

_MODULES = (fact_queries, flow_queries, text_queries, model_queries, scenario_queries, value_queries, check_queries, arm_queries, graph_queries, diagram_queries, dispatch_queries, chain_queries, slice_queries, hint_queries, generic_queries)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in _MODULES for name, q in m.ORACLES.items()}
