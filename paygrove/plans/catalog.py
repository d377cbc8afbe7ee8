"""All registered queries of the library and their SQL."""

from paygrove.plans import q_anatomy, q_backtest, q_canonical, q_chain, q_evaluate, q_features, q_folds, q_graph, q_models, q_reports, q_rules, q_serve, q_simulate, q_streams

_PARTS = (q_canonical, q_features, q_graph, q_rules, q_folds, q_evaluate, q_models, q_serve, q_chain, q_reports, q_anatomy, q_streams, q_backtest, q_simulate)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
