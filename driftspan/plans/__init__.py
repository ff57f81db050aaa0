"""Query plans over the given tables; importing them fills the registry."""

from . import compare_queries, detect_queries, label_queries, log_queries, score_queries, sequence_queries, stream_queries  # noqa: F401
