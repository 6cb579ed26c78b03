"""All registered queries of the sequence operators and their SQL."""

from ostinato.plans import golden_queries, harmony_queries, join_queries, naming_queries, quality_queries, sequence_queries, stream_queries, tuning_queries
from ostinato.plans.common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "golden_queries", "harmony_queries", "join_queries", "naming_queries", "quality_queries", "sequence_queries", "stream_queries", "tuning_queries"]
