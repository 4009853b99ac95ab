"""Selections, assembly of transactions, and statistics."""

from txlog.operators.assemble import assemble, check_grouping, disposition, drop_empty, mark_incomplete, raw_transactions
from txlog.operators.requests import group_by_request, order_by_request, query_groups
from txlog.operators.select import filter_headers, filter_side, filter_tags, has, matches, query_records, query_transactions, truncate_payload
from txlog.operators.stats import log_stats

__all__ = [
    "assemble", "check_grouping", "disposition", "drop_empty", "filter_headers", "filter_side", "filter_tags", "group_by_request", "has", "log_stats",
    "mark_incomplete", "matches", "order_by_request", "query_groups", "query_records", "query_transactions", "raw_transactions", "truncate_payload",
]
