"""The same jobs on growing logs."""

from txlog.streaming.late import LateRecords, late_records_so_far
from txlog.streaming.transactions import (
    drain, flush_log_stats, late_records, pending_events, pending_transactions, read_log_stats, stream_events, stream_log_stats, stream_raw, stream_stats,
    stream_transactions, stream_transactions_windowed,
)

__all__ = [
    "LateRecords", "drain", "flush_log_stats", "late_records", "late_records_so_far", "pending_events", "pending_transactions", "read_log_stats", "stream_events", "stream_log_stats", "stream_raw",
    "stream_stats", "stream_transactions", "stream_transactions_windowed",
]
