"""Output formats and the jobs that they drive."""

from txlog.plans.formats import BACKEND_FORMAT, DEFAULT_FORMAT, format_events, format_line, format_raw, needed_tags, required_slots, validate_format

__all__ = ["BACKEND_FORMAT", "DEFAULT_FORMAT", "format_events", "format_line", "format_raw", "needed_tags", "required_slots", "validate_format"]
