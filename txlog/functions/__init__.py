"""Payload functions, Column to Column."""

from txlog.functions.fields import basic_auth_user, field, has_header, header_field, header_name, header_value, microseconds, quote_binary, split_epoch, url_path, url_query
from txlog.functions.timefmt import strftime

__all__ = ["basic_auth_user", "field", "has_header", "header_field", "header_name", "header_value", "microseconds", "quote_binary", "split_epoch", "strftime", "url_path", "url_query"]
