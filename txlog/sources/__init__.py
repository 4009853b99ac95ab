"""Reading records and writing lines."""

from txlog.sources.folder import stream_folder
from txlog.sources.records import filter_instance, read_records, records_of_messages, stream_records, stream_topic
from txlog.sources.sinks import stream_lines, write_lines

__all__ = ["filter_instance", "read_records", "records_of_messages", "stream_folder", "stream_lines", "stream_records", "stream_topic", "write_lines"]
