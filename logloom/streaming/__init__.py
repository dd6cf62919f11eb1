from .parse_stream import StreamState, first_seen_keys, parse_batch, start_parse_stream

__all__ = ["StreamState", "first_seen_keys", "parse_batch", "start_parse_stream"]
