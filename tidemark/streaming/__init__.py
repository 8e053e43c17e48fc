"""Append-only feeds as Structured Streaming jobs, each with a batch twin.

Watermarks, tumbling windows and the dropping of late rows are our own policy: the
feeds themselves define no event-time rules.
"""
