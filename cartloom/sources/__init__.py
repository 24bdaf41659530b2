"""Readers and writers: member orders, settings tables, exports, star-schema adapter."""
