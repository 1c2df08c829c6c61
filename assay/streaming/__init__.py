"""Structured Streaming forms of the record and event scans."""
