"""Scans: bounded files, manifests, JSON documents as node rows, records and events."""
