"""Structured Streaming forms of trace ingestion, net change and event counting."""
