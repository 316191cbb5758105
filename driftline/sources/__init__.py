"""Readers: change tables, capture stores, profiles, traces, workload files."""
