"""Writers: capture store, traces, profiles, comparisons."""
