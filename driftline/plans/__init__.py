"""Registered queries: each family pairs Spark plans with the SQL they must equal."""


def all_catalogs():
    """The catalogs of every query family."""
    from driftline.plans import captures, changes, diffs, ledger, manifest, sessions, streams, texts, trace

    families = (captures, changes, diffs, trace, ledger, manifest, sessions, texts, streams)
    return [family.catalog for family in families]
