"""Compositions: the medallion flow, the two-run history behind the registered queries,
the query catalog and its SQL oracles."""
