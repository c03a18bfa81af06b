"""Named end-to-end queries over the driver tables (the ``__spark_entry__`` registry)."""

from mixlens.plans.queries import QUERIES, ORACLE_SQL, FLAGSHIP

__all__ = ["QUERIES", "ORACLE_SQL", "FLAGSHIP"]
