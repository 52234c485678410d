"""Named queries over the test tables, each with its SQL counterpart.

``QUERIES`` maps a name to a function (spark, folder) -> DataFrame, ``SQL`` maps
the names that can be said in SQL to the statement.
"""

from importlib import import_module

from fieldloom.workloads.registry import QUERIES, SQL

for _name in ("classification", "rules", "location", "values", "geometry", "documents", "catalogues", "queues", "streams"):
    import_module(f"fieldloom.workloads.{_name}")

__all__ = ["QUERIES", "SQL"]
