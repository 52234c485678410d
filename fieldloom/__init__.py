"""fieldloom: bulk extraction of structured records from document tables, on Spark.

Every public function takes and returns DataFrames (or Columns); nothing is
executed until the caller runs an action.  Sub-packages:

``functions``  column expressions: text, patterns, checks, amounts, votes
``operators``  DataFrame operators: detection, rules, location, layout, upkeep
``sources``    readers, admission, writers and exports
``plans``      recipes of the two supported document families, end-to-end plan
``streaming``  the same operators on arriving files
``workloads``  named queries over the test tables with their SQL counterparts
"""

__version__ = "0.1.0"
