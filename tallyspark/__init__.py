"""tallyspark: bank-ledger analytics as Spark DataFrame operators.

Subpackages: ``functions`` (Column -> Column building blocks), ``sources``
(statement files, snapshots, fixtures over the driver tables), ``operators``
(search, statistics, keyword contributions, recurrence, projection, import,
maintenance), ``streaming`` (incremental statement import) and ``plans``
(the query registry, oracle SQL and plan inspection).
"""

__version__ = "0.1.0"
