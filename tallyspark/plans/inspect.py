"""Physical-plan inspection helpers used by tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Parts of the names of Spark's plan nodes that run Python workers.
PYTHON_NODES = ("EvalPython", "PythonUDF", "PythonUDTF", "InPandas", "InArrow", "PythonDataSource",
                "mapPartitionsInternal")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text (``explain`` output captured)."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def python_nodes(df: DataFrame) -> list[str]:
    text = plan_text(df, "simple")
    return [n for n in PYTHON_NODES if n in text]


def count_nodes(df: DataFrame, name: str) -> int:
    return plan_text(df, "simple").count(name)
