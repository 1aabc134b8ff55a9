"""retentia: subscription and transaction analytics as Spark DataFrame operators.

Every operator takes and returns a ``pyspark.sql.DataFrame`` and is built from
built-in Spark SQL expressions, so Catalyst can prune, push down and codegen
the whole plan.  See README.md for the module map.
"""

__all__ = ["session"]
