"""pagefold: page-acquisition analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame(s) -> DataFrame`` built from
native Spark SQL expressions, so they compose with ``DataFrame.transform``
and Catalyst plans them (pushdown, pruning, codegen, AQE) like any query.
"""

from pagefold.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
