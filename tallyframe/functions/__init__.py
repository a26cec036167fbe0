"""Column-expression builders (all JVM-side, codegen-friendly)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def qcol(name: str) -> Column:
    """A column by its exact name (dots, spaces and backticks are not parsed)."""
    return F.col("`" + name.replace("`", "``") + "`")
