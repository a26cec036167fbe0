"""tallyframe: ledger analytics as lazy Spark DataFrame operators.

Every operator takes and returns DataFrames, accepts optional grouping
``keys`` (tenant, file, region, ...) so one plan serves a single ledger or
a whole fleet, and is built from Catalyst expressions.
"""

from tallyframe.roles import Ledger, Roles
from tallyframe.session import get_session

__all__ = ["Ledger", "Roles", "get_session"]
