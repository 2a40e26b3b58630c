"""Tables in: the operators take DataFrames of any reader; here is the one that the queries use, and positions for files without ids."""

from ..common import row_ids, table

__all__ = ["row_ids", "table"]
