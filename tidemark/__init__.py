"""Interval, event and observation analytics on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need no copy of the package: functions that run there travel with their code.
register_pickle_by_value(sys.modules[__name__])

from .operators.aggregate import factorize, grouped_mode, partition_series  # noqa: E402
from .operators.intervals import combine_intervals, group_intervals  # noqa: E402
from .operators.joins import find_containing_interval, inner_or_cross_join, merge_aggregates, merge_intervals  # noqa: E402
from .operators.locate import get_loc, iloc_loc, iloc_loc_assign  # noqa: E402
from .operators.ordered import impute, prev_next_values, roll1d, shift_compare, shift_equal, shift_unequal  # noqa: E402
from .operators.resample import custom_agg, resample_eav, resample_interval  # noqa: E402
from .operators.windows import make_windows  # noqa: E402

__all__ = [
    "combine_intervals", "custom_agg", "factorize", "find_containing_interval", "get_loc", "group_intervals", "grouped_mode", "iloc_loc", "iloc_loc_assign", "impute",
    "inner_or_cross_join", "make_windows", "merge_aggregates", "merge_intervals", "partition_series", "prev_next_values", "resample_eav", "resample_interval", "roll1d", "shift_compare", "shift_equal", "shift_unequal",
]
