"""Builder of resampling windows."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import q, require


class make_windows:  # noqa: N801
    """Windows as expressions over a table; made when the resampling operator calls it.

    df: the source table; None for the one that is resampled; or a callable (df, **names) -> table, names being entity_col,
    time_col, start_col and stop_col. entity, start, stop, start_rel, stop_rel, duration, anchor: a column's name, a Column over
    the source, or a value. start_rel and stop_rel are added to anchor (time_col by default, with a warning); duration gives
    the endpoint that isn't given. Whether windows are empty isn't checked.
    """

    def __init__(self, df: DataFrame | Callable | None = None, entity=None, start=None, stop=None, start_rel=None, stop_rel=None, duration=None, anchor=None):
        require(start is None or start_rel is None, "start and start_rel exclude each other")
        require(stop is None or stop_rel is None, "stop and stop_rel exclude each other")
        has_start, has_stop = start is not None or start_rel is not None, stop is not None or stop_rel is not None
        require(has_start or has_stop, "an endpoint is needed")
        require(duration is None or has_start != has_stop, "duration needs exactly one endpoint")
        if anchor is not None and start_rel is None and stop_rel is None:
            warnings.warn("anchor is unused without start_rel or stop_rel", stacklevel=2)
        self.df, self.args = df, dict(entity=entity, start=start, stop=stop, start_rel=start_rel, stop_rel=stop_rel, duration=duration, anchor=anchor)

    def __repr__(self) -> str:
        return "make_windows(" + ", ".join(f"{k}={v!r}" for k, v in self.args.items() if v is not None) + ")"

    @staticmethod
    def _parse(df: DataFrame, value, name: str, allow_str: bool = False) -> Column | None:
        if value is None or isinstance(value, Column):
            return value
        if isinstance(value, str):
            if value in df.columns:
                return q(value)
            require(allow_str, f"{name}: unknown column {value!r}")
            return F.lit(value)
        require(not isinstance(value, (DataFrame, list, tuple, set, dict)) and not hasattr(value, "columns") and not hasattr(value, "iloc") and not hasattr(value, "tolist"), f"{name} must be a column or a value, not {type(value).__name__}")
        return F.lit(value)

    def __call__(self, df: DataFrame | None = None, entity_col: str | None = None, time_col: str | None = None, start_col: str | None = None, stop_col: str | None = None, **_) -> DataFrame:
        src = self.df if isinstance(self.df, DataFrame) else df
        if self.df is not None and not isinstance(self.df, DataFrame):
            require(callable(self.df), "df must be a table or a callable")
            src = self.df(df, entity_col=entity_col, time_col=time_col, start_col=start_col, stop_col=stop_col)
        require(isinstance(src, DataFrame), "there is no table to make windows of")
        a = {k: self._parse(src, v, k, allow_str=k == "entity") for k, v in self.args.items()}
        require(self.df is not None or df is not None, "only values and no table")
        anchor = a["anchor"]
        if anchor is None and (a["start_rel"] is not None or a["stop_rel"] is not None):
            require(time_col is not None and time_col in src.columns, "start_rel and stop_rel need an anchor or a time_col")
            warnings.warn(f"windows are anchored at {time_col!r}", stacklevel=2)
            anchor = q(time_col)
        start = a["start"] if a["start_rel"] is None else anchor + a["start_rel"]
        stop = a["stop"] if a["stop_rel"] is None else anchor + a["stop_rel"]
        if a["duration"] is not None:
            start, stop = (start, start + a["duration"]) if stop is None else (stop - a["duration"], stop)
        entity = a["entity"]
        if entity is None and entity_col is not None and entity_col in src.columns:
            entity = q(entity_col)
        if time_col is None:
            s, e = start_col or "start", stop_col or "stop"
            require(s != e, "start and stop need different names")
        else:
            s, e = "start", "stop"
        out = [] if entity is None else [entity.alias(entity_col or "entity")]
        return src.select(*out, *([start.alias(s)] if start is not None else []), *([stop.alias(e)] if stop is not None else []))
