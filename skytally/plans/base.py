"""The decorator that registers queries over the derived frames, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import Frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, frames: tuple[str, ...] = ()):
    """Register a function of ``Frames`` under its name, with its SQL behind the frames' common tables."""

    def register(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Frames(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = ("WITH " + ", ".join(x.strip() for x in frames) + "\n" if frames else "") + sql.strip()
        return f

    return register
