"""Work on rows that may fail: what fails is tried again, then set apart with its reason, and never fails the run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Messages of errors that another attempt may mend.
PASSING = ("connection", "network", "rate limit", "temporarily", "timeout", "too many")


def linear(attempt: int) -> float:
    """Seconds before the next attempt: 1, 2, 3."""
    return float(attempt)


def exponential(attempt: int) -> float:
    """1, 2, 4, 8."""
    return float(2 ** (attempt - 1))


def passing(error: Exception) -> bool:
    """Whether an error is one of a network or a service, by its kind or its message."""
    return isinstance(error, (ConnectionError, TimeoutError)) or any(p in str(error).lower() for p in PASSING)


def settle_all(df: DataFrame, work: Callable[[dict], dict], schema: str | T.StructType, attempts: int = 3, wait: Callable[[int], float] = linear, again: Callable[[Exception], bool] = lambda error: True) -> DataFrame:
    """work(row) for each row of df, any columns: its columns (schema), attempts (long) and error.

    A row whose work raises is tried attempts times in all, with wait(n) seconds after the n-th, as long as again(error) says so;
    then its columns are null and error says why. Rows are independent and stay where they are: no shuffle, one Arrow batch at
    a time. An empty table gives no rows; None from work is a failure too. Errors of Spark itself (a lost executor) are Spark's to
    try again: work may run more than once for a row.
    """
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*out.fields, T.StructField("attempts", T.LongType()), T.StructField("error", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    kind, names = to_arrow_schema(full), out.names

    def one(row: dict) -> dict:
        import time

        for n in range(1, attempts + 1):
            try:
                done = work(row)
                if done is None:
                    raise ValueError("no result")
                return {**{c: done.get(c) for c in names}, "attempts": n, "error": None}
            except Exception as error:  # noqa: BLE001  whatever it is, it is this row's
                reason = f"{type(error).__name__}: {error}"
                if n == attempts or not again(error):
                    break
                time.sleep(wait(n))
        return {**dict.fromkeys(names), "attempts": n, "error": reason}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.slice(at, 500).to_pylist()], schema=kind)

    return df.mapInArrow(run, full)


def settled(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that came through, and the quarantine: those with an error."""
    return results.where("error is null").drop("error", "attempts"), results.where(F.col("error").isNotNull())
