"""Writing results: files, Markdown tables and messages with retries."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, form: str, sources: list[str] = ()) -> None:
    """Writes JSON lines, CSV or Parquet to a new folder; refuses to write over or into a source."""
    if form not in ("json", "csv", "parquet"):
        raise ValueError("form is json, csv or parquet")
    target = _address(path)
    for s in sources:
        source = _address(s)
        if target == source or target.startswith(source + os.sep) or source.startswith(target + os.sep):
            raise ValueError("the target is, holds or lies in a source")
    writer = df.write.mode("errorifexists")
    if form == "csv":
        flat = df.select([F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes])
        flat.write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)
    else:
        getattr(writer, form)(path)


def _address(path: str) -> str:
    """A path without links and detours; addresses of other file systems are compared as they are written, without repeated and closing slashes."""
    scheme, mark, rest = path.partition(":")
    if not mark or scheme == "file":
        return os.path.realpath("/" + rest.lstrip("/") if mark else path)
    return f"{scheme.lower()}:" + os.path.normpath("/" + rest.lstrip("/"))


def wide_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Unlike row types as one table with all their columns and row_type."""
    out = None
    for name, part in parts.items():
        rows = part.withColumn("row_type", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as the row of a Markdown table; pipes and line ends inside a cell are escaped, nulls are empty."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("row"))


def rounded(amount, digits: int = 2):
    """Half-up with thousands separators, for display only."""
    return F.format_number(F.round(amount.cast(f"decimal(38,{digits + 4})"), digits), digits)


def backoff(attempt: int) -> float:
    """Seconds before the next attempt: 1, 2, 4, 4, ..."""
    return float(min(2**attempt, 4))


def send_rows(df: DataFrame, send: Callable[[list[dict]], int], batch: int = 100, attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Sends the rows in batches and reports each: first_row, rows, attempts, status.

    ``send`` gets a list of rows and returns a status like that of HTTP; 429
    and from 500 on are tried again.  A task that is lost sends its batches
    again, so the receiver must know messages by an identifier.
    """

    def run(rows: Iterator):
        held = []
        for frame in rows:
            for row in frame.to_dict("records"):
                held.append(row)
                if len(held) == batch:
                    yield _sent(held)
                    held = []
        if held:
            yield _sent(held)

    def _sent(held):
        import pandas as pd

        for k in range(attempts):
            status = int(send(held))
            if status != 429 and status < 500:
                break
            if k + 1 < attempts:
                wait(backoff(k))
        return pd.DataFrame({"rows": [len(held)], "attempts": [k + 1], "status": [status]})

    return df.mapInPandas(run, "rows int, attempts int, status int")
