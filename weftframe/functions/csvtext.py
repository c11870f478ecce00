"""CSV held in a text column, and rows written as CSV lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import quoted

_CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def parse_csv_text(
    df: DataFrame, column: str, fields: Sequence[str], has_header: bool = True, line_no: str = "line_no"
) -> DataFrame:
    """One row per non-empty CSV line of ``column``; short lines give nulls.

    ``fields`` names the cells left to right; the header line is skipped. The
    other columns are kept and ``line_no`` counts data lines from zero.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    lines = F.filter(F.split(F.replace(F.col(column), F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: x != "")
    if has_header:
        lines = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    exploded = df.select(
        *[F.col(quoted(c)) for c in df.columns if c != column], F.posexplode(lines).alias(line_no, "_line")
    )
    parsed = F.from_csv("_line", schema.simpleString()[len("struct<"):-1].replace(":", " "), _CSV_OPTIONS)
    rest = [c for c in exploded.columns if c != "_line"]
    return exploded.select(*rest, parsed.alias("_cells")).select(*rest, "_cells.*")


def csv_cell(column: Column) -> Column:
    """A value as CSV: quoted only when it holds a comma, quote or newline."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    escaped = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\\n\\r]'), escaped).otherwise(text)


def csv_line(columns: Sequence[str | Column]) -> Column:
    """The values of one row as a CSV line."""
    cells = [csv_cell(F.col(c) if isinstance(c, str) else c) for c in columns]
    return F.concat_ws(",", *cells)


def csv_header(names: Sequence[str]) -> Column:
    return csv_line([F.lit(n) for n in names])


def csv_document(rows: Column, fields: Sequence[str], include_header: bool = True) -> Column:
    """An array of structs in one row as CSV text."""
    lines = F.transform(rows, lambda r: csv_line([r.getField(f) for f in fields]))
    body = F.array_join(lines, "\n")
    if not include_header:
        return body
    return F.when(F.size(rows) > 0, F.concat_ws("\n", csv_header(fields), body)).otherwise(F.lit(""))
