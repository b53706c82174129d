"""What SQL text may call: Arrow functions that have no built-in twin, and sheets read from a text value."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from rollbook.functions.text import strip_accents_exact
from rollbook.operators.similarity import sequence_ratio
from rollbook.sources.files import text_rows


class SheetCells:
    """A3-A5 as a table function: sheet_cells(content) gives row, col and text of a delimited or fixed-width text."""

    def eval(self, content: str) -> Iterator[tuple[int, int, str]]:
        for r, cells in enumerate(text_rows(content or "")):
            for c, text in enumerate(cells):
                yield r, c, text


def register(spark: SparkSession) -> None:
    """strip_accents_exact(text), sequence_ratio(a, b) and sheet_cells(content) for SQL in this session."""
    spark.udf.register("strip_accents_exact", strip_accents_exact)
    spark.udf.register("sequence_ratio", sequence_ratio)
    spark.udtf.register("sheet_cells", udtf(SheetCells, returnType="row int, col int, text string"))
