"""Pluggable recognisers: an engine becomes a table function that SQL calls page by page.

``register(spark, "recognise", engine)`` lets SQL say ``SELECT * FROM recognise(TABLE(parts) PARTITION BY page ORDER
BY part_no)``: Spark brings the parts of one page to one call, in order, and pages run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf

#: One recognised word: line, text, x, y, width, height (pixels), confidence (negative: no word).
Word = tuple[int, str, float, float, float, float, float]
Engine = Callable[[object, list[Row]], Iterable[Word]]
WORDS = "page string, seq int, line int, text string, x double, y double, w double, h double, confidence double"
TYPES = pa.schema([("page", pa.string()), ("seq", pa.int32()), ("line", pa.int32()), ("text", pa.string()), *((n, pa.float64()) for n in ("x", "y", "w", "h", "confidence"))])


def is_word(word: Word) -> bool:
    """Whether what an engine says is a word: text that is not blank, in a box with an area, and not given up."""
    _, text, _, _, w, h, confidence = word
    return bool(text and text.strip()) and w > 0 and h > 0 and confidence >= 0


def register(spark: SparkSession, name: str, engine: Engine) -> None:
    """Register ``engine`` as a table function over parts of pages with a column ``page``, one page a partition.

    The engine gets the page's name and its rows; lines are numbered anew from 1 in the order of their first word,
    words from 1 in the engine's order. A page without words gives no row. Parts and words move as Arrow batches;
    a part's nested values are what Arrow gives Python.
    """

    class Recognise:
        def __init__(self):
            self._rows = []

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            made = Row(*batch.schema.names)
            self._rows.extend(map(made, *(c.to_pylist() for c in batch.columns)))
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            page = self._rows[0]["page"] if self._rows else None
            words = [w for w in engine(page, self._rows) if is_word(w)] if self._rows else []
            if words:
                line, text, *numbers = zip(*words, strict=True)
                number: dict[int, int] = {}
                lines = [number.setdefault(k, len(number) + 1) for k in line]
                columns = [[page] * len(words), range(1, len(words) + 1), lines, [t.strip() for t in text], *(map(float, x) for x in numbers)]
                yield pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES.types, strict=True)], schema=TYPES)

    spark.udtf.register(name, arrow_udtf(Recognise, returnType=WORDS))
