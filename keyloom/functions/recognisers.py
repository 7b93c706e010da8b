"""Recognisers as table functions: each row of a table gives any number of found regions, by a lateral join."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

#: What a region's columns hold; all but the first two can be asked for or left out.
FIELDS = {"ord": IntegerType(), "text": StringType(), "start": IntegerType(), "end": IntegerType(), "confidence": DoubleType()}


class Markup:
    """A stand-in recogniser: the elements of one kind in a page, as regions of the text that they hold.

    Arguments: the page, the element's name, and the columns wanted, as constants. An element that holds further
    elements is no region. Confidence is the share of letters and digits in the text.
    """

    @staticmethod
    def analyze(page: AnalyzeArgument, element: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(page.dataType, StringType):
            raise ValueError("a page is a text")
        if not element.isConstantExpression or not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", str(element.value)):
            raise ValueError("the element's name is a constant")
        schema = StructType()
        for name in ["ord", "text", *(c.strip() for c in str(columns.value or "").split(",") if c.strip())]:
            if name not in FIELDS or name in schema.names:
                raise ValueError(f"no such column: {name}")
            schema = schema.add(name, FIELDS[name])
        return AnalyzeResult(schema)

    def eval(self, page: str, element: str, columns: str) -> Iterator[tuple]:
        names = ["ord", "text", *(c.strip() for c in (columns or "").split(",") if c.strip())]
        pattern = re.compile(rf"<{element}(?: [^<>]*)?>([^<]*)</{element}>")
        for ord_, found in enumerate(pattern.finditer(page or "")):
            text = found[1]
            letters = sum(c.isalnum() for c in text)
            row = {"ord": ord_, "text": text, "start": found.start(1), "end": found.end(1), "confidence": letters / len(text) if text else 0.0}
            yield tuple(row[name] for name in names)


def recogniser(kind: type) -> UserDefinedTableFunction:
    """A class with `analyze` and `eval` as a table function."""
    return udtf(kind)


def regions(spark: SparkSession, rows: DataFrame, text: str, element: str, columns: tuple[str, ...] = (), kind: type = Markup) -> DataFrame:
    """The columns of `rows` beside each region that the recogniser finds in the text; rows without one are left out.

    The table function says itself which columns it returns (`analyze`), so a wrong request fails before any task runs.
    """
    spark.udtf.register("_recognise", recogniser(kind))
    rows.createOrReplaceTempView("_recognised")
    wanted = ",".join(columns)
    return spark.sql(f"SELECT r.*, f.* FROM _recognised r, LATERAL _recognise(r.`{text}`, '{element}', '{wanted}') f")
