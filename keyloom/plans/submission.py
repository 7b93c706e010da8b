"""Answer files: at most 100 rows per query, written as CSV without header, or zipped for one batch."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.contracts import require_none
from keyloom.plans.requests import submission_name

MOST_ROWS, MOST_CHARS, MOST_FILES = 100, 100, 10_000
EMPTY_ZIP = b"PK\x05\x06" + bytes(18)


def first_answers(results: DataFrame, by: str, *order) -> DataFrame:
    """The first answers of each query in their order."""
    w = Window.partitionBy(by).orderBy(*order)
    return results.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= MOST_ROWS)


def competition_rows(results: DataFrame, by: str, *order, columns: tuple[str, ...] = ("video_id", "frame_id")) -> DataFrame:
    """(by, place, row): the first answers of each query, each as a JSON text of the given columns."""
    return first_answers(results, by, *order).select(by, "place", F.to_json(F.struct(*columns)).alias("row"))


def invalid_answers(answers: DataFrame) -> DataFrame:
    """Rows (query_id, answer) that break the rules: blank or too long."""
    a = F.trim(F.coalesce("answer", F.lit("")))
    return answers.filter((a == "") | (F.length("answer") > MOST_CHARS))


def write_csv(rows: DataFrame, folder: str, by: str, *columns: str) -> None:
    """One folder of headerless CSV files per query, each sorted by `place`."""
    (
        rows.repartition(by)
        .sortWithinPartitions(by, "place")
        .select(by, *columns)
        .write.partitionBy(by)
        .option("header", False)
        .option("lineSep", "\n")
        .csv(folder)
    )


def archives(answers: DataFrame, by: str, *columns: str) -> DataFrame:
    """(by, n_files, n_rows, content): a ZIP for each archive, with one CSV for each of its queries, made where its rows meet.

    answers (by, query_id, place, columns...), at most MOST_ROWS rows of a query and MOST_FILES queries of an archive, else an error; so an
    archive is of bounded size. Fields are quoted where CSV asks for it. Every archive is opened again and its names and rows compared.
    """
    sizes = answers.groupBy(by, "query_id").agg(F.count("*").alias("n"))
    require_none(sizes.filter(F.col("n") > MOST_ROWS).select("query_id"), f"queries of over {MOST_ROWS} answers")
    files = sizes.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > MOST_FILES)
    require_none(files.select(by), f"archives of over {MOST_FILES} files")

    def made(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (str(r["query_id"]), r["place"]))
        texts: dict[str, list] = {}
        for row in rows:
            texts.setdefault(f"submission/{submission_name(str(row['query_id']))}", []).append([row[c] for c in columns])
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, lines in texts.items():
                text = io.StringIO(newline="")
                csv.writer(text, lineterminator="\n").writerows(lines)
                z.writestr(zipfile.ZipInfo(name), text.getvalue().encode())
        with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
            back = {n: len(list(csv.reader(io.StringIO(z.read(n).decode(), newline="")))) for n in z.namelist()}
        if back != {n: len(lines) for n, lines in texts.items()}:
            raise ValueError(f"an archive does not hold what was written: {back}")
        return pa.table({by: table.column(by).slice(0, 1), "n_files": pa.array([len(texts)], pa.int32()),
                         "n_rows": pa.array([len(rows)], pa.int32()), "content": pa.array([out.getvalue()], pa.binary())})

    kind = answers.schema[by].dataType.simpleString()
    rows = answers.select(by, "query_id", "place", *columns)
    return rows.groupBy(by).applyInArrow(made, f"{by} {kind}, n_files int, n_rows int, content binary")


def members(made: DataFrame, by: str) -> DataFrame:
    """(by, name, text): the files of archives (by, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in enumerate(batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    texts = [z.read(n).decode() for n in names]
                key = batch.column(0).take(pa.array([at] * len(names), pa.int64()))
                yield pa.RecordBatch.from_arrays([key, pa.array(names, pa.string()), pa.array(texts, pa.string())], [by, "name", "text"])

    return made.select(by, "content").mapInArrow(run, f"{by} {made.schema[by].dataType.simpleString()}, name string, text string")


def zipped(answers: DataFrame, *columns: str) -> bytes:
    """The ZIP of one batch of queries (query_id, place, columns...), which is handed out here."""
    made = archives(answers.withColumn("_batch", F.lit(0)), "_batch", *columns).first()
    return made.content if made else EMPTY_ZIP
