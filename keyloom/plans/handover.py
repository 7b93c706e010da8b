"""Checks and filters between steps, on the provided tables: documents stand for frames, their sources for videos, line items for
detected objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import language
from keyloom.operators import contracts, detections
from keyloom.sources.tables import table

WIDTH, HEIGHT, LEAST = 40, 30, 0.25


def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return detections.numbered(docs, "source", "doc_id", name="number").select("doc_id", "number")


def stream_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in the order of their ids, which repeat after 900 of a source; vectors of two lengths stand in every 50th."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    short = F.when(F.col("doc_id") % 50 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    frames = docs.select(F.col("source").alias("video_id"), (F.col("doc_id") % 900).alias("frame_id"), F.col("doc_id").alias("local_index"), short.alias("vector"))
    return contracts.stream_faults(frames)


def confident_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    box = items.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_tax").cast("double") * 10).alias("confidence"),
        (F.col("l_quantity").cast("double") - 10.5).alias("x1"),
        (F.col("l_discount").cast("double") * 150 - 2.5).alias("y1"),
        (F.col("l_quantity").cast("double") + 2.5).alias("x2"),
        (F.col("l_tax").cast("double") * 500 + 0.5).alias("y2"),
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
    )
    return detections.confident_boxes(box, LEAST, "width", "height").drop("width", "height", "confidence")


def migration_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents and pages as two listings."""
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"))
    b = table(spark, sf_dir, "pages").select((F.col("page_id") * 2).alias("name"))
    return contracts.migration_state(a, b)


def uri_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", language.redact_uri(F.col("url")).alias("shown"))


def answer_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers, some without a text, an id or a right to either."""
    i = F.col("doc_id")
    ids = F.when(i % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i, i % 11))
    answers = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(
        i.alias("query_id"),
        F.when(i % 3 == 0, "INSUFFICIENT").otherwise("ANSWERED").alias("status"),
        F.when(i % 5 == 0, "  ").when(i % 4 != 0, F.substring("text", 1, 20)).alias("answer"),
        ids.alias("evidence_ids"),
    )
    return contracts.answer_faults(answers)


def left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as steps that select evidence for an order: what each tried, took, cut off and could not resolve."""
    whole = lambda c, n=1: (F.col(c).cast("double") * n).cast("long")
    steps = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), whole("l_quantity").alias("attempted"), F.col("l_linenumber").cast("long").alias("selected"),
        F.round(F.col("l_tax").cast("double") * 100).cast("long").alias("truncated"), (F.col("l_linenumber") % 2).cast("long").alias("collisions"),
        whole("l_quantity").alias("requested"), F.least(whole("l_quantity"), F.lit(30)).alias("resolved"),
    )
    return contracts.left_out(steps)


def informative_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation without the short ones, unless all of it are short."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") < 120).alias("short"))
    return contracts.without_repetitive(turns, ["conv_id"], "short").select("conv_id", "turn")


def mixed_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and kind as a branch's result; values under five stand for scores that were not normalised."""
    hits = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_type").alias("branch"), F.when(F.col("value") >= 5, F.col("value")).alias("normalized_score")
    )
    return contracts.mixed_normalisation(hits)


def neighbours_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a user as primary frames, at most five of them, and the events beside them in turn, eight images in all."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    frames = events.select(F.col("event_id").alias("frame_id"), "user_id", "ts")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    bought = events.filter(F.col("event_type") == "purchase").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("frame_id"), nth.alias("position"))
    return contracts.neighbours_within(frames, bought.filter(F.col("position") <= 5), 8, "user_id", "ts", "frame_id")


def confident_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as detected texts, the confidence from their length."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", ((F.length("text") % 100) / 100).alias("confidence"))
    return detections.confident_texts(turns, 0.5).select("conv_id", "turn")


QUERIES = {
    f.__name__: f
    for f in (
        numbered_rows, stream_faults, confident_boxes, migration_state, uri_redaction, answer_faults, left_out, informative_turns,
        mixed_normalisation, neighbours_within, confident_texts,
    )
}
ORACLES = {
    "answer_faults": """WITH a AS (SELECT doc_id AS i, doc_id % 3 <> 0 AS done, trim(CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 4 <> 0 THEN coalesce(text[1:20], '') ELSE '' END, ' ') = '' AS blank,
          doc_id % 7 <> 0 AS ids FROM documents WHERE doc_id IS NOT NULL)
        SELECT i AS query_id, 'answer_missing' AS code FROM a WHERE done AND blank UNION ALL SELECT i, 'evidence_missing' FROM a WHERE done AND NOT ids
        UNION ALL SELECT i, 'answer_unexpected' FROM a WHERE NOT done AND NOT blank UNION ALL SELECT i, 'evidence_repeated' FROM a WHERE ids AND i % 11 = i""",
    "left_out": """SELECT l_orderkey AS query_id, (greatest(0, sum(trunc(l_quantity::DOUBLE) - l_linenumber)) + sum(round(l_tax::DOUBLE * 100) + l_linenumber % 2))::BIGINT AS dropped,
        sum(trunc(l_quantity::DOUBLE) - least(trunc(l_quantity::DOUBLE), 30))::BIGINT AS missing FROM lineitem GROUP BY 1""",
    "informative_turns": """SELECT conv_id, turn FROM (SELECT *, length(text) < 120 AS short, bool_or(length(text) >= 120) OVER (PARTITION BY conv_id) AS any_long FROM conversations)
        WHERE NOT any_long OR NOT short""",
    "mixed_normalisation": "SELECT user_id AS query_id, event_type AS branch FROM events GROUP BY ALL HAVING min(value) < 5 AND max(value) >= 5",
    "neighbours_within": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) AS position FROM e WHERE event_type = 'purchase' QUALIFY position <= 5),
        c AS (SELECT p.user_id, e.event_id, min(position * 2 + if(e.n > p.n, 1, 0)) AS place FROM p JOIN e ON e.user_id = p.user_id AND abs(e.n - p.n) = 1
          WHERE e.event_id NOT IN (SELECT event_id FROM p) GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS nth FROM c)
        SELECT user_id AS query_id, event_id AS frame_id, nth::INT AS nth FROM o WHERE nth + (SELECT count(*) FROM p WHERE p.user_id = o.user_id) <= 8""",
    "confident_texts": "SELECT conv_id, turn FROM conversations WHERE (length(text) % 100) / 100.0 >= 0.5 AND trim(text) <> ''",
    "numbered_rows": "SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS number FROM documents",
    "stream_faults": """WITH f AS (SELECT source AS video_id, doc_id % 900 AS frame_id, doc_id AS i, if(doc_id % 50 = 0, 8, len(embedding)) AS d
        FROM documents JOIN embeddings ON doc_id = vec_id)
        SELECT DISTINCT video_id, 'duplicate_frame_id' AS code FROM f GROUP BY video_id, frame_id HAVING count(*) > 1
        UNION ALL SELECT video_id, 'local_index' FROM f GROUP BY video_id HAVING min(i) <> 0 OR max(i) + 1 <> count(DISTINCT i) OR count(*) <> count(DISTINCT i)
        UNION ALL SELECT video_id, 'dimension' FROM f GROUP BY video_id HAVING min(d) <> max(d)""",
    "confident_boxes": f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_tax::DOUBLE * 10 AS confidence,
        greatest(0, round_even(l_quantity::DOUBLE - 10.5, 0))::INT AS x1, greatest(0, round_even(l_discount::DOUBLE * 150 - 2.5, 0))::INT AS y1,
        least({WIDTH}, round_even(l_quantity::DOUBLE + 2.5, 0))::INT AS x2, least({HEIGHT}, round_even(l_tax::DOUBLE * 500 + 0.5, 0))::INT AS y2 FROM lineitem)
        SELECT l_orderkey, l_linenumber, x1, y1, x2, y2 FROM b WHERE confidence >= {LEAST} AND x2 > x1 AND y2 > y1""",
    "migration_state": """SELECT coalesce(a.name, b.name) AS name,
        CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN 'ambiguous' WHEN a.name IS NOT NULL THEN 'source' ELSE 'destination' END AS state
        FROM (SELECT DISTINCT doc_id AS name FROM labels) a FULL JOIN (SELECT DISTINCT page_id * 2 AS name FROM pages) b ON a.name = b.name""",
    "uri_redaction": r"""SELECT page_id, CASE WHEN url IS NULL THEN NULL WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*@)?[^/?#@:\[\]]+(:[0-9]*)?([/?#]|$)')
        THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1) || '://'
             || lower(regexp_extract(url, '^[^/]*//(?:[^/?#]*@)?([^/?#@:]+)', 1)) || regexp_extract(url, '^[^/]*//(?:[^/?#]*@)?[^/?#@:]+(:[0-9]+)', 1)
        ELSE '[redacted-uri]' END AS shown FROM pages""",
}
