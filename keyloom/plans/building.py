"""How artifacts are made and kept, on the provided tables: models in batches, regions, summaries, partitions, what is out of date."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import encoders, geometry, recognisers
from keyloom.operators import staleness, summaries, variants
from keyloom.sources import partitions, shared
from keyloom.sources.tables import table
from keyloom.streaming import ordered

#: Rows that the stand-in model can hold, and those it is offered.
HOLDS, OFFERED = 100, 512
ROOM, WORDS = 600, 12
WIDTH, HEIGHT = 40, 30


def _counting_model():
    """Characters and capital letters of each text; it refuses more than HOLDS rows."""

    def model(batch: pa.RecordBatch) -> pa.RecordBatch:
        if batch.num_rows > HOLDS:
            raise MemoryError(f"{batch.num_rows} rows")
        text = batch.column(1)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pc.utf8_length(text), pc.cast(pc.count_substring_regex(text, "[A-Z]"), pa.int32())], ["doc_id", "n", "capitals"]
        )

    return model


def shrinking_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text once through a model that cannot hold the batches that it is offered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = encoders.in_shrinking_batches(docs, _counting_model, "doc_id long, n int, capitals int", rows=OFFERED)
    return made.select("doc_id", "n", "capitals")


def recognised_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages as regions, with their place in the page and the share of letters and digits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    found = recognisers.regions(spark, pages, "html", "a", ("start", "confidence"))
    return found.select("page_id", "ord", "text", "start", F.round("confidence", 6).alias("confidence"))


def _first_words():
    return lambda text: " ".join((text or "").split()[:WORDS])


def summary_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each conversation, by a model that keeps the first words of what it gets."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "text")
    return summaries.reduce_texts(turns, "conv_id", _first_words, room=ROOM)


def variant_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query's six rewrites those that are no near duplicates of the query or of an earlier one."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text", F.split("text", " ").alias("w"))
    half = F.slice("w", F.size("w") / 2 + 1, F.size("w"))
    made = (
        F.upper("text"),
        F.array_join(half, " "),
        F.concat(F.lit("Image of "), F.array_join(half, "  ")),
        F.array_join(F.reverse("w"), " "),
        F.concat(F.col("text"), F.lit("!?")),
        F.array_join(F.reverse(half), " "),
    )
    lists = asked.select(F.col("item_id").alias("query_id"), F.posexplode(F.array(*made)).alias("pos", "text"))
    query = asked.select(F.col("item_id").alias("query_id"), "text")
    kept = variants.without_near_duplicates(lists, ["query_id"], limit=2, exclude=query)
    return kept.select("query_id", F.col("pos").cast("int").alias("pos"), F.md5("text").alias("digest"))


def replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, published twice: the second time texts of some sources have changed and one source is not there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.coalesce("source", F.lit("none")).alias("video_id"))
    path = shared.fresh(spark, "videos")
    first = partitions.replace(docs.filter(F.col("video_id") != "src1"), path)
    longer = F.when(F.length("video_id") % 2 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    states = partitions.replace(docs.withColumn("n_chars", longer).filter(F.col("video_id") != "src2"), path)
    now = partitions.read(docs, path).groupBy("video_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    both = now.join(first.withColumnRenamed("state", "first"), "video_id", "left").join(states, "video_id", "left")
    return both.select("video_id", "n", "n_chars", F.coalesce("first", F.lit("-")).alias("first"), F.coalesce("state", F.lit("-")).alias("second"))


def stale_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources, with a raw, a cleaned and a summarised level each, some of which lag behind or are missing."""
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id").isNotNull())
    docs = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.md5("text")).alias("h"))
    i, level = F.col("doc_id"), lambda name, h, old: F.struct(F.lit(name).alias("level"), h.alias("fingerprint"), old.alias("made_from"))
    of = lambda text: F.md5(F.concat(F.col("h"), F.lit(text)))
    lag = lambda n, text: F.when(i % n == 0, F.concat(F.lit("old"), text)).otherwise(text)
    rows = F.array(
        level("source", F.col("h"), F.lit(None).cast("string")),
        level("raw", of("r"), lag(7, F.col("h"))),
        F.when(i % 5 != 0, level("cleaned", of("c"), lag(11, of("r")))),
        level("summary", F.when(i % 13 != 0, of("s")), lag(3, of("c"))),
        F.when(i % 17 == 0, level("raw", of("r"), F.col("h"))),
    )
    artifacts = docs.select(i.alias("video_id"), F.inline(F.array_compact(rows)))
    return staleness.stale(artifacts)


def corner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four points of each line item in the order of corners, clipped to the image, and the size of the crop."""
    q, d, t = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))
    n = F.col("l_linenumber").cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.array(point(q, d * 200), point(n * 5 - 7, q - 3), point(t * 400, n * 4), point(q / 2, t * 300 - 5))
    corners = geometry.ordered_corners(geometry.clipped(points, F.lit(WIDTH), F.lit(HEIGHT)))
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", corners.alias("c"))
    spelt = F.array_join(F.transform("c", lambda p: F.concat_ws("/", *(F.round(p[v] * 1000).cast("long").cast("string") for v in "xy"))), " ")
    return made.select("l_orderkey", "l_linenumber", spelt.alias("corners"), geometry.crop_size(F.col("c")).alias("s")).select(
        "l_orderkey", "l_linenumber", "corners", "s.width", "s.height"
    )


def stream_order_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a stream of frames: conversations as videos, ids that repeat after three, short vectors where a text is even."""
    source = table(spark, sf_dir, "conversations")
    size = F.when(F.length("text") % 2 == 0, 8).otherwise(64)
    place = F.when(F.col("conv_id") % 4 == 0, F.col("turn") + 1).otherwise(F.col("turn"))
    arriving = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/conversations.parquet*")
    frames = arriving.select(F.col("conv_id").alias("video_id"), (F.col("turn") % 3).cast("string").alias("frame_id"),
                             place.alias("local_index"), size.alias("dimension"))
    path = shared.fresh(spark, "faults")
    ordered.with_state(spark)
    query = (
        ordered.order_faults(frames).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema("video_id long, code string, local_index long").parquet(path)


QUERIES = {
    f.__name__: f
    for f in (
        shrinking_batches, recognised_regions, summary_rounds, variant_elimination, replaced_partitions, stale_artifacts,
        corner_order, stream_order_faults,
    )
}

_X = f"least(greatest({{}}, 0.0), {WIDTH - 1}.0)"
_Y = f"least(greatest({{}}, 0.0), {HEIGHT - 1}.0)"
_POINTS = ", ".join(
    f"{{'x': {_X.format(x)}, 'y': {_Y.format(y)}}}"
    for x, y in (("q", "d * 200"), ("n * 5 - 7", "q - 3"), ("t * 400", "n * 4"), ("q / 2", "t * 300 - 5"))
)
_CORNER = "list_sort(list_transform(p, lambda v, i: {{'k': {0}, 'i': i, 'v': v}}))[1].v"
_SIDE = "trunc(sqrt(pow({0}.x - {1}.x, 2) + pow({0}.y - {1}.y, 2)))"
ORACLES = {
    "shrinking_batches": r"""SELECT doc_id, length(text)::INT AS n, len(regexp_extract_all(text, '[A-Z]'))::INT AS capitals FROM documents""",
    "recognised_regions": r"""WITH m AS (SELECT page_id, html, unnest(regexp_extract_all(html, '<a(?: [^<>]*)?>([^<]*)</a>')) AS m,
          generate_subscripts(regexp_extract_all(html, '<a(?: [^<>]*)?>([^<]*)</a>'), 1) - 1 AS ord FROM pages),
        b AS (SELECT *, string_split_regex(html, '<a(?: [^<>]*)?>[^<]*</a>') AS parts, regexp_extract_all(html, '<a(?: [^<>]*)?>([^<]*)</a>') AS ms FROM m),
        t AS (SELECT page_id, ord, regexp_extract(m, '>([^<]*)</a>$', 1) AS text, m,
          (list_sum(list_transform(parts[1:ord + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:ord], lambda x: length(x))), 0))::INT AS before FROM b)
        SELECT page_id, ord::INT AS ord, text, (before + length(m) - length(text) - 4)::INT AS start,
          round(if(text = '', 0, len(regexp_extract_all(text, '[\p{L}\p{N}]'))::DOUBLE / length(text)), 6) AS confidence FROM t""",
    "replaced_partitions": """WITH d AS (SELECT coalesce(source, 'none') AS video_id, n_chars FROM documents)
        SELECT video_id, count(*) AS n, sum(n_chars + if(video_id <> 'src2' AND length(video_id) % 2 = 0, 1, 0))::BIGINT AS n_chars,
          if(video_id = 'src1', '-', 'new') AS "first",
          CASE WHEN video_id = 'src2' THEN '-' WHEN video_id = 'src1' THEN 'new'
            WHEN length(video_id) % 2 = 0 AND count(n_chars) > 0 THEN 'replaced' ELSE 'same' END AS "second" FROM d GROUP BY video_id""",
    "stale_artifacts": """WITH d AS (SELECT DISTINCT doc_id AS i FROM documents WHERE doc_id IS NOT NULL),
        own AS (SELECT i, CASE WHEN i % 17 = 0 THEN 'repeated' WHEN i % 7 = 0 THEN 'changed' END AS r,
            CASE WHEN i % 5 = 0 THEN 'missing' WHEN i % 11 = 0 THEN 'changed' END AS c,
            CASE WHEN i % 13 = 0 THEN 'missing' WHEN i % 5 = 0 OR i % 3 = 0 THEN 'changed' END AS s FROM d)
        SELECT i AS video_id, 'raw' AS level, r AS code FROM own WHERE r IS NOT NULL
        UNION ALL SELECT i, 'cleaned', coalesce(c, 'cascade') FROM own WHERE r IS NOT NULL OR c IS NOT NULL
        UNION ALL SELECT i, 'summary', coalesce(s, 'cascade') FROM own WHERE r IS NOT NULL OR c IS NOT NULL OR s IS NOT NULL""",
    "corner_order": f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t, l_linenumber::DOUBLE AS n FROM lineitem),
        p AS (SELECT l_orderkey, l_linenumber, [{_POINTS}] AS p FROM l),
        c AS (SELECT l_orderkey, l_linenumber, {_CORNER.format("v.x + v.y")} AS tl, {_CORNER.format("v.y - v.x")} AS tr,
          {_CORNER.format("-(v.x + v.y)")} AS br, {_CORNER.format("-(v.y - v.x)")} AS bl FROM p)
        SELECT l_orderkey, l_linenumber, array_to_string(list_transform([tl, tr, br, bl], lambda v: round(v.x * 1000)::BIGINT || '/' || round(v.y * 1000)::BIGINT), ' ') AS corners,
          greatest({_SIDE.format("br", "bl")}, {_SIDE.format("tr", "tl")})::INT AS width, greatest({_SIDE.format("tr", "br")}, {_SIDE.format("tl", "bl")})::INT AS height FROM c""",
    "stream_order_faults": """WITH f AS (SELECT conv_id AS video_id, turn % 3 AS frame_id, turn + if(conv_id % 4 = 0, 1, 0) AS i,
            if(length(text) % 2 = 0, 8, 64) AS n FROM conversations),
          o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS want, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY i) AS nth,
            first_value(n) OVER (PARTITION BY video_id ORDER BY i) AS n0 FROM f)
        SELECT video_id, 'duplicate_frame_id' AS code, min(i)::BIGINT AS local_index FROM o WHERE nth > 1 GROUP BY video_id
        UNION ALL SELECT video_id, 'local_index', min(i)::BIGINT FROM o WHERE i <> want GROUP BY video_id
        UNION ALL SELECT video_id, 'dimension', min(i)::BIGINT FROM o WHERE n <> n0 GROUP BY video_id""",
}
