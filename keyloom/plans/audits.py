"""Relational reads, object constraints, integrity audits and text functions over the provided tables.

Customers stand for videos, their orders for frames and line items for the objects in a frame: the label is made of the
two flags, the confidence is 1 - discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import ids, strings
from keyloom.operators import quality, ranking, sequences, vectors
from keyloom.sources import artifacts, store
from keyloom.sources.tables import table

CONSTRAINTS = [
    (1, "nf", "gte", 1, 0.93, "HARD"),
    (2, "af", "lte", 1, 0.95, "HARD"),
    (3, "no", "gte", 2, 0.9, "SOFT"),
    (4, "rf", "eq", 1, 0.9, "SOFT"),
]
PER_HIT, MOST = 0.1, 0.15


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.lower(F.trim(F.concat("l_returnflag", "l_linestatus"))).alias("label")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), "l_linenumber", label, F.round(1 - F.col("l_discount"), 2).alias("confidence")
    )


def _constraints(spark: SparkSession) -> DataFrame:
    kind = "constraint_id int, label string, op string, cnt int, min_confidence double, mode string"
    return spark.createDataFrame(CONSTRAINTS, kind)


def object_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame with its video and its confident objects, none included."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("video_id"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), "c_name")
    found = _objects(spark, sf_dir).filter(F.col("confidence") >= 0.95).groupBy("frame_id").agg(
        F.count("*").alias("n"), F.max("confidence").alias("best")
    )
    return orders.join(names, "video_id").join(found, "frame_id", "left").select(
        "frame_id", "video_id", "c_name", F.coalesce("n", F.lit(0)).alias("n_objects"), "best"
    )


def object_label_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _objects(spark, sf_dir).filter(F.col("label") != "")
    return objects.groupBy("label").agg(F.count("*").alias("n")).orderBy("label")


def object_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that keep to the hard constraints, with the capped boost of the soft ones."""
    frames = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"))
    out = ranking.constrain(frames, _objects(spark, sf_dir), _constraints(spark), PER_HIT, MOST)
    return out.select("frame_id", F.round("object_boost", 6).alias("object_boost"))


def key_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return quality.key_differences(docs, table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    return quality.multiset_differences(a, b, ["custkey"])


def subset_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return quality.orphans(table(spark, sf_dir, "labels").select("doc_id", "quality"), vecs, ["doc_id"])


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("digest"))
    return quality.duplicate_keys(docs, ["digest"])


def bounds_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items against their order: orphans, dates before the order, values out of range."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderstatus")
    rows = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "left")
    checks = {
        "ORPHAN": F.col("o_orderdate").isNotNull(),
        "EARLY": F.col("l_shipdate") >= F.col("o_orderdate"),
        "CONFIDENCE": F.col("l_discount").between(0.0, 0.05),
        "LARGE": F.col("l_quantity") <= 45,
    }
    return quality.violations(rows, checks, ["l_orderkey", "l_linenumber"])


def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table against the distinct keys that it should have."""
    names = {"customer": "c_custkey", "orders": "o_orderkey", "documents": "doc_id", "lineitem": "l_orderkey", "events": "event_id"}
    actual = quality.record_counts({n: table(spark, sf_dir, n) for n in names})
    keys = quality.record_counts({n: table(spark, sf_dir, n).select(k).distinct() for n, k in names.items()})
    return quality.compare_counts(keys, actual)


def vector_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.audit(table(spark, sf_dir, "embeddings"), 1e-3, "embedding")


def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.select("label", "pos", F.round("value", 6).alias("value"))


def float32_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a price survives rounding to cents, at 32-bit precision."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", quality.same_float32(price, F.floor(price * 100) / 100).alias("same")
    )


def inventory_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    remote = local.filter(F.col("c_mktsegment") != "BUILDING").withColumn("c_acctbal", F.abs("c_acctbal"))
    return quality.changed(local, remote, "c_custkey", ["c_acctbal", "c_mktsegment"])


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source"])


def branch_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user count as failed, signups as degraded, clicks as successful branches."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "FAILED").when(kind == "signup", "DEGRADED").when(kind == "click", "SUCCESS").otherwise("DISABLED")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(hour).alias("hour"), status.alias("status"))
    return ranking.combined_status(rows, ["user_id", "hour"])


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the rows of their newest order's balance put in place of the old ones."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return store.upsert(old, new, ["c_custkey"])


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items left after the orders of all BUILDING customers are deleted with what hangs on them."""
    gone = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").join(gone, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


def union_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = {"documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}
    id_ = F.lit(None).cast("string").alias("video_id")  # the file's stem stands for it
    named = {name: table(spark, sf_dir, name).select(id_, F.col(key).cast("string").alias("stem")) for name, key in families.items()}
    return artifacts.discover(named).select(F.col("video_id").cast("long").alias("id"))


def frame_id_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both roundings of a position in an id, which differ, and the parts read back."""
    made = ids.build_frame_id(F.concat(F.lit("v"), F.col("l_orderkey")), F.col("l_linenumber"), F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", made.alias("frame_id"))
    parts = ids.parse_frame_id(F.col("frame_id"))
    return rows.select(
        "l_orderkey", "l_linenumber", "frame_id", ids.position_code(F.col("l_tax")).alias("code"),
        parts["video_id"].alias("video_id"), parts["shot_id"].alias("shot_id"), parts["position_code"].alias("position_code"),
    )


def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.regexp_extract("url", r"://[^/]*/(.*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", rest.alias("path"), ids.is_safe_path(rest).alias("safe"))


def caption_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss,SSS")
    return table(spark, sf_dir, "events").select("event_id", F.round(ids.caption_seconds(stamp), 3).alias("seconds"))


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", strings.json_field(F.col("props"), "k").alias("k"), F.size(F.map_keys(F.from_json("props", "map<string,string>"))).alias("n"))


def token_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", strings.is_repetitive(F.col("text")).alias("noise"), strings.is_informative(F.col("text")).alias("informative")
    )


def number_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against themselves without the first digits: only texts without digits pass."""
    cleaned = F.regexp_replace("text", "^([^0-9]*)[0-9]+", "$1")
    return table(spark, sf_dir, "documents").select("doc_id", strings.clean_is_faithful(cleaned, F.col("text")).alias("ok"))


def word_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = strings.word_chunks(F.col("text"), 170)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "t"))
    return docs.select("doc_id", "chunk", F.length("t").alias("n"), F.md5("t").alias("digest"))


def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = strings.extract_summary(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(made).alias("digest"), F.length(made).alias("n"))


def artifact_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the folded texts of their documents, held against the documents as they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    vecs = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    made = docs.join(vecs, "doc_id").withColumn("text", F.trim(F.regexp_replace("text", "[0-9]", "")))
    v = F.col("embedding")
    contract = {"label": F.col("label") >= 1, "lang": F.col("lang").isin("en", "de", "fr", "es")}
    return quality.artifact_report(made, docs, "doc_id", "text", contract, v, 64, vectors.is_unit(v, 1e-3))


def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks over the tables, with their failing rows and status."""
    t = lambda name: table(spark, sf_dir, name)
    docs, vecs = t("documents"), t("embeddings")
    checks = [
        quality.check("documents.unique", quality.duplicate_keys(docs, ["doc_id"])),
        quality.check("documents.length", docs.filter(F.length("text") != F.col("n_chars"))),
        quality.check("labels.documents", quality.orphans(t("labels"), docs, ["doc_id"])),
        quality.check("labels.vectors", quality.orphans(t("labels"), vecs.withColumnRenamed("vec_id", "doc_id"), ["doc_id"]), False),
        quality.check("vectors.unit", vecs.filter(~vectors.is_unit(F.col("embedding"), 1e-2))),
        quality.check("pages.url", t("pages").filter(~F.col("url").rlike("^https?://[^/]+/"))),
        quality.check("orders.customers", t("orders").select(F.col("o_custkey").alias("c_custkey")).join(t("customer"), "c_custkey", "left_anti")),
        quality.check("turns.start", t("conversations").groupBy("conv_id").agg(F.min("turn").alias("m")).filter(F.col("m") > 1), False),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


def frame_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against documents of the same number, per language: matched, and missing on either side."""
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dim"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    both = docs.join(vecs, "doc_id", "full_outer")
    n = lambda ok: F.count(F.when(ok, 1))
    lang, dim = F.col("lang"), F.col("dim")
    return both.groupBy("lang").agg(
        n(lang.isNotNull() & dim.isNotNull()).alias("matched"), n(dim.isNull()).alias("no_vector"), n(lang.isNull()).alias("no_document")
    )


def branch_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user as a branch: greatest value, number of hits, and the different kinds in order."""
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")  # a handful of kinds
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max("value").alias("most"), F.count("*").alias("n"), kinds.alias("kinds")
    )


def segment_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as segments: those that start before the one before them, or are empty."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lag("l_quantity").over(w).alias("before")
    )
    checks = {
        "BACKWARD": F.col("before").isNull() | (F.col("l_quantity") >= F.col("before")),
        "EMPTY": F.col("l_tax") > 0,
    }
    return quality.violations(rows, checks, ["l_orderkey", "l_linenumber"])


def keyframe_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as shots of their quantity in frames, sampled at three places."""
    start = F.col("l_linenumber") * 100
    shots = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("shot_id"), start.alias("start_frame"),
        (start + F.col("l_quantity").cast("int")).alias("end_frame"), F.lit(25.0).alias("fps"),
    )
    return artifacts.keyframe_samples(shots).select("video_id", "shot_id", "position_code", "frame_index", "time_sec")


def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as tracks of characters in windows of 1,000."""
    tracks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), F.length("text").cast("long").alias("n_samples"), F.lit(100).alias("rate")
    )
    return artifacts.audio_windows(tracks, 10.0).select(F.col("path").alias("doc_id"), "nth", "first", "last")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text regions of their order."""
    region = F.struct(F.col("l_quantity").alias("cy"), F.col("l_extendedprice").alias("cx"), F.lit(6.0).alias("height"), F.col("l_linenumber").alias("id"))
    lists = sequences.bounded_ordered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], region, "regions")
    return lists.select("l_orderkey", F.posexplode(sequences.reading_order(F.col("regions"))).alias("place", "r")).select(
        "l_orderkey", "place", "r.line_no", F.col("r.id").alias("l_linenumber")
    )


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes of their order; the better ones suppress those of their label that they overlap."""
    size = F.col("l_tax") * 500 + 10
    box = F.struct(
        F.col("l_discount").alias("key"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("label"),
        F.col("l_quantity").alias("x1"), F.col("l_quantity").alias("y1"), (F.col("l_quantity") + size).alias("x2"),
        (F.col("l_quantity") + size).alias("y2"),
    )
    lists = sequences.bounded_ordered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], box, "boxes")
    return lists.select("l_orderkey", F.posexplode(sequences.suppress(F.col("boxes"), 0.3)).alias("place", "b")).select(
        "l_orderkey", "place", F.col("b.n").alias("l_linenumber")
    )


QUERIES = {
    f.__name__: f
    for f in (
        object_join, object_label_catalog, object_constraints, key_set_diff, multiset_diff, subset_orphans, duplicate_keys,
        bounds_audit, manifest_counts, vector_audit, mean_pooling, float32_equality, inventory_changed, content_digest,
        branch_status_rollup, upsert, delete_cascade, union_distinct_ids, frame_id_build, path_safety, caption_time,
        json_field, token_repetition, number_guard, word_chunking, extractive_summary, reading_order, nms,
        frame_vectors, branch_diagnostics, artifact_validity, contract_report, segment_validation, keyframe_sampling, fixed_windows,
    )
}

_OBJ = """o AS (SELECT l_orderkey AS frame_id, lower(trim(l_returnflag || l_linestatus)) AS label,
round(1 - l_discount, 2) AS confidence FROM lineitem)"""
_CON = ", ".join(f"({i}, '{a}', '{op}', {n}, {c}, '{m}')" for i, a, op, n, c, m in CONSTRAINTS)
_HEX = "('0x' || substr(h, {}, 8))::BIGINT"
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
ORACLES = {
    "object_join": f"""WITH {_OBJ} SELECT o_orderkey AS frame_id, o_custkey AS video_id, c_name, count(o.label) AS n_objects,
        max(o.confidence) AS best FROM orders JOIN customer ON c_custkey = o_custkey
        LEFT JOIN o ON o.frame_id = o_orderkey AND o.confidence >= 0.95 GROUP BY ALL""",
    "object_label_catalog": f"WITH {_OBJ} SELECT label, count(*) AS n FROM o WHERE label <> '' GROUP BY label",
    "object_constraints": f"""WITH {_OBJ}, c(id, label, op, cnt, min_c, mode) AS (VALUES {_CON}),
        n AS (SELECT o_orderkey AS frame_id, id, op, cnt, mode, count(o.label) AS found FROM orders CROSS JOIN c
              LEFT JOIN o ON o.frame_id = o_orderkey AND o.label = c.label AND o.confidence >= min_c GROUP BY ALL),
        k AS (SELECT *, CASE op WHEN 'eq' THEN found = cnt WHEN 'gte' THEN found >= cnt ELSE found <= cnt END AS ok FROM n)
        SELECT frame_id, round(least({MOST}, {PER_HIT} * count(*) FILTER (mode = 'SOFT' AND ok)), 6)::DOUBLE AS object_boost FROM k
        GROUP BY frame_id HAVING count(*) FILTER (mode = 'HARD' AND NOT ok) = 0""",
    "key_set_diff": """SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
        UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""",
    "multiset_diff": """SELECT custkey, sum(s)::BIGINT AS surplus FROM (SELECT o_custkey AS custkey, 1 AS s FROM orders
        UNION ALL SELECT c_custkey, -1 FROM customer) GROUP BY custkey HAVING sum(s) <> 0""",
    "subset_orphans": "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "duplicate_keys": "SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "bounds_audit": """WITH r AS (SELECT * FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey)
        SELECT l_orderkey, l_linenumber, code FROM (
          SELECT l_orderkey, l_linenumber, 'ORPHAN' AS code FROM r WHERE o_orderdate IS NULL
          UNION ALL SELECT l_orderkey, l_linenumber, 'EARLY' FROM r WHERE NOT coalesce(l_shipdate >= o_orderdate, false)
          UNION ALL SELECT l_orderkey, l_linenumber, 'CONFIDENCE' FROM r WHERE NOT coalesce(l_discount BETWEEN 0.0 AND 0.05::DOUBLE, false)
          UNION ALL SELECT l_orderkey, l_linenumber, 'LARGE' FROM r WHERE NOT coalesce(l_quantity <= 45, false))""",
    "manifest_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(DISTINCT {k}) AS expected, count(*) AS actual, count(DISTINCT {k}) = count(*) AS ok FROM {t}"
        for t, k in {"customer": "c_custkey", "orders": "o_orderkey", "documents": "doc_id", "lineitem": "l_orderkey", "events": "event_id"}.items()
    ),
    "vector_audit": """WITH v AS (SELECT embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) AS s FROM embeddings)
        SELECT count(*) AS n_rows, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim,
        count(*) FILTER (embedding IS NULL) AS n_null, count(*) FILTER (NOT isfinite(s)) AS n_non_finite,
        count(*) FILTER (abs(sqrt(s) - 1) > 1e-3) AS n_non_unit FROM v""",
    "mean_pooling": """WITH m AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x,
        generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY ALL)
        SELECT label, pos::INT AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m""",
    "float32_equality": """SELECT l_orderkey, l_linenumber, (l_extendedprice * (1 - l_discount))::FLOAT
        = (floor(l_extendedprice * (1 - l_discount) * 100) / 100)::FLOAT AS same FROM lineitem""",
    "inventory_changed": """SELECT c_custkey, c_acctbal, c_mktsegment FROM customer
        WHERE c_mktsegment = 'BUILDING' OR c_acctbal <> abs(c_acctbal)""",
    "content_digest": "WITH d AS (SELECT sha256(concat(" + ", ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "text", "lang", "source")) + ")) AS h FROM documents) SELECT count(*) AS n, "
    + ", ".join(f"sum({_HEX.format(1 + 8 * i)})::BIGINT AS sum{i}, bit_xor({_HEX.format(1 + 8 * i)}) AS xor{i}" for i in range(4))
    + " FROM d",
    "branch_status_rollup": """SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS hour,
        CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END)
        WHEN 3 THEN 'FAILED' WHEN 2 THEN 'DEGRADED' WHEN 1 THEN 'SUCCESS' ELSE 'DISABLED' END AS status FROM events GROUP BY ALL""",
    "upsert": """WITH n AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders GROUP BY 1)
        SELECT c_custkey, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c FULL JOIN n USING (c_custkey)""",
    "delete_cascade": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "union_distinct_ids": """SELECT doc_id AS id FROM documents UNION SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings
        UNION SELECT page_id FROM pages UNION SELECT item_id FROM benchmark""",
    "frame_id_build": """SELECT l_orderkey, l_linenumber, printf('v%d_%05d_%03d', l_orderkey, l_linenumber, trunc(l_tax * 100)::INT) AS frame_id,
        round_even(l_tax * 100, 0)::INT AS code, 'v' || l_orderkey AS video_id, l_linenumber AS shot_id,
        trunc(l_tax * 100)::INT AS position_code FROM lineitem""",
    "path_safety": r"""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*/(.*)$', 1) AS path FROM pages) SELECT page_id, path,
        path <> '' AND NOT regexp_matches(path, '(^/)|(^|/)\.\.?(/|$)|//|/$|^[A-Za-z][A-Za-z0-9+.\-]*:|\\') AS safe FROM p""",
    "caption_time": "SELECT event_id, round(((epoch_us(ts) // 1000) % 86400000) / 1000.0::DOUBLE, 3) AS seconds FROM events",
    "json_field": "SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props))::INT AS n FROM events",
    "token_repetition": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)
        SELECT doc_id, len(t) >= 100 AND len(list_distinct(t)) < 20 AS noise, len(t) >= 100 AND len(list_distinct(t)) >= 20 AS informative FROM t""",
    "number_guard": """WITH c AS (SELECT doc_id, text, regexp_replace(text, '^([^0-9]*)[0-9]+', '\\1') AS c FROM documents)
        SELECT doc_id, NOT starts_with(trim(c), '{') AND length(c) <= greatest(2 * length(text), length(text) + 80)
        AND list_sort(regexp_extract_all(c, '[0-9]+')) = list_sort(regexp_extract_all(text, '[0-9]+')) AS ok FROM c""",
    "word_chunking": f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        c AS (SELECT doc_id, w, unnest(range(0, len(w), 170)) AS i FROM w),
        t AS (SELECT doc_id, (i // 170)::INT AS chunk, array_to_string(w[i + 1 : i + 170], ' ') AS t FROM c)
        SELECT doc_id, chunk, length(t)::INT AS n, md5(t) AS digest FROM t""",
    "extractive_summary": f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        e AS (SELECT doc_id, w, coalesce(list_max(list_filter(range(101, 181), lambda i: regexp_matches(coalesce(w[i], ''), '{strings.SENTENCE_END.replace("'", "''")}'))), 180) AS cut FROM w),
        s AS (SELECT doc_id, array_to_string(if(len(w) <= 180, w, w[1:cut]), ' ') AS s FROM e)
        SELECT doc_id, md5(s) AS digest, length(s)::INT AS n FROM s""",
    "artifact_validity": """WITH m AS (SELECT d.doc_id, trim(regexp_replace(text, '[0-9]', '', 'g')) AS text, lang, label, embedding,
          sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS norm FROM documents d JOIN embeddings ON vec_id = d.doc_id),
        j AS (SELECT d.doc_id AS a, m.doc_id AS b, d.text AS t, m.text AS u, label, m.lang, embedding, norm
              FROM documents d FULL JOIN m ON m.doc_id = d.doc_id),
        c AS (SELECT count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS superfluous,
              count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND t IS DISTINCT FROM u) AS changed,
              count(*) FILTER (b IS NOT NULL AND NOT coalesce(label >= 1 AND lang IN ('en', 'de', 'fr', 'es'), false)) AS broken,
              count(*) FILTER (b IS NOT NULL AND len(embedding) <> 64) AS other_dimension,
              count(*) FILTER (b IS NOT NULL AND NOT abs(norm - 1) <= 1e-3) AS not_unit FROM j),
        r AS (SELECT (count(*) - count(DISTINCT doc_id))::BIGINT AS repeated FROM m)
        SELECT *, missing + superfluous + changed + broken + other_dimension + not_unit + repeated = 0 AS valid FROM c, r""",
    "contract_report": " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS failures, CASE WHEN count(*) = 0 THEN 'PASS' ELSE '{'FAIL' if req else 'WARNING'}' END AS status, "
        f"{str(req).lower()} AS required FROM ({rows})"
        for name, req, rows in (
            ("documents.unique", True, "SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1"),
            ("documents.length", True, "SELECT 1 FROM documents WHERE length(text) <> n_chars"),
            ("labels.documents", True, "SELECT 1 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
            ("labels.vectors", False, "SELECT 1 FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"),
            ("vectors.unit", True, "SELECT 1 FROM embeddings WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) - 1) > 1e-2"),
            ("pages.url", True, "SELECT 1 FROM pages WHERE NOT regexp_matches(url, '^https?://[^/]+/')"),
            ("orders.customers", True, "SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
            ("turns.start", False, "SELECT 1 FROM conversations GROUP BY conv_id HAVING min(turn) > 1"),
        )
    ),
    "frame_vectors": """SELECT lang, count(*) FILTER (lang IS NOT NULL AND v.vec_id IS NOT NULL) AS matched,
        count(*) FILTER (v.vec_id IS NULL) AS no_vector, count(*) FILTER (lang IS NULL) AS no_document
        FROM documents d FULL JOIN embeddings v ON v.vec_id = d.doc_id GROUP BY lang""",
    "branch_diagnostics": """SELECT user_id, max(value) AS most, count(*) AS n,
        string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id""",
    "segment_validation": """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax,
        lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS b FROM lineitem)
        SELECT l_orderkey, l_linenumber, 'BACKWARD' AS code FROM r WHERE l_quantity < b
        UNION ALL SELECT l_orderkey, l_linenumber, 'EMPTY' FROM r WHERE NOT coalesce(l_tax > 0, false)""",
    "keyframe_sampling": """WITH s AS (SELECT l_orderkey, l_linenumber, l_linenumber * 100 AS a, l_linenumber * 100 + l_quantity::INT AS b,
        unnest([0.15::DOUBLE, 0.5, 0.85]) AS p FROM lineitem),
        f AS (SELECT *, greatest(a, least(b, a + round_even(p * (b - a), 0)))::INT AS f FROM s)
        SELECT l_orderkey AS video_id, l_linenumber AS shot_id, round_even(p * 100, 0)::INT AS position_code, f AS frame_index,
        round_even(f / 25.0::DOUBLE, 3) AS time_sec FROM f""",
    "fixed_windows": """SELECT doc_id, (a // 1000)::INT AS nth, a AS "first", least(a + 1000, length(text)) AS "last"
        FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS a FROM documents)""",
}
