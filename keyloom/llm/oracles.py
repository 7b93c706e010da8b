"""DuckDB SQL for the operators whose rows SQL can express."""

from __future__ import annotations

from keyloom.llm.url_filter import KINDS, PARTS, Reputation


def _digits(at: int) -> str:
    return f"('0x' || substr(h, {at}, 15))::BIGINT"


#: The tree deals tickets (source, pass, block) to halves of shards level by level; a source's blocks then go to its shards in order.
MIX = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
             (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT coalesce(arg_min(level, (ratio, no)), 'inf'::DOUBLE) AS level FROM l WHERE ratio >= level),
nb AS (SELECT least(500000, greatest(4096, ceil(count(*) / 250000)))::BIGINT AS blocks FROM documents),
t AS (SELECT no, source, source_size, least(cap, lv.level * weight) AS target,
             greatest(1, blocks * source_size // greatest((SELECT sum(source_size) FROM s), 1))::BIGINT AS n_blocks FROM l, lv, nb),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
dealt AS (SELECT d.doc_id, d.size, q.no, q.source_size, q.target, q.quota, {_digits(1)} % q.n_blocks AS block, {_digits(17)} AS place
          FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT no, block, any_value(quota) AS quota, any_value(source_size) AS source_size, sum(size)::BIGINT AS size FROM dealt GROUP BY ALL),
b2 AS (SELECT no, block, size, turn, md5('1:' || turn || ':' || no || ':' || block) AS o,
              CASE turn WHEN 0 THEN least(quota, source_size) ELSE greatest(quota - source_size, 0) END AS due FROM b, (VALUES (0), (1)) v(turn)),
tk AS (SELECT no, block, turn, o, greatest(0, least(size, due - coalesce(sum(size) OVER (PARTITION BY no, turn ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part
       FROM b2 QUALIFY part > 0),
tree AS (SELECT no, turn, block, 0 AS lo, 16 AS hi, 2 AS level, count(*) OVER () AS n FROM tk
         UNION ALL
         SELECT no, turn, block, CASE WHEN rn <= half THEN lo ELSE (lo + hi) // 2 END, CASE WHEN rn <= half THEN (lo + hi) // 2 ELSE hi END, level + 1, n
         FROM (SELECT *, row_number() OVER (PARTITION BY lo ORDER BY md5('1:' || level || ':' || no || ':' || turn || ':' || block)) AS rn,
                      list_sum(list_transform(range(lo, (lo + hi) // 2), lambda i: (n + 15 - i) // 16)) AS half
               FROM tree WHERE hi - lo > 1)),
leaf AS (SELECT no, lo AS shard, row_number() OVER (PARTITION BY no ORDER BY lo) AS k FROM tree WHERE hi - lo = 1),
put AS (SELECT no, block, turn, part, shard FROM (SELECT *, row_number() OVER (PARTITION BY no ORDER BY turn, o) AS k FROM tk) JOIN leaf USING (no, k)),
b3 AS (SELECT no, block, coalesce(max(part) FILTER (turn = 0), 0) AS quota0, coalesce(max(part) FILTER (turn = 1), 0) AS quota1,
              max(shard) FILTER (turn = 0) AS shard0, max(shard) FILTER (turn = 1) AS shard1 FROM put GROUP BY ALL),
x AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY no, block ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM dealt LEFT JOIN b3 USING (no, block)),
y AS (SELECT *, greatest(0, least(size, coalesce(quota0, 0) - before))::BIGINT AS w0, greatest(0, least(size, coalesce(quota1, 0) - before))::BIGINT AS w1 FROM x)
SELECT doc_id, size, source_size, target, (w0 + w1)::BIGINT AS taken,
       CASE WHEN w0 > 0 THEN shard0 END::INT AS shard, CASE WHEN w1 > 0 THEN shard1 END::INT AS shard_again, w1::BIGINT AS taken_again FROM y
"""


def _search(every: int, k: int, component: str, valid: str) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: {component}) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 {valid}),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
      FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {k}
"""


#: Texts as hexadecimal digits, so that a byte is two characters; windows by digest, spans as islands of window starts.
SUFFIX = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
k AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g
      FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM k)),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, g),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS prev, lead(a) OVER (PARTITION BY r ORDER BY a) AS nxt FROM s),
o AS (SELECT d.r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
             string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
      FROM cut JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN o USING (r)
"""

#: All links by a self-join on five-word grams, classes by reachability.
JACCARD = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
n AS (SELECT r, doc_id, len(g) AS n FROM g),
u AS (SELECT r, n, unnest(g) AS x FROM g JOIN n USING (r)),
p AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.x = b.x AND a.r < b.r
      GROUP BY a.r, b.r, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)
      UNION ALL SELECT a.r, b.r FROM n a JOIN n b ON a.n = 0 AND b.n = 0 AND a.r < b.r),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT a AS r, a AS m FROM e UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.m),
c AS (SELECT reach.r, min(n.doc_id) AS class_id FROM reach JOIN n ON n.r = reach.m GROUP BY reach.r),
l AS (SELECT a AS r, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(links, 0) AS links FROM n LEFT JOIN c USING (r) LEFT JOIN l USING (r)
"""

NEIGHBOURS = _search(20, 20, "x::DOUBLE", "AND len(list_filter(embedding, lambda x: x <> 0)) > 0")
TOPK = _search(100, 10, "floor(1024 * x::DOUBLE)::BIGINT", "")


def url_filter(rules, setting: Reputation = Reputation()) -> str:
    """Rules and reputation as in url_filter.judge_urls, with the quality label of the document of the page's number."""
    pattern = PARTS.replace("'", "''")
    table = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.text}')" for r in rules)
    z, least, most = setting.z, setting.least_good, setting.max_strength
    kinds = ", ".join(f"'{k}'" for k in KINDS)

    def bound(a: str, b: str) -> str:
        n = f"({a} + {b})"
        return f"({a}) / {n} + {z} * sqrt(({a}) / {n} * (({b}) / {n}) / ({n} + 1))"

    def strength(groups: str, p: str) -> str:
        r = (
            f"(sum(CASE WHEN {p} * (1 - {p}) > 0 THEN n * pow(k / n - {p}, 2) / ({p} * (1 - {p})) ELSE 0 END) - count(*))"
            " / greatest(sum(n - 1), 1)"
        )
        return f"(SELECT coalesce(least({most}, greatest(1.0, 1 / greatest({r}, 1e-9) - 1)), {most})::DOUBLE AS s FROM {groups})"

    return f"""
WITH p0 AS (SELECT page_id, lower(coalesce(regexp_extract(url, '{pattern}', 1), '')) AS host,
                  coalesce(regexp_extract(url, '{pattern}', 2), '') AS path FROM pages),
p1 AS (SELECT *, string_split(host, '.') AS labels,
              CASE WHEN list_contains([{kinds}], string_split(host, '.')[-2]) AND regexp_full_match(string_split(host, '.')[-1], '[a-z][a-z]') THEN 2 ELSE 1 END AS last
       FROM p0),
p AS (SELECT page_id, host, path, array_to_string(labels[-last:], '.') AS suffix, array_to_string(labels[-last - 1:], '.') AS domain FROM p1),
rules(verdict, h, pre, txt) AS (VALUES {table}),
fit AS (SELECT page_id, txt, verdict FROM (SELECT DISTINCT page_id, host, path FROM p), rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(txt) DESC, txt) = 1),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k, any_value(domain) AS domain, any_value(suffix) AS suffix
      FROM p JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL AND host <> '' GROUP BY host),
m0 AS (SELECT coalesce(sum(k) / sum(n), 0) AS m FROM h),
sx AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h, m0 GROUP BY suffix),
s1 AS {strength("sx", "m")},
sm AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM sx, s1),
dx AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h JOIN sm USING (suffix) GROUP BY domain),
s2 AS {strength("dx", "m")},
dm AS (SELECT domain, (k + s * m) / (n + s) AS m FROM dx, s2),
hx AS (SELECT host, n, k, m FROM h JOIN dm USING (domain)),
s3 AS {strength("hx", "m")},
ab AS (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b FROM hx, s3),
host_bad AS (SELECT host, {bound("a", "b")} < {least} AS bad FROM ab),
domain_bad AS (SELECT domain, {bound("s * m", "s * (1 - m)")} < {least} AS bad FROM dm, s3),
suffix_bad AS (SELECT suffix, {bound("s * m", "s * (1 - m)")} < {least} AS bad FROM sm, s2)
SELECT p.page_id, p.host, p.path, f.txt AS rule,
       coalesce(f.verdict, CASE WHEN coalesce(b1.bad, b2.bad, b3.bad, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit f ON f.page_id = p.page_id LEFT JOIN host_bad b1 ON b1.host = p.host
LEFT JOIN domain_bad b2 ON b2.domain = p.domain LEFT JOIN suffix_bad b3 ON b3.suffix = p.suffix
"""


#: Items' terms against all texts, in integers but for the weight of a term.
LEXICAL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM t WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
d AS (SELECT r, doc_id, 10 + (90 * len(t) * n) // l AS m FROM t, s WHERE len(t) > 0),
x AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (r) GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM x JOIN d USING (r) QUALIFY rank <= 10
"""


def clusters(k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, salt: str = "2:") -> str:
    """All distances of every round, ties to the smaller centroid; means are floors of whole numbers."""
    step = """
a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.r, p.c, list_sum(list_transform(list_zip(v.e, p.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{p} p) GROUP BY r)"""
    move = """,
m{n} AS (SELECT c, list(x ORDER BY pos) AS e FROM (
  SELECT c, pos, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
    SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n
    FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{n} JOIN v USING (r)) GROUP BY c, pos)) GROUP BY c),
c{n} AS MATERIALIZED (SELECT c, coalesce(m.e, p.e) AS e FROM c{p} p LEFT JOIN m{n} m USING (c)),"""
    body = "".join(step.format(n=n, p=n - 1) + (move.format(n=n, p=n - 1) if n <= rounds else "") for n in range(1, rounds + 2))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS c, e FROM v QUALIFY c < {k}),{body}
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(p.e, ',')) AS centroid_sha256
FROM a{rounds + 1} JOIN v USING (r) JOIN c{rounds} p USING (c)
"""
