"""The registered queries of this package and, where SQL can express them, their SQL."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontamination, line_quality, mixing, near_dedup, neighbours, periodic_runs, pii, secret_scan, token_counts,
               toxicity, turn_repair, url_filter)
from .common import prefix_sums, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _n(spans: str, kind: int, name: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(name)


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_scan.train(secret_scan.labelled_tokens(docs, "doc_id"))
    d = secret_scan.scan(docs, model)
    return d.select("doc_id", _n("base", 0, "n_assign"), _n("base", 1, "n_access"), _n("base", 2, "n_hex"),
                    F.sha2(secret_scan.digest_text(F.col("base")), 256).alias("base_sha256"), secret_scan.digest_text(F.col("spans")).alias("spans"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = pii.find(docs, pii.train(docs, "doc_id"))
    return d.select("doc_id", _n("base", 0, "n_email"), _n("base", 1, "n_ip"), _n("base", 2, "n_card"), _n("base", 3, "n_phone"),
                    F.sha2(pii.digest_text(F.col("base")), 256).alias("base_sha256"), pii.digest_text(F.col("spans")).alias("spans"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after an edit of every document: runs of five digits and more are masked, as a redaction would."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs, gaps = F.regexp_extract_all("text", F.lit("[0-9]{5,}"), 0), F.split("text", "[0-9]{5,}")
    d = token_counts.index(docs).withColumns({"_runs": F.coalesce(runs, F.array()), "_gaps": F.coalesce(gaps, F.array())})
    d = d.withColumn("_steps", F.zip_with(F.slice("_gaps", 1, F.size("_runs")), "_runs", lambda g, r: (F.length(g) + F.length(r)).cast("bigint")))
    d = d.withColumn("_at", prefix_sums(F.col("_steps")))
    edits = F.transform("_runs", lambda r, i: F.struct(
        (F.element_at("_at", i + 1) + F.length(F.element_at("_gaps", i + 1))).alias("start"),
        (F.element_at("_at", i + 1) + F.length(F.element_at("_gaps", i + 1)) + F.length(r)).alias("end"), F.lit("#").alias("replacement")))
    d = token_counts.update(d.withColumn("edits", edits), "edits")
    return d.select("doc_id", "n_tokens", F.size("edits").cast("bigint").alias("n_edits"), "n_tokens_after", "n_encoded", F.size("tree.counts").cast("bigint").alias("n_leaves"))


def held_out(key: str):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    d = toxicity.score(docs, toxicity.train(docs, labels))
    return d.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_tokens", "best_segment", "p_value", "n_passages")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item where the document holds a copy of the item."""
    return decontamination.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(v, v.where(F.pmod("vec_id", F.lit(20)) == 0), 20)


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2).drop("print")


#: fixed by the contract of the query
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    r = chat.read_back(chat.windows(c.unionByName(more)))
    seen = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(seen, 256).alias("turns_sha256"),
                    F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


#: windows of 256 tokens with 64 of history, as chat.windows() has them
ORACLES["op8_chat"] = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM c),
h AS (SELECT conv_id, max(CASE WHEN k = 1 AND role = 'system' THEN 1 ELSE 0 END) AS sys, greatest(1, 192 - max(CASE WHEN k = 1 AND role = 'system' THEN tokens ELSE 0 END)) AS room FROM t GROUP BY 1),
b AS (SELECT t.conv_id, t.k - sys - 1 AS i, tokens, room, coalesce(sum(tokens) OVER (PARTITION BY t.conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
 FROM t JOIN h ON h.conv_id IS NOT DISTINCT FROM t.conv_id WHERE k > sys),
f AS (SELECT conv_id, 0 AS i, 0 AS w, CAST(0 AS HUGEINT) AS base, TRUE AS opens FROM h UNION ALL
 SELECT b.conv_id, CAST(b.i AS INTEGER), CASE WHEN b.s + b.tokens - f.base > room THEN f.w + 1 ELSE f.w END, CASE WHEN b.s + b.tokens - f.base > room THEN b.s ELSE f.base END, b.s + b.tokens - f.base > room
 FROM f JOIN b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.i + 1),
n AS (SELECT t.conv_id, t.k - sys - 1 AS i, 24 + length(url_encode(role)) + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) AS size FROM t JOIN h ON h.conv_id IS NOT DISTINCT FROM t.conv_id),
w AS (SELECT conv_id, i, base, coalesce(lead(i) OVER (PARTITION BY conv_id ORDER BY i), 1000000000) AS stop FROM f WHERE opens),
z AS (SELECT w.conv_id, sum(size) AS chars FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM n.conv_id AND b.i = n.i
 WHERE n.i < 0 OR (n.i < w.stop AND (n.i >= w.i OR b.s >= w.base - 64)) GROUP BY 1),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss FROM t GROUP BY 1)
SELECT d.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM d JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id"""


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES), "page_id")


ORACLES["op9_url_filter"] = """
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(h, q, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                           ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
n AS (SELECT *, row_number() OVER () AS k FROM p),
m AS (SELECT k, h || q AS rule, action, row_number() OVER (PARTITION BY k ORDER BY length(h || q) DESC, length(h) DESC) AS i
      FROM n JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM n LEFT JOIN (SELECT * FROM m WHERE i = 1) USING (k)"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: all pairs that share a shingle, then everything that links reach: for small tables
ORACLES["op7_near_dedup"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, hash(g) AS g FROM (SELECT r, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM d)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT r, r AS m FROM d UNION SELECT c.r, e.y FROM c JOIN e ON e.x = c.m),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.m GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, FALSE) AS kept FROM d JOIN m ON m.r = d.r LEFT JOIN n ON n.r = d.r"""


@query
def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = line_quality.judge(docs, line_quality.train(docs, table(spark, sf_dir, "labels")))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words",
                    F.size("boilerplate").cast("bigint").alias("n_boilerplate"))


@query
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.repair(rows, conv="conv", gone="gone").withColumnRenamed("conv", "conv_id")


#: crc32 of a text of ASCII characters, in SQL: t.crc is the table of its polynomial
_CRC_TABLE = """t AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM range(256) r(i))"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: CAST(unicode(({text})[i]) AS BIGINT)), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


#: the cheapest edits from each row to the end, for the four states n (nothing yet), s, u, a (last turn): (cost, audit, text), the least of all ways; inserted
#: turns come in front of what is decided for the row
ORACLES["op13_turn_repair"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT o.*, {_crc("key")} % 20 AS k FROM o, t),
g AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
 FROM h, range(2) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen, regexp_extract(text, '(?s)([^ 	-
])[ 	-
]*$', 1) AS fin FROM g),
r AS MATERIALIZED (SELECT *, CASE WHEN fin = '' THEN 1 WHEN seen > 1 THEN 2 WHEN fin NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i, left(role, 1) AS l FROM f),
n AS (SELECT conv_id, count(*) AS n FROM r GROUP BY 1),
w AS (SELECT conv_id, n + 1 AS i, ROW(0, '', '') AS vn, ROW(4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:') AS vs, ROW(2, 'I', chr(10) || 'assistant:') AS vu, ROW(0, '', '') AS va FROM n
 UNION ALL SELECT conv_id, i, bn_, bs_, bu_, ba_ FROM (
  SELECT conv_id, i, list_min([bn, ROW(2 + u1[1], 'I' || u1[2], chr(10) || 'user:' || u1[3])]) AS bn_, list_min([bs, ROW(2 + u1[1], 'I' || u1[2], chr(10) || 'user:' || u1[3])]) AS bs_, u1 AS bu_, a1 AS ba_ FROM (
   SELECT *, list_min([bu, ROW(2 + ba[1], 'I' || ba[2], chr(10) || 'assistant:' || ba[3])]) AS u1, list_min([ba, ROW(2 + bu[1], 'I' || bu[2], chr(10) || 'user:' || bu[3])]) AS a1 FROM (
    SELECT w.conv_id, r.i,
     list_min([ROW(3 + vn[1], 'D' || vn[2], vn[3]), ROW(CASE WHEN fault IN (1, 2) THEN 1000000 ELSE 2 + c END + vu[1], 'R' || vu[2], chr(10) || 'user:' || text || vu[3]),
      CASE l WHEN 's' THEN ROW(CASE WHEN fault IN (1, 2) THEN 1000000 ELSE c END + vs[1], 'K' || vs[2], chr(10) || role || ':' || text || vs[3])
       WHEN 'u' THEN ROW(CASE WHEN fault IN (1, 2) THEN 1000000 ELSE c END + vu[1], 'K' || vu[2], chr(10) || role || ':' || text || vu[3]) ELSE ROW(1000000, '', '') END]) AS bn,
     list_min([ROW(3 + vs[1], 'D' || vs[2], vs[3]), ROW(CASE WHEN fault IN (1, 2) THEN 1000000 ELSE 2 + c END + vu[1], 'R' || vu[2], chr(10) || 'user:' || text || vu[3]),
      ROW(CASE WHEN fault IN (1, 2) OR l <> 'u' THEN 1000000 ELSE c END + vu[1], 'K' || vu[2], chr(10) || role || ':' || text || vu[3])]) AS bs,
     list_min([ROW(3 + vu[1], 'D' || vu[2], vu[3]), ROW(CASE WHEN fault IN (1, 2) THEN 1000000 ELSE 2 + c END + va[1], 'R' || va[2], chr(10) || 'assistant:' || text || va[3]),
      ROW(CASE WHEN fault IN (1, 2) OR l <> 'a' THEN 1000000 ELSE c END + va[1], 'K' || va[2], chr(10) || role || ':' || text || va[3])]) AS bu,
     list_min([ROW(3 + va[1], 'D' || va[2], va[3]), ROW(CASE WHEN fault IN (1, 2) THEN 1000000 ELSE 2 + c END + vu[1], 'R' || vu[2], chr(10) || 'user:' || text || vu[3]),
      ROW(CASE WHEN fault IN (1, 2) OR l <> 'u' THEN 1000000 ELSE c END + vu[1], 'K' || vu[2], chr(10) || role || ':' || text || vu[3])]) AS ba
    FROM w JOIN (SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS c FROM r) r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i - 1)))),
p AS (SELECT conv_id, turn, fault, lag(l) OVER (PARTITION BY conv_id ORDER BY i) || l AS pair FROM r),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
 count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM p GROUP BY 1),
e AS (SELECT conv_id, vn[1] AS cost, vn[2] AS audit, sha256(vn[3][2:]) AS sha FROM w WHERE i = 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM d.conv_id"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic_runs.find(periodic_runs.repeated(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # greatest length / period, compared without rounding, then the smallest start and period
    def ahead(x, y):
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(a > b, -1).when(a < b, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["period"] < y["period"], -1).otherwise(1)
    best = F.try_element_at(F.array_sort("runs", ahead), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return d.withColumn("_best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


#: all pairs of equal words up to a quarter of the text apart, then rows of them: for small tables
ORACLES["op12_periodic_runs"] = rf"""
WITH {_CRC_TABLE},
d0 AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CAST(doc_id AS VARCHAR) AS key FROM documents),
d1 AS (SELECT doc_id, r, w, len(w) AS n, {_crc("key")} AS h FROM d0, t),
d2 AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM d1),
d AS MATERIALIZED (SELECT doc_id, r, n, CASE WHEN a = n THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM d2),
x AS MATERIALIZED (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS w FROM d),
m AS (SELECT a.r, a.n, b.i - a.i AS p, a.i FROM x a JOIN x b ON a.r = b.r AND a.w = b.w AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT r, p, min(i) AS s, max(i) + 1 + p AS e FROM (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM m) GROUP BY r, p, k HAVING count(*) + p >= greatest(6, 4 * p)),
u AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.r = s.r AND o.p < s.p AND s.p % o.p = 0 AND o.s <= s.s AND o.e >= s.e)),
b AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM u GROUP BY r),
f AS (SELECT r, s AS start, e - s AS length, p AS period, row_number() OVER (PARTITION BY r ORDER BY (e - s) / p DESC, s, p) AS k FROM u),
c AS (SELECT x.r, string_agg(w, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = x.r AND x.i >= u.s + u.p AND x.i < u.e) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST((1000 * length) // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM d LEFT JOIN b USING (r) LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (r) LEFT JOIN c USING (r)"""
