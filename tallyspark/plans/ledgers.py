"""Queries on ledgers, hashes and text functions. Orders of a customer stand for the revisions of a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import ledger
from tallyspark.sources.tables import load

DOMAIN = "review-decision-v1"
KEY = b"blinding key"
#: The key under the two masks of the keyed hash, as hex.
PADS = [bytes(b ^ mask for b in KEY.ljust(64, b"\0")).hex() for mask in (0x5C, 0x36)]


def signed(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer as revisions, each signed over its parent's signature; some signatures are broken, some parents lost, some numbers skipped."""
    orders = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("payload")))).alias("x"))
    start = F.array().cast("array<struct<o_orderkey:long,payload:string,parent:string,signature:string>>")

    def sign(done: Column, x: Column) -> Column:
        parent = F.try_element_at(done, F.lit(-1))["signature"]
        own = ledger.domain_hash(DOMAIN, F.concat_ws("|", F.coalesce(parent, F.lit("")), x["payload"]))
        return F.concat(done, F.array(F.struct(x["o_orderkey"].cast("long").alias("o_orderkey"), x["payload"].alias("payload"), parent.alias("parent"), own.alias("signature"))))

    rows = orders.select("o_custkey", F.posexplode(F.aggregate("x", start, sign)).alias("i", "r")).select("o_custkey", "r.*", (F.col("i") + 1 + F.when(F.col("r.o_orderkey") % 101 == 0, 100_000).otherwise(0)).cast("long").alias("revision"))
    rows = rows.withColumn("signature", F.when(F.col("o_orderkey") % 97 == 0, "broken").otherwise(F.col("signature")))
    return rows.withColumn("parent", F.when(F.col("o_orderkey") % 89 != 0, F.col("parent")))


def hash_chain(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.chain_issues(signed(spark, d), ["o_custkey"], "revision", "parent", "signature", F.col("payload"), DOMAIN)
    return out.groupBy("o_custkey", "code").agg(F.count(F.lit(1)).alias("n"))


def ledger_current(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return ledger.current(rows, ["o_custkey"], "o_orderkey")


def state_transitions_invalid(spark: SparkSession, d: str) -> DataFrame:
    allowed = {"view": ("view", "click", "signup"), "click": ("view", "click", "purchase"), "signup": ("view", "click"), "purchase": ("view",), "error": ("error", "view")}
    out = ledger.transition_issues(load(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", allowed)
    return out.select("user_id", "event_id", "event_type", "previous_state")


def state_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ledger.state_histogram(load(spark, d, "events"), ["user_id"], "event_type", ["view", "click", "signup", "purchase", "error", "PENDING"])


def declared_counts(spark: SparkSession, d: str) -> DataFrame:
    declared = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("returned"), (F.col("o_custkey") % 5).alias("open"))
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus")
    return ledger.count_issues(declared, rows, "o_orderkey", {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"})


def lesson_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 3 + 1).alias("events"))
    return ledger.lesson_rollup(rows, "o_custkey", "o_orderkey", "y", "y", "events").withColumnsRenamed({"start": "first_year", "end": "last_year"})


def queue_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ledger.queue_rollup(load(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") != "P", F.col("o_orderstatus").isin("F", "O"), F.floor(F.col("o_totalprice") / 50000))


def package_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.package_rollup(load(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate")), "l_suppkey", "day", "day", "day", F.col("l_returnflag") == "N")
    return out.withColumnsRenamed({"start": "first_day", "end": "last_day"})


def revoked_pins(spark: SparkSession, d: str) -> DataFrame:
    pins = load(spark, d, "customer").select("c_custkey", F.sha2(F.col("c_mktsegment"), 256).alias("sha"))
    gone = load(spark, d, "customer").where("c_mktsegment in ('MACHINERY', 'BUILDING')").select(F.sha2(F.col("c_mktsegment"), 256).alias("sha"))
    return ledger.revoked_pins(pins, gone, "sha").select("c_custkey")


def hash_order(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.hash_order(load(spark, d, "orders").select("o_custkey", "o_orderkey"), DOMAIN, F.lit(1), F.col("o_orderkey"), ["o_custkey"])
    return out.select("o_custkey", "o_orderkey", "place")


def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    content = text.canonical_object(total=text.js_number(F.round(F.col("o_totalprice"), 0)), key=text.js_number(F.col("o_orderkey")), status=F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')))
    return load(spark, d, "orders").select("o_orderkey", text.derived_id("case-", content, 20).alias("id"), text.even_side(F.col("o_orderkey").cast("string"), "skills", "baseline").alias("side"))


def hmac_reblind(spark: SparkSession, d: str) -> DataFrame:
    """Blind ids under a key."""
    return load(spark, d, "orders").select("o_orderkey", text.hmac_sha256(KEY, F.col("o_orderkey").cast("string")).alias("blind_id"))


def rng_draws(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", F.floor(text.mulberry32(20240731, F.col("o_orderkey") + 1) * 1e9).cast("long").alias("draw"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("text")
    return load(spark, d, "documents").select("doc_id", text.slug(doc, "doc").alias("slug"), text.auto_title(doc).alias("title"), text.shorten(doc, 12).alias("short"), text.xml_escape(doc).alias("xml"))


def clock_format(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("value") * 37.5
    return load(spark, d, "events").select("event_id", text.clock(at).alias("clock"), text.timecode(F.col("value")).alias("code"), F.round(text.parse_timecode(text.timecode(F.floor(at), ",")), 3).alias("seconds"))


def markup_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "pages").select(F.explode(F.split("html", ">")).alias("part"))
    rows = rows.select(text.has_markup(F.concat("part", F.lit(">"))).alias("markup"))
    return rows.groupBy("markup").agg(F.count(F.lit(1)).alias("n"))


def unsafe_uri(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses, and paths made of them, some climbing out or encoded twice."""
    path = F.regexp_replace("url", "^https?://", "")
    ways = F.array(F.col("url"), path, F.concat(path, F.lit("/../x")), F.concat(path, F.lit("/%252e%252e/x")), F.concat(path, F.lit("/a%20b")), F.concat(F.lit("/"), path))
    return load(spark, d, "pages").select("page_id", F.posexplode(ways).alias("way", "uri")).select("page_id", "way", text.safe_relative_uri(F.col("uri")).alias("safe"))


def search_tokens(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select("conv_id", "turn", F.size(text.search_tokens(F.col("text"))).alias("n"), F.array_join(F.array_sort(text.search_tokens(F.lit("图像 ab 力学题 x_y 电"))), " ").alias("cjk"))


def masked_settings(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer")
    saved, env = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, F.lit("  ")).otherwise(F.lit("env"))
    return rows.select("c_custkey", text.setting(saved, env, "default").alias("value"), text.masked_key(F.col("c_name")).alias("masked"))


QUERIES = {f.__name__: f for f in (hash_chain, ledger_current, state_transitions_invalid, state_histogram, declared_counts, lesson_rollup, queue_rollup, package_rollup, revoked_pins, hash_order, derived_ids, hmac_reblind, rng_draws, slugs, clock_format, markup_guard, unsafe_uri, search_tokens, masked_settings)}

SQL = {
    "hash_chain": f"""
WITH RECURSIVE o AS (SELECT o_custkey c, o_orderkey k, o_orderkey || ':' || o_orderstatus AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
s AS (SELECT c, k, n, p, CAST(NULL AS VARCHAR) AS up, sha256('{DOMAIN}' || chr(0) || '|' || p) AS sig FROM o WHERE n = 1 UNION ALL SELECT o.c, o.k, o.n, o.p, s.sig, sha256('{DOMAIN}' || chr(0) || s.sig || '|' || o.p) FROM s JOIN o ON o.c = s.c AND o.n = s.n + 1),
t AS (SELECT c, p, n + CASE WHEN k % 101 = 0 THEN 100000 ELSE 0 END AS rev, CASE WHEN k % 97 = 0 THEN 'broken' ELSE sig END AS sig, CASE WHEN k % 89 <> 0 THEN up END AS up FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY rev) AS place, lag(sig) OVER (PARTITION BY c ORDER BY rev) AS before, sha256('{DOMAIN}' || chr(0) || coalesce(up, '') || '|' || p) AS own FROM t),
i AS (SELECT c, 'revision.skipped' AS code FROM w WHERE rev <> place UNION ALL SELECT c, 'parent.signature' FROM w WHERE up IS DISTINCT FROM before UNION ALL SELECT c, 'signature.mismatch' FROM w WHERE sig <> own)
SELECT c AS o_custkey, code, count(*) AS n FROM i GROUP BY ALL""",
    "ledger_current": "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) n FROM orders) WHERE n = 1",
    "state_transitions_invalid": """
WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_state FROM events)
SELECT * FROM e WHERE previous_state IS NOT NULL AND NOT list_contains(CASE previous_state WHEN 'view' THEN ['view', 'click', 'signup'] WHEN 'click' THEN ['view', 'click', 'purchase'] WHEN 'signup' THEN ['view', 'click'] WHEN 'purchase' THEN ['view'] ELSE ['error', 'view'] END, event_type)""",
    "state_histogram": 'SELECT user_id, count(*) FILTER (event_type = \'view\') AS "view", count(*) FILTER (event_type = \'click\') AS "click", count(*) FILTER (event_type = \'signup\') AS "signup", count(*) FILTER (event_type = \'purchase\') AS "purchase", count(*) FILTER (event_type = \'error\') AS "error", CAST(0 AS BIGINT) AS "PENDING" FROM events GROUP BY ALL',
    "declared_counts": """
WITH d AS (SELECT l_orderkey k, count(*) FILTER (l_returnflag = 'R') r, count(*) FILTER (l_linestatus = 'O') p FROM lineitem GROUP BY ALL),
j AS (SELECT o_orderkey, o_orderkey % 4 AS dr, o_custkey % 5 AS dp, coalesce(r, 0) r, coalesce(p, 0) p FROM orders LEFT JOIN d ON k = o_orderkey)
SELECT o_orderkey, 'returned' AS counter, dr AS declared, r AS derived FROM j WHERE dr <> r UNION ALL SELECT o_orderkey, 'open', dp, p FROM j WHERE dp <> p""",
    "lesson_rollup": """
SELECT o_custkey, 'lesson-' || left(sha256('{"events":' || CAST(sum(o_custkey % 3 + 1) AS BIGINT) || ',"packages":["' || array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR))), '","') || '"]}'), 16) AS lesson_id,
  count(*) AS n_packages, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year, CAST(sum(o_custkey % 3 + 1) AS BIGINT) AS events FROM orders GROUP BY o_custkey""",
    "queue_rollup": "SELECT o_custkey, count(*) AS groups, count(*) FILTER (o_orderstatus <> 'P') AS decided, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS signed, CAST(sum(floor(o_totalprice / 50000)) AS BIGINT) AS accepted, count(*) FILTER (o_orderstatus IN ('F', 'O')) = count(*) AND sum(floor(o_totalprice / 50000)) >= 30 AS ready FROM orders GROUP BY ALL",
    "package_rollup": "SELECT l_suppkey, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day, count(*) FILTER (l_returnflag = 'N') AS accepted, CAST(max(l_shipdate) AS DATE) AS frozen_at, count(*) AS groups FROM lineitem GROUP BY ALL",
    "revoked_pins": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')",
    "hash_order": f"SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('{DOMAIN}|1|' || o_orderkey), o_orderkey) AS INTEGER) AS place FROM orders",
    "derived_ids": "SELECT o_orderkey, 'case-' || left(sha256('{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\",\"total\":' || CAST(round(o_totalprice) AS BIGINT) || '}'), 20) AS id, CASE WHEN right(sha256(CAST(o_orderkey AS VARCHAR)), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'skills' ELSE 'baseline' END AS side FROM orders",
    "hmac_reblind": f"SELECT o_orderkey, sha256(from_hex('{PADS[0]}') || from_hex(sha256(from_hex('{PADS[1]}') || encode(CAST(o_orderkey AS VARCHAR))))) AS blind_id FROM orders",
    "rng_draws": """
WITH a AS (SELECT o_orderkey, (20240731 + (o_orderkey + 1) * 1831565813) % 4294967296 a FROM orders),
b AS (SELECT *, CAST((CAST(xor(a, a >> 15) AS HUGEINT) * (a | 1)) % 4294967296 AS BIGINT) t FROM a),
c AS (SELECT *, xor(t, (t + CAST((CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % 4294967296 AS BIGINT)) % 4294967296) u FROM b)
SELECT o_orderkey, CAST(floor(xor(u, u >> 14) / 4294967296.0 * 1e9) AS BIGINT) AS draw FROM c""",
    "slugs": """
WITH d AS (SELECT doc_id, text t, text x FROM documents),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(t), '[^a-z0-9-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g') g, trim(regexp_replace(t, '\\s+', ' ', 'g')) q FROM d)
SELECT doc_id, regexp_replace(left(CASE WHEN g = '' THEN 'doc' ELSE g END, 63), '-$', '') AS slug, CASE WHEN length(q) > 28 THEN left(q, 28) || '…' ELSE q END AS title,
  CASE WHEN length(t) > 12 THEN left(t, 11) || '…' ELSE t END AS short, replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM s""",
    "clock_format": """
WITH e AS (SELECT event_id, value, value * 37.5 AS t, CAST(floor(value * 1000 + 0.5) AS BIGINT) ms FROM events)
SELECT event_id, printf('%02d:%02d', CAST(floor(t / 60) AS BIGINT), CAST(floor(t) AS BIGINT) % 60) AS clock,
  printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS code, round(floor(t), 3) AS seconds FROM e""",
    "markup_guard": "WITH p AS (SELECT unnest(string_split(html, '>')) x FROM pages) SELECT regexp_matches(x || '>', '(?i)</?[a-z][^>]*>') AS markup, count(*) AS n FROM p GROUP BY ALL",
    "unsafe_uri": """
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') x FROM pages),
w AS (SELECT page_id, 0 AS way, false AS safe FROM p UNION ALL SELECT page_id, 1, NOT regexp_matches(x, '[?#\\\\]') AND NOT list_has_any(string_split(x, '/'), ['', '.', '..']) FROM p
  UNION ALL SELECT page_id, 2, false FROM p UNION ALL SELECT page_id, 3, false FROM p UNION ALL SELECT page_id, 4, NOT regexp_matches(x, '[?#\\\\]') AND NOT list_has_any(string_split(x, '/'), ['', '.', '..']) FROM p UNION ALL SELECT page_id, 5, false FROM p)
SELECT * FROM w""",
    "search_tokens": """
WITH c AS (SELECT conv_id, turn, regexp_replace(lower(text), '\\s+', '', 'g') s FROM conversations)
SELECT conv_id, turn, CAST(len(list_distinct(regexp_extract_all(s, '[a-z0-9][a-z0-9_-]+'))) AS INTEGER) AS n, 'ab x_y 力学 力学题 图像 学题 电' AS cjk FROM c""",
    "masked_settings": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 1 THEN 'env' ELSE 'default' END AS value, left(c_name, 4) || '…' || right(c_name, 4) AS masked FROM customer",
}
