"""Queries that apply the operators to the star schema's tables, each with its DuckDB twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.functions import dates, misc, render, text, urls
from tracewright.operators import association, contracts, history, layout, report, rules
from tracewright.plans.audit import audit
from tracewright.streaming import tasks as store

QUERIES: dict = {}
SQL: dict[str, str] = {}
TODAY = dt.date(2001, 8, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT page_id, lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\\.', '')) || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS canonical_url,
       regexp_extract(url, '^(https?://)', 1) || lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\\.', '')) || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS display_url
FROM pages""")
def canonical_url(spark, sf_dir):
    """F10, F11."""
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"), urls.display_url(F.col("url")).alias("display_url"))


#: A dimension of top-level domains, as platforms are one of domains.
_TLDS = {"com": "commercial", "net": "network", "org": "organisation"}


@query("""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS path_lang, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS html_lang FROM pages)
SELECT page_id, host, coalesce(CASE WHEN ends_with(host, '.com') THEN 'commercial' WHEN ends_with(host, '.net') THEN 'network' WHEN ends_with(host, '.org') THEN 'organisation' END, '') AS platform,
       CASE WHEN path_lang <> '' THEN path_lang ELSE html_lang END AS lang, path_lang <> '' AND html_lang <> '' AND path_lang <> html_lang AS conflict
FROM p""")
def platform_by_domain(spark, sf_dir):
    """The suffix names the platform; the path's language wins over the page's."""
    host = F.regexp_extract(urls.canonical_url(F.col("url")), "^([^/]*)", 1)
    p = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_extract("url", "^https?://[^/]+/([a-z]{2})/", 1).alias("told"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("seen"))
    platform = F.lit("")
    for tld, name in _TLDS.items():
        platform = F.when(F.col("host").endswith(f".{tld}"), name).otherwise(platform)
    picked = rules.resolved_platform(F.col("seen"), F.col("told"))
    return p.select("page_id", "host", platform.alias("platform"), picked["value"].alias("lang"), picked["conflict"].alias("conflict"))


@query(f"""
WITH l AS (SELECT DISTINCT o_orderkey, 1 AS line FROM orders), nl AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY ALL),
nr AS (SELECT l_orderkey AS k, l_linenumber, count(*) AS n, min(l_partkey) AS found FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)
SELECT o.o_orderkey, 1 AS l_linenumber, CASE WHEN nl.n = 1 AND nr.n = 1 THEN nr.found ELSE -1 END AS l_partkey, CASE WHEN nl.n = 1 AND nr.n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
       CASE WHEN nl.n = 1 AND nr.n = 1 THEN '{association.UNIQUE}' WHEN nr.n IS NULL THEN '{association.NOT_FOUND}' ELSE '{association.AMBIGUOUS}' END AS reason
FROM orders o JOIN nl ON nl.k = o.o_orderkey LEFT JOIN nr ON nr.k = o.o_orderkey""")
def associate_unique_key(spark, sf_dir):
    """orders' first lines, where there is exactly one."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return association.unique_key_join(orders, lines, ["l_orderkey", "l_linenumber"], "o_orderkey", "l_partkey").drop("l_orderkey").fillna(-1, ["l_partkey"])


@query("""
WITH p AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN total IS NULL THEN 'unverifiable' WHEN abs(total - o_totalprice) < 0.005 THEN 'match' ELSE 'mismatch' END AS price_state,
       CASE WHEN shipped IS NULL THEN 'unverifiable' WHEN shipped::DATE = o_orderdate::DATE THEN 'match' ELSE 'mismatch' END AS date_state
FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def field_compare(spark, sf_dir):
    """an order against the sum of its lines, field by field."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.max("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    price = F.when(F.col("total").isNull(), "unverifiable").when(F.abs(F.col("total") - F.col("o_totalprice")) < 0.005, "match").otherwise("mismatch")
    day = lambda c: dates.published_at(F.date_format(c, "yyyy-MM-dd"))
    return o.select("o_orderkey", price.alias("price_state"), dates.compare_published_at(day("shipped"), day("o_orderdate")).alias("date_state"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem
           WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice))
SELECT o_orderkey, coalesce(l_linenumber, -1) AS l_linenumber, coalesce(l_partkey, -1) AS l_partkey, coalesce(c, 0) AS n_children, coalesce(c, 0) > 1 AS ambiguous FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND n = 1""")
def first_per_parent(spark, sf_dir):
    """Each order's first line and whether there are more."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    out = layout.first_per_parent(table(spark, sf_dir, "orders").select("o_orderkey"), lines, ["o_orderkey"], order, ["l_linenumber", "l_partkey"])
    return out.withColumn("ambiguous", F.col("n_children") > 1).fillna(-1, ["l_linenumber", "l_partkey"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) = 1""")
def last_duplicate_wins(spark, sf_dir):
    """Of lines with the same key the last."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("ord"))
    return rules.last_by(lines, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_LINES = "l_shipdate, l_linenumber, l_partkey, l_suppkey"
_CHUNKS = f"SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) AS place FROM lineitem"


def _line_batches(spark, sf_dir) -> DataFrame:
    """An order's lines with their place, in batches of three."""
    order = [F.col(c) for c in _LINES.split(", ")]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", *_LINES.split(", ")[:2], "l_suppkey")
    return layout.batches(lines, ["l_orderkey"], order, 3).withColumn("place", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)))


@query(f"SELECT l_orderkey, ((place - 1) // 3)::INTEGER AS batch, count(*) AS items, min(l_partkey) AS first_part FROM ({_CHUNKS}) GROUP BY ALL")
def chunk_batches(spark, sf_dir):
    """Batches of three of each order's lines, in their order over the whole order."""
    return _line_batches(spark, sf_dir).groupBy("l_orderkey", "batch").agg(F.count(F.lit(1)).alias("items"), F.min("l_partkey").alias("first_part"))


@query(f"""
WITH RECURSIVE c AS (SELECT *, ((place - 1) // 3)::INTEGER AS batch, floor(l_extendedprice)::BIGINT AS size FROM ({_CHUNKS})),
s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, batch ORDER BY place) AS rn, max(size) OVER (PARTITION BY l_orderkey, batch) > 80000 AS too_large FROM c),
f AS (
  SELECT l_orderkey, batch, rn, place, size AS bytes, 1 AS n, 0 AS part FROM s WHERE rn = 1 AND NOT too_large
  UNION ALL
  SELECT s.l_orderkey, s.batch, s.rn, s.place, CASE WHEN f.n >= 2 OR f.bytes + s.size > 80000 THEN s.size ELSE f.bytes + s.size END, CASE WHEN f.n >= 2 OR f.bytes + s.size > 80000 THEN 1 ELSE f.n + 1 END,
         f.part + CASE WHEN f.n >= 2 OR f.bytes + s.size > 80000 THEN 1 ELSE 0 END
  FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.batch = f.batch AND s.rn = f.rn + 1
)
SELECT l_orderkey, batch, place, part FROM f UNION ALL SELECT l_orderkey, batch, place, -1 FROM s WHERE too_large""")
def byte_split(spark, sf_dir):
    """Those batches cut again at 80,000 or two items, in order; a batch with a larger item is an error (-1)."""
    d = _line_batches(spark, sf_dir).withColumn("size", F.floor("l_extendedprice"))
    g = d.groupBy("l_orderkey", "batch").agg(F.sort_array(F.collect_list(F.struct("place", "size"))).alias("s"))  # three at most
    parts = F.coalesce(layout.byte_split(F.transform("s", lambda x: x["size"]), 80_000, 2), F.transform("s", lambda x: F.lit(-1)))
    return g.select("l_orderkey", "batch", F.explode(F.arrays_zip(F.transform("s", lambda x: x["place"]).alias("place"), parts.alias("part"))).alias("x")).select("l_orderkey", "batch", "x.place", "x.part")


def _order_tasks(spark, sf_dir) -> DataFrame:
    """Orders seen as tasks: customers own them, the priority is the file name, the date the time of creation."""
    created = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, sf_dir, "orders").select(F.format_string("%010d", "o_orderkey").alias("id"), F.concat(F.lit("segment-"), F.col("o_custkey") % 7).alias("owner_email"), F.col("o_orderpriority").alias("file_name"), created.alias("created_at"), "o_orderstatus")


_ORDER_TASKS = "SELECT printf('%010d', o_orderkey) AS id, 'segment-' || (o_custkey % 7) AS owner_email, o_orderpriority AS file_name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at, o_orderstatus FROM orders"


@query(f"""
WITH t AS ({_ORDER_TASKS}), page AS (
  SELECT id, file_name, created_at FROM t WHERE owner_email = 'segment-3' AND translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%h_gh%'
    AND created_at >= '1996-01-01T00:00:00.000Z' AND created_at <= '2000-12-31T00:00:00.000Z' AND (created_at < '2000-06-15T00:00:00.000Z' OR created_at = '2000-06-15T00:00:00.000Z' AND id < '0000001000')
  ORDER BY created_at DESC, id DESC LIMIT 21)
SELECT * FROM page""")
def history_page(spark, sf_dir):
    """A page of 20 and one more row, which tells that there are further ones."""
    t = store.history(_order_tasks(spark, sf_dir), "segment-3", query="H_gh", created_from="1996-01-01T00:00:00.000Z", created_to="2000-12-31T00:00:00.000Z", after=("2000-06-15T00:00:00.000Z", "0000001000"))
    return t.limit(21).select("id", "file_name", "created_at")


@query("""
SELECT 'part' AS kind, p_partkey AS key, p_name AS name FROM part WHERE translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%r_d%get%'
UNION ALL SELECT 'customer', c_custkey, c_name FROM customer WHERE translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%r#0%1_3%'""")
def like_ascii(spark, sf_dir):
    """P13, F32."""
    parts = table(spark, sf_dir, "part").filter(text.like_ascii(F.col("p_name"), "R_d%GET")).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return parts.unionByName(table(spark, sf_dir, "customer").filter(text.like_ascii(F.col("c_name"), "R#0%1_3")).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))


@query("""
WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, count_if(event_type = 'error')::BIGINT AS attempts, max(ts) AS last_ts FROM events GROUP BY user_id),
t AS (SELECT *, CASE last_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'queued' ELSE 'rendering' END AS status FROM s)
SELECT user_id, CASE WHEN status <> 'rendering' THEN status WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS status, attempts, status = 'rendering' AND attempts >= 3 AS exhausted FROM t""")
def recover_state(spark, sf_dir):
    """T-1, T-4: events folded to the last state of a user; active ones are queued again or, after three errors, failed."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count_if(F.col("event_type") == "error").alias("attempt_count"))
    last = last.withColumn("status", F.when(F.col("last_type") == "purchase", "completed").when(F.col("last_type") == "signup", "queued").otherwise("rendering"))
    idle = last.filter(~store.active()).select("user_id", "status", F.col("attempt_count").alias("attempts"), F.lit(False).alias("exhausted"))
    run = last.withColumns({c: store.null("int") for c in ("progress", "processed_pages")})
    back = store.recovered(run, "2024-02-01T00:00:00.000Z")
    return idle.unionByName(back.select("user_id", "status", F.col("attempt_count").alias("attempts"), (F.col("error_code").isNotNull()).alias("exhausted")))


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('purchase', 'error') AND ts <= TIMESTAMP '2024-01-10 00:00:00'")
def retention_expired(spark, sf_dir):
    """T-8: finished ones whose time is before a fixed limit."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("queued")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", status.alias("status"), F.lit("x").alias("pdf_path"), store.null().alias("pdf_deleted_at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("pdf_expires_at"))
    return store.expired(e, "2024-01-10T00:00:00.000000").select("event_id", "user_id")


@query("""
SELECT preset, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN (VALUES ('today', DATE '2001-08-01', DATE '2001-08-02'), ('7d', DATE '2001-07-26', DATE '2001-08-02'), ('30d', DATE '2001-07-03', DATE '2001-08-02'),
  ('custom', DATE '1996-02-29', DATE '1997-03-01'), ('open', NULL, DATE '1995-07-01'), ('all', NULL, NULL)) b(preset, lo, hi) ON (lo IS NULL OR o_orderdate >= lo) AND (hi IS NULL OR o_orderdate < hi) GROUP BY preset""")
def date_presets(spark, sf_dir):
    """P15, in one scan: each order counts in every preset it falls in. An invalid custom date leaves its side open."""
    bounds = {"today": dates.preset_bounds("today", TODAY), "7d": dates.preset_bounds("7d", TODAY), "30d": dates.preset_bounds("30d", TODAY), "custom": dates.preset_bounds("custom", TODAY, "1996-02-29", "1997-02-28"), "open": dates.preset_bounds("custom", TODAY, "1995-02-30", "1995-06-30"), "all": dates.preset_bounds("all", TODAY)}
    names = F.filter(F.array(*[F.when(dates.in_bounds(F.col("o_orderdate"), b), F.lit(p)) for p, b in bounds.items()]), lambda x: x.isNotNull())
    o = table(spark, sf_dir, "orders").select("o_totalprice", F.explode(names).alias("preset"))
    return o.groupBy("preset").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'match' WHEN 1 THEN 'match' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'unverifiable' ELSE 'mismatch' END AS state,
       CASE WHEN o_orderkey % 5 = 3 THEN -1 WHEN o_orderkey % 5 = 2 THEN year(o_orderdate + INTERVAL 1 DAY)::INTEGER ELSE year(o_orderdate)::INTEGER END AS year FROM orders""")
def partial_date_match(spark, sf_dir):
    """dates written five ways and read back."""
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    written = F.when(k == 0, F.concat(F.lit("编辑于 "), F.date_format(d, "yyyy年M月d日"))).when(k == 1, F.date_format(d, "yy/M/d HH:mm")).when(k == 2, F.date_format(F.date_add(d, 1), "yyyy.MM.dd")).when(k == 3, F.date_format(d, "yyyy-'13'-dd")).otherwise(F.date_format(d, "yyyy-MM-dd 23:59"))
    # Years before 2000 written with two digits would be read as 20xx, so those are written in full.
    written = F.when((k == 1) & (F.year(d) < 2000), F.date_format(d, "yyyy/M/d HH:mm")).otherwise(written)
    o = table(spark, sf_dir, "orders").select("o_orderkey", dates.published_at(written).alias("seen"), dates.published_at(F.date_format(d, "yyyy-MM-dd HH:mm")).alias("told"))
    return o.select("o_orderkey", dates.compare_published_at(F.col("seen"), F.col("told")).alias("state"), F.coalesce("seen.year", F.lit(-1)).alias("year"))


@query("""
WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM w),
f AS (SELECT doc_id, line, min(pos) AS pos FROM u WHERE line <> '' GROUP BY doc_id, line), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM f)
SELECT d.doc_id, count(r.rn) AS n_distinct, coalesce(string_agg(line, chr(10) ORDER BY rn), '') AS lines FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""")
def warning_dedupe(spark, sf_dir):
    """A document's distinct lines in order of first occurrence, without empty ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.stage_warnings(F.split("text", "\n", -1)).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_distinct"), F.array_join("w", "\n").alias("lines"))


@query("""
WITH n AS (SELECT r_regionkey, r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM region LEFT JOIN nation ON n_regionkey = r_regionkey)
SELECT r_regionkey, '{' || chr(10) || (r_regionkey + 1) || '. ' || any_value(r_name) || '：' || CASE WHEN count(n_nationkey) = 0 THEN '评估无错误' ELSE '' END
  || coalesce(chr(10) || string_agg('   - 错误点' || i || '：' || n_name, chr(10) ORDER BY i) FILTER (WHERE n_nationkey IS NOT NULL), '') || chr(10) || '}' AS report FROM n GROUP BY r_regionkey""")
def report_text(spark, sf_dir):
    """The nations of each region as a numbered category."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("message")))).alias("issues"))
    r = table(spark, sf_dir, "region").join(nations, "r_regionkey", "left")
    none = F.array().cast("array<struct<n_nationkey:int,message:string>>")
    body = report.category(0, "", F.coalesce("issues", none), none)
    titled = F.concat(F.array(F.concat((F.col("r_regionkey") + 1).cast("string"), F.lit(". "), F.col("r_name"), F.substring(F.get(body, F.lit(0)), 4, 100))), F.slice(body, F.lit(2), F.size(body)))
    return r.select("r_regionkey", F.array_join(F.concat(F.array(F.lit("{")), titled, F.array(F.lit("}"))), "\n").alias("report"))


@query("""
SELECT event_id, coalesce(json_keys(props) = ['k'], false) AS exact, json_extract_string(props, '$.k')::INTEGER AS k FROM events""")
def props_contract(spark, sf_dir):
    """Exactly the known key, and its value."""
    exact = contracts.has_exact_keys(F.col("props"), ["k"])
    return table(spark, sf_dir, "events").select("event_id", exact.alias("exact"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""
WITH a AS (SELECT o_orderkey AS g, o_custkey AS id FROM orders), r AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS id FROM lineitem),
j AS (SELECT coalesce(a.g, r.g) AS g, a.id AS ai, r.id AS ri FROM (SELECT DISTINCT g % 500 AS g, id % 50 AS id FROM a) a FULL JOIN (SELECT DISTINCT g % 500 AS g, id % 50 AS id FROM r) r ON a.g = r.g AND a.id = r.id)
SELECT g AS batch, count_if(ri IS NULL)::BIGINT AS missing, count_if(ai IS NULL)::BIGINT AS extra, count_if(ri IS NULL) = 0 AND count_if(ai IS NULL) = 0 AS ok FROM j GROUP BY g""")
def coverage_check(spark, sf_dir):
    """Ids asked for against ids returned, by batch."""
    asked = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 500).alias("batch"), (F.col("o_custkey") % 50).alias("id"))
    got = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("batch"), (F.col("l_suppkey") % 50).alias("id"))
    return contracts.id_sets(asked, got, ["batch"], "id")


@query("""
WITH t AS (SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_id, event_type FROM t""")
def newest_read(spark, sf_dir):
    """W4, J15, T-13: the newest read of each key."""
    return store.newest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
SELECT o_orderkey, greatest(1, ceil(200.0::DOUBLE * (p_size * 10.0::DOUBLE / 200.0::DOUBLE) * (200.0::DOUBLE / 72)))::INTEGER AS crop_width, round(least(2.0::DOUBLE, 1800.0::DOUBLE / greatest(600 + p_size * 40, 800)), 6) AS page_scale FROM orders JOIN part ON p_partkey = o_orderkey""")
def render_geometry(spark, sf_dir):
    """crop width and page scale of pages sized by part."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("o_orderkey"), "p_size")
    plan = render.region_plan(F.lit(200.0), F.lit(200.0), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.col("p_size") * 10.0 / 200.0).alias("width"), F.lit(0.5).alias("height")), F.lit(200.0))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(p, "o_orderkey").select("o_orderkey", plan["width"].alias("crop_width"), F.round(render.page_scale((600 + F.col("p_size") * 40).cast("double"), F.lit(800.0)), 6).alias("page_scale"))


def order_requests(spark, sf_dir) -> DataFrame:
    """Orders as audit documents (doc_id, request): lines are summary rows and, but for every tenth part, screenshots; fields differ by fixed rules of the line."""
    obs = lambda t, ok=None, **more: F.struct(t.cast("string").alias("rawText"), (F.lit("recognized") if ok is None else F.when(ok, "recognized").otherwise("partial")).alias("status"), F.lit(0.9).alias("confidence"), F.lit(1).alias("pageNumber"), F.lit("r").alias("regionId"), *[v.alias(k) for k, v in more.items()])
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").alias("l"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: keep all tasks, for the table that is written here, too
    line = line.repartition(tasks, "l_orderkey")
    lines = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l")).alias("l"))
    nothing = F.array().cast(dict(lines.dtypes)["l"])
    o = table(spark, sf_dir, "orders").repartition(tasks, "o_orderkey").join(lines, "o_orderkey", "left").withColumn("l", F.coalesce("l", nothing))
    o = o.withColumns({"rows": F.transform("l", lambda x, i: F.struct(i.alias("i"), x.alias("l"))), "n": F.transform("l", lambda x: x["l_linenumber"])})
    o = o.withColumn("shots", F.filter("rows", lambda r: r["l"]["l_partkey"] % 10 != 0))
    o = o.withColumn("shot_n", F.transform("shots", lambda r: r["l"]["l_linenumber"]))
    name = lambda p, r: F.concat(F.lit(p), r["i"].cast("string"))
    weibo = lambda r: r["l"]["l_suppkey"] % 2 == 0
    null = lambda kind: F.lit(None).cast(kind)
    shot = lambda r: F.struct(
        name("s", r), F.lit("r"), F.lit(1), F.lit(1), r["l"]["l_linenumber"], obs(F.lit("微博")), obs(F.when(weibo(r), "www.weibo.com").otherwise("m.xiaohongshu.com")), obs(F.concat(F.lit("Supplier "), r["l"]["l_suppkey"].cast("string")), r["l"]["l_partkey"] % 13 != 0),
        obs(F.date_format(r["l"]["l_shipdate"], "编辑于 yyyy年M月d日"), None, kind=F.lit("edited"), yearContextClear=F.lit(True)), obs(null("string")), null("string"),
    )
    url = lambda r: F.concat(F.lit("https://www.weibo.com/p/"), r["l"]["l_partkey"].cast("string"), F.lit("?from=x"))
    review = lambda r: F.struct(name("s", r), url(r), url(r), F.array(), F.array(), url(r), F.when(r["l"]["l_linenumber"] == 5, "partial").otherwise("recognized"), F.lit(0.9))
    row = lambda r: F.struct(
        name("t", r), F.lit(1), F.lit("r"), F.lit(1), r["l"]["l_linenumber"], obs(F.when(r["l"]["l_quantity"] > 45, "抖音").when(weibo(r), "Weibo").otherwise("小红书")),
        obs(F.concat(F.lit("Supplier "), (r["l"]["l_suppkey"] + (r["l"]["l_partkey"] % 7 == 0).cast("int")).cast("string"))), obs(F.date_format(F.date_add(r["l"]["l_shipdate"], (r["l"]["l_discount"] > 0.08).cast("int")), "yyyy-MM-dd")),
        F.array(F.lit("weibo.com/p/"), F.concat(r["l"]["l_partkey"].cast("string"), F.when(r["l"]["l_tax"] > 0.06, "/x").otherwise("/"))),
    )
    times = lambda where, r: F.size(F.filter(where, lambda k: k == r["l"]["l_linenumber"]))
    only = lambda r: (times("n", r) == 1) & (times("shot_n", r) == 1)
    link = lambda r: F.struct(name("s", r), F.when(only(r), name("t", r)), F.when(only(r), 1.0).otherwise(0.0), F.lit(""))
    owner = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    paper = F.struct(F.lit("c"), F.lit(1), F.when(F.col("o_orderstatus") == "F", "yes").otherwise("uncertain"), obs(owner), obs(F.lit("美术")))
    has_paper = F.col("o_orderstatus") != "O"
    none = F.array().cast("array<string>")
    region = F.struct(F.lit("c"), F.lit("certificate"), F.lit(1), F.struct(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), null("string"), null("int"), null("int"), F.lit(1), F.lit(0.9))
    header = F.struct(F.lit("h"), F.lit(1), obs(F.when(F.col("o_custkey") % 11 == 0, "Nobody").otherwise(owner)), obs(F.lit("美术作品")))
    types = {f.name: f.dataType for f in schemas.REQUEST.spark().fields}
    cast = lambda c, group, field: c.cast(types[group][field].dataType)
    some = lambda c, of: F.when(has_paper, F.array(c)).otherwise(F.filter(F.array(c), lambda _: F.lit(False)))
    request = F.struct(
        F.lit("orders.pdf").alias("fileName"), F.lit(1).alias("pageCount"),
        F.struct(cast(F.array(F.struct(F.lit(1), some(region, "regions"), none, F.lit(0.9))), "layout", "pages"), none).alias("layout"),
        F.struct(cast(some(paper, "certificates"), "evidence", "certificates"), cast(F.transform("shots", shot), "evidence", "screenshots"), none).alias("evidence"),
        F.struct(cast(F.transform("shots", review), "urlReviews", "reviews"), none).alias("urlReviews"),
        F.struct(cast(F.array(header), "table", "headers"), cast(F.transform("rows", row), "table", "rows"), none).alias("table"),
        F.struct(cast(F.transform("shots", link), "associations", "associations"), none).alias("associations"), none.alias("warnings"), F.array().cast(types["stageFailures"]).alias("stageFailures"),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), request.cast(schemas.REQUEST.spark()).alias("request"))


@query("""
WITH r AS (SELECT *, l_partkey % 10 <> 0 AS shot FROM lineitem), k AS (SELECT l_orderkey, l_linenumber, count(*) AS n_r, count_if(shot) AS n_s FROM r GROUP BY ALL), m AS (SELECT r.*, n_r = 1 AND n_s = 1 AS uniq FROM r JOIN k USING (l_orderkey, l_linenumber)),
f AS (
  SELECT o_orderkey AS d, 'notice' AS part, 1 AS phase, 0 AS line, 0 AS seq, 'CERTIFICATE_PRESENCE_UNCERTAIN' AS code FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'issue', 1, 0, 1, 'RIGHTS_HOLDER_MISMATCH' FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 11 = 0
  UNION ALL SELECT l_orderkey, 'notice', 3, l_linenumber, 0, 'ASSOCIATION_UNVERIFIABLE' FROM m WHERE shot AND NOT uniq
  UNION ALL SELECT l_orderkey, 'notice', 3, l_linenumber, 2, 'PLATFORM_SOURCE_CONFLICT' FROM m WHERE uniq AND l_suppkey % 2 = 1
  UNION ALL SELECT l_orderkey, 'issue', 3, l_linenumber, 3, 'PLATFORM_MISMATCH' FROM m WHERE uniq AND l_quantity > 45
  UNION ALL SELECT l_orderkey, 'notice', 3, l_linenumber, 4, 'PUBLISHER_UNVERIFIABLE' FROM m WHERE uniq AND l_partkey % 13 = 0
  UNION ALL SELECT l_orderkey, 'issue', 3, l_linenumber, 5, 'PUBLISHER_MISMATCH' FROM m WHERE uniq AND l_partkey % 13 <> 0 AND l_partkey % 7 = 0
  UNION ALL SELECT l_orderkey, 'issue', 3, l_linenumber, 6, 'PUBLISHED_AT_MISMATCH' FROM m WHERE uniq AND l_discount > 0.08
  UNION ALL SELECT l_orderkey, 'notice', 3, l_linenumber, 7, 'URL_UNVERIFIABLE' FROM m WHERE uniq AND l_linenumber = 5
  UNION ALL SELECT l_orderkey, 'issue', 3, l_linenumber, 8, 'URL_MISMATCH' FROM m WHERE uniq AND l_linenumber <> 5 AND l_tax > 0.06
  UNION ALL SELECT l_orderkey, 'notice', 4, l_linenumber, 9, 'TABLE_ROW_WITHOUT_SCREENSHOT' FROM m WHERE NOT uniq
), g AS (
  SELECT d, coalesce(string_agg(CASE WHEN part = 'issue' THEN code END, ',' ORDER BY phase, line, seq), '') AS issue_codes, coalesce(string_agg(CASE WHEN part = 'notice' THEN code END, ',' ORDER BY phase, line, seq), '') AS notice_codes FROM f GROUP BY d
), c AS (SELECT l_orderkey, count_if(shot) AS shots, bool_and(uniq OR NOT shot) AS all_linked FROM m GROUP BY l_orderkey)
SELECT o_orderkey AS doc_id, coalesce(issue_codes, '') AS issue_codes, coalesce(notice_codes, '') AS notice_codes,
       CASE WHEN coalesce(issue_codes, '') <> '' THEN 'issues_found' WHEN coalesce(notice_codes, '') <> '' OR coalesce(shots, 0) = 0 OR NOT all_linked THEN 'needs_review' ELSE 'passed' END AS outcome,
       CASE WHEN coalesce(shots, 0) > 0 AND NOT all_linked THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence, (o_orderstatus = 'F')::INTEGER * 2 AS rights_fields
FROM orders LEFT JOIN g ON d = o_orderkey LEFT JOIN c ON l_orderkey = o_orderkey""")
def audit_orders(spark, sf_dir):
    """The whole audit of every order: rules, completeness, outcome."""
    done = audit(order_requests(spark, sf_dir))
    codes = lambda c: F.array_join(F.transform(c, lambda f: f["code"]), ",")
    return done.select("doc_id", codes("issues").alias("issue_codes"), codes("notices").alias("notice_codes"), "outcome", F.col("summary.confidence").alias("confidence"), F.col("summary.rightsFieldCount").alias("rights_fields"))


@query("""
WITH new AS (SELECT o_orderkey AS id, o_orderdate + INTERVAL 1 DAY AS created_at FROM orders WHERE o_orderkey % 97 = 0), old AS (SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderkey % 97 <> 0)
SELECT printf('%010d', id) AS id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at FROM (SELECT * FROM new UNION ALL SELECT * FROM old) ORDER BY created_at DESC, id DESC LIMIT 80""")
def upsert_newest(spark, sf_dir):
    """Changed orders replace the old ones; the newest 80 remain."""
    o = table(spark, sf_dir, "orders").select(F.format_string("%010d", "o_orderkey").alias("id"), "o_orderkey", "o_orderdate")
    at = lambda days: F.date_format(F.date_add("o_orderdate", days), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at")
    return history.upserted(o.select("id", at(0)), o.filter("o_orderkey % 97 = 0").select("id", at(1)), 80)


@query("""
WITH old AS (SELECT user_id AS id, max(event_id) AS generation, arg_max(event_type, event_id) AS status FROM events WHERE event_id % 3 <> 0 GROUP BY user_id), new AS (SELECT user_id AS id, max(event_id) AS generation, arg_max(event_type, event_id) AS status FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR o.id IS NOT NULL AND (o.status = 'error' OR o.generation > n.generation) THEN o.generation ELSE n.generation END AS generation,
       CASE WHEN n.id IS NULL OR o.id IS NOT NULL AND (o.status = 'error' OR o.generation > n.generation) THEN o.status ELSE n.status END AS status FROM old o FULL JOIN new n ON o.id = n.id""")
def merge_reads(spark, sf_dir):
    """J15, T-13, T-14: two sets of reads; the newer generation wins, a tombstone (an error) stays."""
    e = table(spark, sf_dir, "events")
    side = lambda df: df.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("generation"), F.max_by("event_type", "event_id").alias("status")).withColumns({"gone": F.col("status") == "error", "updated_at": F.lit(""), "report": store.null()})
    return history.merged(side(e.filter("event_id % 3 != 0")), side(e.filter("event_id % 3 = 0"))).select("id", "generation", "status")
