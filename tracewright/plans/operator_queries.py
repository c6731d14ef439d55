"""Queries of regions, contracts, verdicts, text functions and files: lines are regions, documents and events are answers. Each calls the operator and has a DuckDB twin."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.functions import misc, render, text, urls
from tracewright.operators import contracts, layout, report, rules, verdict
from tracewright.plans import pipeline
from tracewright.plans.queries import query, table
from tracewright.sources import files, gateway, legacy, pdf

_quoted = lambda items: ", ".join(f"'{x}'" for x in items)
_REGIONS = f"""WITH r AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS page_number, printf('r%06d%04d%d%02d', l_partkey, l_suppkey, l_linenumber, floor(l_quantity)::INTEGER) AS region_id, [{_quoted(schemas.REGION_TYPES)}][1 + l_suppkey % 4] AS type, floor(l_quantity)::INTEGER AS reading_order,
         (l_partkey % 5)::INTEGER AS rights_image_index, l_linenumber AS result_index FROM lineitem
), s AS (SELECT doc_id, min(region_id) AS shot FROM r WHERE type = 'rights_screenshot' GROUP BY doc_id),
g AS (SELECT r.*, CASE WHEN type = 'address_bar' THEN shot END AS parent_region_id FROM r LEFT JOIN s USING (doc_id))"""


def regions(spark, sf_dir) -> DataFrame:
    """Lines as regions of orders; the address bars of an order belong to its first screenshot."""
    kind = F.get(F.array(*[F.lit(t) for t in schemas.REGION_TYPES]), (F.col("l_suppkey") % 4).cast("int"))
    r = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), F.format_string("r%06d%04d%d%02d", "l_partkey", "l_suppkey", "l_linenumber", F.floor("l_quantity")).alias("region_id"), kind.alias("type"),
        F.floor("l_quantity").cast("int").alias("reading_order"), (F.col("l_partkey") % 5).cast("int").alias("rights_image_index"), F.col("l_linenumber").alias("result_index"),
    )
    shots = r.filter("type = 'rights_screenshot'").groupBy("doc_id").agg(F.min("region_id").alias("shot"))
    return r.join(shots, "doc_id", "left").withColumn("parent_region_id", F.when(F.col("type") == "address_bar", F.col("shot"))).drop("shot")


_ORDER = "page_number, reading_order, region_id"


@query(f"""{_REGIONS} SELECT doc_id, region_id, type, row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}) AS place FROM g""")
def region_order(spark, sf_dir):
    """An order's regions by page, reading order and id."""
    return layout.ordered_regions(regions(spark, sf_dir)).select("doc_id", "region_id", "type", "place")


@query(f"""{_REGIONS}, b AS (SELECT doc_id, parent_region_id AS region_id, region_id AS bar, row_number() OVER (PARTITION BY doc_id, parent_region_id ORDER BY {_ORDER}) AS n, count(*) OVER (PARTITION BY doc_id, parent_region_id) AS c FROM g WHERE type = 'address_bar' AND parent_region_id IS NOT NULL)
SELECT g.doc_id, g.region_id, coalesce(bar, '') AS address_bar_region_id, CASE WHEN c > 1 THEN '{layout.AMBIGUOUS_BAR[0]}' ELSE '' END AS code FROM g LEFT JOIN b ON b.doc_id = g.doc_id AND b.region_id = g.region_id AND n = 1 WHERE g.type = 'rights_screenshot'""")
def address_bars(spark, sf_dir):
    """Each screenshot's first address bar, and a failure where there are several."""
    shots, failures = layout.address_bars(regions(spark, sf_dir))
    told = failures.select("doc_id", F.col("failure.region_id").alias("region_id"), F.col("failure.code").alias("code"))
    return shots.join(told, ["doc_id", "region_id"], "left").select("doc_id", "region_id", F.coalesce("address_bar_region_id", F.lit("")).alias("address_bar_region_id"), F.coalesce("code", F.lit("")).alias("code"))


@query(f"""{_REGIONS}, asked AS (SELECT g.doc_id, g.region_id, min(b.region_id) AS bar FROM g LEFT JOIN g b ON b.doc_id = g.doc_id AND b.type = 'address_bar' WHERE g.type = 'rights_screenshot' GROUP BY ALL)
SELECT a.doc_id, a.region_id, b.region_id IS NOT NULL AND b.parent_region_id = a.region_id AS reviewed, CASE WHEN b.region_id IS NOT NULL AND b.parent_region_id = a.region_id THEN '' ELSE '{layout.MISSING_BAR[0]}' END AS code
FROM asked a LEFT JOIN g b ON b.doc_id = a.doc_id AND b.region_id = a.bar""")
def reviewable(spark, sf_dir):
    """Screenshots that name one of the order's address bars; it must be a bar and theirs."""
    r = regions(spark, sf_dir)
    first = r.filter("type = 'address_bar'").groupBy("doc_id").agg(F.min("region_id").alias("address_bar_region_id"))
    good, bad = layout.reviewable(r.filter("type = 'rights_screenshot'").join(first, "doc_id", "left"), r)
    one = good.select("doc_id", "region_id", F.lit(True).alias("reviewed"), F.lit("").alias("code"))
    return one.unionByName(bad.select("doc_id", F.col("failure.region_id").alias("region_id"), F.lit(False).alias("reviewed"), F.col("failure.code").alias("code")))


@query(f"""{_REGIONS}, known AS (SELECT doc_id, region_id, reading_order FROM g WHERE type <> 'summary_table')
SELECT g.doc_id, 'x' || g.region_id AS id, page_number, rights_image_index, result_index, coalesce(k.reading_order, 1) AS reading_order FROM g LEFT JOIN known k ON k.doc_id = g.doc_id AND k.region_id = g.region_id""")
def locators(spark, sf_dir):
    """What is sent of an item: ids, page, indices, and the reading order of its region, 1 where that isn't known."""
    r = regions(spark, sf_dir)
    items = r.withColumn("item", F.concat(F.lit("x"), F.col("region_id"))).drop("reading_order")
    return layout.locators(items, r.filter("type != 'summary_table'"), "item")


@query(f"""{_REGIONS}, c AS (SELECT *, page_number % 2 AS page, count(*) OVER (PARTITION BY doc_id, page_number % 2, type || rights_image_index) AS n, type || rights_image_index AS id FROM g),
p AS (SELECT DISTINCT ON (doc_id, page, id) doc_id, page, id, rights_image_index FROM c WHERE type = 'rights_screenshot')
SELECT c.doc_id, c.region_id, (c.page_number <> c.page)::INTEGER + (n > 1)::INTEGER + (type = 'address_bar' AND p.id IS NULL)::INTEGER + (type IN ('certificate', 'summary_table'))::INTEGER AS n_errors
FROM c LEFT JOIN p ON p.doc_id = c.doc_id AND p.page = c.page AND c.type = 'address_bar' AND p.id = 'rights_screenshot' || c.rights_image_index""")
def region_errors(spark, sf_dir):
    """Regions of a page against the rules of pages: its number, unique ids, address bars inside a screenshot of the page, indices by type."""
    name = lambda kind: F.concat(kind, F.col("rights_image_index").cast("string"))
    r = regions(spark, sf_dir).withColumns({"key": F.col("region_id"), "page": F.col("page_number") % 2, "region_id": name(F.col("type")), "parent_region_id": F.when(F.col("type") == "address_bar", name(F.lit("rights_screenshot")))})
    r = r.withColumn("result_index", F.when(F.col("type").isin("rights_screenshot", "address_bar"), F.lit(1)))
    return layout.region_errors(r).select("doc_id", F.col("key").alias("region_id"), F.size("errors").alias("n_errors"))


@query("""SELECT p_partkey, floor((p_size - 1) / 6)::INTEGER AS batch, floor(15 + (p_size - 1) / 50.0::DOUBLE * 10 + 0.5)::INTEGER AS locating, CASE WHEN p_size % 3 = 0 THEN 35 ELSE floor(27 + 1.0::DOUBLE / (p_size % 3) * 15 + 0.5)::INTEGER END AS recognizing, CASE WHEN p_size % 2 = 0 THEN 82 ELSE 82 END AS associating FROM part""")
def page_batches(spark, sf_dir):
    """The batch of a page, and the progress shown at stages with and without work."""
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", layout.page_batch(n).alias("batch"), layout.progress("locating", n - 1, F.lit(50)).alias("locating"), layout.progress("recognizing", F.lit(1), n % 3).alias("recognizing"), layout.progress("associating", F.lit(0), n % 2).alias("associating"))


_BOX = schemas.record(id=schemas.Number(least=0, whole=True), box=schemas.BOUNDS, warnings=schemas.BATCH_WARNINGS)


@query("""WITH b AS (SELECT vec_id, abs(embedding[1])::DOUBLE AS x, abs(embedding[2])::DOUBLE AS y, abs(embedding[3])::DOUBLE * 4 AS w, 0.5::DOUBLE AS h, vec_id % 7 = 0 AS strange, vec_id % 5 = 0 AS missing, vec_id % 11 = 0 AS broken FROM embeddings)
SELECT vec_id, CASE WHEN broken THEN 1 ELSE (missing)::INTEGER + (strange)::INTEGER + (w > 1 OR w <= 0)::INTEGER + (NOT strange AND NOT missing AND NOT (w > 1 OR w <= 0) AND (x + w > 1 OR y + h > 1))::INTEGER END > 0 AS rejected,
       CASE WHEN broken OR missing OR strange OR w > 1 OR w <= 0 OR x + w > 1 OR y + h > 1 THEN -1.0::DOUBLE ELSE w END AS width FROM b""")
def embedding_contract(spark, sf_dir):
    """JSON records with a box against a strict schema: unknown and missing keys, numbers out of range, boxes that leave the page."""
    at = lambda i: F.abs(F.get("embedding", F.lit(i))).cast("double")
    box = F.struct(at(0).alias("x"), at(1).alias("y"), (at(2) * 4).alias("width"), F.lit(0.5).alias("height"))
    odd = F.when(F.col("vec_id") % 7 == 0, F.lit(1)).alias("extra")
    warnings = F.when(F.col("vec_id") % 5 != 0, F.array(F.lit("w"))).alias("warnings")
    json = F.to_json(F.struct(F.col("vec_id").alias("id"), box.alias("box"), warnings, odd))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 11 == 0, F.left(json, F.lit(9))).otherwise(json).alias("json"))
    return contracts.validated(e, "json", _BOX).select("vec_id", (F.size("errors") > 0).alias("rejected"), F.coalesce("value.box.width", F.lit(-1.0)).alias("width"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS content, CASE WHEN event_id % 4 = 0 THEN -1 ELSE json_extract_string(props, '$.k')::INTEGER END AS k FROM events")
def model_envelope(spark, sf_dir):
    """The content that an answer wraps, and what is in it; nothing where an answer has no choices."""
    message = F.struct(F.struct(F.col("props").alias("content")).alias("message"))
    answer = F.when(F.col("event_id") % 4 == 0, F.lit('{"choices": []}')).otherwise(F.to_json(F.struct(F.array(message).alias("choices"), F.lit(1).alias("n"))))
    content = contracts.envelope(answer)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(content, F.lit("")).alias("content"), F.coalesce(F.get_json_object(content, "$.k").cast("int"), F.lit(-1)).alias("k"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 2 = 0 AS paper FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS regions, max(l_linenumber) AS last, count_if(paper AND l_partkey % 9 = 0) AS marked, count_if(NOT paper AND l_partkey % 9 = 0) AS bare FROM l GROUP BY l_orderkey)
SELECT l_orderkey AS doc_id, n = regions AND last <= 6 AND marked = 0 AND bare = 0 AS evidence_ok, n = regions AND last <= 6 AND l_orderkey % 3 <> 0 AS review_ok FROM g""")
def request_checks(spark, sf_dir):
    """Requests for evidence and for reviews of addresses: ids once, pages inside the document, what each type sets, two images for each pair."""
    paper, odd = F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 9 == 0
    index = F.when(paper != odd, F.lit(None)).otherwise(F.lit(1)).cast("int")  # a certificate has one where it mustn't, a screenshot none
    region = F.struct(F.col("l_linenumber").cast("string").alias("regionId"), F.when(paper, "certificate").otherwise("rights_screenshot").alias("type"), F.col("l_linenumber").alias("pageNumber"), index.alias("rightsImageIndex"), index.alias("resultIndex"), F.lit(None).cast("string").alias("addressBarRegionId"))
    pair = F.struct(F.col("l_linenumber").cast("string").alias("screenshotId"), F.col("l_linenumber").alias("pageNumber"))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(region).alias("r"), F.collect_list(pair).alias("p"))
    images = 2 * F.size("p") + (F.col("doc_id") % 3 == 0).cast("int")
    return g.select("doc_id", contracts.evidence_request_ok(F.col("r"), F.lit(6)).alias("evidence_ok"), contracts.review_request_ok(F.col("p"), F.lit(6), images).alias("review_ok"))


@query(f"""{_REGIONS} SELECT doc_id, region_id AS screenshot_id, page_number % 5 <> 0 AND rights_image_index <> 3 AS ok FROM g WHERE type = 'rights_screenshot'""")
def evidence_check(spark, sf_dir):
    """Answers beside what was asked: every field must agree; a page and an image index are told wrong by rule."""
    asked = regions(spark, sf_dir).filter("type = 'rights_screenshot'").withColumn("address_bar_region_id", F.lit(None).cast("string"))
    told = asked.withColumns({"page_number": F.when(F.col("page_number") % 5 == 0, 99).otherwise(F.col("page_number")), "rights_image_index": F.when(F.col("rights_image_index") == 3, F.lit(None)).otherwise(F.col("rights_image_index"))})
    return contracts.evidence_matches(asked, told).select("doc_id", "screenshot_id", "ok")


@query(f"""SELECT o_orderkey AS doc_id, o_orderkey % 4 <> 0 AS fallback, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END AS n_rows, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '{contracts.TABLE_FALLBACK_WARNING}' END AS warning FROM orders""")
def table_fallback(spark, sf_dir):
    """Table answers that are invalid, name a region nobody asked for or repeat a row id become empty tables with a warning."""
    k = F.col("o_orderkey") % 4
    obs = F.struct(F.lit("t").alias("rawText"), F.lit("recognized").alias("status"), F.lit(0.9).alias("confidence"), F.lit(1).alias("pageNumber"), F.lit("r1").alias("regionId"))
    row = lambda name, region: F.struct(name.alias("tableRowId"), F.lit(1).alias("pageNumber"), region.alias("regionId"), F.lit(1).alias("rightsImageIndex"), F.lit(1).alias("resultIndex"), obs.alias("platform"), obs.alias("publisher"), obs.alias("publishedAt"), F.array(F.lit("u")).alias("urlCellSegments"))
    rows = F.array(row(F.lit("a"), F.lit("r1")), row(F.when(k == 1, "a").otherwise("b"), F.when(k == 2, "r9").otherwise("r1")))
    none = F.array().cast("array<string>")
    value = F.when(k != 3, F.struct(F.array().cast("array<int>").alias("headers"), rows.alias("rows"), none.alias("warnings")))
    kind = schemas.TABLE_BATCH.spark().simpleString()
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("batch"), F.array(F.lit("r1")).alias("requested"), F.from_json(F.to_json(value), kind).alias("value"))
    out = contracts.table_or_fallback(b)
    return out.select("doc_id", "fallback", F.size("value.rows").alias("n_rows"), F.array_join("value.warnings", "|").alias("warning"))


def _label_requests(spark, sf_dir) -> DataFrame:
    """Documents as audited files: their label says what was found, their id how complete it is."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    k, none = F.col("doc_id"), F.array().cast("array<string>")
    types = {f.name: f.dataType for f in schemas.REQUEST.spark().fields}
    cast = lambda c, group, field: c.cast(types[group][field].dataType)
    obs = lambda t, ok=None, **more: F.struct(t.alias("rawText"), (F.lit("recognized") if ok is None else F.when(ok, "recognized").otherwise("partial")).alias("status"), F.lit(0.9).alias("confidence"), F.lit(1).alias("pageNumber"), F.lit("r").alias("regionId"), *[v.alias(n) for n, v in more.items()])
    region = F.struct(F.lit("c"), F.lit("certificate"), F.lit(1), F.struct(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1), F.lit(0.9))
    page = lambda n, some: F.struct(n, F.when(some, F.array(region)).otherwise(F.filter(F.array(region), lambda _: F.lit(False))), none, F.lit(0.95))
    pages = F.array(page(F.lit(1), F.col("quality").isNotNull()), page(F.when(k % 9 == 0, 1).otherwise(2), F.lit(False)))
    paper = lambda name, work, formal, at: F.struct(F.lit(at), F.lit(1), formal, obs(name), obs(work, k % 8 != 0))
    papers = F.array(paper(F.col("source"), F.lit("美术"), F.when(F.col("quality") == 1, "yes").otherwise("no"), "c"), paper(F.when(k % 5 == 0, F.lit("other")).otherwise(F.col("source")), F.lit("美术作品"), F.when(F.col("quality") == 1, "yes").otherwise("no"), "d"))
    shot = F.struct(F.lit("s"), F.lit("r"), F.lit(1), (k % 3 + 1).cast("int"), F.lit(1), obs(F.lit("微博")), obs(F.lit("weibo.com")), obs(F.lit("p")), obs(F.lit("2020-01-01"), None, kind=F.lit("published"), yearContextClear=F.lit(True)), obs(F.lit("u")), F.lit(None).cast("string"))
    review = F.struct(F.when(k % 10 == 0, "other").otherwise("s"), F.lit("u"), F.lit("u"), F.array(), F.array(), F.lit("u"), F.lit("recognized"), F.lit(0.9))
    row = F.struct(F.lit("t"), F.lit(1), F.lit("r"), F.lit(1), F.lit(1), obs(F.lit("x")), obs(F.lit("x")), obs(F.lit("x")), F.array(F.lit("u")))
    link = F.struct(F.lit("s"), F.lit("t"), F.when(k % 7 == 0, 0.4).otherwise(0.9), F.lit(""))
    header = F.struct(F.lit("h"), F.lit(1), obs(F.col("source")), obs(F.lit("美术作品")))
    request = F.struct(
        F.lit("d.pdf").alias("fileName"), F.lit(2).alias("pageCount"), F.struct(cast(pages, "layout", "pages"), none).alias("layout"),
        F.struct(cast(F.when(F.col("quality").isNotNull(), papers).otherwise(F.slice(papers, 1, 0)), "evidence", "certificates"), cast(F.array(shot), "evidence", "screenshots"), none).alias("evidence"),
        F.struct(cast(F.array(review), "urlReviews", "reviews"), none).alias("urlReviews"), F.struct(cast(F.array(header), "table", "headers"), cast(F.array(row), "table", "rows"), none).alias("table"),
        F.struct(cast(F.array(link), "associations", "associations"), none).alias("associations"), F.when(k % 13 == 0, F.array(F.lit(" w "), F.lit("w"), F.lit(""))).otherwise(none).alias("warnings"), F.array().cast(types["stageFailures"]).alias("stageFailures"),
    )
    return d.select("doc_id", "toxic", request.cast(schemas.REQUEST.spark()).alias("request"))


@query(f"""WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), d AS (SELECT d.doc_id, quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN l USING (doc_id)),
f AS (SELECT *, doc_id % 9 <> 0 AS covered, CASE WHEN quality = 1 THEN 'provided' WHEN doc_id % 9 = 0 THEN 'uncertain' ELSE 'not_provided' END AS presence, (CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN quality = 1 AND doc_id % 5 = 0 THEN 1 ELSE 0 END) AS n_warnings,
            CASE WHEN doc_id % 7 = 0 THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM d),
c AS (SELECT *, covered AND n_warnings = 0 AND confidence >= {schemas.COMPLETE_CONFIDENCE} AND doc_id % 10 <> 0 AND (presence = 'not_provided' OR presence = 'provided' AND doc_id % 8 <> 0) AS complete FROM f)
SELECT doc_id, presence, covered, n_warnings, confidence, complete, CASE WHEN toxic = 1 THEN 'issues_found' WHEN NOT complete THEN 'needs_review' ELSE 'passed' END AS outcome,
       CASE WHEN presence = 'provided' THEN 1 + (doc_id % 8 <> 0)::INTEGER ELSE 0 END AS rights_fields, 1 AS groups, 1 AS rows FROM c""")
def verdict_ladder(spark, sf_dir):
    """Coverage, presence, conflicts, confidence, completeness and outcome of documents."""
    facts = verdict.document_facts(_label_requests(spark, sf_dir))
    finding = F.filter(F.array(F.struct(F.lit("TOXIC").alias("code"))), lambda _: F.coalesce(F.col("toxic") == 1, F.lit(False)))
    done = verdict.verdicts(facts.withColumns({"issues": finding, "notices": F.filter(finding, lambda _: F.lit(False)), "all_linked": F.lit(True)}))
    s = F.col("summary")
    return done.select("doc_id", "presence", "covered", F.size("warnings").alias("n_warnings"), "confidence", "complete", "outcome", s["rightsFieldCount"].alias("rights_fields"), s["groupCount"].alias("groups"), s["tableRowCount"].alias("rows"))


@query("""WITH u AS (SELECT user_id, count(DISTINCT (event_type, CASE floor(value)::INTEGER % 4 WHEN 0 THEN '美术作品' WHEN 1 THEN '美术作品' WHEN 2 THEN '音乐' ELSE '文字' END)) AS n FROM events GROUP BY user_id)
SELECT user_id, n > 1 AS conflict FROM u""")
def conflict_groups(spark, sf_dir):
    """A4, A5: whether a user's owners and kinds of work differ, once names that mean the same are one."""
    work = F.get(F.array(F.lit("美术"), F.lit("美术作品"), F.lit("音乐"), F.lit("文字")), (F.floor("value") % 4).cast("int"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("o"), work.alias("w"))).alias("x"))
    return e.select("user_id", verdict.differing(F.transform("x", lambda p: p["o"]), F.transform("x", lambda p: p["w"])).alias("conflict"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') AS host, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') || '/a' AS joined FROM pages""")
def host_names(spark, sf_dir):
    """the host name of an address, and an address from the segments of a cell."""
    host = urls.url_host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), urls.joined_segments(F.array(F.concat(F.lit(" "), host), F.lit("/ａ "))).alias("joined"))


#: Labels as they may be typed, and as browsers write them; empty where they reject the name.
_TYPED = {
    "stra\u00dfe": "xn--strae-oqa", "\u03b2\u03cc\u03bb\u03bf\u03c2": "xn--nxasmm1c", "\uff25\uff58ample": "example", "MA\u00d1ANA": "xn--maana-pta", "e\u0301clair": "xn--clair-9ra", "\u2603": "xn--n3h", "FA\u1e9e": "xn--fa-hia",
    "\u0646\u0627\u0645\u0647\u200c\u0627\u06cc": "xn--mgba3gch31f060k", "\u0915\u094d\u200d\u0937": "xn--11b2ezcw70k", "XN--Bcher-KVA": "xn--bcher-kva", "a\u200db": "", "xn--a": "",
}


@query(f"""WITH t AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}', '{a}')" for i, (t, a) in enumerate(_TYPED.items()))}) t(label, typed, written)),
p AS (SELECT page_id, label, written, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, typed FROM pages, t),
w AS (SELECT *, regexp_replace(lower(replace(host, 'example', CASE WHEN written = '' THEN typed ELSE written END)), '^www\\.', '') AS name FROM p)
SELECT page_id, label, name AS host, CASE WHEN written = '' THEN '' ELSE name || path END AS canonical_url FROM w""")
def unicode_hosts(spark, sf_dir):
    """the pages' addresses with a label of their hosts in other scripts and forms, as browsers write them."""
    typed = F.posexplode(F.array(*[F.lit(t) for t in _TYPED])).alias("label", "typed")
    p = table(spark, sf_dir, "pages").select("page_id", "url", typed)
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    address = F.concat(F.regexp_extract("url", "^(https?://)", 1), F.replace(host, F.lit("example"), F.col("typed")), F.regexp_extract("url", "^https?://[^/?#]*(.*)$", 1))
    return p.select("page_id", "label", urls.url_host(address).alias("host"), urls.canonical_url(address).alias("canonical_url"))


_HOSTS = ["weibo.com", "m.weibo.com", "notweibo.com", "a.xiaohongshu.com", "www.douyin.com", "weibo.com.example.org"]


@query(f"""WITH p AS (SELECT event_id, [{_quoted(_HOSTS)}][1 + event_id % 6] AS host, CASE event_type WHEN 'click' THEN '微博' WHEN 'view' THEN '抖音' ELSE '' END AS seen FROM events),
t AS (SELECT *, CASE WHEN event_id % 6 IN (0, 1) THEN '微博' WHEN event_id % 6 = 3 THEN '小红书' ELSE '' END AS told FROM p)
SELECT event_id, told AS platform, CASE WHEN told <> '' THEN told ELSE seen END AS picked, told <> '' AND seen <> '' AND told <> seen AS conflict FROM t""")
def host_platforms(spark, sf_dir):
    """The platform of a host or of a domain above it; it wins over the one that is seen, and a difference is a conflict."""
    seen = text.platform(F.when(F.col("event_type") == "click", "WeiBo").when(F.col("event_type") == "view", "抖音").otherwise(""))
    told = urls.platform_of_host(F.get(F.array(*[F.lit(h) for h in _HOSTS]), (F.col("event_id") % 6).cast("int")))
    picked = rules.resolved_platform(seen, told)
    return table(spark, sf_dir, "events").select("event_id", told.alias("platform"), picked["value"].alias("picked"), picked["conflict"].alias("conflict"))


_SHOWN = "CASE event_type WHEN 'error' THEN '未识别' WHEN 'view' THEN '未完整识别' WHEN 'click' THEN 'T' || event_id ELSE '未识别' END"


@query(f"""SELECT event_id, {_SHOWN} AS shown, coalesce(CASE WHEN event_type = 'click' THEN 'T' || event_id END, '') AS recognized, 'day ' || user_id AS unlabelled FROM events""")
def shown_texts(spark, sf_dir):
    """Observations as a report shows them; a time without its label."""
    status = F.when(F.col("event_type") == "click", "recognized").when(F.col("event_type") == "view", "partial").when(F.col("event_type") == "purchase", "recognized").otherwise("unrecognized")
    raw = F.when(F.col("event_type") == "purchase", " \u3000 ").otherwise(F.concat(F.lit("\ufeffＴ"), F.col("event_id").cast("string"), F.lit("\u00a0")))
    obs, norm = F.struct(status.alias("status")), text.norm(raw)
    label = F.get(F.array(F.lit("编辑于 "), F.lit("发布于"), F.lit("发表于\u3000"), F.lit("")), (F.col("event_id") % 4).cast("int"))
    e = table(spark, sf_dir, "events").withColumns({"n": norm, "o": obs})
    return e.select("event_id", text.display(F.col("o"), F.col("n")).alias("shown"), F.coalesce(text.recognized(F.col("o"), F.col("n")), F.lit("")).alias("recognized"), text.without_published_label(F.concat(label, F.lit("day "), F.col("user_id").cast("string"))).alias("unlabelled"))


_CAPTION = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in misc.STATUS_CAPTIONS.items())


@query(f"""WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'a/b\\' || o_orderkey || '.pdf ' WHEN 1 THEN repeat('x', 256) WHEN 2 THEN 'dir/' WHEN 3 THEN 'c' || chr(9) || 'd' ELSE o_clerkless END AS given FROM (SELECT *, 'o' || o_orderkey AS o_clerkless FROM orders))
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey || '.pdf' WHEN 4 THEN given ELSE '' END AS name, CASE [{_quoted(schemas.TASK_STATUSES)}][1 + o_orderkey % 10] {_CAPTION} END AS caption,
       CASE WHEN o_orderkey % 5 = 4 THEN 'needs_review' ELSE 'issues_found' END AS outcome, CASE WHEN o_orderkey % 3 = 0 THEN '{misc.LEGACY_NOTICE}' WHEN o_orderkey % 3 = 1 THEN '{misc.LEGACY_NOTICE}' || chr(10) || chr(10) || 'r' ELSE '{misc.LEGACY_NOTICE}x' END AS report,
       CASE WHEN o_orderkey % 1000 < 500 THEN (o_orderkey % 1000) || ' B' ELSE ((o_orderkey % 1000) // 100) || '.0 KB' END AS size FROM n""")
def names_and_captions(spark, sf_dir):
    """safe file names, captions of states, old reports marked, sizes."""
    k = F.col("o_orderkey")
    given = F.when(k % 5 == 0, F.concat(F.lit("a/b\\"), k.cast("string"), F.lit(".pdf "))).when(k % 5 == 1, F.repeat(F.lit("x"), 256)).when(k % 5 == 2, "dir/").when(k % 5 == 3, "c\td").otherwise(F.concat(F.lit("o"), k.cast("string")))
    status = F.get(F.array(*[F.lit(s) for s in schemas.TASK_STATUSES]), (k % 10).cast("int"))
    issues = F.filter(F.array(k), lambda _: k % 5 != 4)
    old = F.when(k % 3 == 0, "").when(k % 3 == 1, "r").otherwise(misc.LEGACY_NOTICE + "x")
    size = F.when(k % 1000 < 500, k % 1000).otherwise(F.floor((k % 1000) / 100) * 1024)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(misc.safe_file_name(given), F.lit("")).alias("name"), misc.caption(status, misc.STATUS_CAPTIONS).alias("caption"), misc.legacy_outcome(issues).alias("outcome"), misc.legacy_report(old).alias("report"), misc.format_bytes(size).alias("size"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Customer ' || c_custkey WHEN 1 THEN '' WHEN 2 THEN 'a+b' ELSE '' END AS name, 'legacy-' || sha256(c_name || chr(0) || c_custkey::VARCHAR) AS id FROM customer""")
def decoded_names(spark, sf_dir):
    """Percent-encoded names: only those that encode again to the same text; hashed old ids."""
    k = F.col("c_custkey")
    header = F.when(k % 4 == 0, F.concat(F.lit("Customer%20"), k.cast("string"))).when(k % 4 == 1, "a%2fb").when(k % 4 == 2, "a%2Bb").otherwise("a,b")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(misc.decoded_name(header), F.lit("")).alias("name"), misc.legacy_id(F.col("c_name"), k.cast("string")).alias("id"))


@query("""WITH g AS (SELECT p_partkey, p_size, least(255, greatest(0, floor((floor(p_size * 0.299::DOUBLE + p_size * 2 * 0.587::DOUBLE + 100 * 0.114::DOUBLE + 0.0) * 0 + (p_size * 0.299::DOUBLE + p_size * 2 * 0.587::DOUBLE + 100 * 0.114::DOUBLE) - 128) * 1.35::DOUBLE + 128 + 0.5)))::INTEGER AS gray FROM part)
SELECT p_partkey, upper(printf('%02x%02x%02x%02x', gray, gray, gray, 7)) AS pixels, 'data:image/png;base64,' || base64(('p' || p_size)::BLOB) AS url, p_size % 3 = 0 AS jpeg_ok, p_size % 5 <> 0 AS pdf_ok, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'PDF 文件为空。' WHEN p_size % 4 = 2 THEN '仅支持 PDF 文件。' ELSE 'PDF 文件超过 20 MiB 限制。' END AS problem FROM g""")
def file_contents(spark, sf_dir):
    """Gray pixels, data addresses, and files judged by their first bytes, size and name."""
    n = F.col("p_size")
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    pixel = F.concat(byte(n), byte(n * 2), byte(F.lit(100)), byte(F.lit(7)))
    image = F.when(n % 3 == 0, F.unhex(F.lit(files.JPEG + "00"))).otherwise(F.unhex(F.lit(files.PNG)))
    body = F.when(n % 5 == 0, F.lit("PDF-").cast("binary")).otherwise(F.unhex(F.lit(files.PDF)))
    problem = files.pdf_problem(F.when(n % 4 == 2, "a.txt").otherwise("a.PDF"), F.when(n % 4 == 1, 0).when(n % 4 == 3, schemas.MAX_PDF_BYTES + 1).otherwise(9), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(render.grayscale(pixel)).alias("pixels"), render.data_url(F.lit("image/png"), F.concat(F.lit("p"), n.cast("string")).cast("binary")).alias("url"), files.image_ok(image, F.lit("image/jpeg")).alias("jpeg_ok"), files.pdf_bytes_ok(body, F.octet_length(body)).alias("pdf_ok"), F.coalesce(problem, F.lit("")).alias("problem"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS inside, o_orderkey % 2 = 0 AS stored FROM orders""")
def stored_paths(spark, sf_dir):
    """Paths below the private folder, and names as stored uploads have them."""
    k = F.col("o_orderkey")
    name = F.concat(F.format_string("%08x", k), F.lit("-0000-4000-"), F.when(k % 2 == 0, "8").otherwise("7"), F.lit("000-000000000000.pdf"))
    path = F.when(k % 3 == 0, F.concat(F.lit("file:///data/up/"), name)).when(k % 3 == 1, F.concat(F.lit("/data/up/../"), name)).otherwise(F.concat(F.lit("/data/upper/"), name))
    return table(spark, sf_dir, "orders").select("o_orderkey", files.inside(path, "/data/up").alias("inside"), files.stored_name(path).alias("stored"))


@query("""WITH c AS (SELECT batch, count(*) AS n, bool_and(s % 2 = 0) AS fine FROM (SELECT ps AS s, p_partkey // 9 AS batch, p_partkey FROM (SELECT p_size AS ps, p_partkey FROM part)) GROUP BY batch)
SELECT batch, n, fine AND n <= 8 AS ok FROM c""")
def image_batches(spark, sf_dir):
    """Uploads of several images: at most eight, all named, all of their type."""
    image = F.when(F.col("p_size") % 2 == 0, F.unhex(F.lit(files.PNG))).otherwise(F.lit("no").cast("binary"))
    i = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 9).alias("batch"), F.col("p_partkey").cast("string").alias("name"), F.lit("image/png").alias("type"), image.alias("content"))
    return files.image_batches(i.groupBy("batch").agg(F.collect_list("name").alias("names")), i).select("batch", "n", "ok")


def _old_task(k: Column) -> Column:
    """A customer as a record of an old browser history; some can't be tasks."""
    status = F.when(k % 5 == 0, "running").otherwise("failed")
    at = F.lit("2024-01-02T03:04:05Z")
    return F.struct(
        F.concat(F.lit("t"), k.cast("string")).alias("id"), F.concat(F.lit("C:\\x\\"), k.cast("string"), F.lit(".pdf")).alias("fileName"), F.when(k % 7 != 0, k * 10).alias("fileSize"), F.lit("application/pdf").alias("fileType"),
        status.alias("status"), F.lit(0).alias("processedPages"), F.lit(1).alias("totalPages"), F.when(k % 3 == 0, "yesterday").otherwise(at).alias("createdAt"), at.alias("completedAt"), F.lit("boom").alias("errorMessage"),
    )


@query("""WITH c AS (SELECT *, c_custkey // 100 AS g FROM customer), ok AS (SELECT g, c_custkey AS k, row_number() OVER (PARTITION BY g ORDER BY c_custkey) - 1 AS ord FROM c WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 <> 0)
SELECT 'o' || g AS owner_email, 't' || k AS id, k || '.pdf' AS file_name, k * 10 AS file_size, 'failed' AS status, 'INTERNAL_ERROR' AS error_code, ord::INTEGER AS ord FROM ok WHERE ord < 80""")
def legacy_history(spark, sf_dir):
    """Old histories as tasks to import; running ones, ones without a size and ones with a wrong time are left out, and failures lose their text."""
    c = table(spark, sf_dir, "customer").withColumn("g", F.floor(F.col("c_custkey") / 100))
    histories = c.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("c_custkey", _old_task(F.col("c_custkey")).alias("t")))).alias("l"))
    histories = histories.select(F.concat(F.lit("o"), F.col("g").cast("string")).alias("owner_email"), F.to_json(F.transform("l", lambda x: x["t"])).alias("text"))
    return legacy.legacy_tasks(histories).select("owner_email", "id", "file_name", "file_size", "status", "error_code", "ord")


@query("""WITH g AS (SELECT l_orderkey, l_linenumber % 3 AS image, l_linenumber AS result, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT l_orderkey, string_agg(CASE WHEN n = 1 THEN '【权利图-' || image || '】' || chr(10) ELSE '' END || 'line ' || l_partkey, chr(10) ORDER BY image, result, l_partkey, l_suppkey) AS blocks FROM g GROUP BY l_orderkey""")
def report_blocks(spark, sf_dir):
    """An order's results under the heading of their picture, by picture and result."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct((F.col("l_linenumber") % 3).alias("rights_image_index"), F.col("l_linenumber").alias("result_index"), F.struct("l_partkey", "l_suppkey").alias("ord"), F.array(F.concat(F.lit("line "), F.col("l_partkey").cast("string"))).alias("lines")).alias("x"))
    return x.groupBy("l_orderkey").agg(F.array_join(report.blocks(F.collect_list("x")), "\n").alias("blocks"))


@query("""SELECT p_partkey, CASE WHEN p_size % 6 IN (0, 1) THEN 0 ELSE 2 END AS page_count, CASE WHEN p_size % 6 IN (0, 1) THEN 0.0::DOUBLE ELSE (100 + p_size)::DOUBLE END AS first_width, CASE WHEN p_size % 6 IN (0, 1) THEN 0.0::DOUBLE ELSE 20.5::DOUBLE END AS last_height,
  CASE WHEN p_size % 6 = 0 THEN 'PDF_INVALID' WHEN p_size % 6 = 1 THEN 'PDF_ENCRYPTED' ELSE '' END AS problem FROM part""")
def pdf_sizes(spark, sf_dir):
    """Page counts and sizes of PDFs written by rule; a box can be inherited from the page tree."""
    n = F.col("p_size")
    head = F.when(n % 6 == 0, "%PDX-1.4\n").otherwise("%PDF-1.4\n")
    pages = F.format_string("1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 %d 50] >> endobj\n", 100 + n)
    own = F.lit("3 0 obj << /Type /Page /Parent 2 0 R >> endobj\n4 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 -10 30 10.5] >> endobj\n")
    locked = F.when(n % 6 == 1, "trailer << /Encrypt 9 0 R >>").otherwise("")
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(head, pages, own, locked).cast("binary").alias("content"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pdf.opened(made).select(F.col("path").cast("long").alias("p_partkey"), "page_count", zero(F.get("sizes", F.lit(0))["width"]).alias("first_width"), zero(F.get("sizes", F.lit(1))["height"]).alias("last_height"), F.coalesce("problem", F.lit("")).alias("problem"))


def _answer(stage: str, request: str, correction: str | None) -> str:
    """A model: what it says depends on the number asked, and on whether it was told to correct itself."""
    asked = int(request) % 6
    if asked == 0:
        raise gateway.ModelError(503)
    if asked == 1:
        raise gateway.ModelError(400)
    good = json.dumps({"headers": [], "rows": [], "warnings": [f"about {request}"]})
    said = "not json" if asked == 2 or asked == 3 and correction is None else '{"rows": []}' if asked == 4 else good
    return json.dumps({"choices": [{"message": {"content": said}}]})


@query("""SELECT c_custkey::VARCHAR AS doc_id, CASE WHEN c_custkey % 6 IN (0, 1) THEN 'MODEL_UNAVAILABLE' WHEN c_custkey % 6 IN (2, 4) THEN 'INVALID_MODEL_OUTPUT' ELSE '' END AS error, CASE WHEN c_custkey % 6 IN (3, 5) THEN 'about ' || c_custkey ELSE '' END AS said FROM customer""")
def model_answers(spark, sf_dir):
    """Answers of a model behind a provider, with a second attempt and a correction; no second one after a refusal."""
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(0).alias("batch"), F.lit(0).alias("part"), F.col("c_custkey").cast("string").alias("request"))
    got = gateway.CallProvider(_answer).answers("table", requests)
    return got.select("doc_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.get_json_object("output", "$.warnings[0]"), F.lit("")).alias("said"))


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}.parquet' AS name, true AS some, true AS small" for t in _TABLES))
def folder_files(spark, sf_dir):
    """The files of a folder, as a listing gives them; contents aren't read."""
    name = F.regexp_extract("path", "([^/]+\\.parquet)(?:/[^/]*)?$", 1)
    f = files.listing(spark, sf_dir).select(name.alias("name"), (F.col("length") > 0).alias("some"), (F.col("length") < 1 << 30).alias("small"), F.col("modified").isNotNull().alias("dated"))
    return f.filter("dated").groupBy("name").agg(F.bool_or("some").alias("some"), F.bool_and("small").alias("small"))


def _finished(k: Column) -> Column:
    """A customer as a finished record of an old history; counts, pages and lists of some don't agree."""
    finding = F.struct(F.lit("X").alias("code"), F.lit("RESULT").alias("scope"), F.lit(1).alias("rightsImageIndex"), F.lit(2).alias("resultIndex"), F.lit("url").alias("field"), F.concat(F.lit("m"), k.cast("string")).alias("message"))
    some = F.when(k % 2 == 0, F.array(finding)).otherwise(F.filter(F.array(finding), lambda _: F.lit(False)))
    none = F.filter(F.array(finding), lambda _: F.lit(False))
    report_of = F.struct(none.alias("certificateIssues"), some.alias("resultIssues"), F.when(k % 7 == 0, none).otherwise(some).alias("issues"), none.alias("verificationNotices"))
    summary = F.struct(
        F.lit("m").alias("parserMode"), F.when(k % 5 == 0, 3).otherwise(2).alias("pageCount"), F.lit(2).alias("rightsFieldCount"), F.lit(1).alias("groupCount"), F.lit(1).alias("tableRowCount"), F.lit(1).alias("screenshotHeadingCount"),
        F.when(k % 11 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.lit(0.9).alias("confidence"), F.lit(True).alias("extractionComplete"),
    )
    at = F.lit("2024-01-02T03:04:05Z")
    return F.struct(
        F.concat(F.lit("t"), k.cast("string")).alias("id"), F.lit("f.pdf").alias("fileName"), (k * 10).alias("fileSize"), F.lit("application/pdf").alias("fileType"), F.lit("completed").alias("status"), F.lit(2).alias("processedPages"), F.lit(2).alias("totalPages"),
        at.alias("createdAt"), at.alias("completedAt"), F.lit(100).alias("progress"), F.lit(schemas.MODEL).alias("model"), F.when(k % 3 == 0, 9).otherwise(F.size(report_of["issues"])).alias("issueCount"), summary.alias("summary"), F.lit("text").alias("reportText"), report_of.alias("report"),
    )


@query(f"""SELECT 'o' || c_custkey AS owner_email, 't' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'issues_found' ELSE 'needs_review' END AS outcome, ((c_custkey + 1) % 2)::INTEGER AS issue_count, '{misc.LEGACY_NOTICE}' || chr(10) || chr(10) || 'text' AS report_text
FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 11 <> 0 AND (c_custkey % 7 <> 0 OR c_custkey % 2 = 1)""")
def legacy_finished(spark, sf_dir):
    """Finished records of old histories: counts, pages, lists and completeness must agree; the outcome follows from the issues."""
    h = table(spark, sf_dir, "customer").select(F.concat(F.lit("o"), F.col("c_custkey").cast("string")).alias("owner_email"), F.to_json(F.array(_finished(F.col("c_custkey"))), {"ignoreNullFields": "false"}).alias("text"))
    return legacy.legacy_tasks(h).select("owner_email", "id", "outcome", "issue_count", "report_text")


_PAGES = "WITH d AS (SELECT c_custkey::VARCHAR AS doc_id, c_nationkey AS pages, c_custkey % 4 AS kind FROM customer)"


@query(f"""{_PAGES}, ok AS (SELECT * FROM d WHERE pages BETWEEN 1 AND 80 AND kind NOT IN (1, 2)), p AS (SELECT doc_id, unnest(range(1, pages + 1))::INTEGER AS page_number FROM ok)
SELECT doc_id, page_number, (page_number - 1) // 6 AS batch, (page_number - 1) % 6 AS part, '' AS code FROM p UNION ALL SELECT doc_id, -1, -1, -1, 'PDF_INVALID' FROM d WHERE NOT (pages BETWEEN 1 AND 80 AND kind NOT IN (1, 2))""")
def planned_batches(spark, sf_dir):
    """Documents that are admitted, and the batches and parts of their pages; pictures of 13 MiB go alone."""
    k = F.col("c_custkey") % 4
    d = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("doc_id"), F.when(k == 1, "a.png").otherwise("a.pdf").alias("file_name"), F.when(k == 2, 0).otherwise(10).cast("long").alias("file_size"), F.lit(None).cast("string").alias("file_type"), F.col("c_nationkey").alias("page_count"),
    )
    good, bad = pipeline.admitted(d)
    pages = good.withColumn("page_number", F.explode(F.sequence(F.lit(1), F.col("page_count")))).withColumn("item", F.col("page_number").cast("string"))
    measured = pages.select("doc_id", F.lit("page").alias("kind"), "item", F.lit(13 << 20).cast("long").alias("bytes"))
    placed, _ = pipeline.cut(pages, gateway.ReplayProvider(measured, measured), "page", schemas.MAX_BATCH_ITEMS, [F.col("page_number")])
    none = F.lit(-1)
    return placed.select("doc_id", "page_number", "batch", "part", F.lit("").alias("code")).unionByName(bad.select("doc_id", none.alias("page_number"), none.alias("batch"), none.alias("part"), "code"))
