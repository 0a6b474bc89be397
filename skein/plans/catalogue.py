"""The registered queries and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import scoring, text, vectors
from skein.operators import aggregate, cache, dedup, feeds, filters, formats, fulltext, nearest, state
from skein.plans.tables import calls, entries, feed_items, items, table, with_copies
from skein.sources import feeds as feed_sources
from skein.sources import pages as page_sources
from skein.sources import registry

QUERY = "the er then the"
TOKENS = scoring.words(QUERY)
NOW = 1_706_000_000
KEYWORDS = [("the", 5.0, False), ("er", 3.0, False), ("ation", 2.0, False)]
REQUIRED = [("the", 5.0, True), ("er", 3.0, False)]
COL = F.col

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(c) -> F.col:
    return F.round(c, 6)


# ---- SQL of what several queries share -------------------------------------
SP = r"[\s\x0B\x85\p{Z}]+"
ITEMS = "items AS (SELECT doc_id, source AS engine_name, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS engine_ord, doc_id AS pos, split_part(text, chr(10), 1) AS title, 'https://' || source || '.example/' || doc_id AS url, text AS content, 1.0::DOUBLE AS score FROM documents)"
COPIES = f"{ITEMS}, copies AS (SELECT * FROM items UNION ALL SELECT doc_id, engine_name, engine_ord + 100, pos, title, ' ' || upper(url), content, score FROM items WHERE doc_id % 7 = 0)"
CALLS = "calls AS (SELECT CAST(user_id AS VARCHAR) AS engine, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'zero' ELSE 'success' END AS outcome, CAST(floor(value * 100) AS BIGINT) AS response_ms FROM events)"
FEED = "feed AS (SELECT CAST(conv_id AS VARCHAR) AS feed_url, CAST(turn AS BIGINT) AS pos, role AS title, 'https://feed.example/' || array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS link, text AS description, conv_id || '-' || turn AS guid FROM conversations)"
ENTRIES = f"{ITEMS}, entries AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS key, CAST(0 AS BIGINT) AS pos, doc_id, title, url, content, score, doc_id * 37 + 1000 AS expires_at, doc_id * 37 AS created_at FROM items)"


def toks(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"


def clean(x: str, most: int) -> str:
    t = rf"trim(regexp_replace({x}, '{SP}', ' ', 'g'))"
    # Entities of the test texts; the ampersand last, so that nothing is decoded twice.
    for e, c in (("&eacute;", "é"), ("&#8217;", "’"), ("&#x4E2D;", "中"), ("&lt;", "<"), ("&nbsp;", chr(160)), ("&amp;", "&")):
        t = f"replace({t}, '{e}', '{c}')"
    return f"CASE WHEN octet_length(encode({t})) > {most} THEN substr({t}, 1, {most - 3}) || '...' ELSE {t} END"


def bm25(tokens: str, mean: str) -> str:
    one = lambda t: f"(len(list_filter({tokens}, lambda x: x = '{t}')) * 2.5::DOUBLE / (len(list_filter({tokens}, lambda x: x = '{t}')) + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len({tokens}) / {mean}))))"
    return f"CASE WHEN len({tokens}) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ({' + '.join(map(one, TOKENS))}) / ({len(TOKENS)} * 2.5::DOUBLE)) END"


def exact(x: str) -> str:
    return f"CASE WHEN lower({x}) = '{QUERY}' THEN 1.0::DOUBLE WHEN starts_with(lower({x}), '{QUERY}') THEN 0.8::DOUBLE WHEN contains(lower({x}), '{QUERY}') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"


URL_SQL = "((" + " + ".join(f"CAST(contains(lower(url), '{t}') AS INTEGER)" for t in TOKENS) + f") / {len(TOKENS)}::DOUBLE)"
SCORED = f"""WITH {COPIES}, std AS (
  SELECT doc_id, engine_ord, pos, {clean('title', 200)} AS title, {clean('content', 500)} AS content, CASE WHEN trim(url) = '' THEN '#' ELSE url END AS url FROM copies
), ded AS (
  SELECT * FROM std QUALIFY row_number() OVER (PARTITION BY trim(lower(url)) ORDER BY engine_ord, pos) = 1
), tok AS (
  SELECT *, row_number() OVER (ORDER BY engine_ord, pos) - 1 AS position, {toks('title')} AS t, {toks('content')} AS c FROM ded
), m AS (SELECT *, avg(len(t)) OVER () AS tm, avg(len(c)) OVER () AS cm FROM tok),
scored AS (
  SELECT doc_id, url, position, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    0.4::DOUBLE * least(1.0::DOUBLE, 0.7::DOUBLE * ({bm25('t', 'tm')}) + 0.3::DOUBLE * ({exact('title')}))
    + 0.3::DOUBLE * least(1.0::DOUBLE, 0.8::DOUBLE * ({bm25('c', 'cm')}) + 0.2::DOUBLE * ({exact('content')}))
    + 0.1::DOUBLE * {URL_SQL} + 0.15::DOUBLE * 0.7::DOUBLE + 0.05::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + ln(position + 1.0::DOUBLE))))) AS score FROM m
)"""


# ---- projections and scalar functions --------------------------------------
@query(f"SELECT doc_id, CAST(len({toks('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({toks('text')})) AS BIGINT) AS n_distinct FROM documents")
def tokenize_counts(spark, d):
    t = text.tokenize(COL("text"))
    return table(spark, d, "documents").withColumn("t", t).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({toks('text')}) AS token FROM documents) GROUP BY token")
def term_frequency(spark, d):
    # A document's tokens are counted in its row, so that a row a distinct token is made; one shuffle, of sums by token.
    t = table(spark, d, "documents").select(F.explode(text.term_counts(text.tokenize(COL("text")))).alias("x"))
    return t.groupBy(COL("x.term").alias("token")).agg(F.sum("x.n").alias("n"), F.count("*").alias("docs"))


@query(rf"SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(lower(text), '{SP}'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: octet_length(encode(w)) > 1)) AS BIGINT) AS n_terms FROM documents")
def vector_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.terms(COL("text"))).cast("bigint").alias("n_terms"))


@query(f"WITH t AS (SELECT doc_id, {toks('text')} AS c FROM documents), m AS (SELECT *, avg(len(c)) OVER () AS cm FROM t) SELECT doc_id, round({bm25('c', 'cm')}, 6) AS score FROM m")
def bm25_content(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.tokenize(COL("text")).alias("t"))
    mean = t.agg(F.avg(F.size("t")).alias("m"))
    return t.join(F.broadcast(mean)).select("doc_id", r6(scoring.bm25(COL("t"), TOKENS, COL("m"))).alias("score"))


@query(f"WITH {ITEMS} SELECT doc_id, {exact('title')} AS title_bonus, {exact('content')} AS content_bonus FROM items")
def exact_match_bonus(spark, d):
    return items(spark, d).select("doc_id", scoring.exact_match(COL("title"), QUERY).alias("title_bonus"), scoring.exact_match(COL("content"), QUERY).alias("content_bonus"))


@query(f"SELECT page_id, round({URL_SQL}, 6) AS relevance FROM pages")
def url_relevance(spark, d):
    return table(spark, d, "pages").select("page_id", r6(scoring.url_relevance(COL("url"), TOKENS)).alias("relevance"))


@query("SELECT doc_id, round(1.0::DOUBLE / (1.0::DOUBLE + ln(doc_id + 1.0::DOUBLE)), 6) AS score FROM documents")
def position_score(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(scoring.position_score(COL("doc_id"))).alias("score"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.92::DOUBLE ELSE 0.7::DOUBLE END AS authority FROM documents")
def engine_authority(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("Google", "bing", "GitHub", "elsewhere"))), (COL("doc_id") % 4).cast("int") + 1)
    return table(spark, d, "documents").select("doc_id", scoring.authority(name).alias("authority"))


@query(f"SELECT doc_id, {clean('text', 200)} AS title, {clean('text', 500)} AS content FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_text(COL("text"), 200).alias("title"), text.clean_text(COL("text"), 500).alias("content"))


@query("SELECT page_id, regexp_replace(replace(replace(replace(lower(url), 'https://', ''), 'http://', ''), 'www.', ''), '/+$', '') AS normalized FROM pages")
def normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", text.normalize_url(COL("url")).alias("normalized"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, CAST(len(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1), '^/', ''), '/')) AS BIGINT) AS path_depth, 'https://' || regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) || '/favicon.ico' AS favicon FROM pages")
def page_info(spark, d):
    m = text.page_info(COL("url"))
    return table(spark, d, "pages").withColumn("m", m).select("page_id", COL("m")["scheme"].alias("scheme"), COL("m")["host"].alias("host"), COL("m")["path_depth"].cast("bigint").alias("path_depth"), text.favicon(COL("url")).alias("favicon"))


@query("SELECT doc_id, 'q=' || replace(url_encode(text), '+', '%20') || '&page=' || (doc_id % 5) AS qs FROM documents")
def url_params_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", text.query_string([("q", COL("text")), ("page", COL("doc_id") % 5)]).alias("qs"))


_QUERIES["url_params"], _SQL["url_params"] = url_params_whole, _SQL["url_params_whole"]


@query("SELECT item_id, CASE WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' WHEN octet_length(encode(text)) = length(text) THEN 'en' END AS language FROM benchmark")
def detect_language_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.query_language(COL("text")).alias("language"))


@query("WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) || ' ' || text AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 0 AND (length(x) - length(regexp_replace(x, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{20000}-\\x{2ebef}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}]', '', 'g'))) / length(x)::DOUBLE > 0.3 THEN 'zh' ELSE 'en' END AS language FROM t")
def detect_language_doc(spark, d):
    return items(spark, d).select("doc_id", text.document_language(COL("title"), COL("content")).alias("language"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&nbsp;', ' '), '[\\s\\x0B\\x85\\p{Z}]+', ' ', 'g')) AS stripped FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags(COL("html")).alias("stripped"))


# ---- scoring and merging ----------------------------------------------------
@query(f"{SCORED} SELECT doc_id, CAST(position AS BIGINT) AS position, round(score, 6) AS score FROM scored")
def aggregate_with_scoring(spark, d):
    out = aggregate.aggregate_with_scoring(with_copies(items(spark, d)), QUERY)
    return out.select("doc_id", COL("position").cast("bigint").alias("position"), r6(COL("score")).alias("score"))


@query(f"{SCORED} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, position LIMIT 20")
def score_top20(spark, d):
    out = aggregate.aggregate_with_scoring(with_copies(items(spark, d)), QUERY)
    return out.select("doc_id", "position", r6(COL("score")).alias("score")).orderBy(F.desc("score"), "position").limit(20).drop("position")


_REL = " + ".join(f"CASE WHEN starts_with(lower(title), '{t}') THEN 2.0::DOUBLE WHEN contains(lower(title), '{t}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(lower(content), '{t}') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END" for t in QUERY.split()) + f" + CASE WHEN contains(lower(url), '{QUERY}') THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"WITH {ITEMS} SELECT doc_id, {_REL} AS relevance FROM items")
def relevance_score(spark, d):
    return items(spark, d).select("doc_id", scoring.relevance(COL("title"), COL("content"), COL("url"), QUERY).alias("relevance"))


_FRESH = f"CASE WHEN floor(({NOW} - floor(epoch(ts))) / 86400) < 7 THEN 1.0::DOUBLE WHEN floor(({NOW} - floor(epoch(ts))) / 86400) < 30 THEN 0.5::DOUBLE WHEN floor(({NOW} - floor(epoch(ts))) / 86400) < 365 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"SELECT event_id, {_FRESH} AS bonus FROM events")
def freshness_bonus(spark, d):
    return table(spark, d, "events").select("event_id", scoring.freshness(COL("ts"), F.timestamp_seconds(F.lit(NOW))).alias("bonus"))


@query(f"SELECT event_id, round(0.6::DOUBLE * (event_id % 5) + 0.3::DOUBLE * (event_id % 3) + 0.1::DOUBLE * ({_FRESH}), 6) AS score FROM events")
def combined_score(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", r6(scoring.combined((COL("event_id") % 5).cast("double"), (COL("event_id") % 3).cast("double"), scoring.freshness(COL("ts"), F.timestamp_seconds(F.lit(NOW))))).alias("score"))


@query(f"WITH {COPIES} SELECT doc_id, engine_ord, url FROM copies QUALIFY row_number() OVER (PARTITION BY trim(lower(url)) ORDER BY engine_ord, pos) = 1")
def dedup_url(spark, d):
    return dedup.by_url(with_copies(items(spark, d))).select("doc_id", "engine_ord", "url")


@query("WITH p AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, upper(replace(url, 'https://', 'http://www.')) || '/' FROM pages) SELECT page_id, url FROM p QUALIFY row_number() OVER (PARTITION BY regexp_replace(replace(replace(replace(lower(url), 'https://', ''), 'http://', ''), 'www.', ''), '/+$', '') ORDER BY page_id) = 1")
def dedup_normalized_url(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    again = p.select((COL("page_id") + 1000000).alias("page_id"), F.concat(F.upper(F.replace("url", F.lit("https://"), F.lit("http://www."))), F.lit("/")).alias("url"))
    return dedup.by_normalized_url(p.unionByName(again), ("page_id",))


@query(f"WITH {COPIES} SELECT doc_id, engine_ord, pos FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos, engine_ord) AS n FROM copies) WHERE n = 1")
def round_robin_merge(spark, d):
    return dedup.round_robin(with_copies(items(spark, d))).select("doc_id", "engine_ord", "pos")


@query(f"WITH {COPIES} SELECT doc_id, url FROM copies QUALIFY row_number() OVER (PARTITION BY url ORDER BY engine_ord, pos) = 1")
def merge_source_sort(spark, d):
    return aggregate.merged(with_copies(items(spark, d)), sort_by="source").select("doc_id", "url")


# ---- filters, full text, feeds ---------------------------------------------
@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality >= 1 AND l.toxic = 0")
def filter_low_quality(spark, d):
    scored = table(spark, d, "labels").where("toxic = 0").withColumn("score", COL("quality"))
    return table(spark, d, "documents").select("doc_id").join(filters.min_score(scored, 1), "doc_id").select("doc_id", "quality")


@query(f"WITH {ITEMS} SELECT doc_id FROM items WHERE NOT contains(url, 'src1.') AND NOT contains(url, 'src7.')")
def filter_domains(spark, d):
    return filters.blocked(items(spark, d).withColumn("display_url", F.lit(None).cast("string")), ["src1.", "src7."]).select("doc_id")


@query(f"SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty query' WHEN octet_length(encode(text)) > 1000 THEN 'query too long' WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in text.MALICIOUS) + " THEN 'malicious content' WHEN doc_id % 11 < 1 THEN 'invalid page' WHEN doc_id % 130 < 1 OR doc_id % 130 > 100 THEN 'invalid page size' END AS problem FROM documents")
def validate_query(spark, d):
    return table(spark, d, "documents").select("doc_id", text.query_problem(COL("text"), COL("doc_id") % 11, COL("doc_id") % 130).alias("problem"))


@query(f"WITH {ITEMS} SELECT doc_id FROM items WHERE length(title) BETWEEN 10 AND 200 AND contains(url, 'src2')")
def valid_results(spark, d):
    return items(spark, d).where(filters.valid_result(COL("title"), COL("url"), "src2") & filters.has_link(COL("title"), COL("url"))).select("doc_id")


@query(f"WITH {ENTRIES} SELECT doc_id FROM entries WHERE contains(lower(title), 'stre') OR contains(lower(content), 'stre') OR contains(lower(title), 'keit') OR contains(lower(content), 'keit') ORDER BY key, pos LIMIT 50")
def fulltext_cache_scan(spark, d):
    return filters.stored_matches(entries(spark, d), ["STRE", "keit"], ["title", "content"], 50, 0).select("doc_id")


@query(f"WITH {ITEMS} SELECT doc_id FROM items WHERE engine_name IN (SELECT engine_name FROM items WHERE contains(lower(title), 'thble thtion') OR contains(lower(content), 'thble thtion'))")
def search_by_query(spark, d):
    return filters.batches_with(items(spark, d), "thble thtion", "engine_name").select("doc_id")


_K1, _K2 = "keit", "tion"
_RESCORE = "least(1.0::DOUBLE, score + " + " + ".join(f"CASE WHEN contains(lower(title), '{k}') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(lower(content), '{k}') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END" for k in (_K1, _K2)) + ")"


@query(f"""WITH {ENTRIES}, {FEED}, net AS (SELECT 0 AS o, '' AS key, doc_id AS pos, title, url, content, 0.2::DOUBLE AS score FROM items),
c AS (SELECT 1 AS o, key, pos, title, upper(url) AS url, content, 0.1::DOUBLE AS score FROM entries WHERE contains(lower(title), '{_K1}') OR contains(lower(content), '{_K1}') OR contains(lower(url), '{_K1}') OR contains(lower(title), '{_K2}') OR contains(lower(content), '{_K2}') OR contains(lower(url), '{_K2}') ORDER BY key, pos LIMIT 50),
f AS (SELECT 2 AS o, feed_url AS key, pos, title, link AS url, description AS content, 0.7::DOUBLE AS score FROM feed WHERE contains(lower(title || ' ' || description || ' ' || link), '{_K1}') OR contains(lower(title || ' ' || description || ' ' || link), '{_K2}') ORDER BY key, pos LIMIT 30),
u AS (SELECT * FROM net UNION ALL SELECT * FROM c UNION ALL SELECT * FROM f),
x AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lower(url) ORDER BY o, key, pos) = 1)
SELECT url, round({_RESCORE}, 6) AS score FROM x""")
def fulltext_search(spark, d):
    net = items(spark, d).withColumns({"position": COL("doc_id"), "score": F.lit(0.2)})
    cached = entries(spark, d).withColumns({"url": F.upper("url"), "score": F.lit(0.1)})
    feed = feed_items(spark, d).withColumns({"key": COL("feed_url"), "content": F.lit(None).cast("string")})
    return fulltext.search(net, cached, feed, f"{_K1} {_K2}", 0).select("url", r6(COL("score")).alias("score"))


_QUERIES["fulltext_search_whole"], _SQL["fulltext_search_whole"] = fulltext_search, _SQL["fulltext_search"]


def _feed_sql(keywords, extra=""):
    t = "lower(title) || ' ' || lower(coalesce(description, ''))"
    part = lambda k, w: f"CASE WHEN contains({t}, '{k}') THEN {w}::DOUBLE * (1.0::DOUBLE + ln(CAST((length({t}) - length(replace({t}, '{k}', ''))) / {len(k)} AS DOUBLE))) ELSE 0.0::DOUBLE END"
    total = " + ".join(part(k, w) for k, w, _ in keywords)
    for k, _, required in keywords:
        if required:
            total = f"CASE WHEN contains({t}, '{k}') THEN {total} ELSE 0.0::DOUBLE END"
    return f"WITH {FEED}, s AS (SELECT feed_url, pos, link, round({total}, 6) AS score FROM feed)"


@query(_feed_sql(KEYWORDS) + ", r AS (SELECT * FROM s WHERE score >= 8 QUALIFY row_number() OVER (PARTITION BY link ORDER BY score DESC, feed_url, pos) = 1) SELECT feed_url, pos, score FROM r ORDER BY score DESC, feed_url, pos LIMIT 100")
def rss_rank(spark, d):
    out = feeds.rank(feed_items(spark, d), KEYWORDS, least=8.0)
    return out.select("feed_url", "pos", r6(COL("score")).alias("score"))


@query(_feed_sql(REQUIRED) + " SELECT feed_url, pos, score FROM s WHERE score >= 0 ORDER BY score DESC, feed_url, pos LIMIT 50")
def rss_rank_required(spark, d):
    out = feeds.rank(feed_items(spark, d), REQUIRED, most=50, distinct_links=False)
    return out.select("feed_url", "pos", r6(COL("score")).alias("score"))


@query(f"WITH {FEED} SELECT feed_url, pos FROM feed WHERE pos < 2 AND (contains(lower(title), 'tion') OR contains(lower(description), 'tion'))")
def rss_limit_then_filter(spark, d):
    return feeds.fetched(feed_items(spark, d), 2, ["tion"]).select("feed_url", "pos")


@query(f"WITH {FEED}, u AS (SELECT *, 0 AS gen FROM feed WHERE pos % 2 = 0 UNION ALL SELECT *, 1 AS gen FROM feed WHERE 1000 + pos > 1001) SELECT feed_url, pos, gen FROM u QUALIFY row_number() OVER (PARTITION BY feed_url, guid ORDER BY gen, pos) = 1")
def rss_merge_guid(spark, d):
    f = feed_items(spark, d)
    out = dedup.merge_feed(f.where("pos % 2 = 0").withColumn("expires_at", F.lit(None).cast("bigint")), f.withColumn("expires_at", COL("pos") + 1000), F.lit(1001))
    return out.select("feed_url", "pos", "gen")


_RSS = "'<rss><channel><title>' || role || '</title><item><title><![CDATA[ ' || text || ' ]]></title><link>https://x.example/' || conv_id || '</link><guid>' || turn || '</guid></item><item><title>second</title></item></channel></rss>'"


def _rss_bodies(spark, d):
    return table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("feed_url"), F.expr(_RSS).alias("body"))


@query("SELECT conv_id || '-' || turn AS feed_url, 0 AS pos, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS title, 'https://x.example/' || conv_id AS link, CAST(turn AS VARCHAR) AS guid FROM conversations UNION ALL SELECT conv_id || '-' || turn, 1, 'second', NULL, NULL FROM conversations")
def rss_parse(spark, d):
    return feed_sources.items(_rss_bodies(spark, d)).select("feed_url", "pos", "title", "link", "guid")


@query("SELECT CAST(item_id AS VARCHAR) AS feed_url, 0 AS pos, 'Item ' || item_id AS title, 'https://a.example/' || item_id AS link, 'urn:' || item_id AS guid FROM benchmark")
def atom_parse(spark, d):
    n = COL("item_id").cast("string")
    body = F.concat(F.lit('<feed>\n<title>all</title>\n<entry>\n<title>Item '), n, F.lit('</title>\n<link href="https://a.example/'), n, F.lit('"/>\n<id>urn:'), n, F.lit("</id>\n</entry>\n</feed>"))
    return feed_sources.items(table(spark, d, "benchmark").select(n.alias("feed_url"), body.alias("body"))).select("feed_url", "pos", "title", "link", "guid")


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS n_links FROM pages")
def html_title_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a ")).cast("bigint").alias("n_links"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS u, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, trim(replace(replace(replace(t[i], '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title, u[i] AS url FROM (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM l)""")
def html_items(spark, d):
    return page_sources.html_items(table(spark, d, "pages"), "links", "page_id").select("page_id", "pos", "title", "url")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(page_sources.variant(COL("props")), "$.k", "bigint").alias("k"))


@query("SELECT item_id, 0 AS pos, 'T' || item_id AS title, 'https://j.example/' || item_id AS url, 'abs' AS content FROM benchmark")
def json_results(spark, d):
    n = COL("item_id").cast("string")
    body = F.concat(F.lit('{"results":[{"title":"T'), n, F.lit('","link":"https://j.example/'), n, F.lit('","abstract":"abs"}]}'))
    return page_sources.json_items(table(spark, d, "benchmark").select("item_id", body.alias("body")), "baidu", "item_id").drop("metadata")


# ---- cache, vectors, health, formats ---------------------------------------
@query(f"WITH {ENTRIES} SELECT doc_id, expires_at <= 20000 AS expired, greatest(20000 - created_at, 0) >= 9000 AS stale FROM entries")
def cache_expired(spark, d):
    return entries(spark, d).select("doc_id", cache.expired(COL("expires_at"), 20000).alias("expired"), cache.stale(COL("created_at"), 9000, 20000).alias("stale"))


@query("SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'error') AS misses, count(*) FILTER (event_type = 'purchase') AS writes, count(*) FILTER (event_type = 'signup') AS deletes, round(coalesce(count(*) FILTER (event_type = 'view') / nullif(count(*) FILTER (event_type IN ('view', 'error')), 0)::DOUBLE, 0), 6) AS hit_rate FROM events")
def cache_stats(spark, d):
    names = F.create_map(*[F.lit(x) for kv in (("view", "hit"), ("error", "miss"), ("purchase", "write"), ("signup", "delete")) for x in kv])
    return cache.stats(table(spark, d, "events").select(names[COL("event_type")].alias("outcome"))).withColumn("hit_rate", r6(COL("hit_rate")))


@query(f"WITH {ENTRIES} SELECT doc_id, expires_at <= 9000 AS is_stale FROM entries WHERE key = '000000000042'")
def cache_stale_join(spark, d):
    return cache.get(entries(spark, d), "000000000042", 9000, include_stale=True).select("doc_id", "is_stale")


@query(f"WITH {ENTRIES}, n AS (SELECT key, doc_id, 'new' AS title FROM entries WHERE doc_id % 5 = 0) SELECT key, title FROM n UNION ALL SELECT key, title FROM entries WHERE doc_id % 5 <> 0 AND expires_at > 9000")
def cache_put_clean(spark, d):
    e = entries(spark, d)
    new = e.where("doc_id % 5 = 0").select("key", F.lit("new").alias("title"))
    return cache.put(cache.cleaned(e, 9000).select("key", "title"), new)


@query("SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN true WHEN conv_id % 3 = 0 THEN false ELSE greatest(5000 - min(turn) * 1000 - conv_id, 0) >= 3600 END AS due FROM conversations GROUP BY conv_id")
def feeds_need_update(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("t"))
    last = F.when(COL("conv_id") % 4 != 0, COL("t") * 1000 + COL("conv_id"))
    return c.select("conv_id", cache.needs_update(last, F.when(COL("conv_id") % 3 != 0, F.lit(3600)), 5000).alias("due"))


_TERMS = rf"list_filter(list_transform(regexp_split_to_array(lower(text), '{SP}'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: octet_length(encode(w)) > 1)"


@query(f"WITH t AS (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark), b AS (SELECT item_id, CAST(CAST(concat('0x', substr(md5(t), 1, 8)) AS BIGINT) % 100 AS INTEGER) AS bucket, count(*) AS n FROM t GROUP BY ALL) SELECT item_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM b")
def vectorize_norm(spark, d):
    v = table(spark, d, "benchmark").select("item_id", F.posexplode(vectors.vectorize(COL("text"))).alias("bucket", "weight"))
    return v.where("weight > 0").select("item_id", "bucket", r6(COL("weight")).alias("weight"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, list_sum(list_transform(list_zip(e, embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)))), 6) AS score FROM q JOIN embeddings ON vec_id <> query_id) SELECT query_id, vec_id, score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5")
def cosine_topk(spark, d):
    """Every twentieth vector against all vectors, in blocks."""
    return nearest.nearest(table(spark, d, "embeddings"), COL("vec_id") % 20 == 0, 0.3, 5)


_QUERIES["cosine_topk_20"], _SQL["cosine_topk_20"] = cosine_topk, _SQL["cosine_topk"]


_FOLD = f"""WITH RECURSIVE {CALLS}, o AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY ts, seq) AS n FROM calls),
f(engine, n, total, ok, failed, consecutive, avg_ms, disabled_until) AS (
  SELECT DISTINCT engine, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM calls
  UNION ALL
  SELECT f.engine, o.n, f.total + CASE WHEN outcome = 'zero' THEN 0 ELSE 1 END, f.ok + CASE WHEN outcome = 'success' THEN 1 ELSE 0 END, f.failed + CASE WHEN outcome = 'failure' THEN 1 ELSE 0 END,
    CASE WHEN outcome = 'success' THEN 0 ELSE f.consecutive + 1 END,
    CASE WHEN outcome <> 'success' THEN f.avg_ms WHEN f.total = 0 THEN o.response_ms ELSE (f.avg_ms * f.total + o.response_ms) // (f.total + 1) END,
    CASE outcome WHEN 'success' THEN NULL WHEN 'failure' THEN f.disabled_until ELSE o.ts + 300 * CAST(pow(5, least(f.consecutive, 5)) AS BIGINT) END
  FROM f JOIN o ON o.engine = f.engine AND o.n = f.n + 1
), last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY engine ORDER BY n DESC) = 1)"""


@query(f"{_FOLD} SELECT engine, total, ok, failed, consecutive, avg_ms, disabled_until FROM last")
def engine_state_fold(spark, d):
    return state.fold(calls(spark, d))


@query(f"{_FOLD} SELECT engine FROM last WHERE disabled_until IS NULL OR disabled_until <= {NOW}")
def engine_active(spark, d):
    return state.active(state.fold(calls(spark, d)), NOW).select("engine")


@query(f"WITH {CALLS} SELECT count(*) AS total_searches, count(*) FILTER (outcome = 'failure') AS failures, count(*) FILTER (outcome = 'zero') AS zero_results FROM calls")
def search_counters(spark, d):
    return state.counters(calls(spark, d))


@query("SELECT doc_id, printf('%d. %s' || chr(10) || '   %s' || chr(10) || '   %s' || chr(10) || '   Score: %.2f' || chr(10) || chr(10), doc_id, split_part(text, chr(10), 1), 'https://' || source || '.example/' || doc_id, text, 1.0::DOUBLE) AS line FROM documents")
def format_text(spark, d):
    return items(spark, d).select("doc_id", formats.as_text(COL("doc_id")).alias("line"))


@query(f"WITH {ITEMS} SELECT doc_id, printf(chr(10) || '<div class=\"result-item\">' || chr(10) || '    <h3 class=\"title\"><a href=\"%s\">%s</a></h3>' || chr(10) || '    <div class=\"url\">%s</div>' || chr(10) || '    <div class=\"content\">%s</div>' || chr(10) || '    <div class=\"meta\">Score: %.2f</div>' || chr(10) || '</div>', url, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), url, replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), score) AS html FROM items")
def format_html(spark, d):
    return items(spark, d).withColumn("display_url", F.lit(None).cast("string")).select("doc_id", formats.as_html().alias("html"))


@query("SELECT page_id, '{\"page_id\":' || page_id || ',\"url\":\"' || url || '\"}' AS json FROM pages")
def results_to_json(spark, d):
    return table(spark, d, "pages").select("page_id", formats.as_json(["page_id", "url"]).alias("json"))


@query("SELECT CAST(item_id AS VARCHAR) AS query_id, 0 AS pos, 'about ' || item_id AS title FROM benchmark")
def plugin_source(spark, d):
    def echo(q):
        return {"results": [{"title": f"about {q['query']}", "url": "https://e.example", "snippet": "x"}]}

    n = COL("item_id").cast("string")
    return registry.run_callback(echo, table(spark, d, "benchmark").select(n.alias("query_id"), n.alias("query"))).select("query_id", "pos", "title")


def queries() -> dict[str, Query]:
    from skein.plans import more, stored, tabled  # noqa: F401 - add their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from skein.plans import more, stored, tabled  # noqa: F401 - add their own

    return dict(_SQL)
