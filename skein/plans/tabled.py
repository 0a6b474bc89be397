"""Queries that make their questions, addresses and settings of the rows of tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scoring, text, vectors
from skein.operators import cache, feeds, formats, paging, privacy, settings, state
from skein.plans.catalogue import _FOLD, CALLS, COL, FEED, ITEMS, KEYWORDS, NOW, REQUIRED, SP, calls, feed_items, items, query, r6, table
from skein.sources import feeds as feed_sources
from skein.sources import requests
from skein.sources.base import Abilities, Source


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, at):
    """One of the values, by the rest of a number."""
    return F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))


# ---- queries ---------------------------------------------------------------
_MARKS = ("site:example.com", "buy", "price", "near me", "购买", "news:", "新闻", "image:", "图片", "video: dog", "视频", "code:", "代码", "附近", "plain")


@query(f"""WITH q AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_list(_MARKS)}[1 + doc_id % {len(_MARKS)}] || ' ' || text ELSE text || ' ' || {_list(_MARKS)}[1 + doc_id % {len(_MARKS)}] END AS q FROM documents)
SELECT doc_id, CASE WHEN contains(q, 'site:') THEN 'navigational' WHEN contains(q, 'buy') OR contains(q, 'price') OR contains(q, '购买') THEN 'transactional' WHEN contains(q, 'near me') OR contains(q, '附近') THEN 'local' WHEN contains(q, 'news:') OR starts_with(q, '新闻') THEN 'news' WHEN contains(q, 'image:') OR contains(q, '图片') THEN 'image' WHEN contains(q, 'video:') OR contains(q, '视频') THEN 'video' WHEN contains(q, 'code:') OR contains(q, '代码') THEN 'code' ELSE 'informational' END AS intent FROM q""")
def detect_intent(spark, d):
    mark = _pick(_MARKS, COL("doc_id"))
    q = F.when(COL("doc_id") % 2 == 0, F.concat(mark, F.lit(" "), "text")).otherwise(F.concat("text", F.lit(" "), mark))
    return table(spark, d, "documents").select("doc_id", text.detect_intent(q).alias("intent"))


@query(f"""WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(replace(text, ':', ';'), '{SP}'), lambda w: w <> '') AS w, coalesce(lang, 'xx') AS lang, coalesce(source, 'src') AS source FROM documents)
SELECT doc_id, array_to_string(w, ' ') AS text, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN 'zz' END AS language, CASE WHEN doc_id % 2 = 0 THEN source || '.example' END AS site FROM p""")
def parse_query_filters(spark, d):
    """Whole texts as queries, with filters before, after and in both places; the last of a kind counts."""
    k, lang = COL("doc_id"), F.coalesce("lang", F.lit("xx"))
    ahead = F.when(k % 3 == 0, F.concat(F.lit("lang:"), lang, F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("lang:"), lang, F.lit(" language:zz "))).otherwise("other:1 ")
    after = F.when(k % 2 == 0, F.concat(F.lit(" site:"), F.coalesce("source", F.lit("src")), F.lit(".example"))).otherwise("")
    q = F.concat(ahead, F.replace("text", F.lit(":"), F.lit(";")), after)
    return table(spark, d, "documents").select("doc_id", text.parse_filters(q).alias("p")).select("doc_id", "p.*")


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9\s\x85\p{{Z}}\-+"]', '', 'g'), '{SP}', ' ', 'g')) AS cleaned,
  replace(replace(replace(text, '"', '\"'), '''', '\'''), '\', '\\') AS escaped, lower(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS normalized FROM documents""")
def clean_query(spark, d):
    t = COL("text")
    return table(spark, d, "documents").select("doc_id", text.clean_query(t).alias("cleaned"), text.escape_special(t).alias("escaped"), text.normalize_query(t).alias("normalized"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda p: p <> ''), ' ') AS collected FROM documents")
def collect_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collect_text(F.split("text", "\n")).alias("collected"))


class _Narrow(Source):
    name, abilities = "narrow", Abilities(max_page_size=40, time_range=True, parameters=("sort", "kind"))

    def build_request(self, query):
        return ""

    def parse(self, body):
        return []


class _Plain(_Narrow):
    name, abilities = "plain", Abilities()


@query(r"""SELECT doc_id, CASE WHEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) = '' THEN 'empty query' WHEN octet_length(encode(text)) > 1000 THEN 'query too long' WHEN doc_id % 60 > 40 THEN 'page size over 40' WHEN doc_id % 4 = 1 THEN 'no parameter extra' END AS narrow,
  CASE WHEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) = '' THEN 'empty query' WHEN octet_length(encode(text)) > 1000 THEN 'query too long' WHEN doc_id % 3 = 0 THEN 'no time range' WHEN doc_id % 4 = 1 THEN 'no parameter extra' ELSE 'no parameter sort' END AS plain FROM documents""")
def source_query_problems(spark, d):
    """Why sources of other abilities refuse the same queries."""
    k = COL("doc_id")
    parameters = F.when(k % 4 == 1, F.create_map(F.lit("sort"), F.lit("x"), F.lit("extra"), F.lit("y"))).otherwise(F.create_map(F.lit("sort"), F.lit("x")))
    asked = (COL("text"), k % 60, F.when(k % 3 == 0, "week"), parameters)
    return table(spark, d, "documents").select("doc_id", _Narrow().problem(*asked).alias("narrow"), _Plain().problem(*asked).alias("plain"))


@query("SELECT doc_id, text AS query, doc_id % 9 AS page, greatest(1, least(100, doc_id % 150 - 10)) AS page_size FROM documents")
def query_json_round_trip(spark, d):
    q = table(spark, d, "documents").select("doc_id", COL("text").alias("query"), (COL("doc_id") % 9).alias("page"), paging.page_size(COL("doc_id") % 150 - 10).alias("page_size"))
    said = q.select("doc_id", settings.query_json(["query", "page", "page_size"]).alias("j"))
    return said.select("doc_id", settings.query_from_json(COL("j"), "query string, page bigint, page_size bigint").alias("q")).select("doc_id", "q.*")


@query("SELECT doc_id, sha256(coalesce(text, chr(0)) || chr(31) || coalesce(source, chr(0)) || chr(31) || CASE WHEN doc_id % 3 = 0 THEN chr(0) ELSE doc_id % 5 || '' END) AS key FROM documents")
def cache_keys(spark, d):
    page = F.when(COL("doc_id") % 3 != 0, COL("doc_id") % 5)
    return table(spark, d, "documents").select("doc_id", cache.cache_key(COL("text"), COL("source"), page).alias("key"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS level FROM documents")
def safe_search_levels(spark, d):
    return table(spark, d, "documents").select("doc_id", text.safe_search(_pick(("none", "Moderate", "STRICT", "other"), COL("doc_id"))).alias("level"))


@query("SELECT doc_id, split_part(text, ' ', 1) AS word, CASE doc_id % 3 WHEN 0 THEN 5.0::DOUBLE ELSE greatest(1.0::DOUBLE, least(10.0::DOUBLE, (doc_id % 15)::DOUBLE / 1)) END AS weight FROM documents WHERE NOT contains(split_part(text, ' ', 1), ':') AND trim(split_part(text, ' ', 1), ' ' || chr(10) || chr(9) || chr(13)) = split_part(text, ' ', 1)")
def keyword_specs(spark, d):
    """word:weight, word and word:nonsense, for words without a colon or white space of their own."""
    k, w = COL("doc_id"), F.split_part("text", F.lit(" "), F.lit(1))
    t = table(spark, d, "documents").where(~F.contains(w, F.lit(":")) & (F.regexp_replace(w, rf"^{SP}|{SP}$", "") == w))
    spec = F.when(k % 3 != 0, F.concat(w, F.lit(":"), (k % 15).cast("string"))).when(k % 2 == 0, w).otherwise(F.concat(w, F.lit(":much")))
    return t.select("doc_id", scoring.keyword_spec(spec).alias("s")).select("doc_id", "s.*")


# ---- addresses and what they say -------------------------------------------
@query("""SELECT page_id, url AS decoded, CASE page_id % 3 WHEN 0 THEN 'https:' || substr(url, strpos(url, '//')) WHEN 1 THEN 'https://www.bing.com/p/' || page_id ELSE url END AS absolute,
  'https://u.example/p' || CASE WHEN page_id % 2 = 0 THEN '?w=' || page_id ELSE '' END AS cleaned FROM pages""")
def url_rewrites(spark, d):
    """Addresses of pages as redirects, without scheme and host, and with a parameter that goes."""
    u, k = COL("url"), COL("page_id").cast("string")
    coded = F.translate(F.regexp_replace(F.base64(u.cast("binary")), r"[=\s]+", ""), "+/", "-_")
    redirect = F.concat(F.lit("https://www.bing.com/ck/a?!&&p=1&u=a1"), coded)
    relative = F.when(COL("page_id") % 3 == 0, F.substring(u, F.instr(u, "//"), F.length(u))).when(COL("page_id") % 3 == 1, F.concat(F.lit("/p/"), k)).otherwise(u)
    marked = F.concat(F.lit("https://u.example/p?ixid="), k, F.when(COL("page_id") % 2 == 0, F.concat(F.lit("&w="), k)).otherwise(""))
    return table(spark, d, "pages").select("page_id", text.decode_redirect(redirect).alias("decoded"), text.absolute(relative, "https://www.bing.com").alias("absolute"), text.without_parameter(marked).alias("cleaned"))


_AGES = ("minute", "hour", "day", "week", "month")


@query(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN 86400 WHEN 3 THEN 604800 END * (user_id % 40) AS seconds_ago FROM events")
def relative_date(spark, d):
    said = F.concat(F.lit("about "), (COL("user_id") % 40).cast("string"), F.lit(" "), _pick(_AGES, COL("event_id")), F.lit("s ago"))
    return table(spark, d, "events").select("event_id", (F.unix_timestamp("ts") - F.unix_timestamp(text.relative_date(said, COL("ts")))).alias("seconds_ago"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id * 1000 WHEN 2 THEN event_id * 1000000 WHEN 3 THEN (event_id * 10 + 5) * 100 END AS n FROM events""")
def view_count(spark, d):
    """Plain, thousands, millions, with a fraction, and what isn't a number of views."""
    k = COL("event_id").cast("string")
    said = _pick(("", "K", "m", ".5k", " likes"), COL("event_id"))
    return table(spark, d, "events").select("event_id", text.view_count(F.concat(k, said, F.when(COL("event_id") % 5 < 4, " Views").otherwise(""))).cast("bigint").alias("n"))


_Q = "replace(replace(replace(url_encode(q), '+', '%20'), '*', '%2A'), '%7E', '~')"
_PAST = f"CASE r WHEN 'day' THEN {NOW - 86400} WHEN 'week' THEN {NOW - 604800} WHEN 'month' THEN {NOW - 2592000} WHEN 'year' THEN {NOW - 31536000} END"
_AGE = "CASE r WHEN 'day' THEN 1440 WHEN 'week' THEN 10080 WHEN 'month' THEN 44640 WHEN 'year' THEN 525600 END"
_CODE = "CASE r WHEN 'day' THEN {} WHEN 'week' THEN {} WHEN 'month' THEN {} WHEN 'year' THEN {} END"


@query(f"""WITH t AS (SELECT item_id, text AS q, item_id % 4 + 1 AS p, ['day', 'week', 'month', 'year', NULL][1 + item_id % 5] AS r FROM benchmark), u AS (SELECT item_id, unnest([
  struct_pack(engine := 'bing', url := 'https://www.bing.com/search?q=' || {_Q} || '&pq=' || {_Q} || CASE WHEN p > 1 THEN '&first=' || (p * 10 - 9) || '&FORM=PERE' || CASE WHEN p > 2 THEN p - 2 || '' ELSE '' END ELSE '' END || coalesce('&filters=ex1:"ez' || {_CODE.format(1, 2, 3, 4)} || '"', '')),
  struct_pack(engine := 'baidu', url := 'https://www.baidu.com/s?wd=' || {_Q} || '&rn=10&pn=' || (p * 10 - 10) || '&tn=json' || coalesce('&gpc=stf%3D' || {_PAST} || '%2C{NOW}%7Cstftype%3D1', '')),
  struct_pack(engine := 'yandex', url := 'https://yandex.com/search/site/?tmpl_version=releases&text=' || {_Q} || '&web=1&frame=1&searchid=3131712' || CASE WHEN p > 1 THEN '&p=' || (p - 1) ELSE '' END),
  struct_pack(engine := 'sogou', url := 'https://www.sogou.com/web?query=' || {_Q} || '&page=' || p || coalesce('&s_from=inttime_' || r || '&tsn=1', '')),
  struct_pack(engine := 'bing_news', url := 'https://www.bing.com/news/infinitescrollajax?q=' || {_Q} || '&first=' || (p * 10 - 9) || coalesce('&qft=interval%3D%22' || {_CODE.format("'4'", "'7'", "'9'", "NULL")} || '%22', '')),
  struct_pack(engine := 'bing_videos', url := 'https://www.bing.com/videos/asyncv2?q=' || {_Q} || '&async=content&first=' || (p * 35 - 34) || '&count=35' || coalesce('&qft=filterui%3Aage-lt' || {_AGE}, '')),
  struct_pack(engine := 'bing_images', url := 'https://www.bing.com/images/async?q=' || {_Q} || '&async=1&first=' || (p * 35 - 34) || '&count=35' || coalesce('&qft=filterui%3Aage-lt' || {_AGE}, '')),
  struct_pack(engine := 'bilibili', url := 'https://api.bilibili.com/x/web-interface/search/type?__refresh__=true&page=' || p || '&page_size=20&single_column=0&keyword=' || {_Q} || '&search_type=video'),
  struct_pack(engine := 'unsplash', url := 'https://unsplash.com/napi/search/photos?query=' || {_Q} || '&page=' || p || '&per_page=20'),
  struct_pack(engine := 'sogou_images', url := 'https://pic.sogou.com/pics?query=' || {_Q} || '&start=' || (p * 20 - 20)),
  struct_pack(engine := 'sogou_videos', url := 'https://v.sogou.com/v?query=' || {_Q} || '&page=' || p),
  struct_pack(engine := 'sogou_wechat', url := 'https://weixin.sogou.com/weixin?query=' || {_Q} || '&page=' || p || '&type=2'),
  struct_pack(engine := 'xinhua', url := 'https://so.news.cn/#search/' || CASE WHEN p = 2 THEN 3 ELSE 0 END || '/' || {_Q} || '/' || p)]) AS x FROM t) SELECT item_id, x.engine AS engine, x.url AS url FROM u""")
def request_urls(spark, d):
    """Addresses of all sources for every benchmark item, on four pages, over all ranges of time."""
    k = COL("item_id")
    asked = table(spark, d, "benchmark").select("item_id", COL("text").alias("q"), (k % 4 + 1).alias("p"), _pick(("day", "week", "month", "year", None), k).alias("r"))
    u = requests.urls(COL("q"), COL("p"), COL("r"), F.lit(NOW).cast("bigint"), category=F.when(COL("p") == 2, 3).otherwise(0))
    return asked.select("item_id", F.explode(F.array(*[F.struct(F.lit(n).alias("engine"), u[n].alias("url")) for n in u])).alias("x")).select("item_id", "x.*")


# ---- states and settings ---------------------------------------------------
@query(f"{_FOLD} SELECT engine, consecutive AS n, CAST(5 * pow(5, least(consecutive - 1, 5)) AS BIGINT) AS minutes FROM last WHERE consecutive > 0")
def engine_backoff(spark, d):
    s = state.fold(calls(spark, d)).where("consecutive > 0")
    return s.select("engine", COL("consecutive").alias("n"), state.backoff_minutes(COL("consecutive")).alias("minutes"))


@query("WITH c AS (SELECT conv_id, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(i AS INTEGER) AS attempt, pow(2.0::DOUBLE, i) AS delay FROM (SELECT conv_id, unnest(range(n - 1)) AS i FROM c WHERE conv_id % 4 < 2)")
def retry_schedule(spark, d):
    """As many attempts as a conversation has turns, for errors that may be tried again."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    told = c.withColumn("error", _pick(("a network error", "connection timeout", "parse", "Network"), COL("conv_id"))).where(state.may_retry(COL("error")))
    return told.select("conv_id", F.posexplode(state.retry_delays(COL("n"))).alias("attempt", "delay"))


_AGENTS, _PRINTS = ("fixed", "realistic", "random", "custom"), ("none", "basic", "advanced", "full")


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 15 ELSE 0 END + CASE WHEN doc_id % 11 = 0 THEN 10 ELSE 5 END + [0, 10, 15, 20][1 + doc_id % 4] + [0, 10, 20, 30][1 + doc_id // 4 % 4] AS points FROM documents)
SELECT doc_id, points, CASE WHEN points <= 30 THEN 'low' WHEN points <= 60 THEN 'medium' WHEN points <= 85 THEN 'high' ELSE 'maximum' END AS level FROM p""")
def privacy_level(spark, d):
    k = COL("doc_id")
    on = {c: k % n == 0 for c, n in (("fake_headers", 2), ("fake_referer", 3), ("remove_fingerprints", 5), ("doh", 7), ("verify_certificates", 11))}
    rows = table(spark, d, "documents").select("doc_id").withColumns(on | {"user_agent": _pick(_AGENTS, k), "fingerprint": _pick(_PRINTS, F.floor(k / 4))})
    return rows.select("doc_id", privacy.points().cast("int").alias("points")).withColumn("level", privacy.level(COL("points")))


_ON = lambda n: f"CASE WHEN doc_id % {n} = 0 THEN 10 ELSE 0 END"


@query(f"""SELECT doc_id, {_ON(2)} + {_ON(3)} + {_ON(5)} + CASE WHEN doc_id % 2 = 0 AND doc_id % 7 <> 0 THEN 10 ELSE 0 END + {_ON(4)} + {_ON(6)} + CASE WHEN doc_id % 4 > 0 THEN 10 ELSE 0 END + {_ON(8)} + {_ON(9)} + {_ON(10)} AS security,
  CASE WHEN doc_id % 2 = 0 THEN 15 ELSE 0 END + {_ON(3)} + CASE WHEN doc_id % 5 = 0 THEN 5 ELSE 0 END + CASE WHEN doc_id % 30 >= 5 THEN 10 ELSE 0 END + CASE WHEN doc_id % 30 <= 20 THEN 10 ELSE 0 END + {_ON(7)} + CASE WHEN doc_id % 13 > doc_id % 11 THEN 10 ELSE 0 END + {_ON(6)} + CASE WHEN doc_id % 4 <> 0 OR doc_id % 2 = 0 THEN 10 ELSE 0 END + {_ON(10)} AS performance FROM documents""")
def settings_scores(spark, d):
    k = COL("doc_id")
    every = lambda n: k % n == 0
    rows = table(spark, d, "documents").select(
        "doc_id", every(2).alias("api.auth.enabled"), F.when(every(3), "s3cret").otherwise("please change me").alias("server.secret_key"), every(5).alias("server.tls.enabled"), F.when(every(2), "production").otherwise("development").alias("general.environment"),
        every(7).alias("general.debug"), every(4).alias("privacy.enable_tor"), F.when(every(6), F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("privacy.proxy_chain"), _pick(_PRINTS, k).alias("privacy.fingerprint_protection.protection_level"),
        every(8).alias("api.rate_limit.enabled"), every(9).alias("logging.structured"), every(10).alias("general.enable_metrics"), every(2).alias("cache.enable_result_cache"), every(3).alias("cache.enable_metadata_cache"), every(5).alias("cache.enable_dns_cache"),
        (k % 30).alias("search.max_concurrent_engines"), every(7).alias("logging.performance.enabled"), (k % 13).alias("privacy.request_timing.max_delay"), (k % 11).alias("privacy.request_timing.min_delay"), every(6).alias("cache.compression.enabled"),
        every(4).alias("search.aggregation.enable_deduplication"), every(10).alias("engines.global_settings.enable_monitoring"),
    )
    return rows.select("doc_id", settings.security_score().alias("security"), settings.performance_score().alias("performance"))


# ---- rows for others -------------------------------------------------------
_CUT = "left(content, list_max(list_filter(range(0, 201), lambda n: octet_length(encode(left(content, n))) <= 200)))"


@query(f"WITH {ITEMS}, f AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM items) SELECT n, title, url, CASE WHEN octet_length(encode(content)) > 200 THEN {_CUT} || '...' ELSE content END AS description FROM f WHERE n <= 50")
def screen_rows(spark, d):
    """The first 50 items, texts cut at 200 bytes where a character ends."""
    return formats.screen_rows(items(spark, d), verbose=True, order=("pos",)).select(COL("n").cast("bigint").alias("n"), "title", "url", "description")


@query(f"WITH {ITEMS} SELECT title, url, content, score FROM items")
def sdk_rows(spark, d):
    return formats.sdk_rows(items(spark, d))


@query(f"WITH {ITEMS} SELECT title, url, content AS description, 'aggregated' AS engine, score FROM items")
def http_rows(spark, d):
    return formats.response_rows(items(spark, d))


# ---- stores and feeds ------------------------------------------------------
@query(f"WITH {CALLS} SELECT count(*) AS total_searches, count(*) FILTER (outcome = 'failure' AND seq % 2 = 1) AS failures, count(*) FILTER (outcome = 'failure' AND seq % 2 = 0) AS timeouts, count(*) FILTER (outcome = 'zero') AS zero_results, 0::BIGINT AS cache_hits, 0::BIGINT AS cache_misses FROM calls")
def search_counters_whole(spark, d):
    """With timeouts, and the counters of the cache, which a search never raises."""
    outcome = F.when((COL("outcome") == "failure") & (COL("seq") % 2 == 0), "timeout").otherwise(COL("outcome"))
    return state.counters(calls(spark, d).withColumn("outcome", outcome), cache=True)


@query("SELECT CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 3 = 1")
def entries_of_kind(spark, d):
    e = table(spark, d, "documents").select(COL("doc_id").cast("string").alias("key"), _pick(("result", "rss", "meta"), COL("doc_id")).alias("kind"))
    return cache.of_kind(e, "rss").select("key")


@query(f"WITH {FEED}, m AS (SELECT feed_url, max(pos) AS last_updated FROM feed GROUP BY feed_url HAVING CAST(feed_url AS BIGINT) % 2 = 0) SELECT guid, last_updated FROM feed LEFT JOIN m USING (feed_url)")
def feeds_with_meta(spark, d):
    f = feed_items(spark, d)
    meta = f.groupBy("feed_url").agg(F.max("pos").alias("last_updated")).where(COL("feed_url").cast("bigint") % 2 == 0)
    return cache.with_feed_meta(f, meta).select("guid", "last_updated")


@query("""WITH i AS (SELECT CAST(conv_id AS VARCHAR) AS feed_url, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, 'turn ' || turn AS title, text FROM conversations)
SELECT feed_url, CAST(pos AS INTEGER) AS pos, title FROM i WHERE pos < 3 AND (contains(lower(text), 'tion') OR contains(lower(title), '2'))""")
def fetch_and_parse(spark, d):
    """A feed of each conversation, parsed; of its first three items those with a keyword."""
    item = F.concat(F.lit("<item><title>turn "), COL("turn").cast("string"), F.lit("</title><description><![CDATA["), "text", F.lit("]]></description></item>"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("x")))), lambda s: s["x"]), "").alias("x"))
    bodies = c.select(COL("conv_id").cast("string").alias("feed_url"), F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>")).alias("body"))
    return feeds.fetched(feed_sources.items(bodies), 3, ["TION", "2"]).select("feed_url", "pos", "title")


@query(f"""WITH {ITEMS}, s AS (SELECT doc_id, 0.6::DOUBLE * (CASE WHEN starts_with(lower(title), 'the') THEN 2 WHEN contains(lower(title), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'the') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(url), 'the') THEN 1.5 ELSE 0 END)
  + 0.3::DOUBLE * (doc_id % 10) / 10 + 0.1::DOUBLE * CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 500 < 7 THEN 1 WHEN doc_id % 500 < 30 THEN 0.5 WHEN doc_id % 500 < 365 THEN 0.2 ELSE 0 END AS combined FROM items)
SELECT doc_id, round(combined, 6) AS combined FROM (SELECT * FROM s ORDER BY round(combined, 6) DESC, doc_id LIMIT 30)""")
def best_by_several_factors(spark, d):
    k = COL("doc_id")
    published = F.when(k % 4 != 0, F.timestamp_seconds(F.lit(NOW) - (k % 500) * 86400))
    rows = items(spark, d).withColumns({"score": (k % 10) / 10.0, "published": published})
    return paging.by_several(rows, "the", F.timestamp_seconds(F.lit(NOW)), 30, ties=("doc_id",)).select("doc_id", r6(COL("combined")).alias("combined"))


@query(f"WITH {ITEMS} SELECT title, url, left(content, 150) AS description, score FROM items")
def described_rows(spark, d):
    return formats.described(items(spark, d), 150)


_TERMS_OF = rf"list_filter(list_transform(regexp_split_to_array(lower(text), '{SP}'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: octet_length(encode(w)) > 1)"


@query(f"""WITH t AS (SELECT item_id, unnest({_TERMS_OF}) AS t FROM benchmark), b AS (SELECT item_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 100 AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
v AS (SELECT item_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS w FROM b)
SELECT x.item_id, y.item_id AS other, round(least(1.0::DOUBLE, sum(x.w * y.w)), 6) AS similarity FROM v x JOIN v y ON y.item_id = x.item_id + 1 AND x.bucket = y.bucket GROUP BY ALL HAVING round(least(1.0::DOUBLE, sum(x.w * y.w)), 6) > 0""")
def similarity_to_next(spark, d):
    """Each benchmark item and the next one."""
    v = table(spark, d, "benchmark").select("item_id", vectors.vectorize(COL("text")).alias("v"))
    after = v.select((COL("item_id") - 1).alias("item_id"), COL("item_id").alias("other"), COL("v").alias("w"))
    near = v.join(after, "item_id").select("item_id", "other", r6(vectors.cosine(COL("v"), COL("w"))).alias("similarity"))
    return near.where("similarity > 0")


_HITS = lambda words: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for w, _, _ in words) + "], lambda x: x IS NOT NULL), ',')"


@query(f"""WITH {FEED}, t AS (SELECT guid, lower(title) || ' ' || lower(coalesce(description, '')) AS t FROM feed)
SELECT guid, {_HITS(KEYWORDS)} AS any_of, CASE WHEN contains(t, '{REQUIRED[0][0]}') THEN {_HITS(REQUIRED)} ELSE '' END AS required FROM t""")
def matched_keywords(spark, d):
    """Which keywords each feed item has, and which where one of them is required."""
    found = lambda words: F.array_join(scoring.feed_score(COL("title"), COL("description"), words)[1], ",")
    return feed_items(spark, d).select("guid", found(KEYWORDS).alias("any_of"), found(REQUIRED).alias("required"))
