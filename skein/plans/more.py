"""Queries of the parsers, the stores and the settings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import cache, filters, paging, semantic, settings, state
from skein.plans.catalogue import CALLS, COL, ENTRIES, FEED, ITEMS, NOW, calls, entries, feed_items, items, query, r6, table
from skein.sources import feeds as feed_sources
from skein.sources import pages as page_sources

T0 = "TIMESTAMP '2024-01-01 00:00:00'"


def _bodies(spark, d, sql: str):
    """A page or an answer made of each benchmark item."""
    return table(spark, d, "benchmark").select(COL("item_id").alias("response_id"), F.expr(sql).alias("body"))


def _parsed(spark, d, source: str, sql: str, *told: str):
    made = page_sources.html_items(_bodies(spark, d, sql), source, "response_id", "body", F.expr(T0))
    return made.select("response_id", "pos", "title", "url", "content", *[F.coalesce(COL("metadata")[t], F.lit("")).alias(t) for t in told])


def _answered(spark, d, source: str, sql: str, *told: str):
    made = page_sources.json_items(_bodies(spark, d, sql), source, "response_id")
    return made.select("response_id", "pos", "title", "url", "content", *[F.coalesce(COL("metadata")[t], F.lit("")).alias(t) for t in told])


BING = """'<ol><li class="b_algo"><h2><a href="https://out.example">out</a></h2></li></ol><ol id="b_results"><li class="x"><h2><a href="https://no.example">no</a></h2></li><li class="b_algo big"><h2><a href="https://b.example/'
 || item_id || '"> Item <b>' || item_id || '</b> </a></h2><p>Web</p><p> ' || 'says ' || item_id || '</p><p>more</p></li><li class="b_algo"><h2><a href="/relative">rel</a></h2></li><li class="b_algo"><h2><span><a href="https://deep.example">deep</a></span></h2></li><li class="b_algo"><h2><a href="https://empty.example"></a></h2></li></ol>'"""
NEWS = """'<div class="news-card"><h3><a href="/n/' || item_id || '">News ' || item_id || '</a></h3><p class="snippet">s</p><div class="snippet">not this</div><span class="source">Paper</span><span class="date">2 hours ago</span><img data-src="//t.example/1.png"></div><div class="news-card"><h2><a href="/x">no</a></h2></div><div class="news-card"><h3><a href="">no</a></h3></div><div class="news-card"><h3><a href="https://k.example">Kept</a></h3><img src="/p.png"></div>'"""
YANDEX = """'<ul><li class="serp-item"><h2></h2><h3>Title ' || item_id || '</h3><a href="https://y.example/' || item_id || '">link</a><div class="text-container"></div><div class="text">said</div></li><li class="serp-item"><h2>relative</h2><a href="/r">r</a></li><li class="serp-item"><a class="link" href="http://z.example">Linked</a><div class="my-snippet-box">boxed</div></li></ul><div class="serp-item"><h2>other</h2><a href="https://o.example">o</a></div>'"""
YANDEX_LAST = """'<div class="x-serp-item-y"><h2>Odd ' || item_id || '</h2><a href="https://odd.example">o</a></div>'"""
SOGOU = """'<div class="vrwrap"><h3 class="vr-title"><a href="https://s.example/' || item_id || '">S ' || item_id || '</a></h3><div class="text-layout"><p class="star-wiki"> star </p></div></div><div class="vrwrap"><h3 class="vr-title"><a href="/link?url=z">gone</a></h3></div><div class="vrwrap"><h3><a href="https://no.example">no class</a></h3></div><div class="vrwrap"><h3 class="vr-title"><a href="/local">Local</a></h3><div class="fz-mid space-txt">mid</div></div>'"""
XINHUA = """'<div><a href="https://www.news.cn/">首页</a><a href="https://www.news.cn/a/' || item_id || '">A headline that is long enough ' || item_id || '</a><a href="https://www.news.cn/a/' || item_id || '">The same address once more, said otherwise</a><a href="https://other.example/article">An article of another host, which goes</a><a href="https://www.news.cn/s">short</a></div>'"""
IMAGES = """'<ul class="dgControl_list"><li><a class="iusc" m=''{"murl":"https://i.example/' || item_id || '.png","turl":"https://t.example/1","purl":"https://p.example/1","desc":"d"}''></a><div class="infnmpt"><a>Cat ' || item_id || '</a></div><div class="imgpt"><div><span>10x20 · png</span></div></div></li><li><a class="iusc" m=''{"turl":"t"}''></a></li></ul>'"""
VIDEOS = """'<div class="dmcv"><a class="title" href="/v/' || item_id || '">V</a><p class="caption">c</p><span class="mc_vtvc_meta_views">1.5K views</span><img data-src="//t.example/1"></div><div class="dmcv"><a class="title" href="">no</a></div>'"""
SOGOU_IMAGES = """'<div class="img-box"><a href="https://s.example/' || item_id || '"><img src="/1.jpg" alt="Alt"></a></div><div class="img-box">none</div><div class="img-box"><img data-original="https://o.example/2"> two </div>'"""
SOGOU_VIDEOS = """'<div class="video-box"><h3><a href="https://v.example/' || item_id || '">V</a></h3><p class="desc">d</p><span class="duration">9:00</span></div><div class="video-box"><a href="x">no heading</a></div>'"""
WECHAT = """'<li id="sogou_vr_1"><h3><a href="https://m.example/' || item_id || '">M</a></h3><p class="txt-info">t</p><script>document.write(timeConvert(''1700000000''))</script></li><li id="sogou_vr_2"><h3><a href="/link?url=z">R</a></h3></li><li id="other"><h3><a href="https://n.example">N</a></h3></li>'"""


def _rows(*rows: str) -> str:
    return " UNION ALL ".join(f"SELECT item_id AS response_id, {r} FROM benchmark" for r in rows)


@query(_rows("0 AS pos, 'Item ' || item_id AS title, 'https://b.example/' || item_id AS url, 'says ' || item_id AS content"))
def parse_bing(spark, d):
    return _parsed(spark, d, "bing", BING)


@query(_rows("0 AS pos, 'News ' || item_id AS title, '/n/' || item_id AS url, 's' AS content, 'Paper' AS source, 'https://t.example/1.png' AS thumbnail, '1704060000' AS published", "1, 'Kept', 'https://k.example', '', '', 'https://www.bing.com/p.png', ''"))
def parse_bing_news(spark, d):
    return _parsed(spark, d, "bing_news", NEWS, "source", "thumbnail", "published")


@query(_rows("0 AS pos, 'Title ' || item_id AS title, 'https://y.example/' || item_id AS url, 'said' AS content", "2, 'Linked', 'http://z.example', 'boxed'"))
def parse_yandex(spark, d):
    return _parsed(spark, d, "yandex", YANDEX)


@query(_rows("0 AS pos, 'Odd ' || item_id AS title, 'https://odd.example' AS url, '' AS content"))
def parse_yandex_last_selector(spark, d):
    return _parsed(spark, d, "yandex", YANDEX_LAST)


@query(_rows("0 AS pos, 'S ' || item_id AS title, 'https://s.example/' || item_id AS url, 'star' AS content", "1, 'Local', '/local', 'mid'"))
def parse_sogou(spark, d):
    return _parsed(spark, d, "sogou", SOGOU)


@query(_rows("0 AS pos, 'A headline that is long enough ' || item_id AS title, 'https://www.news.cn/a/' || item_id AS url, '' AS content"))
def parse_xinhua(spark, d):
    return _parsed(spark, d, "xinhua", XINHUA)


@query(_rows("0 AS pos, 'Cat ' || item_id AS title, 'https://p.example/1' AS url, 'd' AS content, 'https://i.example/' || item_id || '.png' AS image_url, '10x20' AS resolution, 'png' AS img_format"))
def parse_bing_images(spark, d):
    return _parsed(spark, d, "bing_images", IMAGES, "image_url", "resolution", "img_format")


@query(_rows("0 AS pos, 'V' AS title, '/v/' || item_id AS url, 'c' AS content, '1500' AS views, 'https://t.example/1' AS thumbnail"))
def parse_bing_videos(spark, d):
    return _parsed(spark, d, "bing_videos", VIDEOS, "views", "thumbnail")


@query(_rows("0 AS pos, 'Alt' AS title, 'https://s.example/' || item_id AS url, '' AS content, '/1.jpg' AS image_url", "1, 'two', '', '', 'https://o.example/2'"))
def parse_sogou_images(spark, d):
    return _parsed(spark, d, "sogou_images", SOGOU_IMAGES, "image_url")


@query(_rows("0 AS pos, 'V' AS title, 'https://v.example/' || item_id AS url, 'd' AS content, '9:00' AS duration"))
def parse_sogou_videos(spark, d):
    return _parsed(spark, d, "sogou_videos", SOGOU_VIDEOS, "duration")


@query(_rows("0 AS pos, 'M' AS title, 'https://m.example/' || item_id AS url, 't' AS content, '1700000000' AS published"))
def parse_sogou_wechat(spark, d):
    return _parsed(spark, d, "sogou_wechat", WECHAT, "published")


BAIDU = """CASE item_id % 4 WHEN 0 THEN '<html>' WHEN 1 THEN '{"feed":{"entry":[{"title":"F' || item_id || '","url":"https://f.example","content":"c"},{"title":"","url":"https://x.example"},{"title":"t","url":"/rel"}]}}'
 WHEN 2 THEN '{"results":[{"title":"captcha","link":"https://j.example"}]}' ELSE '{"results":[{"title":"R' || item_id || '","link":"https://r.example","summary":"s"}]}' END"""
BILIBILI = """'{"data":{"result":[{"title":"<em class=\\\\"keyword\\\\">Word</em> of ' || item_id || '","arcurl":"http://b.example/' || item_id || '","pic":"//p.example/1.jpg","description":"a &amp; b","author":"me","aid":' || item_id || ',"pubdate":1700000000,"duration":"1:02"},{"title":"no link"},{"title":"","arcurl":"http://x.example"}]}}'"""
UNSPLASH = """'{"results":[{"alt_description":null,"description":"D' || item_id || '","links":{"html":"https://u.example/p?a=1&ixid=zz"},"urls":{"thumb":"https://t.example/?ixid=1&w=2","regular":"https://g.example/?w=3"},"user":{"name":"Ann","links":{"html":"https://u.example/ann"}},"width":10,"height":20,"color":"#fff"},{"links":{}},{"links":{"html":"https://v.example/"}}]}'"""


@query("SELECT item_id AS response_id, 0 AS pos, 'F' || item_id AS title, 'https://f.example' AS url, 'c' AS content FROM benchmark WHERE item_id % 4 = 1 UNION ALL SELECT item_id, 0, 'R' || item_id, 'https://r.example', 's' FROM benchmark WHERE item_id % 4 = 3")
def parse_baidu(spark, d):
    return _answered(spark, d, "baidu", BAIDU)


@query(_rows("0 AS pos, 'Word of ' || item_id AS title, 'http://b.example/' || item_id AS url, 'a & b' AS content, 'https://p.example/1.jpg' AS thumbnail, 'me' AS author, '1:02' AS length, 'https://player.bilibili.com/player.html?aid=' || item_id || '&high_quality=1&autoplay=false&danmaku=0' AS iframe_src, '1700000000' AS published, 'Word' AS keywords"))
def parse_bilibili(spark, d):
    return _answered(spark, d, "bilibili", BILIBILI, "thumbnail", "author", "length", "iframe_src", "published", "keywords")


@query(_rows("0 AS pos, 'D' || item_id AS title, 'https://u.example/p?a=1' AS url, 'D' || item_id AS content, 'https://t.example/?w=2' AS thumbnail, 'https://g.example/?w=3' AS img_src, 'by Ann' AS photographer, '10' AS width, '#fff' AS color", "2, 'unknown', 'https://v.example/', '', '', '', '', '', ''"))
def parse_unsplash(spark, d):
    return _answered(spark, d, "unsplash", UNSPLASH, "thumbnail", "img_src", "photographer", "width", "color")


_MIXED = {0: ("bing", BING), 1: ("sogou", SOGOU), 2: ("bilibili", BILIBILI), 3: ("nobody", "'<p>'")}


@query("SELECT item_id AS response_id, 'bing' AS engine_name, 0 AS pos, 'https://b.example/' || item_id AS url FROM benchmark WHERE item_id % 4 = 0 UNION ALL SELECT item_id, 'sogou', 0, 'https://s.example/' || item_id FROM benchmark WHERE item_id % 4 = 1 UNION ALL SELECT item_id, 'sogou', 1, '/local' FROM benchmark WHERE item_id % 4 = 1 UNION ALL SELECT item_id, 'bilibili', 0, 'http://b.example/' || item_id FROM benchmark WHERE item_id % 4 = 2")
def dispatch_responses(spark, d):
    """Each engine's answers are read as its pages are."""
    b = table(spark, d, "benchmark")
    rows = None
    for k, (engine, sql) in _MIXED.items():
        own = b.where(COL("item_id") % 4 == k).select(COL("item_id").alias("response_id"), F.lit(engine).alias("engine"), F.expr(sql).alias("body"))
        rows = own if rows is None else rows.unionByName(own)
    return page_sources.responses_to_items(rows).select("response_id", "engine_name", "pos", "url")


@query("SELECT page_id, starts_with(ltrim(html), '<') OR starts_with(ltrim(html), 'Found') OR contains(html, 'captcha') OR contains(html, 'wappass.baidu.com') OR contains(lower(html), 'please verify') AS blocked FROM pages UNION ALL SELECT -doc_id - 1, contains(text, 'captcha') OR starts_with(ltrim(text), '<') OR starts_with(ltrim(text), 'Found') OR contains(lower(text), 'please verify') FROM documents")
def captcha_pages(spark, d):
    both = table(spark, d, "pages").select("page_id", COL("html").alias("body")).unionByName(table(spark, d, "documents").select((-COL("doc_id") - 1).alias("page_id"), COL("text").alias("body")))
    return both.select("page_id", filters.is_blocked_page(COL("body")).alias("blocked"))


# ---- feeds -----------------------------------------------------------------
_ENTITY = "item_id || ' a &amp;lt; b caf&eacute; &#8217; &#x4E2D; ' || text"


@query("SELECT item_id, trim(regexp_replace(item_id || ' a &lt; b café ’ 中 ' || text, '[\\s\\x0B\\x85\\p{Z}]+', ' ', 'g')) AS clean FROM benchmark")
def clean_entities(spark, d):
    """Entities are decoded once: what an ampersand's entity leaves is no entity again."""
    return table(spark, d, "benchmark").select("item_id", text.clean_text(F.expr(_ENTITY), 10**6).alias("clean"))


_ATOM = """'<feed>' || chr(10) || '<title>Feed ' || item_id || '</title>' || chr(10) || '<link href="https://feed.example/"/>' || chr(10) || '<entry>' || chr(10) || '<title>first</title>' || chr(10) || '  <title>Item ' || item_id || '</title>' || chr(10)
 || '<summary>no field</summary>' || chr(10) || '<content>c ' || item_id || '</content>' || chr(10) || '<updated>2024</updated><id>hidden</id>' || chr(10) || '<id>urn:' || item_id || '</id>' || chr(10) || '</entry>' || chr(10) || '</feed>'"""


@query("SELECT CAST(item_id AS VARCHAR) AS feed_url, 0 AS pos, 'Item ' || item_id AS title, '' AS link, CAST(NULL AS VARCHAR) AS description, 'c ' || item_id AS content, CAST(NULL AS VARCHAR) AS pub_date, 'urn:' || item_id AS guid FROM benchmark")
def atom_fields(spark, d):
    """The last line of a field counts, a summary is none, and a line is one field only."""
    f = table(spark, d, "benchmark").select(COL("item_id").cast("string").alias("feed_url"), F.expr(_ATOM.replace("chr(10)", "char(10)")).alias("body"))
    return feed_sources.items(f).select("feed_url", "pos", "title", "link", "description", "content", "pub_date", "guid")


_CHANNEL = "CASE WHEN item_id % 2 = 0 THEN '<rss><channel><link>https://c.example</link><language> en </language><item><title>of an item ' || item_id || '</title></item></channel></rss>' ELSE {atom} END"


@query("SELECT CAST(item_id AS VARCHAR) AS feed_url, CASE WHEN item_id % 2 = 0 THEN 'of an item ' ELSE 'Feed ' END || item_id AS title, CASE WHEN item_id % 2 = 0 THEN 'https://c.example' ELSE 'https://feed.example/' END AS link, CASE WHEN item_id % 2 = 0 THEN 'en' END AS language FROM benchmark")
def feed_channels(spark, d):
    sql = _CHANNEL.replace("{atom}", _ATOM.replace("chr(10)", "char(10)"))
    return feed_sources.channels(table(spark, d, "benchmark").select(COL("item_id").cast("string").alias("feed_url"), F.expr(sql).alias("body"))).select("feed_url", "title", "link", "language")


@query(f"""WITH {FEED}, stored AS (SELECT feed_url, pos, title, guid, 900 + pos * 100 AS expires_at FROM feed),
due AS (SELECT DISTINCT feed_url FROM feed WHERE CAST(feed_url AS BIGINT) % 3 = 0 OR CAST(feed_url AS BIGINT) % 3 = 1 AND 1000 - CAST(feed_url AS BIGINT) % 7 * 100 >= 500),
new AS (SELECT feed_url, 0 AS pos, 'new' AS title, feed_url || '-0' AS guid, 1000 + CASE WHEN CAST(feed_url AS BIGINT) % 3 = 0 THEN 3600 ELSE 500 END AS expires_at FROM due),
both_ AS (SELECT *, 0 AS gen FROM new UNION ALL SELECT s.*, 1 FROM stored s JOIN due USING (feed_url) WHERE expires_at > 1000)
SELECT feed_url, pos, title, expires_at FROM both_ QUALIFY row_number() OVER (PARTITION BY feed_url, guid ORDER BY gen, pos) = 1
UNION ALL SELECT feed_url, pos, title, expires_at FROM stored WHERE feed_url NOT IN (SELECT feed_url FROM due)""")
def refresh_feeds(spark, d):
    stored = feed_items(spark, d).withColumn("expires_at", 900 + COL("pos") * 100)
    feeds = stored.select("feed_url").distinct()
    k = COL("feed_url").cast("bigint")
    meta = feeds.where(k % 3 != 0).select("feed_url", (k % 7 * 100).alias("last_updated"), F.when(k % 3 == 1, 500).cast("bigint").alias("update_interval"))
    body = F.concat(F.lit("<rss><channel><item><title>new</title><guid>"), "feed_url", F.lit("-0</guid></item></channel></rss>"))
    return feed_sources.refreshed(stored, meta, feeds.select("feed_url", body.alias("body")), 1000).select("feed_url", "pos", "title", "expires_at")


@query("""SELECT 't' || item_id % 3 AS name, 'https://t.example/' || item_id AS feed_url, 'c' || item_id % 4 AS category, item_id % 2 = 0 AS answered FROM benchmark WHERE item_id % 4 IN (1, 2)""")
def template_feeds(spark, d):
    """Three templates with a feed for each benchmark item; two of four categories are asked for."""
    b = table(spark, d, "benchmark").select((COL("item_id") % 3).alias("t"), COL("item_id").alias("i"))
    one = F.create_map(F.concat(F.lit("c"), (COL("i") % 4).cast("string")), F.concat(F.lit("https://t.example/"), COL("i").cast("string")))
    t = b.select(F.concat(F.lit("t"), COL("t").cast("string")).alias("name"), F.lit(True).alias("persistent"), F.lit(3600).cast("bigint").alias("update_interval"), one.alias("urls"))
    answers = b.where("i % 2 = 0").select(F.concat(F.lit("https://t.example/"), COL("i").cast("string")).alias("feed_url"), F.lit("<rss>").alias("body"))
    return feed_sources.template_answers(t, answers, ["c1", "c2"]).select("name", "feed_url", "category", COL("body").isNotNull().alias("answered"))


# ---- stores ----------------------------------------------------------------
_SEM = "sem AS (SELECT conv_id AS c, turn, text, 'q' || (conv_id % 10) || ' word' || (conv_id % 10) AS query, CASE turn % 2 WHEN 0 THEN 'bing' ELSE 'yandex' END AS engine FROM conversations)"


def _stored(spark, d):
    c = table(spark, d, "conversations")
    k = (COL("conv_id") % 10).cast("string")
    rows = c.select(F.concat(F.lit("q"), k, F.lit(" word"), k).alias("query"), F.when(COL("turn") % 2 == 0, "bing").otherwise("yandex").alias("engine"), (COL("conv_id") * 1000 + COL("turn")).alias("pos"), F.lit("t").alias("title"), F.concat(F.lit("u"), (COL("conv_id") % 30).cast("string")).alias("url"), COL("text").alias("content"))
    return semantic.stored_rows(rows)


@query("WITH s AS (SELECT DISTINCT conv_id % 10 AS k FROM conversations), a AS (SELECT 'q' || k || ' word' || k AS asked, k FROM s) SELECT asked, asked AS query, 1.0::DOUBLE AS similarity FROM a")
def similar_stored_queries(spark, d):
    s = _stored(spark, d)
    return semantic.similar(s, s.select(COL("query").alias("asked")), 0.99).select("asked", "query", r6(COL("similarity")).alias("similarity"))


@query("WITH s AS (SELECT 'q' || (conv_id % 10) || ' word' || (conv_id % 10) AS query, turn % 2 AS e, conv_id * 1000 + turn AS pos, 'u' || (conv_id % 30) AS url FROM conversations) SELECT query AS asked, row_number() OVER (PARTITION BY query ORDER BY pos) AS place, url FROM s WHERE e = 0 UNION ALL SELECT 'word0 q0', place, url FROM (SELECT url, row_number() OVER (ORDER BY pos) AS place FROM (SELECT url, min(pos) AS pos FROM s WHERE e = 0 AND query = 'q0 word0' GROUP BY url)) WHERE place <= 50")
def semantic_get(spark, d):
    """A stored query gives its own items; another order of its words, those of the query next to it, each URL once."""
    s = _stored(spark, d)
    asked = s.select(COL("query").alias("asked")).distinct().unionByName(spark.createDataFrame([("word0 q0",), ("nothing like it",)], "asked string"))
    return semantic.get(s, asked, "bing").select("asked", "place", "url")


@query("WITH s AS (SELECT turn % 2 AS e, conv_id * 1000 + turn AS pos, 'u' || (conv_id % 30) AS url FROM conversations WHERE conv_id % 10 = 0), f AS (SELECT lower(url) AS url, e, pos FROM s QUALIFY row_number() OVER (PARTITION BY lower(url) ORDER BY e, pos) = 1) SELECT row_number() OVER (ORDER BY e, pos) AS place, url FROM f")
def semantic_combined(spark, d):
    return semantic.combined(_stored(spark, d), spark.createDataFrame([("q0 word0",)], "asked string")).select("place", "url")


@query("SELECT query, count(*) AS n FROM (SELECT 'q' || (conv_id % 10) || ' word' || (conv_id % 10) AS query, turn % 2 AS e FROM conversations) WHERE query <> 'q3 word3' AND NOT (query = 'q0 word0' AND e = 0) GROUP BY query UNION ALL SELECT 'q0 word0', -1")
def semantic_put_clear(spark, d):
    s = _stored(spark, d)
    new = spark.createDataFrame([("q0 word0", "bing", 0, "t", "u", "c")], "query string, engine string, pos bigint, title string, url string, content string")
    left = semantic.clear_query(semantic.put(s, new), "q3 word3")
    return left.where("content != 'c'").groupBy("query").agg(F.count("*").alias("n")).unionByName(left.where("content = 'c'").select("query", F.lit(-1).cast("bigint").alias("n")))


@query("SELECT CAST(item_id AS VARCHAR) AS name, CASE WHEN item_id % 5 = 0 THEN 'new' ELSE 'old' END AS value FROM benchmark WHERE item_id % 7 <> 0")
def metadata_store(spark, d):
    b = table(spark, d, "benchmark").select(COL("item_id").cast("string").alias("name"), "item_id")
    store = spark.createDataFrame([("engine_info:1", "other", 10)], "key string, value string, expires_at bigint")
    store = cache.put_metadata(store, b.select("name", F.lit("old").alias("value")), "metadata", 100)
    store = cache.put_metadata(store, b.where("item_id % 5 = 0").select("name", F.lit("new").alias("value")), "metadata", 200)
    return cache.get_metadata(cache.delete_metadata(store, b.where("item_id % 7 = 0"), "metadata"), "metadata", 300)


@query(f"WITH {ENTRIES} SELECT count(*) AS kept, 0 AS cleared FROM entries WHERE expires_at > 9000 OR doc_id % 5 = 0")
def cache_capacity(spark, d):
    """Expired entries make room; what is put stays."""
    e = entries(spark, d).select("key", "doc_id", "expires_at")
    left = cache.put(e, e.where("doc_id % 5 = 0"), capacity=e.count() - 1, now=9000)
    return left.agg(F.count("*").alias("kept")).join(cache.clear(e).agg(F.count("*").cast("int").alias("cleared")))


@query("SELECT count(*) AS total, count(*) FILTER (value * 10 > 300) AS expired, count(*) FILTER (NOT value * 10 > 300) AS active FROM events")
def dns_pool_stats(spark, d):
    return cache.pool_stats(table(spark, d, "events").select((COL("value") * 10).alias("age")), 300)


@query("SELECT count(*) AS requests, round(count(*) FILTER (event_type = 'view') / count(*)::DOUBLE, 6) AS hit_rate FROM events")
def connection_pool_hits(spark, d):
    return cache.connection_hit_rate(table(spark, d, "events").select((COL("event_type") == "view").alias("reused"))).withColumn("hit_rate", r6(COL("hit_rate")))


@query("SELECT conv_id AS query_id, count(*) AS batches, sum(turn + 1)::BIGINT AS total, max(turn + 1)::INTEGER AS longest FROM conversations GROUP BY conv_id")
def item_totals(spark, d):
    c = table(spark, d, "conversations")
    return cache.item_totals(c.select(COL("conv_id").alias("query_id"), F.sequence(F.lit(0), COL("turn").cast("int")).alias("items")))


# ---- settings and pages ----------------------------------------------------
_ENGINES = "engines AS (SELECT 'e' || doc_id AS name, doc_id % 3 <> 0 AS enabled, CAST(doc_id % 5 AS DOUBLE) AS weight, CASE WHEN doc_id % 2 = 0 THEN ['general', 'news'] ELSE ['images'] END AS categories FROM documents)"


def _engines(spark, d):
    k = COL("doc_id")
    cats = F.when(k % 2 == 0, F.array(F.lit("general"), F.lit("news"))).otherwise(F.array(F.lit("images")))
    return table(spark, d, "documents").select(F.concat(F.lit("e"), k.cast("string")).alias("name"), (k % 3 != 0).alias("enabled"), (k % 5).cast("double").alias("weight"), cats.alias("categories"))


@query(f"WITH {_ENGINES} SELECT name FROM engines WHERE enabled AND list_contains(categories, 'news')")
def enabled_engines(spark, d):
    return settings.enabled(_engines(spark, d), "news").select("name")


@query(f"WITH {_ENGINES} SELECT sum(weight) FILTER (enabled) AS every, sum(weight) FILTER (enabled AND list_contains(categories, 'images')) AS images FROM engines")
def engine_weights(spark, d):
    e = _engines(spark, d)
    return settings.weight_sum(e).select(COL("weight").alias("every")).join(settings.weight_sum(e, "images").select(COL("weight").alias("images")))


@query(f"SELECT conv_id AS query_id, turn AS ord, CASE turn % 3 WHEN 0 THEN 'bing' WHEN 1 THEN 'yandex' ELSE 'google' END AS engine FROM conversations WHERE turn % 3 = 0")
def select_engines(spark, d):
    """Asked engines that are allowed and not paused; yandex is paused here."""
    c = table(spark, d, "conversations")
    asked = c.select(COL("conv_id").alias("query_id"), COL("turn").alias("ord"), F.element_at(F.array(*map(F.lit, ("bing", "yandex", "google"))), (COL("turn") % 3 + 1).cast("int")).alias("engine"))
    states = spark.createDataFrame([("yandex", NOW + 60), ("bing", NOW - 60)], "engine string, disabled_until bigint")
    return settings.selected(asked, ["bing", "yandex"], states, NOW)


@query(f"WITH {ITEMS} SELECT doc_id FROM items ORDER BY doc_id DESC LIMIT 7 OFFSET 14")
def third_page(spark, d):
    return paging.page(items(spark, d), 3, 7, (F.desc("doc_id"),)).select("doc_id")


@query(f"""WITH {CALLS}, e AS (SELECT *, CASE WHEN outcome <> 'success' AND seq % 2 = 0 THEN 'HTTP status 500' WHEN outcome <> 'success' THEN 'parse' ELSE '' END AS error FROM calls),
o AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY ts, seq, outcome = 'success') AS n FROM e),
r AS (SELECT *, coalesce(max(CASE outcome WHEN 'success' THEN n END) OVER (PARTITION BY engine ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS healed FROM o)
SELECT engine, max(ts) FILTER (contains(error, 'status') AND n - healed >= 3) + 300 AS disabled_until, count(*) FILTER (outcome <> 'success') AS failures, max(ts) FILTER (outcome = 'success') AS re_enabled_at, bool_and(outcome <> 'success') AS temporarily_disabled
FROM r GROUP BY engine, healed HAVING count(*) FILTER (contains(error, 'status') AND n - healed >= 3) > 0""")
def engine_network_pauses(spark, d):
    """Every pause, and what ended it. Every call counts as a failure that isn't a success; those of even numbers are the network's."""
    failed = COL("outcome") != "success"
    error = F.when(failed & (COL("seq") % 2 == 0), "HTTP status 500").when(failed, "parse").otherwise("")
    return state.pause_log(calls(spark, d).withColumns({"error": error, "outcome": F.when(failed, "failure").otherwise("success")}))


@query(f"WITH {CALLS} SELECT engine, count(*) FILTER (outcome <> 'zero') AS total, count(*) FILTER (outcome = 'success') AS ok, count(*) FILTER (outcome = 'failure') AS failed FROM calls GROUP BY engine")
def engine_totals(spark, d):
    return state.fold_totals(calls(spark, d))
