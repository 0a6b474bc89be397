from pyspark.sql import functions as F

from skein.functions import scoring, text
from skein.operators import dedup, state
from skein.sources import feeds, pages, registry


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "q string").select(f(F.col("q")).alias("x")).first().x


def test_clean_text_counts_bytes_and_cuts_characters(spark):
    assert one(spark, "  hello   world  ", lambda q: text.clean_text(q, 200)) == "hello world"
    assert one(spark, "a" * 300, lambda q: text.clean_text(q, 200)) == "a" * 197 + "..."
    assert one(spark, "字" * 70, lambda q: text.clean_text(q, 200)) == "字" * 70 + "..."


def test_bm25_prefers_repeated_words(spark):
    df = spark.createDataFrame([("rust rust rust",), ("rust programming language",), ("",)], "t string")
    got = [r.s for r in df.select(scoring.bm25(text.tokenize(F.col("t")), ["rust"], F.lit(3.0)).alias("s")).collect()]
    assert 0 < got[1] < got[0] <= 1 and got[2] == 0


def test_exact_match(spark):
    assert one(spark, "Rust", lambda q: scoring.exact_match(q, "rust")) == 1.0
    assert one(spark, "rust book", lambda q: scoring.exact_match(q, "rust")) == 0.8
    assert one(spark, "go", lambda q: scoring.exact_match(q, "rust")) == 0.0


def test_round_robin_starts_with_each_source(spark):
    rows = [(0, 0, "A1"), (0, 1, "A2"), (1, 0, "B1"), (1, 1, "B2"), (1, 2, "A1")]
    df = spark.createDataFrame(rows, "engine_ord int, pos int, url string")
    assert [r.url for r in dedup.round_robin(df).collect()][:2] == ["A1", "B1"]


def test_state_uses_the_truncating_mean(spark):
    calls = [("e", t, t, o, ms) for t, (o, ms) in enumerate([("success", 100), ("failure", 0), ("success", 51), ("zero", 0), ("zero", 0)])]
    r = state.fold(spark.createDataFrame(calls, "engine string, ts bigint, seq bigint, outcome string, response_ms bigint")).first()
    assert (r.total, r.ok, r.failed, r.consecutive, r.avg_ms, r.disabled_until) == (3, 2, 1, 2, 83, 4 + 25 * 60)


def test_feed_scan_tolerates_what_is_no_xml(spark):
    body = "<rss><channel><title>c</title><item><title>a & b</title><link>l</link></item><item><title><![CDATA[x]]></title></item></rss>"
    got = feeds.items(spark.createDataFrame([("f", body)], "feed_url string, body string")).orderBy("pos").collect()
    assert [(r.pos, r.title, r.link) for r in got] == [(0, "a & b", "l"), (1, "x", None)]


def test_result_page(spark):
    html = '<ol id="b_results"><li class="b_algo"><h2><a href="https://x.example/">T</a></h2><p>Web</p><p>said</p></li></ol>'
    r = pages.html_items(spark.createDataFrame([(1, html)], "k int, html string"), "bing", "k").first()
    assert (r.title, r.url, r.content) == ("T", "https://x.example/", "said")


def test_registry():
    registry.register_engine("mine", "web", "", [], lambda q: {"results": []})
    assert registry.has_engine("mine") and "bing" in registry.list_engines()
    assert registry.unregister_engine("mine") and not registry.unregister_engine("mine")


def each(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "id int, q string").select("id", f(F.col("q")).alias("x"))
    return [r.x for r in df.orderBy("id").collect()]


def test_intents(spark):
    said = ["site:example.com", "buy shoes", "restaurant near me", "购买笔记本电脑", "news: today", "新闻 头条", "头条 新闻", "image: cat", "video: dog", "code: rust", "plain words"]
    want = ["navigational", "transactional", "local", "transactional", "news", "news", "informational", "image", "video", "code", "informational"]
    assert each(spark, said, text.detect_intent) == want


def test_filters_in_queries(spark):
    got = each(spark, ["rust lang:en site:example.com", "language:zh x other:1 y", "plain", "a b:c d"], text.parse_filters)
    assert [tuple(r) for r in got] == [("rust", "en", "example.com"), ("x y", "zh", None), ("plain", None, None), ("a d", None, None)]


def test_relative_dates_and_views(spark):
    now = F.timestamp_seconds(F.lit(1_706_000_000))
    ago = lambda q: (F.unix_timestamp(now) - F.unix_timestamp(text.relative_date(q, now))).cast("int")
    assert each(spark, ["5 minutes ago", "2 hours ago", "3 days ago", "1 week ago", "2 months ago", "yesterday", "about 4 hours"], ago) == [300, 7200, 259200, 604800, None, None, 14400]
    assert each(spark, ["1.2K views", "3M views", "2b views", "17 views", "1.5 k views", "12 likes", "view"], text.view_count) == [1200, 3000000, 2000000000, 17, None, None, None]


def test_cleaned_and_escaped_queries(spark):
    said = ['  Hello   "World" -x +y!?', "c'est \"bon\"", "a\\b"]
    assert each(spark, said, text.clean_query) == ['Hello "World" -x +y', 'cest "bon"', "ab"]
    assert each(spark, said, text.escape_special) == ['  Hello   \\\\"World\\\\" -x +y!?', "c\\\\'est \\\\\"bon\\\\\"", "a\\\\b"]


def test_rewritten_addresses(spark):
    said = ["https://www.bing.com/ck/a?!&&p=1&u=a1aHR0cHM6Ly9leGFtcGxlLmNvbS94", "https://plain.example/x", "//img.example/a.png", "/rel.png", "https://u.example/p?ixid=1&w=2"]
    assert each(spark, said, text.decode_redirect) == ["https://example.com/x", *said[1:]]
    assert each(spark, said, lambda q: text.absolute(q, "https://www.bing.com"))[2:4] == ["https://img.example/a.png", "https://www.bing.com/rel.png"]
    assert each(spark, said, text.without_parameter)[4] == "https://u.example/p?w=2"


def test_keyword_specifications(spark):
    said = ["rust:3", "rust", "rust:much", "rust:99", "rust:0.5", " rust : 2 ", "a:b:c"]
    assert [tuple(r) for r in each(spark, said, scoring.keyword_spec)] == [(w, x) for w, x, _ in scoring.keyword_list(said)]


def test_addresses_page_by_page(spark):
    from skein.sources import requests

    row = spark.createDataFrame([("a b", 3, "week")], "q string, p int, r string")
    got = row.select(*[u.alias(n) for n, u in requests.urls(F.col("q"), F.col("p"), F.col("r"), F.lit(1_706_000_000).cast("bigint")).items()]).first()
    assert got.bing == 'https://www.bing.com/search?q=a%20b&pq=a%20b&first=21&FORM=PERE1&filters=ex1:"ez2"'
    assert got.baidu == "https://www.baidu.com/s?wd=a%20b&rn=10&pn=20&tn=json&gpc=stf%3D1705395200%2C1706000000%7Cstftype%3D1"
    assert got.xinhua == "https://so.news.cn/#search/0/a%20b/3" and got.sogou_images == "https://pic.sogou.com/pics?query=a%20b&start=40"


def test_texts_cut_at_bytes(spark):
    from skein.operators.formats import cut_bytes

    for t in ("a" * 300, "字" * 70, "a" + "😀" * 60, "é" * 100, "é" * 101, "short", ""):
        head = t.encode()[:200].decode(errors="ignore")
        assert one(spark, t, lambda q: cut_bytes(q, 200)) == (t if len(t.encode()) <= 200 else head + "...")


def test_seen_addresses_of_a_session(spark, tmp_path):
    from skein.streaming import health

    rows = [(f"https://x/{i % 4}", i) for i in range(12)]
    spark.createDataFrame(rows, "url string, s long").select("url", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in"))
    q = health.unseen(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.url for r in spark.table("seen").collect()) == [f"https://x/{i}" for i in range(4)]


def test_answers_that_ask_for_a_captcha(spark):
    import pytest

    df = spark.createDataFrame([(1, '{"results":[{"title":"T","url":"http://x"}]}'), (2, "<html>captcha</html>")], "response_id int, body string")
    assert [r.response_id for r in pages.json_items(df, "baidu", "response_id").collect()] == [1]
    with pytest.raises(Exception, match="asks for a captcha"):
        pages.json_items(df, "baidu", "response_id", blocked="error").collect()


def test_nearest_in_tiles_of_any_size(spark, monkeypatch):
    import numpy as np
    from skein.operators import nearest

    monkeypatch.setattr(nearest, "ASKED", 7)
    monkeypatch.setattr(nearest, "STORED", 11)
    v = np.random.default_rng(5).normal(size=(60, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 3 == 0, 0.2, 4).orderBy("query_id", F.desc("score"), "vec_id").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    s = np.round(np.clip(v @ v.T, 0, 1), 6)
    want = {i: [(j, s[i, j]) for j in sorted((j for j in range(60) if j != i and s[i, j] >= 0.2), key=lambda j: (-s[i, j], j))[:4]] for i in range(0, 60, 3)}
    assert {k: [j for j, _ in x] for k, x in got.items()} == {k: [j for j, _ in x] for k, x in want.items() if x}
