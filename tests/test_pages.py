"""Captured pages of sources, small ones."""

import pytest

from skein.sources.pages import html_items

PAGES = {
    "bing_images": (
        """<ul class="dgControl_list x"><li><a class="iusc" m='{"murl":"https://i/1.png","turl":"https://t/1","purl":"https://p/1","desc":"d"}'></a>
        <div class="infnmpt"><a> A cat </a></div><div class="imgpt"><div><span>10x20 · png</span></div><div class="lnkw"><a>p</a></div></div></li>
        <li><a class="iusc" m='{"turl":"t"}'></a></li><li><a class="iusc" m='{no'></a></li><li>none</li></ul>""",
        [("A cat", "https://p/1", "d", {"thumbnail": "https://t/1", "image_url": "https://i/1.png", "source": "p", "format": "10x20 · png", "resolution": "10x20", "img_format": "png"})],
    ),
    "bing_videos": (
        """<div class="dmcv"><a class="title" href="/v">V<b>ery</b></a><img data-src="//t/1"><p class="caption">c</p>
        <span class="mc_vtvc_duration"><span class="dur">1:02</span></span><span class="mc_vtvc_meta_author">me</span><span class="mc_vtvc_meta_views">1.5K views</span></div>
        <div class="dmcv"><a class="title" href="/w">W</a><span class="mc_vtvc_meta_views">many</span></div><div class="dmcv"><a class="title" href="">X</a></div>""",
        [("Very", "/v", "c", {"thumbnail": "https://t/1", "duration": "1:02", "source": "me", "views": "1500"}), ("W", "/w", "", {})],
    ),
    "sogou_images": (
        """<div class="img-box"><a href="https://s/1"><img src="/1.jpg" alt=""></a></div><div class="img-box"><img data-original="https://o/2"> two </div><div class="img-box">no</div>""",
        [("", "https://s/1", "", {"thumbnail": "https://pic.sogou.com/1.jpg", "image_url": "/1.jpg"}), ("two", "", "", {"thumbnail": "https://o/2", "image_url": "https://o/2"})],
    ),
    "sogou_videos": (
        """<div class="video-box"><h3><a href="https://v/1">V</a></h3><img src="/1"><p class="desc">d</p><span class="duration">9:00</span></div><div class="video-box"><a href="x">no heading</a></div>""",
        [("V", "https://v/1", "d", {"thumbnail": "https://v.sogou.com/1", "duration": "9:00"})],
    ),
    "sogou_wechat": (
        """<li id="sogou_vr_1"><h3><a href="https://m/1">M</a></h3><p class="txt-info">t</p><div class="img-box"><a><img src="//i/1"></a></div><script>document.write(timeConvert('1700000000'))</script></li>
        <li id="sogou_vr_2"><h3><a href="/link?url=z">R</a></h3></li><li id="other"><h3><a href="https://n">N</a></h3></li>""",
        [("M", "https://m/1", "t", {"thumbnail": "https://i/1", "source": "WeChat", "published": "1700000000"})],
    ),
}


@pytest.mark.parametrize("source", PAGES)
def test_items(spark, source):
    page, want = PAGES[source]
    df = spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id bigint, html string")
    rows = html_items(df, source, "page_id").orderBy("page_id", "pos").collect()
    assert [(r.title, r.url, r.content, r.metadata) for r in rows] == want
    assert {r.page_id for r in rows} == {1}


def test_unclosed_tags_nest_without_end(spark):
    page = "<div>" * 3000 + "<b>" * 3000 + '<ol id="b_results"><li class="b_algo"><h2><a href="https://x.example">X</a></h2>' + "<p>" * 1200 + "said"
    got = html_items(spark.createDataFrame([(1, page)], "page_id bigint, html string"), "bing", "page_id").collect()
    assert [(r.title, r.url, r.content) for r in got] == [("X", "https://x.example", "said")]


def test_no_results_and_unknown_feeds(spark):
    from skein.sources import feeds

    page = 'There are no results <ol id="b_results"><li class="b_algo"><h2><a href="https://x.example">X</a></h2></ol>'
    assert html_items(spark.createDataFrame([(1, page)], "page_id bigint, html string"), "bing", "page_id").count() == 0
    odd = spark.createDataFrame([("a", "neither")], "feed_url string, body string")
    assert feeds.items(odd).count() == 0
    with pytest.raises(Exception, match="unknown feed format"):
        feeds.items(odd, unknown="error").collect()


def test_settings(tmp_path):
    from skein.operators import settings

    (tmp_path / "a.toml").write_text("[x]\ny = 1\n")
    (tmp_path / "a.json").write_text('{"x": {"y": 1}}')
    (tmp_path / "a.yaml").write_text("x: 1")
    assert settings.load(str(tmp_path / "a.toml")) == settings.load(str(tmp_path / "a.json")) == {"x": {"y": 1}}
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "a.yaml"))
    assert settings.from_environment(["port", "host"], "app", {"APP_PORT": "1"}) == {"port": "1"}
    assert settings.problems({"a": 1}, [lambda s: None, lambda s: "no b" if "b" not in s else None]) == ["no b"]


def test_full_cache(spark):
    from skein.operators import cache

    e = spark.createDataFrame([("a", 5), ("b", None)], "key string, expires_at bigint")
    new = spark.createDataFrame([("c", 9), ("d", 9)], "key string, expires_at bigint")
    with pytest.raises(cache.CacheFull):
        cache.put(e, new, capacity=2, now=6)
    assert {r.key for r in cache.put(e, new, capacity=3, now=6).collect()} == {"b", "c", "d"}


@pytest.mark.parametrize("source, row", [
    ("sogou", '<div class="vrwrap"><h3 class="vr-title"><a href="https://x/1">t</a></h3></span>'),
    ("yandex", '<div class="serp-item"><a class="link" href="https://x/1">t</a>'),
    ("bing_videos", '<div class="dmcv"><a class="title" href="https://x/1">t</a>'),
    ("xinhua", '<div class="result"><div class="title"><a href="https://x/1">t</a></b>'),
])
def test_pages_are_read_in_time_in_proportion_to_their_size(source, row):
    """100000 rows, each within the one before: a walk through each row's descendants would take hours."""
    import time

    from skein.sources import pages

    start = time.process_time()
    found = pages.PARSERS[source](pages.parse(row * 100_000))
    assert len(found) == (0 if source == "xinhua" else 100_000) and time.process_time() - start < 60


def test_one_pass_over_answers_of_all_engines(spark):
    from skein.sources.pages import responses_to_items

    df = spark.createDataFrame([(i, s, PAGES[s][0]) for i, s in enumerate(PAGES)] + [(90, "nobody", "<p>"), (91, "own", "a b"), (92, "bing", None)], "response_id bigint, engine string, body string")
    got = responses_to_items(df, sources={"own": lambda body: [{"title": w, "url": f"https://own/{w}", "metadata": {"n": 1}} for w in body.split()]})
    rows = {}
    for r in got.orderBy("response_id", "pos").collect():
        rows.setdefault(r.response_id, []).append((r.title, r.url, r.content, r.metadata))
    assert rows == {i: PAGES[s][1] for i, s in enumerate(PAGES)} | {91: [("a", "https://own/a", "", {"n": "1"}), ("b", "https://own/b", "", {"n": "1"})]}
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
