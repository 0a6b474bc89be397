"""Request URLs by source: paging and time ranges pushed down to the source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import percent_encode, query_string

# Codes of time ranges.
_SECONDS = {"day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
_MINUTES = {"day": 1440, "week": 10080, "month": 44640, "year": 525600}
_BING = {"day": "1", "week": "2", "month": "3", "year": "4"}
_NEWS = {"day": 'interval="4"', "week": 'interval="7"', "month": 'interval="9"'}
_SOGOU = {"day": "inttime_day", "week": "inttime_week", "month": "inttime_month", "year": "inttime_year"}


def _of(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, str(v))])[key]


def urls(query: Column, page: Column, time_range: Column, now: Column | None = None, category: Column | None = None) -> dict[str, Column]:
    """URL of each source. page: from 1; time_range: day, week, month, year or null; now: epoch seconds; category: a number, of xinhua."""
    past = now - _of(_SECONDS, time_range).cast("bigint") if now is not None else F.lit(None).cast("bigint")
    span = F.concat(F.lit("stf="), past.cast("string"), F.lit(","), (now if now is not None else F.lit(None)).cast("string"), F.lit("|stftype=1"))
    later = page > 1
    form = F.when(page == 2, "PERE").when(page > 2, F.concat(F.lit("PERE"), (page - 2).cast("string")))
    first = F.when(later, (page - 1) * 10 + 1)
    age = F.concat(F.lit("filterui:age-lt"), _of(_MINUTES, time_range))
    ez = F.coalesce(F.concat(F.lit('&filters=ex1:"ez'), _of(_BING, time_range), F.lit('"')), F.lit(""))
    at = lambda base, pairs: F.concat(F.lit(base + "?"), query_string(pairs))
    from_ = _of(_SOGOU, time_range)
    hundred = [("query", query)]
    # Addresses and names of parameters.
    return {
        "bing": F.concat(at("https://www.bing.com/search", [("q", query), ("pq", query), ("first", first), ("FORM", form)]), ez),
        "baidu": at("https://www.baidu.com/s", [("wd", query), ("rn", F.lit(10)), ("pn", (page - 1) * 10), ("tn", F.lit("json")), ("gpc", span)]),
        "yandex": at("https://yandex.com/search/site/", [("tmpl_version", F.lit("releases")), ("text", query), ("web", F.lit(1)), ("frame", F.lit(1)), ("searchid", F.lit(3131712)), ("p", F.when(later, page - 1))]),
        "sogou": at("https://www.sogou.com/web", [*hundred, ("page", page), ("s_from", from_), ("tsn", F.when(from_.isNotNull(), 1))]),
        "bing_news": at("https://www.bing.com/news/infinitescrollajax", [("q", query), ("first", (page - 1) * 10 + 1), ("qft", _of(_NEWS, time_range))]),
        "bing_videos": at("https://www.bing.com/videos/asyncv2", [("q", query), ("async", F.lit("content")), ("first", (page - 1) * 35 + 1), ("count", F.lit(35)), ("qft", age)]),
        "bing_images": at("https://www.bing.com/images/async", [("q", query), ("async", F.lit("1")), ("first", (page - 1) * 35 + 1), ("count", F.lit(35)), ("qft", age)]),
        "bilibili": at("https://api.bilibili.com/x/web-interface/search/type", [("__refresh__", F.lit("true")), ("page", page), ("page_size", F.lit(20)), ("single_column", F.lit(0)), ("keyword", query), ("search_type", F.lit("video"))]),
        "unsplash": at("https://unsplash.com/napi/search/photos", [*hundred, ("page", page), ("per_page", F.lit(20))]),
        "sogou_images": at("https://pic.sogou.com/pics", [*hundred, ("start", (page - 1) * 20)]),
        "sogou_videos": at("https://v.sogou.com/v", [*hundred, ("page", page)]),
        "sogou_wechat": at("https://weixin.sogou.com/weixin", [*hundred, ("page", page), ("type", F.lit(2))]),
        "xinhua": F.concat(F.lit("https://so.news.cn/#search/"), (F.lit(0) if category is None else category).cast("string"), F.lit("/"), percent_encode(query), F.lit("/"), page.cast("string")),
    }
