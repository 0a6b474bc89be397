"""Captured pages and JSON answers as items.

HTML is read in Python, in Arrow batches: no SQL function follows a selector
through tags that are not closed.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.functions.text import absolute, decode_redirect, keywords_in, relative_date, strip_tags, unescape_six, view_count, without_parameter
from skein.operators.filters import NAVIGATION, TITLE_LENGTHS, has_link, is_blocked_page

ITEM = "pos int, title string, url string, content string, metadata map<string,string>"
# Parts of addresses of articles, in order, and the most results of a page.
XINHUA_LINKS = ("news.cn", "article")
XINHUA_MOST = 50
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Found:
    """Nodes in the order of the page, looked up as they are asked for."""

    def __init__(self, make: Callable[[], Iterator[Node]]):
        self._make, self._first = make, next(make(), None)

    def __bool__(self) -> bool:
        return self._first is not None

    def __getitem__(self, at: int) -> Node:
        if at or self._first is None:
            raise IndexError(at)
        return self._first

    def __iter__(self) -> Iterator[Node]:
        return self._make()


class Page:
    """The nodes of a page by number, in order, and lists of the numbers that a selector has, each made once."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self._lists: dict[tuple[str, str, str], list[int]] = {}

    def having(self, kind: str, tag: str, what: str) -> list[int]:
        """Numbers of the nodes of a tag (any if empty) with all of some classes, or a string in the class attribute."""
        key = (kind, tag, what)
        if key not in self._lists:
            of_tag = range(1, len(self.nodes)) if not tag else self._lists.get(("tag", tag, ""))
            if of_tag is None:
                of_tag = self._lists["tag", tag, ""] = [n.at for n in self.nodes if n.tag == tag]
            if kind == "part":
                self._lists[key] = [i for i in of_tag if what in self.nodes[i].attrs.get("class", "")]
            else:
                asked = set(what.split())
                self._lists[key] = [i for i in of_tag if not asked or asked <= set(self.nodes[i].classes())]
        return self._lists[key]


class Node:
    """An element; its descendants have the numbers from its own to ``end``."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, page: Page):
        self.tag, self.attrs, self.parent, self.children, self.page = tag, attrs, parent, [], page
        self.at = len(page.nodes)
        self.end = self.at + 1
        page.nodes.append(self)

    def fragments(self) -> Iterator[str]:
        """The texts in it, one by one; by a stack, as unclosed tags nest without end."""
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            else:
                stack += reversed(c.children)

    def text(self) -> str:
        """Fragments that are not blank, with single spaces."""
        return " ".join(" ".join(self.fragments()).split())

    def plain(self) -> str:
        """The text as it stands, without white space around it."""
        return "".join(self.fragments()).strip()

    def kids(self, tag: str, cls: str = "") -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.tag == tag and (not cls or cls in c.classes())]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def find(self, *path: tuple[str, str]) -> Found:
        """Descendants by (tag, classes), either of them empty for any; of a longer path, descendants of the one before."""
        return Found(lambda: below(self.page, iter([self]), [("class", *p) for p in path]))

    def holding(self, tag: str, part: str, *path: tuple[str, str]) -> Found:
        """Descendants whose class attribute holds a string, or what a path finds in them."""
        return Found(lambda: below(self.page, iter([self]), [("part", tag, part), *[("class", *p) for p in path]]))


def below(page: Page, found: Iterator[Node], path: list[tuple[str, str, str]]) -> Iterator[Node]:
    """Nodes of a path of selectors, each once. What one node has covered the nodes in it need not look at again."""
    for selector in path:
        found = _step(page, found, page.having(*selector))
    return found


def _step(page: Page, found: Iterator[Node], numbers: list[int]) -> Iterator[Node]:
    done = 0
    for f in found:
        for k in range(bisect_left(numbers, max(f.at + 1, done)), len(numbers)):
            if numbers[k] >= f.end:
                break
            yield page.nodes[numbers[k]]
        done = max(done, f.end)


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.root = self.at = Node("", {}, None, self.page)
        self.open: Counter[str] = Counter()

    def _leave(self) -> None:
        self.open[self.at.tag] -= 1
        self.at.end = len(self.page.nodes)
        self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == self.at.tag and tag in ("p", "li"):  # a paragraph or list item ends where the next begins
            self._leave()
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.page)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n
            self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        while self.open[tag] > 0:  # else there is nothing to close
            last = self.at.tag == tag
            self._leave()
            if last:
                break

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def finish(self) -> Node:
        self.close()
        while self.at is not self.root:
            self._leave()
        self.root.end = len(self.page.nodes)
        return self.root


def parse(html: str) -> Node:
    t = Tree()
    t.feed(html)
    return t.finish()


def _item(title: str, url: str, content: str, **metadata: str) -> dict:
    return {"title": title, "url": url, "content": content, "metadata": [(k, v) for k, v in metadata.items() if v]}


Nodes = list | Found


def _first(nodes: Nodes, attr: str = "") -> str:
    return (nodes[0].attrs.get(attr, "") if attr else nodes[0].text()) if nodes else ""


def _attr(nodes: Nodes, *names: str) -> str:
    """The first of the attributes that the first node has, be it empty."""
    return next((nodes[0].attrs[n] for n in names if n in nodes[0].attrs), "") if nodes else ""


def _plain(nodes: Nodes) -> str:
    return nodes[0].plain() if nodes else ""


def _joined(nodes: Nodes) -> str:
    return " ".join(n.plain() for n in nodes).strip()


def _first_text(choices: list[Nodes]) -> str:
    """The first text that is not empty among the first nodes of the choices."""
    return next((t for nodes in choices if (t := _plain(nodes))), "")


def bing(root: Node) -> list[dict]:
    """Rows of the list of results with a linked heading; the first paragraph that says something."""
    out = []
    for row in (x for ol in root.find(("ol", "")) if ol.attrs.get("id") == "b_results" for x in ol.kids("li", "b_algo")):
        link = next(([a] for h in row.find(("h2", "")) for a in h.kids("a")), [])
        said = (" ".join(f for f in p.fragments() if f.strip()).strip() for p in row.find(("p", "")))
        if link:
            out.append(_item(_plain(link), _attr(link, "href"), next((t for t in said if t not in ("", "Web")), "")))
    return out


def bing_news(root: Node) -> list[dict]:
    """Cards with a linked heading; date: as the card says it."""
    out = []
    for card in root.find(("div", "news-card")):
        link = card.find(("h3", ""), ("a", ""))
        if _plain(link) and _attr(link, "href"):
            told = {c: _plain(card.find(("span", c))) for c in ("source", "date")}
            out.append(_item(_plain(link), _attr(link, "href"), _plain(card.find(("p", "snippet"))), thumbnail=_attr(card.find(("img", "")), "src", "data-src"), **told))
    return out


def yandex(root: Node) -> list[dict]:
    """The first row selector that finds anything; of headings and snippets the first that say something."""
    out = []
    for r in root.find(("li", "serp-item")) or root.find(("div", "serp-item")) or root.holding("div", "serp-item"):
        title = _first_text([r.find(("h2", "")), r.find(("h3", "")), r.find(("a", "link"))])
        said = [r.find(("div", c)) for c in ("text-container", "OrganicTextContentSpan", "text")]
        out.append(_item(title, _attr(r.find(("a", "")), "href"), _first_text([*said, r.holding("div", "snippet")])))
    return out


def sogou(root: Node) -> list[dict]:
    """Redirects of the source are dropped, and rows without a linked heading."""
    out = []
    for r in root.find(("div", "vrwrap")):
        link = r.find(("h3", "vr-title"), ("a", ""))
        url = _attr(link, "href")
        if _plain(link) and url and not url.startswith("/link?url="):
            out.append(_item(_plain(link), url, _plain(r.find(("div", "text-layout"), ("p", "star-wiki")) or r.find(("div", "fz-mid space-txt")))))
    return out


def xinhua(root: Node) -> list[dict]:
    """Links of the first selector that gives a valid one; each address once."""
    every = root.find(("a", ""))
    choices = [[a for a in every if part in a.attrs.get("href", "")] for part in XINHUA_LINKS]
    choices += [root.holding("div", "result", ("a", "")), root.holding("div", "item", ("a", "")), root.find(("li", ""), ("a", "")), root.holding("", "title", ("a", ""))]
    for nodes in choices:
        out: dict[str, dict] = {}
        for a in nodes:
            title, url = a.plain(), a.attrs.get("href", "")
            if url and url not in out and is_valid(title, url):
                out[url] = _item(title, url, "")
        if out:
            return list(out.values())[:XINHUA_MOST]
    return []


def is_valid(title: str, url: str) -> bool:
    return TITLE_LENGTHS[0] <= len(title) <= TITLE_LENGTHS[1] and "news.cn" in url and not any(w in title for w in NAVIGATION)


def bing_images(root: Node) -> list[dict]:
    """Image, thumbnail, page and description come as JSON in an attribute; those without an image go."""
    out = []
    for r in root.find(("ul", "dgControl_list"), ("li", "")):
        try:
            known = json.loads(_attr(r.find(("a", "iusc")), "m") or "{}")
        except ValueError:
            known = {}
        of = lambda k: v if isinstance(known, dict) and isinstance(v := known.get(k), str) else ""
        if not of("murl"):
            continue
        form = _joined(r.find(("div", "imgpt"), ("div", ""), ("span", "")))
        resolution, kind = [*form.split(" · "), ""][:2]
        source = _joined(r.find(("div", "imgpt"), ("div", "lnkw"), ("a", "")))
        out.append(_item(_joined(r.find(("div", "infnmpt"), ("a", ""))), of("purl"), of("desc"), thumbnail=of("turl") or of("murl"), image_url=of("murl"), source=source, format=form, resolution=resolution, img_format=kind))
    return out


def bing_videos(root: Node) -> list[dict]:
    """Views are the text here; html_items makes numbers of them."""
    out = []
    for r in root.find(("div", "dmcv")):
        link = r.find(("a", "title"))
        if _plain(link) and _attr(link, "href"):
            seen = {"source": ("span", "mc_vtvc_meta_author"), "views": ("span", "mc_vtvc_meta_views")}
            duration = _plain(r.find(("span", "mc_vtvc_duration"), ("span", "dur")))
            out.append(_item(_plain(link), _attr(link, "href"), _plain(r.find(("p", "caption"))), thumbnail=_attr(r.find(("img", "")), "src", "data-src", "data-thumbsrc"), duration=duration, **{k: _plain(r.find(x)) for k, x in seen.items()}))
    return out


def sogou_images(root: Node) -> list[dict]:
    """A row may have no link; one without an image goes."""
    out = []
    for r in root.find(("div", "img-box")):
        image = r.find(("img", ""))
        src = _attr(image, "src", "data-src", "data-original")
        if src:
            out.append(_item(image[0].attrs["alt"] if "alt" in image[0].attrs else r.plain(), _attr(r.find(("a", "")), "href"), "", thumbnail=src, image_url=src))
    return out


def sogou_videos(root: Node) -> list[dict]:
    out = []
    for r in root.find(("div", "video-box")):
        link = r.find(("h3", ""), ("a", ""))
        if _plain(link) and _attr(link, "href"):
            out.append(_item(_plain(link), _attr(link, "href"), _plain(r.find(("p", "desc"))), thumbnail=_attr(r.find(("img", "")), "src", "data-src", "data-original"), duration=_plain(r.find(("span", "duration")))))
    return out


def sogou_wechat(root: Node) -> list[dict]:
    """Redirects are dropped; published: epoch seconds, which stand in a script."""
    out = []
    for r in root.find(("li", "")):
        link = r.find(("h3", ""), ("a", ""))
        url = _attr(link, "href")
        if "sogou_vr_" not in r.attrs.get("id", "") or not _plain(link) or not url or url.startswith("/link?url="):
            continue
        times = [m[1] for x in r.find(("script", "")) if (m := re.search(r"timeConvert\('([0-9]+)'\)", x.plain()))]
        out.append(_item(_plain(link), url, _plain(r.find(("p", "txt-info"))), thumbnail=_attr(r.find(("div", "img-box"), ("a", ""), ("img", "")), "src"), source="WeChat", published=times[-1] if times else ""))
    return out


def links(root: Node) -> list[dict]:
    """Any page: its title, links and first heading."""
    title = _first(root.find(("title", "")))
    return [_item(a.text(), a.attrs.get("href", ""), title) for a in root.find(("a", ""))]


PARSERS: dict[str, Callable[[Node], list[dict]]] = {
    f.__name__: f for f in (bing, bing_news, bing_images, bing_videos, yandex, sogou, sogou_images, sogou_videos, sogou_wechat, xinhua, links)
}
#: Sources whose rows need a title and an http address.
WEB = ("bing", "yandex", "baidu")
# What a page says that has no results.
NO_RESULTS = {"bing": "There are no results"}
# Hosts that relative thumbnails belong to.
HOSTS = {
    "bing_news": "https://www.bing.com",
    "bing_videos": "https://www.bing.com",
    "sogou_images": "https://pic.sogou.com",
    "sogou_videos": "https://v.sogou.com",
    "sogou_wechat": "https://weixin.sogou.com",
}


KINDS = {"pos": pa.int32(), "title": pa.string(), "url": pa.string(), "content": pa.string(), "metadata": pa.map_(pa.string(), pa.string())}


def _read(parser: Callable[[Node], list[dict]], nothing: str | None, html: str | None) -> list[dict]:
    return parser(parse(html or "")) if not html or nothing is None or nothing not in html else []


def _parsed(responses: DataFrame, key: str, body: str, reader: Callable[[str, str | None], list[dict]], engine: Column) -> DataFrame:
    """key, _engine and the columns of ITEM, as the reader of each row's engine finds them: one pass over all rows."""
    schema = StructType([*responses.select(key).schema.fields, *StructType.fromDDL(f"_engine string, {ITEM}").fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, (name, html) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = reader(name, html)
                keys += [i] * len(found)
                rows += [{"pos": n} | x for n, x in enumerate(found)]
            at = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([r[c] for r in rows], t) for c, t in KINDS.items())], names=[key, "_engine", *KINDS])

    return responses.select(key, engine.alias("_engine"), F.col(body).alias("_body")).mapInArrow(task, schema)


def _finished(items: DataFrame, engine: Column, now: Column | None) -> DataFrame:
    """Addresses decoded and completed, dates and views as numbers, by the engine of each row; rows of web sources need a title and an address."""
    metadata, url = F.col("metadata"), F.col("url")
    out = items.withColumn("url", F.when(engine == "bing", decode_redirect(url)).otherwise(url))
    for source, host in HOSTS.items():
        whole = F.transform_values(metadata, lambda k, v: F.when(k == "thumbnail", absolute(v, host)).otherwise(v))  # noqa: B023
        out = out.withColumn("metadata", F.when(engine == source, whole).otherwise(metadata))
    out = out.where(~engine.isin(*WEB) | has_link(F.col("title"), url))
    if now is not None:
        at = F.unix_timestamp(relative_date(metadata["date"], now)).cast("string")
        out = out.withColumn("metadata", F.when((engine == "bing_news") & at.isNotNull(), F.map_concat("metadata", F.create_map(F.lit("published"), at))).otherwise(metadata))
    views = F.transform_values(metadata, lambda k, v: F.when(k == "views", view_count(v).cast("string")).otherwise(v))
    return out.withColumn("metadata", F.when(engine == "bing_videos", F.map_filter(views, lambda k, v: v.isNotNull())).otherwise(metadata))


def html_items(responses: DataFrame, source: str, key: str, body: str = "html", now: Column | None = None) -> DataFrame:
    """key and the columns of ITEM; metadata has only what a source tells, pos the place on the page.

    now: the time from which relative dates count back; metadata then has them as published, in epoch seconds.
    """
    parser, nothing = PARSERS[source], NO_RESULTS.get(source)
    made = _parsed(responses, key, body, lambda _, html: _read(parser, nothing, html), F.lit(source))
    return _finished(made, F.lit(source), now).drop("_engine")


def variant(body: Column) -> Column:
    return F.try_parse_json(body)


def _field(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def _told(**values: Column) -> Column:
    """A map of what is known."""
    every = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.coalesce(v, F.lit("")) for v in values.values()]))
    known = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[v.isNotNull() for v in values.values()]))
    return F.map_filter(every, lambda k, v: known[k])


#: Where the rows of an answer are; the first that there is counts.
ROWS = {"baidu": ("$.feed.entry", "$.results"), "bilibili": ("$.data.result",), "unsplash": ("$.results",), "plugin": ("$.results",)}
JSON_SOURCES = ("baidu", "bilibili", "unsplash")


def _json_rows(source: str, v: Column) -> Column:
    return F.coalesce(*[F.try_variant_get(v, a, "array<variant>") for a in ROWS[source]])


def _json_item(source: str, x: Column) -> Column:
    """A struct of title, url, content and metadata."""
    metadata = F.create_map().cast("map<string,string>")
    if source == "baidu":
        cols = (_field(x, "$.title"), _field(x, "$.url", "$.link"), _field(x, "$.content", "$.abstract", "$.summary"))
    elif source == "bilibili":
        cols = (strip_tags(_field(x, "$.title")), _field(x, "$.arcurl"), unescape_six(_field(x, "$.description")))
        words = keywords_in(_field(x, "$.title"))
        frame = F.concat(F.lit("https://player.bilibili.com/player.html?aid="), F.coalesce(_field(x, "$.aid"), F.lit("0")), F.lit("&high_quality=1&autoplay=false&danmaku=0"))
        blank = lambda c: F.coalesce(c, F.lit(""))
        metadata = _told(
            thumbnail=absolute(_field(x, "$.pic"), "https:"), author=blank(_field(x, "$.author")), length=blank(_field(x, "$.duration")), iframe_src=frame, published=F.try_variant_get(x, "$.pubdate", "bigint").cast("string"),
            keywords=F.when(F.size(words) > 0, F.array_join(words, ",")),
        )
    elif source == "unsplash":
        cols = (F.coalesce(_field(x, "$.alt_description", "$.description"), F.lit("unknown")), without_parameter(_field(x, "$.links.html")), F.coalesce(_field(x, "$.description"), F.lit("")))
        metadata = _told(
            thumbnail=without_parameter(_field(x, "$.urls.thumb")), img_src=without_parameter(_field(x, "$.urls.regular")), photographer=F.concat(F.lit("by "), _field(x, "$.user.name")), photographer_url=_field(x, "$.user.links.html"),
            width=F.try_variant_get(x, "$.width", "bigint").cast("string"), height=F.try_variant_get(x, "$.height", "bigint").cast("string"), color=_field(x, "$.color"),
        )
    else:
        cols = (_field(x, "$.title"), _field(x, "$.url"), _field(x, "$.snippet", "$.content"))
    return F.struct(*[F.coalesce(c, F.lit("")).alias(n) for n, c in zip(("title", "url", "content"), cols)], metadata.alias("metadata"))


def _json_keeps(source: str, x: Column) -> Column:
    if source in WEB:
        return has_link(x["title"], x["url"])
    if source == "bilibili":
        return (x["url"] != "") & (x["title"] != "")
    return x["url"] != "" if source == "unsplash" else F.lit(True)


def json_items(responses: DataFrame, source: str, key: str, body: str = "body", blocked: str = "drop") -> DataFrame:
    """key, pos, title, url, content and metadata of JSON answers; a body that is no JSON, or asks for a captcha, has none.

    blocked="error": a captcha or a page in place of an answer is an error.
    """
    asked, stops = responses, is_blocked_page(F.col(body))
    if blocked == "error":
        asked = responses.withColumn(body, F.when(stops, F.raise_error(F.lit("the source asks for a captcha")).cast("string")).otherwise(F.col(body)))
    elif source == "baidu":
        asked = responses.where(~stops)
    rows = asked.select(key, F.posexplode(_json_rows(source, variant(F.col(body)))).alias("pos", "v"))
    made = rows.select(key, "pos", _json_item(source, F.col("v")).alias("x")).where(_json_keeps(source, F.col("x")))
    return made.select(key, "pos", "x.*")


def responses_to_items(responses: DataFrame, now: Column | None = None, sources: Mapping[str, Callable[[str], list[dict]]] | None = None) -> DataFrame:
    """Items of captured answers (response_id, engine, body), each read as its engine's answers are.

    One pass over the answers that are read in Python (pages, and what
    ``sources`` of other names parse: see registry), one over JSON answers;
    each names its engines to the scan. Answers of unknown engines have no items.
    """
    own = {k: f for k, f in (sources or {}).items() if k not in PARSERS and k not in JSON_SOURCES}
    names = [k for k in PARSERS if k != "links"]

    def reader(engine: str, body: str | None) -> list[dict]:
        if engine in own:
            return [_item(*(str(r.get(k) or "") for k in ("title", "url", "content")), **{k: str(v) for k, v in (r.get("metadata") or {}).items()}) for r in own[engine](body or "")]
        return _read(PARSERS[engine], NO_RESULTS.get(engine), body)

    engine = F.col("engine")
    pages = _finished(_parsed(responses.where(engine.isin(*names, *own)), "response_id", "body", reader, engine), F.col("_engine"), now)
    columns = ["response_id", "engine_name", "pos", "title", "url", "content", "metadata"]
    answers = responses.where(engine.isin(*JSON_SOURCES)).where((engine != "baidu") | ~is_blocked_page(F.col("body")))
    v = variant(F.col("body"))
    pick = lambda of: F.coalesce(*[F.when(engine == s, of(s)) for s in JSON_SOURCES])
    rows = answers.select("response_id", "engine", F.posexplode(pick(lambda s: _json_rows(s, v))).alias("pos", "v"))
    made = rows.withColumn("x", pick(lambda s: _json_item(s, F.col("v")))).where(pick(lambda s: _json_keeps(s, F.col("x"))))
    told = made.select("response_id", engine.alias("engine_name"), "pos", "x.*")
    return pages.withColumnRenamed("_engine", "engine_name").select(*columns).unionByName(told.select(*columns))
