"""Text, URL and query functions, as Column expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space (Java's \s is ASCII only).
SPACE = r"[\s\u0085\p{Z}]+"
# Entities that a tag-stripper replaces one after the other, in order.
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&nbsp;", " "))
#: All named entities, as "\x1ename\x1ftext\x1e..."; in this form one search finds a name.
NAMED = "\x1e" + "".join(f"{k[:-1]}\x1f{v}\x1e" for k, v in sorted(html5.items()) if k.endswith(";"))
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# Substrings by intent, in the order of their tests.
INTENTS = (
    ("navigational", ("site:",), ()),
    ("transactional", ("buy", "price", "购买"), ()),
    ("local", ("near me", "附近"), ()),
    ("news", ("news:",), ("新闻",)),
    ("image", ("image:", "图片"), ()),
    ("video", ("video:", "视频"), ()),
    ("code", ("code:", "代码"), ()),
)
# Ranges that count as Chinese.
CHINESE = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{2ceb0}-\x{2ebef}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"
# What no query may hold.
MALICIOUS = ("<script", "</script>", "javascript:", "data:", "vbscript:", "onload=", "onerror=", "onclick=", "onmouseover=")
# Levels of safe search.
SAFE_SEARCH = {"none": 0, "moderate": 1, "strict": 2}
UNITS = (("minute", "MINUTES"), ("hour", "HOURS"), ("day", "DAYS"), ("week", "WEEKS"))


def _any(items: list[Column]) -> Column:
    out = F.lit(False)
    for x in items:
        out = out | x
    return out


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def unescape_six(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _decoded(entity: Column) -> Column:
    """What an entity stands for; itself if nothing."""
    name = F.substring(entity, F.lit(2), F.length(entity) - 2)
    hexed = F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.substring(name, F.lit(3), F.length(name))).otherwise(F.conv(F.substring(name, F.lit(2), F.length(name)), 10, 16))
    wide = F.lpad(hexed, 8, "0")
    sound = (F.conv(hexed, 16, 10).cast("bigint").between(1, 0x10FFFF)) & ~F.conv(hexed, 16, 10).cast("bigint").between(0xD800, 0xDFFF)
    number = F.when(sound, F.decode(F.unhex(wide), "UTF-32"))
    table, key = F.lit(NAMED), F.concat(F.lit("\x1e"), name, F.lit("\x1f"))
    named = F.when(F.contains(table, key), F.substring_index(F.call_function("substring_index", table, key, F.lit(-1)), "\x1e", 1))
    return F.coalesce(F.when(F.startswith(name, F.lit("#")), number).otherwise(named), entity)


def unescape(text: Column) -> Column:
    """HTML entities decoded, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), _decoded)
    parts = F.zip_with(F.split(text, ENTITY, -1), F.concat(found, F.array(F.lit(""))), lambda gap, e: F.concat(gap, e))
    # Few texts have an ampersand, which is quickly seen.
    return F.when(F.contains(text, F.lit("&")) & text.rlike(ENTITY), F.array_join(parts, "")).otherwise(text)


def clean_text(text: Column, most: int) -> Column:
    """Collapsed and unescaped; over most *bytes*: its first most - 3 characters and dots."""
    t = unescape(collapse(text))
    return F.when(F.octet_length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def tokenize(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def terms(text: Column) -> Column:
    """Tokens of the vectoriser: split at white space, bare ends, of over one byte."""
    bare = F.transform(F.split(F.lower(text), SPACE), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda x: F.octet_length(x) > 1)


def term_counts(tokens: Column) -> Column:
    """(term, n) of each token, sorted; tokens are sorted once, and runs of equal ones measured."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1) != x), i)), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t)) - i).alias("n")))), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(tokens)), runs), F.lit(0))


def normalize_url(url: Column) -> Column:
    u = F.lower(url)
    for part in ("https://", "http://", "www."):
        u = F.replace(u, F.lit(part), F.lit(""))
    return F.regexp_replace(u, "/+$", "")


def url_key(url: Column) -> Column:
    return F.trim(F.lower(url))


def domain(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def page_info(url: Column) -> Column:
    """scheme, host, port and path_depth of a URL that can be read, as a map."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+(/[^?#]*)?", 1)
    port = F.regexp_extract(url, r"^[a-z]+://[^/?#]*:([0-9]+)", 1)
    depth = F.size(F.split(F.regexp_replace(F.when(path == "", "/").otherwise(path), "^/", ""), "/")).cast("string")
    entries = F.array(F.struct(F.lit("scheme"), part("PROTOCOL")), F.struct(F.lit("host"), part("HOST")), F.struct(F.lit("port"), F.nullif(port, F.lit(""))), F.struct(F.lit("path_depth"), depth))
    return F.when(part("HOST").isNotNull(), F.map_filter(F.map_from_entries(entries), lambda k, v: v.isNotNull()))


def favicon(url: Column) -> Column:
    return F.concat(F.lit("https://"), domain(url), F.lit("/favicon.ico"))


def percent_encode(text: Column) -> Column:
    e = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_string(pairs: list[tuple[str, Column]]) -> Column:
    """Pairs of a null value are left out."""
    return F.concat_ws("&", *[F.concat(percent_encode(F.lit(k)), F.lit("="), percent_encode(v.cast("string"))) for k, v in pairs])


def decode_redirect(url: Column, prefix: str = "https://www.bing.com/ck/a?") -> Column:
    """The target in parameter u (two characters, then url-safe base64), or the URL itself."""
    u = F.translate(F.substring(F.try_parse_url(url, F.lit("QUERY"), F.lit("u")), 3, 1 << 20), "-_", "+/")
    padded = F.rpad(u, (F.ceil(F.length(u) / 4) * 4).cast("int"), F.lit("="))
    target = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when(F.startswith(url, F.lit(prefix)) & (F.length(u) > 0), F.coalesce(target, url)).otherwise(url)


def without_parameter(url: Column, name: str = "ixid") -> Column:
    base, query = F.substring_index(url, "?", 1), F.when(F.contains(url, F.lit("?")), F.regexp_extract(url, r"\?(.*)$", 1))
    kept = F.array_join(F.transform(F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1) != name), lambda p: F.try_url_decode(p)), "&")
    return F.when(query.isNull(), url).when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def absolute(url: Column, host: str) -> Column:
    return F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).when(~F.startswith(url, F.lit("http")), F.concat(F.lit(host), url)).otherwise(url)


def keywords_in(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"<em class=[^>]*keyword[^>]*>([^<]*)</em>"), F.lit(1))


def strip_tags(html: Column) -> Column:
    return collapse(unescape_six(F.regexp_replace(html, "<[^>]*>", "")))


def safe_search(level: Column) -> Column:
    """The number of a level, whatever its case; null for others."""
    return F.create_map(*[F.lit(x) for kv in SAFE_SEARCH.items() for x in kv])[F.lower(level)]


def collect_text(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, rf"^{SPACE}|{SPACE}$", "")), lambda p: p != ""), " ")


def normalize_query(query: Column) -> Column:
    return F.lower(F.regexp_replace(query, rf"^{SPACE}|{SPACE}$", ""))


def detect_intent(query: Column) -> Column:
    out = None
    for name, inside, ahead in INTENTS:
        test = _any([F.contains(query, F.lit(x)) for x in inside] + [F.startswith(query, F.lit(x)) for x in ahead])
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("informational")


def query_language(query: Column) -> Column:
    return F.when(query.rlike(r"[\x{4e00}-\x{9fff}]"), "zh").when(query.rlike(r"^\p{ASCII}*$"), "en")


def document_language(title: Column, content: Column) -> Column:
    text = F.concat(title, F.lit(" "), content)
    chinese = F.length(text) - F.length(F.regexp_replace(text, CHINESE, ""))
    return F.when(chinese / F.length(text) > 0.3, "zh").otherwise("en")


def clean_query(query: Column, ascii_only: bool = True) -> Column:
    kept = r"[^A-Za-z0-9\s\u0085\p{Z}\-+\"]" if ascii_only else r"[^\p{L}\p{N}\s\u0085\p{Z}\-+\"]"
    return collapse(F.regexp_replace(query, kept, ""))


def escape_special(query: Column) -> Column:
    """The backslashes of earlier escapes are doubled, as the original does."""
    q = F.replace(F.replace(query, F.lit('"'), F.lit('\\"')), F.lit("'"), F.lit("\\'"))
    return F.replace(q, F.lit("\\"), F.lit("\\\\"))


def parse_filters(query: Column) -> Column:
    """text, language and site of a query with filters; any word with a colon leaves the text."""
    parts = F.filter(F.split(query, SPACE), lambda p: p != "")
    value = lambda names: F.regexp_extract(F.element_at(F.filter(parts, lambda p: F.substring_index(p, ":", 1).isin(*names) & F.contains(p, F.lit(":"))), -1), r"^[^:]*:(.*)$", 1)
    some = lambda names: F.when(F.exists(parts, lambda p: F.substring_index(p, ":", 1).isin(*names) & F.contains(p, F.lit(":"))), value(names))
    text = F.array_join(F.filter(parts, lambda p: ~F.contains(p, F.lit(":"))), " ")
    return F.struct(text.alias("text"), some(("lang", "language")).alias("language"), some(("site",)).alias("site"))


def query_problem(query: Column, page: Column, page_size: Column) -> Column:
    """Why a query is refused, or null."""
    low = F.lower(query)
    return (
        F.when(F.regexp_replace(query, SPACE, "") == "", "empty query")
        .when(F.octet_length(query) > 1000, "query too long")
        .when(_any([F.contains(low, F.lit(p)) for p in MALICIOUS]), "malicious content")
        .when(page < 1, "invalid page")
        .when(~page_size.between(1, 100), "invalid page size")
    )


def first_number(text: Column) -> Column:
    found = F.filter(F.transform(F.split(text, SPACE), lambda w: F.when(w.rlike(r"^[+-]?[0-9]+$"), w).try_cast("bigint")), lambda n: n.isNotNull())
    return F.get(found, F.lit(0))


def relative_date(text: Column, now: Column) -> Column:
    """now less a number of minutes, hours, days or weeks; else null."""
    low, out = F.lower(text), None
    n = first_number(low)
    seconds = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    for unit, _ in UNITS:
        at = F.timestamp_seconds(F.unix_timestamp(now) - n * seconds[unit])
        out = F.when(F.contains(low, F.lit(unit)), at) if out is None else out.when(F.contains(low, F.lit(unit)), at)
    return out


def view_count(text: Column) -> Column:
    low = F.lower(text)
    clean = F.trim(F.replace(F.replace(low, F.lit("views"), F.lit("")), F.lit("view"), F.lit("")))
    base = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]*)?|\.[0-9]+)[kmb]$", 1)
    scale = F.when(F.endswith(clean, F.lit("k")), 1e3).when(F.endswith(clean, F.lit("m")), 1e6).when(F.endswith(clean, F.lit("b")), 1e9)
    scaled = F.when(base != "", F.floor(base.try_cast("double") * scale))
    plain = F.when(clean.rlike(r"^\+?[0-9]+$"), clean).try_cast("bigint")
    return F.when(F.contains(low, F.lit("view")), F.when(scale.isNotNull(), scaled).otherwise(plain))
