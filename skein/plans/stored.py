"""Queries over stored indexes and states, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import aggregate, answers, fulltext, state, store, textindex
from skein.operators.scan import work_folder
from skein.plans.catalogue import _FOLD, _K1, _K2, _SQL, COL, COPIES, ENTRIES, ITEMS, calls, clean, entries, feed_items, items, query, r6, table, toks, with_copies


def new_folder(spark, name: str) -> str:
    return f"{work_folder(spark, name)}/{name}"


@query(_SQL["fulltext_search_whole"])
def fulltext_indexed(spark, d):
    """fulltext_search_whole, with cached entries and feeds found by their trigrams."""
    folder = new_folder(spark, "fulltext")
    cached = entries(spark, d).withColumns({"url": F.upper("url"), "score": F.lit(0.1)})
    feed = feed_items(spark, d).withColumns({"key": COL("feed_url"), "content": F.lit(None).cast("string")})
    textindex.build(cached, ["title", "content", "url"], f"{folder}/cached")
    textindex.build(feed, ["title", "description", "link"], f"{folder}/feeds")
    net = items(spark, d).withColumns({"position": COL("doc_id"), "score": F.lit(0.2)})
    return fulltext.search_indexed(net, f"{folder}/cached", f"{folder}/feeds", f"{_K1} {_K2}").select("url", r6(COL("score")).alias("score"))


@query(rf"""WITH {ENTRIES}, w AS (SELECT item_id AS query_id, unnest(list_slice({toks("text")}, 2, 3)) AS word FROM benchmark UNION ALL SELECT -1, 'zu'),
h AS (SELECT DISTINCT query_id, key, pos, doc_id FROM w JOIN entries e ON contains(lower(e.title), word) OR contains(lower(e.content), word) OR contains(lower(e.url), word))
SELECT query_id, doc_id FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY key, pos) <= 50""")
def fulltext_many(spark, d):
    """Two words of every benchmark item, and one too short for the index, asked at once."""
    from skein.functions import text

    folder = new_folder(spark, "fulltext")
    textindex.build(entries(spark, d), ["title", "content", "url"], folder)
    b = table(spark, d, "benchmark").select(COL("item_id").alias("query_id"), F.explode(F.slice(text.tokenize(COL("text")), 2, 2)).alias("word"))
    b = b.unionByName(spark.createDataFrame([(-1, "zu")], "query_id bigint, word string"))
    return textindex.search(spark, folder, b, ["title", "content", "url"], 50).select("query_id", "doc_id")


@query(f"{_FOLD} SELECT engine, total, ok, failed, consecutive, avg_ms, disabled_until FROM last")
def engine_state_in_batches(spark, d):
    """The log in three parts by time, each folded onto the states that the parts before it left."""
    log, at = calls(spark, d), None
    first, last = (x or 0 for x in log.agg(F.min("ts"), F.max("ts")).first())
    bounds = [first - 1, first + (last - first) // 5, first + (last - first) // 2, last]
    for low, high in zip(bounds, bounds[1:]):
        folder = new_folder(spark, "states")
        state.fold(log.where((COL("ts") > low) & (COL("ts") <= high)), at).write.parquet(folder)
        at = spark.read.parquet(folder)
    return at


_TF = lambda x, mean: f"list_sum(list_transform(words, lambda w: len(list_filter({x}, lambda y: y = w)) * 2.5::DOUBLE / (len(list_filter({x}, lambda y: y = w)) + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len({x}) / {mean})))))"
_BM = lambda x, mean: f"CASE WHEN len({x}) = 0 OR len(words) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ({_TF(x, mean)}) / (len(words) * 2.5::DOUBLE)) END"
_EX = lambda x: f"CASE WHEN lower({x}) = lower(query) THEN 1.0::DOUBLE WHEN starts_with(lower({x}), lower(query)) THEN 0.8::DOUBLE WHEN contains(lower({x}), lower(query)) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
_MANY = f"""WITH {COPIES}, qs AS (SELECT item_id AS query_id, array_to_string(list_slice({toks("text")}, 1, 3), ' ') AS query FROM benchmark),
std AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS query_id, engine_ord, pos, {clean("title", 200)} AS title, {clean("content", 500)} AS content, CASE WHEN trim(url) = '' THEN '#' ELSE url END AS url FROM copies),
ded AS (SELECT * FROM std QUALIFY row_number() OVER (PARTITION BY query_id, trim(lower(url)) ORDER BY engine_ord, pos) = 1),
tok AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY engine_ord, pos) - 1 AS position, {toks("title")} AS t, {toks("content")} AS c FROM ded),
m AS (SELECT *, avg(len(t)) OVER (PARTITION BY query_id) AS tm, avg(len(c)) OVER (PARTITION BY query_id) AS cm FROM tok),
j AS (SELECT m.*, query, {toks("query")} AS words FROM m JOIN qs USING (query_id)),
scored AS (SELECT query_id, doc_id, url, position, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    0.4::DOUBLE * least(1.0::DOUBLE, 0.7::DOUBLE * ({_BM("t", "tm")}) + 0.3::DOUBLE * ({_EX("title")}))
    + 0.3::DOUBLE * least(1.0::DOUBLE, 0.8::DOUBLE * ({_BM("c", "cm")}) + 0.2::DOUBLE * ({_EX("content")}))
    + 0.1::DOUBLE * CASE WHEN len(words) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(words, lambda w: contains(lower(url), w))) / len(words)::DOUBLE END
    + 0.15::DOUBLE * 0.7::DOUBLE + 0.05::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + ln(position + 1.0::DOUBLE))))) AS score FROM j)"""


def _asked(spark, d):
    """Items as answers to the queries: three words of each benchmark item."""
    from skein.functions import text

    b = table(spark, d, "benchmark")
    asked = with_copies(items(spark, d)).withColumn("query_id", COL("doc_id") % b.count())
    return aggregate.aggregate_queries(asked, b.select(COL("item_id").alias("query_id"), F.array_join(F.slice(text.tokenize(COL("text")), 1, 3), " ").alias("query")))


@query(f"{_MANY} SELECT query_id, doc_id, url, position, round(score, 6) AS score FROM scored")
def aggregate_many_queries(spark, d):
    return _asked(spark, d).select("query_id", "doc_id", "url", "position", r6(COL("score")).alias("score"))


@query(f"{_MANY} SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position) AS rank FROM scored) WHERE rank <= 5")
def best_of_many_queries(spark, d):
    scored = _asked(spark, d).withColumn("score", F.round("score", 9))
    return aggregate.best_of_queries(scored, 5).select("query_id", "doc_id", COL("rank").cast("bigint").alias("rank"))


_OPS = """ops AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq, event_type || ':' || event_id AS value,
  CASE event_type WHEN 'signup' THEN 'put' WHEN 'purchase' THEN 'put' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'get_stale' END ELSE 'get' END AS op,
  CASE WHEN event_id % 7 > 0 THEN CAST(floor(value * 3600) AS BIGINT) END AS ttl FROM events),
g AS (SELECT *, max(CASE WHEN op IN ('put', 'delete') THEN n END) OVER (PARTITION BY key ORDER BY n) AS gen FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n FROM ops)),
p AS (SELECT key, n AS gen, value AS held, ts AS created_at, ts + ttl AS expires_at FROM g WHERE op = 'put'),
r AS (SELECT g.*, held, created_at, expires_at, held IS NOT NULL AND (op = 'get_stale' OR expires_at IS NULL OR g.ts < expires_at) AS hit FROM g LEFT JOIN p USING (key, gen)),
c AS (SELECT *, count(*) FILTER (op = 'get' AND hit) OVER w AS access_count, max(CASE WHEN op = 'get' AND hit THEN ts END) OVER w AS last_access FROM r WINDOW w AS (PARTITION BY key, gen ORDER BY n))"""


def store_log(spark, d):
    """events as operations: signups and purchases put, errors delete or ask for stale values, the others get."""
    kind, k = COL("event_type"), COL("event_id")
    op = F.when(kind.isin("signup", "purchase"), "put").when(kind == "error", F.when(k % 3 == 0, "delete").otherwise("get_stale")).otherwise("get")
    ttl = F.when(k % 7 > 0, F.floor(COL("value") * 3600))
    return table(spark, d, "events").select(
        COL("user_id").cast("string").alias("key"), F.unix_timestamp("ts").alias("ts"), k.alias("seq"), op.alias("op"), F.concat(kind, F.lit(":"), k.cast("string")).alias("value"), ttl.alias("ttl")
    )


@query(f"WITH {_OPS} SELECT key, seq, CASE WHEN hit THEN held END AS value, hit AND coalesce(ts >= expires_at, FALSE) AS is_stale, CASE WHEN hit THEN access_count END AS access_count FROM c WHERE op IN ('get', 'get_stale')")
def store_reads(spark, d):
    return store.reads(store_log(spark, d)).select("key", "seq", "value", "is_stale", "access_count")


@query(f"WITH {_OPS} SELECT key, held AS value, created_at, expires_at, access_count, last_access FROM c JOIN (SELECT key, max(n) AS n FROM c GROUP BY key) USING (key, n) WHERE held IS NOT NULL")
def store_left(spark, d):
    return store.left(store_log(spark, d))


@query(f"WITH {_OPS} SELECT count(*) FILTER (op = 'get' AND hit) AS hits, count(*) FILTER (op = 'get' AND NOT hit) AS misses, count(*) FILTER (op = 'put') AS writes, count(*) FILTER (op = 'delete') AS deletes FROM c")
def store_statistics(spark, d):
    return store.statistics(store_log(spark, d))


_VECTORS = rf"""q AS (SELECT DISTINCT array_to_string(list_slice({toks("text")}, 2, 5), ' ') AS query FROM documents),
t AS (SELECT query, unnest(list_filter(string_split(query, ' '), lambda w: octet_length(encode(w)) > 1)) AS term FROM q),
b AS (SELECT query, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 100 AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
v AS (SELECT query, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query)) AS w FROM b)"""


@query(f"""WITH {_VECTORS}, p AS (SELECT x.query AS asked, y.query AS query, least(1.0::DOUBLE, round(sum(x.w * y.w), 9)) AS similarity FROM v x JOIN v y USING (bucket) GROUP BY 1, 2)
SELECT asked, query, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY similarity DESC, query) AS n FROM p WHERE similarity >= 0.7) WHERE n <= 5""")
def similar_queries_join(spark, d):
    """Four words of every document as a query, each asked against all."""
    from skein.functions import text, vectors
    from skein.operators import semantic

    q = table(spark, d, "documents").select(F.array_join(F.slice(text.tokenize(COL("text")), 2, 4), " ").alias("query")).distinct()
    stored = q.withColumn("vector", vectors.vectorize(COL("query")))
    return semantic.similar(stored, q.select(COL("query").alias("asked"))).select("asked", "query", r6(COL("similarity")).alias("similarity"))


_ANSWERED = f"""{ITEMS}, qs AS (SELECT item_id AS query_id, array_to_string(list_slice({toks("text")}, 1, 3), ' ') AS query FROM benchmark),
docs AS (SELECT *, doc_id % (SELECT count(*) FROM benchmark) AS query_id FROM items),
ans AS (SELECT query_id, engine_name AS engine, (engine_ord * 7 + query_id) % 11 AS ts, engine_ord AS seq,
  CASE (engine_ord + query_id) % 9 WHEN 0 THEN 'failure' WHEN 1 THEN 'timeout' ELSE 'success' END AS outcome, (engine_ord + query_id) % 9 = 2 AS empty FROM docs GROUP BY query_id, engine_name, engine_ord),
used AS (SELECT query_id, engine, row_number() OVER (PARTITION BY query_id ORDER BY ts, seq, engine) - 1 AS engine_ord FROM ans WHERE outcome = 'success' AND NOT empty)"""


def answers_of(spark, d):
    """documents as answers of their sources to the benchmark items: some fail, some come late, some are empty."""
    n = table(spark, d, "benchmark").count()
    q, o = COL("query_id"), COL("engine_ord").cast("bigint")
    docs = items(spark, d).withColumn("query_id", COL("doc_id") % n)
    each = docs.groupBy("query_id", COL("engine_name").alias("engine"), o.alias("o")).agg(F.sort_array(F.collect_list(F.struct("pos", "title", "url", "content"))).alias("x"))
    kind, o = (COL("o") + q) % 9, COL("o")
    outcome = F.when(kind == 0, "failure").when(kind == 1, "timeout").otherwise("success")
    rows = F.when(kind != 2, F.transform("x", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["content"].alias("content")))).otherwise(F.array())
    return each.select("query_id", "engine", ((o * 7 + q) % 11).alias("ts"), o.alias("seq"), outcome.alias("outcome"), F.lit(10).cast("bigint").alias("elapsed_ms"), rows.alias("items"))


def queries_of(spark, d):
    from skein.functions import text

    return table(spark, d, "benchmark").select(COL("item_id").alias("query_id"), F.array_join(F.slice(text.tokenize(COL("text")), 1, 3), " ").alias("query"))


@query(f"WITH {_ANSWERED} SELECT * FROM used")
def engines_used(spark, d):
    return answers.engines_used(answers_of(spark, d))


@query(f"WITH {_ANSWERED} SELECT count(DISTINCT query_id) AS total_searches, count(*) FILTER (outcome = 'failure') AS engine_failures, count(*) FILTER (outcome = 'timeout') AS timeouts FROM ans")
def answer_counters(spark, d):
    return answers.counters(answers_of(spark, d))


@query(_MANY.replace(f"WITH {COPIES}, qs AS (SELECT item_id AS query_id, array_to_string(list_slice({toks('text')}, 1, 3), ' ') AS query FROM benchmark)", f"WITH {_ANSWERED}").replace("doc_id % (SELECT count(*) FROM benchmark) AS query_id, engine_ord, pos", "query_id, used.engine_ord, row_number() OVER (PARTITION BY query_id, engine_name ORDER BY pos) AS pos").replace("FROM copies)", "FROM docs JOIN used USING (query_id) WHERE engine = engine_name)") + " SELECT query_id, url, position, round(score, 6) AS score FROM scored")
def merged_answers(spark, d):
    return answers.merged(answers_of(spark, d), queries_of(spark, d)).select("query_id", "url", "position", r6(COL("score")).alias("score"))


_FEEDS = """f AS (SELECT CAST(conv_id AS VARCHAR) AS feed_url, conv_id AS c, conv_id || '-' || turn AS guid, turn, role FROM conversations),
one AS (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY turn) - 1 AS place FROM f WHERE turn < 2),
due AS (SELECT DISTINCT feed_url FROM f WHERE c % 3 = 0 OR feed_url NOT IN (SELECT feed_url FROM one)),
two AS (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY gen, place) - 1 AS spot FROM (
  SELECT feed_url, guid, 'again ' || role AS title, 0 AS gen, row_number() OVER (PARTITION BY feed_url ORDER BY turn) AS place FROM f JOIN due USING (feed_url) WHERE turn >= 1
  UNION ALL SELECT feed_url, guid, role, 1, place FROM one JOIN due USING (feed_url)) QUALIFY row_number() OVER (PARTITION BY feed_url, guid ORDER BY gen, place) = 1),
answered AS (SELECT DISTINCT feed_url FROM f WHERE turn >= 1),
last AS (SELECT feed_url, guid, title, spot AS place FROM two WHERE feed_url IN (SELECT feed_url FROM answered)
  UNION ALL SELECT feed_url, guid, role, place FROM one WHERE feed_url NOT IN (SELECT feed_url FROM due) OR feed_url NOT IN (SELECT feed_url FROM answered))"""


def refreshed_twice(spark, d):
    """Conversations as feeds, turns as items: the first two at 1000; all but the first at 3000, where one of three is due."""
    from skein.operators import feedstore

    store = feedstore.FeedStore(spark, work_folder(spark, "feeds"))
    c = table(spark, d, "conversations")

    def answers(rows, title):
        item = F.concat(F.lit("<item><title>"), title, F.lit("</title><guid>"), COL("conv_id").cast("string"), F.lit("-"), COL("turn").cast("string"), F.lit("</guid></item>"))
        each = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("x")))), lambda s: s["x"]), "").alias("x"))
        interval = F.when(COL("conv_id") % 3 == 0, 100).when(COL("conv_id") % 3 == 1, 10000).cast("bigint")
        body = F.concat(F.lit("<rss><channel><title>feed "), COL("conv_id").cast("string"), F.lit("</title>"), "x", F.lit("</channel></rss>"))
        return each.select(COL("conv_id").cast("string").alias("feed_url"), body.alias("body"), (COL("conv_id") % 3 < 2).alias("persistent"), interval.alias("update_interval"))

    store.refresh(answers(c.where("turn < 2"), COL("role")), 1000)
    store.refresh(answers(c.where("turn >= 1"), F.concat(F.lit("again "), COL("role"))), 3000)
    return store


@query(f"WITH {_FEEDS} SELECT * FROM last")
def feed_store_items(spark, d):
    return refreshed_twice(spark, d).items().select("feed_url", "guid", "title", "place")


@query(f"""WITH {_FEEDS}, n AS (SELECT feed_url, count(*) AS item_count FROM last GROUP BY feed_url)
SELECT feed_url, 'feed ' || feed_url AS name, CASE WHEN feed_url IN (SELECT feed_url FROM due) AND feed_url IN (SELECT feed_url FROM answered) THEN 3000 ELSE 1000 END::BIGINT AS last_updated,
  CAST(feed_url AS BIGINT) % 3 < 2 AS persistent, CASE CAST(feed_url AS BIGINT) % 3 WHEN 0 THEN 100 WHEN 1 THEN 10000 END::BIGINT AS update_interval, item_count FROM n""")
def feed_store_meta(spark, d):
    return refreshed_twice(spark, d).meta().select("feed_url", "name", "last_updated", "persistent", "update_interval", "item_count")
