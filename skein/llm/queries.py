"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import capfilters, importance, jaccard, langid, linededup, mixing, packing, pii, prefixtrie, secrets, simple8b, transducer, vafile
from skein.llm.common import table
from skein.operators.scan import work_folder

TOKENIZER = "byte_bpe_50k.json"
PII_KEY = "skein-demonstration-key"
WEIGHTS = (5, 2, 1)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = langid.held_out()
    model = langid.train(documents.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out))
    found = langid.predict(documents, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark, 'tokens')}/files"
    simple8b.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), folder, end_id=2)
    return simple8b.read_tokens(spark, folder, with_ids=False).drop("ids")


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.links(table(spark, sf_dir, "embeddings"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtrie.turns(table(spark, sf_dir, "conversations"))
    return prefixtrie.trie(*prefixtrie.with_shared_heads(turns))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_simple8b, op3_line_chunks, op4_exact_topk, op5_mix_sources, op6_pack_nnls, op7_secrets, op8_ngram_jaccard, op9_cap_filters, op10_pii_surrogates, op11_importance_resampling, op12_prefix_trie, op13_token_counts)
    return {f.__name__: f for f in found}


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER o AS k,
         (SELECT sum(source_size) FROM s) - 3 * coalesce(sum(source_size) OVER p, 0) AS left_size,
         (SELECT sum(w) FROM s) - coalesce(sum(w) OVER p, 0) AS left_w
  FROM s
  WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST),
         p AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT arg_min(CAST(left_size AS DOUBLE) / left_w, k) AS share FROM r
  WHERE CAST(left_size AS DOUBLE) / left_w <= CAST(3 * source_size AS DOUBLE) / w
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, share * w) AS target FROM s, c
), u AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget, row_number() OVER () AS id,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT *, before + p * source_size AS first, greatest(0, least(size, budget - before - p * source_size)) AS head
  FROM u, (SELECT unnest([0, 1, 2]) AS p)
), rest AS (
  SELECT CAST((SELECT sum(size) FROM d) - (SELECT sum(head) FROM passes) AS BIGINT) AS n, (SELECT count(*) FROM t) AS sources,
         (SELECT sum(target) FROM t WHERE target < 3 * source_size) AS open_words
), words AS (
  SELECT id, source, upto, CAST(upto AS DOUBLE) / target AS finish, n
  FROM (SELECT *, unnest(range(first + head + 1, first + least(size, CAST(ceil((1 + 3 * (n + sources) / open_words) * target) AS BIGINT) - first) + 1)) AS upto
        FROM passes, rest WHERE head < size)
), line AS (
  SELECT id, 1 AS got FROM words QUALIFY row_number() OVER (ORDER BY finish, source NULLS LAST, upto) <= n
)
SELECT u.doc_id, u.size, u.source_size, u.target, CAST(a.head + coalesce(b.got, 0) AS BIGINT) AS taken
FROM u JOIN (SELECT id, sum(head) AS head FROM passes GROUP BY id) a USING (id)
LEFT JOIN (SELECT id, sum(got) AS got FROM line GROUP BY id) b USING (id)
"""


#: A table for crc32 by bytes, and the checksum of a string column x by it.
CRC_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc_table"


def _crc32(x: str) -> str:
    bytes_ = f"list_transform(range(octet_length(encode({x}))), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(crc_table[xor(c, b) % 256 + 1], c >> 8)))"


OP11_SQL = rf"""
WITH crc AS ({CRC_TABLE}),
d AS (
  SELECT row_number() OVER () AS id, doc_id, text, TRUE AS corpus FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, FALSE FROM benchmark
), w AS (
  SELECT id, doc_id, corpus, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM d
), f AS (
  SELECT id, corpus, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w
), b AS (
  SELECT feature, {_crc32("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f), crc
), n AS (
  SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM f JOIN b USING (feature) GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM n) + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n
), m AS (
  SELECT id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE corpus GROUP BY id
), r AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN m USING (id) WHERE corpus
), s AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM r
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) AS place,
         count(*) FILTER (n_words >= 20) OVER () AS fit
  FROM s
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank FROM o
"""


OP12_SQL = f"""
WITH crc AS ({CRC_TABLE}),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc
), r AS (
  SELECT c.conv_id, t.pos, 0 AS own, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos, 1, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), s AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS n_bytes, list(struct_pack(role := role, text := text)) OVER w AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, [] FROM c
), e AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last, path AS node,
         CASE WHEN depth > 0 THEN path[:-2] END AS parent
  FROM s
), n AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(n_bytes) AS n_bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM e GROUP BY node
), k AS (
  SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)
), u AS (
  SELECT conv_id, depth, node AS top FROM e
), below AS (
  SELECT u.top, sum((m.n_convs - 1) * m.n_bytes) AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves
  FROM u JOIN (SELECT m.*, conv_id AS owner FROM m) m ON u.conv_id = m.owner AND u.depth <= m.depth GROUP BY u.top
)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children,
       CAST(coalesce(below.n_leaves, 0) AS BIGINT) AS n_leaves, CAST(coalesce(below.saved_tokens, 0) AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m LEFT JOIN m p ON p.node = m.parent LEFT JOIN below ON below.top = m.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": OP4_SQL, "op5_mix_sources": OP5_SQL, "op11_importance_resampling": OP11_SQL, "op12_prefix_trie": OP12_SQL}
