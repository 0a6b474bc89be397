"""op11 against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import importance

rng = random.Random(11)
WORDS = ["alpha", "BETA", "gamma", "straße", "日本", "x", "42", "w" * 60, "long" * 30]
DOCS = "doc_id bigint, text string, rank int, score string, n_words int"


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(docs, target):
    s, t = (Counter(bucket(f) for text in texts for f in features(text)) for texts in ([d[1] for d in docs], target))
    total = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total[0] + 10000) / ((s[b] + 1) * (total[1] + 10000))))
    out = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2]))
    drawn = [*zip(fit[: len(fit) * 25 // 100], range(1, len(fit) + 1))]
    ranks = Counter((*r, k) for r, k in drawn) + Counter((*r, None) for r in fit[len(drawn) :]) + Counter((*r, None) for r in out if r[1] < 20)
    return ranks


def text(n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "\n", "-", "\x00", " - "]) for _ in range(n))


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("repeats", [1, 60])
def test_equal_to_brute_force(spark, repeats):
    rows = [(i, text(rng.randrange(45))) for i in range(150)] + [(200, None), (201, ""), (202, " -- "), (203, "one"), (204, text(40000)), (None, text(30)), (None, text(30))]
    rows += [(7, text(25)), (8, text(50))] + [(9, text(31))] * repeats
    target = [text(rng.randrange(60)) for _ in range(12)] + [None, ""]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS).repartition(5)
    got = importance.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"))
    assert found(got) == brute(rows, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id bigint, text string")
    assert importance.resample(none, none).count() == 0
    assert found(importance.resample(some, none)) == brute([(1, "a " * 30)], [])
    assert importance.resample(none, some).count() == 0


def test_checksums_of_spans():
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    starts = np.array([0, 5, 5, 100, 2999, 700, 40, 3000])
    ends = np.array([0, 6, 50, 148, 3000, 2900, 89, 3000])
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert importance.crc32_spans(data, starts, ends).tolist() == want
    before = np.arange(8, dtype=np.uint32) * np.uint32(77777777)
    assert importance.crc32_spans(data, starts, ends, before).tolist() == [zlib.crc32(data[a:b].tobytes(), int(p)) for a, b, p in zip(starts, ends, before)]


def test_matrix_round_trip(spark, tmp_path):
    texts = [text(rng.randrange(30)) for _ in range(40)] + [None]
    importance.write_matrix(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), str(tmp_path / "m"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids, indptr, indices, counts = (np.frombuffer(r[c], t) for c, t in (("doc_ids", "<i8"), ("indptr", "<i8"), ("indices", "<u2"), ("data", "<u4")))
        got |= {int(i): Counter(dict(zip(indices[a:b].tolist(), counts[a:b].tolist()))) for i, a, b in zip(ids, indptr, indptr[1:])}
    assert got == {i: Counter(map(bucket, features(t))) for i, t in enumerate(texts)}
