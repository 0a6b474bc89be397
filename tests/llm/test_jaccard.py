"""op8: sets of one digest, and very long texts."""

import random

import numpy as np

from skein.llm import jaccard

rng = random.Random(88)


def text(n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def brute(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    return {i: (len(s), low[i]) for i, s in enumerate(sets)}


def test_sets_of_one_digest_are_told_apart(spark):
    """Digests of 3 bits: nearly all sets clash at first."""
    base = [text(60) for _ in range(25)]
    texts = base + [b + " more" for b in base[:10]] + base[5:9] + ["", "one", "two", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df, bits=3).collect()} == brute(texts)


def test_very_long_texts(spark):
    long = text(200_000)
    texts = [long, long + " end", text(150_000), "x" * 300_000, "x" * 300_000 + " y", " ".join(["same"] * 100_000), "same " * 6]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df).collect()} == brute(texts)


def test_digests():
    x, y = np.arange(50, dtype=np.uint64), np.arange(51, dtype=np.uint64)
    plain = jaccard.Digest()
    apart = jaccard.Digest(apart=frozenset([plain(x)]))
    assert plain(x) == plain(x.copy()) != plain(y) and apart(x) != plain(x) and apart(y) == plain(y) and jaccard.Digest(3)(x) in range(8)


def test_links_of_near_copies_grow_with_them(spark, monkeypatch):
    """Each text is near to 45 others, but not to all: a few links a text are made, not one for each pair."""
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(5, 130, 5):
        for j in range(5, i, 5):
            w = list(base)
            w[i], w[j] = f"x{i}", f"x{j}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    texts += [text(150) for _ in range(20)]
    texts += [" ".join(["other", *t.split()[:-1]]) for t in texts[-5:]]
    made, components = [], jaccard.connected_components

    def counted(edges):
        made.append(edges.count())
        return components(edges)

    monkeypatch.setattr(jaccard, "CROWD", 64, raising=False)
    monkeypatch.setattr(jaccard, "connected_components", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df).collect()}
    assert got == {i: (146, 0 if i < 300 else i if i < 320 else i - 5) for i in range(325)}
    assert max(made) < 4 * len(texts), made


def shuffled(spark):
    """Bytes that all shuffles of the session have written so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_sets_are_not_shuffled(spark):
    """Long near copies, and long texts that share half their words in one place: less goes over than two times all sets."""
    texts = []
    for _ in range(30):
        base = text(3000).split()
        near = list(base)
        near[500] = near[2000] = "other"
        texts += [" ".join(base), " ".join(near), " ".join([*base[:2000], *text(1000).split()])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).checkpoint()
    before = shuffled(spark)
    got = {r.doc_id: r.component_id for r in jaccard.components(df).collect()}
    assert got == {i: i - (i % 3 == 1) for i in range(90)}
    assert shuffled(spark) - before < 2 * 90 * 2996 * 8


def test_wide_sketches_leave_out_no_similar_pair():
    """Sets at the limit pass, whatever the lengths of their sketches; most of those a little beyond it don't."""
    passed = 0
    for n in (1, 2, 5, 100, 127, 128, 1000, 1023, 1025, 4100, 5000):
        for _ in range(5):
            x = np.array(rng.sample(range(1 << 40), 2 * n), np.uint64)
            both = -(-80 * n // 100)
            for y in (np.append(x[:both], []), x[: n + n // 4], np.append(x[n - 8 * n // 9 : n], x[n : n + n // 9])):
                y = np.unique(y.astype(np.uint64))
                if jaccard.similar(np.unique(x[:n]), y, 80):
                    for a, b in ((x[:n], y), (y, x[:n])):
                        assert jaccard.wide_may_be_similar(jaccard.wide_sketch(a), jaccard.wide_sketch(b), 80)
            if n >= 1000:
                far = np.append(x[: n * 8 // 10], x[n : n + n * 2 // 10])
                passed += jaccard.wide_may_be_similar(jaccard.wide_sketch(x[:n]), jaccard.wide_sketch(far), 80)
    assert passed == 0
