import random

from pyspark.sql import functions as F

from skein.operators import textindex

rng = random.Random(8)
LETTERS = ["a", "b", "C", "é", "日", "😀", " ", "\n", "%", "ab"]


def word(n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def test_found_as_by_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 16)  # lists of several blocks
    rows = [(f"k{i % 37:02d}", i, word(rng.randrange(40)), None if i % 9 == 0 else word(rng.randrange(25))) for i in range(300)]
    rows += [("k99", 1000, "", ""), ("k99", 1001, None, None), ("k00", 1002, "x" * 30000 + "needle", "")]
    textindex.build(spark.createDataFrame(rows, "key string, pos int, title string, content string").repartition(5), ["title", "content"], str(tmp_path / "i"))
    asked = [(q, word(rng.randrange(1, 6))) for q in range(40) for _ in range(2)] + [(50, "NEEDLE"), (51, "xxxxxx"), (52, "é"), (53, "absent word")]
    df = spark.createDataFrame(asked, "query_id int, word string")
    for most in (None, 3):
        got = {}
        for r in textindex.search(spark, str(tmp_path / "i"), df, ["title", "content"], most).collect():
            got.setdefault(r.query_id, []).append((r.key, r.pos))
        want = {}
        for q in {a[0] for a in asked}:
            words = [w.lower() for k, w in asked if k == q]
            hits = sorted((k, p) for k, p, t, c in rows if any(w in (t or "").lower() or w in (c or "").lower() for w in words))
            if hits:
                want[q] = hits[:most]
        assert {q: sorted(v) for q, v in got.items()} == want


def test_a_search_reads_its_own_trigrams_only(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("string").alias("key"), F.lit(0).alias("pos"), F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"))
    textindex.build(rows, ["title"], str(tmp_path / "i"))
    found = textindex.candidates(spark, str(tmp_path / "i"), spark.createDataFrame([("e 199",)], "word string"))
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan  # only folders of the word's trigrams are read
    assert [r.word for r in found.collect()] == ["e 199"]


def test_ranges_end_where_words_have_enough(spark, tmp_path, monkeypatch):
    """The first entries of frequent, rare and short words over ranges of any length; each text is fetched once a range."""
    monkeypatch.setattr(textindex, "FIRST", 64)
    monkeypatch.setattr(textindex, "WIDER", 2)
    rows = [(f"{i:05d}", 0, f"common {'rare' if i % 211 == 5 else ''} no{i}", "zu" if i % 300 == 7 else None) for i in range(1000)]
    folder = str(tmp_path / "i")
    textindex.build(spark.createDataFrame(rows, "key string, pos int, title string, content string").repartition(7), ["title", "content"], folder)
    seen, real = [], textindex._holding
    monkeypatch.setattr(textindex, "_holding", lambda s, f, words, c, low=0, high=None: seen.append(sorted(r.word for r in words.collect())) or real(s, f, words, c, low, high))
    asked = spark.createDataFrame([(1, "common"), (2, "Rare"), (3, "zu"), (4, "common"), (4, "rare"), (5, "no99"), (6, "none such")], "query_id int, word string")
    got = {}
    for r in textindex.search(spark, folder, asked, ["title", "content"], 4).collect():
        got.setdefault(r.query_id, []).append(r.key)
    hold = lambda w: [k for k, _, t, c in rows if w in t or w in (c or "")]
    want = {1: hold("common")[:4], 2: hold("rare")[:4], 3: hold("zu")[:4], 4: hold("common")[:4], 5: hold("no99")[:4]}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert "common" in seen[0] and all("common" not in s for s in seen[1:])
