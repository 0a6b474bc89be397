import os
import random
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skein.llm.common import table
from skein.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and docs.count() > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert pieces.length.sum() == pieces[pieces.start == 0].doc_tokens.sum()


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred int, score string, n_lines int, n_removed string, n_shingles int, size string, taken int, _row int, _gone string, sequence_id int"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, names that operators give to their own columns."""
    rng = random.Random(14)
    said = {"en": "the that with ness ing of and thou", "de": "der die und keit ung schaft ein zu"}
    line = lambda lang, n: " ".join(rng.choice(said[lang].split()) + rng.choice(said[lang].split()) for _ in range(n))
    text = lambda lang: "\n".join(line(lang, rng.randrange(8, 30)) for _ in range(rng.randrange(1, 6)))
    more = (7, "s", 1, "x", 2, "y", 3, 4, "z", 5)
    rows = [(i, text(("en", "de")[i % 2]), ("en", "de", None)[i % 3], ("b", "a", None)[i % 3], 1, *more) for i in range(60)]
    passage = "\n".join(line("en", 20) for _ in range(4))
    near = rows[4][1].split(" ")
    rows += [(100, rows[4][1], "en", "a", 1, *more), (101, " ".join(near + ["oneword"]), "en", "a", 1, *more), rows[8], rows[8], (8, rows[9][1], "de", "b", 1, *more)]
    rows += [(i, text("en") + "\n" + passage + "\n" + text("de"), "en", "b", 1, *more) for i in range(110, 114)]
    rows += [(120, " ".join(line("en", 50) for _ in range(1000)), "en", "long", 1, *more), (121, None, "en", "a", 1, *more), (122, "", None, None, None, *[None] * 10), (123, " \n", "en", "a", 1, *more), (124, "12 -- 34", "en", "a", 1, *more)]
    rows += [(None, text("de"), "de", "c", 1, *more), (None, None, None, None, None, *[None] * 10), (130, "word", "en", "a", 1, *more)]
    return rows


def test_stages_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(5)
    kept, before = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, DATA).write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
        assert kept[name].columns == docs.columns and kept[name].dtypes == docs.dtypes
        before = kept[name]
    key = lambda df: Counter((r.doc_id, r.text, r.source, r.lang_pred, r._row) for r in df.collect())
    # Language: what has no letters goes, copies alike; all else passes through whole.
    first = key(kept["language_id"])
    assert not first - key(docs) and all(re.search("[a-z]", t) for _, t, *_ in first) and first[8, odd_rows()[8][1], None, 7, 4] in (0, 3)
    assert {d for d, *_ in first} >= {0, 1, 4, 8, 100, 120}
    # Lines: the passage stays in its first document only.
    lines = kept["line_dedup"].collect()
    passage = odd_rows()[66][1].split("\n")
    assert sum(r.doc_id in range(110, 114) and all(x in r.text.split("\n") for x in passage[-9:-5]) for r in lines) <= 1
    assert all(r.n_chars == len(r.text) for r in lines if r.doc_id is not None)
    # Near copies: by brute force on what the stage before kept.
    sets = {}
    for r in lines:
        w = r.text.split()
        if r.doc_id is not None and w:
            sets.setdefault(r.doc_id, []).append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    link = lambda a, b: any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
    smallest = {a: a for a in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if link(a, b):
                    smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    want = Counter((r.doc_id, r.text) for r in lines if r.doc_id is None or smallest.get(r.doc_id, r.doc_id) == r.doc_id)
    assert Counter((r.doc_id, r.text) for r in kept["near_duplicates"].collect()) == want
    # Mix: as often as the words that the mix takes of each document tell.
    mixed = Counter((r.doc_id, r.text, r.source) for r in kept["mix_sources"].collect())
    assert set(mixed) <= {(r.doc_id, r.text, r.source) for r in kept["near_duplicates"].collect()}
    one = Counter((r.doc_id, r.text, r.source) for r in kept["near_duplicates"].collect())
    assert all(n <= 3 * one[k] for k, n in mixed.items())
    # Pack: each id of each document in exactly one piece.
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()
    assert sum(p.length for p in pieces) == sum(n * (len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for (_, t, _), n in mixed.items())
    full = Counter()
    for p in pieces:
        full[p.sequence_id] += p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in full.values())


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
