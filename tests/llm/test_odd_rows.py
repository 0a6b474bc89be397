"""Columns with the names of results or of columns on the way, repeated rows, and ties."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import capfilters, langid, packing, secrets, simple8b

PATH = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(71)
CLASH = "lang_pred int, score string, ambiguous int, ids int, start string, n_tokens int, first int, n_ids int, file string, chunk int, sequence_id string, offset int, length int, doc_tokens int, spans int, n_assign string, n_access int, base_sha256 int, _row int, _gone int, h int, v int, c int"
MORE = tuple("x" if " string" in c else 7 for c in CLASH.split(", "))
TEXTS = [None, "", " ", "password = abcdefgh1 AKIA" + "B" * 16, "f" * 40, "the quick brown fox", "der schnelle braune fuchs", "12 34", "é" * 3000, "word " * 900]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], *MORE) for i, t in enumerate(TEXTS * 3)]
    rows += [rows[3]] * 5 + [rows[8]] * 2 + [(None, TEXTS[3], "en", *MORE)] * 2 + [(3, "another text of this id", "en", *MORE)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, {CLASH}").repartition(4)


def test_language_id_of_repeated_rows(docs):
    model = langid.train(docs)
    got = langid.predict(docs, model)
    assert got.count() == docs.count() and dict(got.dtypes)["score"] == "double" and dict(got.dtypes)["n_tokens"] == "int"
    seen = {}
    for r in got.collect():
        language, score = seen.setdefault(r.text, (r.lang_pred, r.score))
        assert r.lang_pred == language and r.score == pytest.approx(score, abs=1e-6)
        assert (r.lang_pred == langid.UNKNOWN) == (not any(map(str.isalpha, r.text or "")))


def test_token_files_of_repeated_rows(spark, docs, tmp_path):
    simple8b.write_tokens(docs, PATH, str(tmp_path / "t"), 2)
    got = simple8b.read_tokens(spark, str(tmp_path / "t")).collect()
    t, total = Tokenizer.from_file(PATH), 0
    want = sorted(((r.doc_id is None, r.doc_id or 0, r.text or ""), len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    for g, (key, n) in zip(sorted(got, key=lambda r: r.start), want, strict=True):
        assert (g.doc_id is None, g.doc_id or 0, g.start, g.n_tokens) == (*key[:2], total, n)
        total += n


def test_packing_of_repeated_rows(docs):
    got = packing.pack(docs, PATH, 1, window=256).collect()
    t = Tokenizer.from_file(PATH)
    assert sum(r.length for r in got) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n == 256 or n & (n - 1) == 0 for n in at.values()) and max(at.values()) <= 256


def test_secrets_of_repeated_rows(docs):
    got = secrets.report(secrets.scan(docs))
    assert got.count() == docs.count()
    rows = [r for r in got.collect() if r.doc_id == 3 and r.n_assign]
    assert len(rows) == 6 and len(set(rows)) == 1 and (rows[0].n_assign, rows[0].n_access, rows[0].n_hex) == (1, 1, 0)


def test_cap_filters_of_repeated_rows_and_ties(spark):
    g = np.random.default_rng(9)
    x = g.normal(size=(30, 8))
    rows = [(i, v.tolist(), i % 2, *MORE) for i, v in enumerate(x)]
    rows += [rows[4]] * 3 + [(100 + i, x[6].tolist(), 0, *MORE) for i in range(4)] + [(200, (2 * x[6]).tolist(), 0, *MORE), (201, (3 * x[6]).tolist(), None, *MORE)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<double>, label int, {CLASH}").repartition(3)
    got = capfilters.links(df)
    assert got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r.vec_id, set()).add((r.n_links, r.component_id, r.kept))
    assert by[4] == {(3, 4, True)} and by[6] == {(5, 6, True)} and by[201] == {(0, 201, True)}
    assert all(by[k] == {(5, 6, False)} for k in (100, 101, 102, 103, 200))


def test_empty_tables(spark, docs, tmp_path):
    none = docs.where(F.lit(False))
    assert langid.predict(none, langid.train(docs)).count() == 0 and secrets.report(secrets.scan(none)).count() == 0
    assert packing.pack(none, PATH, 1).count() == 0 and langid.train(none).languages == []
