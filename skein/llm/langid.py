"""Language identification with error-correcting output codes.

Each language has a codeword; for each of its bits a binary classifier over
hashed byte n-grams of the whole text predicts that bit. Decoding takes the
codeword of least loss, the bits weighted by how well their classifiers fit;
a small distance to the second codeword is flagged as ambiguous.

Edge cases: a null text or one without letters is ``und`` with score 0; an
empty text likewise; rows without doc_id are predicted as any other and, as
they have no crc32, never used in training; without labelled rows every text
is ``und``; with one language every text with letters is of it; ties go to
the language that comes first; repeated rows get equal languages, and scores
that are equal in their first six digits (products of single precision depend
on the place in a batch); other columns are ignored, or kept where asked for.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import begin, cut, string_slices
from skein.llm.hashing import mix

UNKNOWN = "und"
BUCKETS = 1 << 12
#: The bound of the training sample: rows for each language, and in all (one of each language at least).
ROWS_A_LANGUAGE = 400
ROWS = 4000
RIDGE = 1e-3
#: Tables of a row for each language are broadcast up to so many.
MOST_BROADCAST = 100_000
#: Rows whose features are held at once.
AT_ONCE = 512
#: Scores below it are flagged as ambiguous.
AMBIGUOUS = 0.45

# Bytes by role: ASCII that is no letter becomes a space, capitals become small.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
_FOLD[65:91] += 32


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 and -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of hashed n-gram frequencies (1 to 3 bytes), each of length 1."""
    n = len(offsets) - 1
    b = _FOLD[data]
    out = np.zeros((n, BUCKETS), np.float32)
    if len(b):
        back = np.concatenate([[np.uint8(32)], b[:-1]])
        back[offsets[:-1][offsets[:-1] < len(b)]] = 32
        keep = (b != 32) | (back != 32)  # runs of spaces count as one
        row = np.repeat(np.arange(n), np.diff(offsets))[keep]
        b = b[keep]
        code = b.astype(np.uint32)
        same = np.ones(len(b), bool)
        for k in range(3):
            if k:
                code = code[1:] | (b[: len(code) - 1].astype(np.uint32) << np.uint32(8 * k))
                same = row[: len(code)] == row[k:]
            slot = ((code + np.uint32(k + 1)) * np.uint32(2654435761)) >> np.uint32(20)
            where = (row[: len(code)] * BUCKETS + slot.astype(np.int64))[same]
            out += np.bincount(where, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    np.sqrt(out, out=out)
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)
    return out


def codewords(k: int) -> np.ndarray:
    """All splits in two for up to 6 languages, else the most distant of many random words."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 6:
        return np.array([[1.0, *s] for s in itertools.product((1.0, -1.0), repeat=k - 1) if -1.0 in s]).T
    bits, rng, best = int(np.ceil(10 * np.log2(k))), np.random.default_rng(k), (-1, None)
    for _ in range(64):
        m = rng.choice([-1.0, 1.0], (k, bits))
        one = np.abs(m.sum(axis=0)) == k  # says nothing: half of the languages change sides
        m[: k // 2, one] *= -1
        far = int((bits - (m @ m.T - 2 * bits * np.eye(k))).min() // 2)
        if far > best[0]:
            best = (far, m)
    return best[1]


def train(documents: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE, most: int = ROWS) -> Model:
    """Fits the classifiers on a sample of labelled rows of bounded size.

    The sample holds, of each language, the rows_a_language texts with the
    smallest hashes of doc_id and text, fewer where there are more than
    most / rows_a_language languages, but one at least; only rows with a
    language are asked for. A threshold for the hashes, from the count of each
    language, keeps what is ordered in a task near the size of the sample. A
    row that is repeated is in the sample once.
    """
    labelled = documents.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("_h"))
    counts = cut(labelled.groupBy("lang").count())
    languages = counts.count()
    of_each = max(1, min(rows_a_language, most // max(1, languages)))
    small = F.broadcast if languages <= MOST_BROADCAST else (lambda x: x)
    enough = counts.select(F.col("lang").alias("_lang"), (F.lit(2.0 * of_each + 200) / F.col("count")).alias("_share"))
    at = F.pmod(F.col("_h"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    few = labelled.join(small(enough), F.col("lang") == F.col("_lang")).where(at < F.col("_share")).select("lang", "_h")
    w = Window.partitionBy("lang").orderBy(F.pmod(F.col("_h"), F.lit(1 << 32)), "_h")
    chosen = few.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= of_each).select(F.col("lang").alias("_l"), F.col("_h").alias("_chosen"))
    sample = labelled.join(small(chosen), (F.col("lang") == F.col("_l")) & (F.col("_h") == F.col("_chosen")), "left_semi").dropDuplicates(["lang", "_h"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("language")
        for batch in batches:
            for a, b, data, offsets in string_slices(batch.column(0)):
                for low in range(0, b - a, AT_ONCE):
                    part = offsets[low : min(b - a, low + AT_ONCE) + 1]
                    x = features(data[part[0] : part[-1]], part - part[0]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(a + low, len(x))], names=["x", "lang"])

    got = sorted((r.lang, bytes(r.x)) for r in sample.select("text", "lang").mapInArrow(rows, "x binary, lang string").collect())
    return fit([g[0] for g in got], np.array([np.frombuffer(g[1], np.float16) for g in got], np.float32).reshape(len(got), BUCKETS))


def fit(languages: list[str], x: np.ndarray) -> Model:
    names = sorted(set(languages))
    codes = codewords(len(names))
    number = {a: i for i, a in enumerate(names)}
    y = codes[[number[a] for a in languages]] if names else np.zeros((0, 0))
    if codes.shape[1] == 0:
        return Model(names, codes, np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    share = np.bincount([number[a] for a in languages])[[number[a] for a in languages]]
    s = np.sqrt(1.0 / share)  # each language counts the same
    s = s / s.mean()
    a = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64) * s[:, None]
    gram = a @ a.T
    dual = np.linalg.solve(gram + RIDGE * len(x) / 100 * np.eye(len(x)), y * s[:, None])
    w = a.T @ dual
    # How well a bit is predicted without the row itself (closed form of leaving one out).
    hat = gram @ np.linalg.inv(gram + RIDGE * len(x) / 100 * np.eye(len(x)))
    out = (y * s[:, None] - (y * s[:, None] - gram @ dual) / np.maximum(1 - np.diag(hat), 1e-6)[:, None]) / s[:, None]
    right = ((out * y) > 0).mean(axis=0)
    trust = np.log(np.clip(right, 0.55, 0.999) / (1 - np.clip(right, 0.55, 0.999)))
    return Model(names, codes, w[:-1].astype(np.float32), w[-1], trust / trust.sum())


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best language and its score, 0 to 1, for rows of features."""
    if len(model.languages) == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    f = x @ model.weights + model.bias
    loss = np.log1p(np.exp(-4 * f[:, None, :] * model.codes[None])) * model.trust
    p = np.exp(-4 * loss.sum(axis=2))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return best, p[np.arange(len(x)), best]


def predict(documents: DataFrame, model: Model, keep: list[str] | None = None, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """The columns of keep (all, if None) with lang_pred, score and ambiguous."""
    documents = documents.drop("lang_pred", "score", "ambiguous")
    keep = documents.columns if keep is None else keep
    columns = list(dict.fromkeys([*keep, "text"]))
    schema = documents.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    names = np.array([*model.languages, UNKNOWN], object)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("language")
        for batch in batches:
            text = batch.column(columns.index("text"))
            for a, b, data, offsets in string_slices(text, 1 << 20):
                for low in range(a, b, AT_ONCE):
                    high = min(b, low + AT_ONCE)
                    cut = offsets[low - a : high - a + 1]
                    letters = np.array([t is not None and any(map(str.isalpha, t)) for t in text.slice(low, high - low).to_pylist()], bool)
                    best, score = np.full(high - low, len(model.languages)), np.zeros(high - low)
                    if letters.any() and model.languages:
                        got = decode(model, features(data[cut[0] : cut[-1]], cut - cut[0]))
                        best, score = np.where(letters, got[0], best), np.where(letters, got[1], 0.0)
                    arrays = [batch.column(i).slice(low, high - low) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(names[best], pa.string()), pa.array(score), pa.array(score < ambiguous)], names=[*keep, "lang_pred", "score", "ambiguous"])

    return documents.select(*columns).mapInArrow(task, schema)


def held_out() -> F.col:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
