"""op3: passages whose lines stand apart in other places, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import linededup
from skein.llm.common import string_slices

rng = random.Random(33)


def line(n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def dedup(spark, texts):
    rows = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("n", [2, 6])
def test_passage_whose_lines_stand_apart_before_and_between(spark, n):
    """The lines stand apart in 1 and 3, whole in 2: 4, which equals 2, goes."""
    lines = [line(12) for _ in range(n)]
    apart = ["\n".join(x for k in lines for x in (k, line(12))) for _ in range(2)]
    texts = [apart[0], "\n".join(lines), apart[1], "\n".join(lines)]
    assert dedup(spark, texts) == [*texts[:3], ""]


def test_random_runs_of_lines_against_all_earlier_places(spark):
    """Every line of a run of two long lines or more that stands earlier as such is gone, no other one."""
    pool = [line(rng.randrange(10, 30)) for _ in range(25)]
    docs = []
    for _ in range(120):
        lines = []
        while len(lines) < 12:
            k = rng.randrange(len(pool))
            lines += pool[k : k + rng.randrange(1, 5)] if rng.random() < 0.6 else [line(rng.randrange(10, 60))]
        docs.append(lines)
    got = dedup(spark, ["\n".join(d) for d in docs])
    pairs, singles = set(), set()
    for lines, text in zip(docs, got):
        gone = set()
        for i in range(len(lines)):
            if len(lines[i].split()) >= 50 and lines[i] in singles:
                gone.add(i)
            if i and (lines[i - 1], lines[i]) in pairs:
                gone |= {i - 1, i}
            singles.add(lines[i])
            if i:
                pairs.add((lines[i - 1], lines[i]))
        assert text == "\n".join(x for i, x in enumerate(lines) if i not in gone)


def test_most_chunks_have_several_lines(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    counts = []
    for _, _, data, offsets in string_slices(pa.array(texts)):
        c = linededup.chunk_table(data, offsets)
        counts.append(c["last"] - c["first"] + 1)
    counts = np.concatenate(counts)
    assert (counts > 1).mean() > 2 / 3
