"""op9 on whole tables of vectors, against all products: python tests/llm/test_capfilters_recall.py FOLDER prints what is found."""

import os
import sys
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/check_s"


def brute(folder: str, least: float = 0.98) -> dict[int, int]:
    """How many other vectors each one links with, label by label, a block of rows at a time."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"{folder}/embeddings.parquet", columns=["vec_id", "embedding", "label"])
    ids, labels, vectors = (t.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))
    sound = [v is not None and k is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v, k in zip(vectors, labels)]
    out = dict.fromkeys(ids, 0)
    groups: dict[tuple, list[int]] = {}
    for i, ok in enumerate(sound):
        if ok:
            groups.setdefault((labels[i], len(vectors[i])), []).append(i)
    for rows in groups.values():
        x = np.array([vectors[i] for i in rows], float)
        norm = np.sqrt((x * x).sum(axis=1))
        for low in range(0, len(x), 2048):
            cos = (x[low : low + 2048] @ x.T) / (norm[low : low + 2048, None] * norm)
            for i, n in zip(rows[low : low + 2048], (cos >= least).sum(axis=1) - 1):
                out[ids[i]] += int(n)
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_links_of_a_whole_table(spark):
    from skein.llm import capfilters

    want = brute(DATA)
    got = {r.vec_id: r.n_links for r in capfilters.links(spark.read.parquet(f"{DATA}/embeddings.parquet")).collect()}
    assert got.keys() == want.keys() and sum(want.values()) > 10_000
    # A pair's cosine may round differently where it is 0.98 to the last digits.
    assert sum(min(got[i], want[i]) for i in want) >= 0.999 * sum(want.values())
    assert sum(max(0, got[i] - want[i]) for i in want) <= 2


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT))
    os.environ["PYTHONPATH"] = str(ROOT)
    from pyspark.sql import SparkSession

    from skein.llm import capfilters

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g").getOrCreate()
    told = brute(sys.argv[1])
    found = {r.vec_id: r.n_links for r in capfilters.links(session.read.parquet(f"{sys.argv[1]}/embeddings.parquet")).collect()}
    print(f"links: {sum(told.values())}, found: {sum(min(found[i], n) for i, n in told.items())}, others: {sum(max(0, found[i] - n) for i, n in told.items())}")
