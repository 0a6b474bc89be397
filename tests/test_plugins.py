"""Sources and steps that others write, found without a call that registers them."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from skein.sources import captured, registry
from skein.sources.base import Abilities, Source

MODULE = '''
from pyspark.sql import functions as F
from skein.sources.base import Abilities, Function, Source


class Lines(Source):
    name = "lines"
    abilities = Abilities(max_page_size=20, parameters=("sort",))

    def build_request(self, query):
        return "https://lines.example/?q=" + query["query"]

    def parse(self, body):
        return [{"title": t, "url": f"https://lines.example/{n}", "content": t.upper()} for n, t in enumerate(body.split("\\n"))]


class Long:
    name, kind = "long", "filter"

    def __call__(self, items):
        return items.where(F.length("text") > 100)


shout = Function("shout", "formatter", lambda items: items.withColumn("text", F.upper("text")))
'''


@pytest.fixture
def plugins(tmp_path, monkeypatch):
    (tmp_path / "skein_plugins").mkdir()
    (tmp_path / "skein_plugins" / "mine.py").write_text(MODULE)
    dist = tmp_path / "own-1.0.dist-info"
    dist.mkdir()
    (dist / "METADATA").write_text("Metadata-Version: 2.1\nName: own\nVersion: 1.0\n")
    (dist / "entry_points.txt").write_text("[skein.steps]\nbest = own_steps:Best\n")
    (tmp_path / "own_steps.py").write_text("class Best:\n    name, kind = 'best', 'sorter'\n\n    def __call__(self, items):\n        return items.orderBy('doc_id').limit(5)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    yield str(tmp_path)
    for m in [m for m in sys.modules if m.startswith("skein_plugins") or m == "own_steps"]:
        del sys.modules[m]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_steps_of_a_plugin_over_documents(spark, plugins):
    assert set(registry.steps()) >= {"long", "shout", "best"} and "lines" in registry.list_engines()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = registry.chain(docs, "long", "shout", "best").collect()
    want = docs.where(F.length("text") > 100).orderBy("doc_id").limit(5).collect()
    assert [(r.doc_id, r.text) for r in got] == [(r.doc_id, r.text.upper()) for r in want]
    with pytest.raises(KeyError, match="no step other"):
        registry.chain(docs, "other")
    with pytest.raises(ValueError, match="a step is one of"):
        registry.register_step(lambda x: x, "odd", "nothing")


def test_source_of_a_plugin_parses_on_executors(spark, plugins):
    spark.sparkContext.addPyFile(os.path.join(plugins, "skein_plugins", "mine.py"))  # as an installed module would be there
    df = spark.createDataFrame([(1, "lines", "a\nb"), (2, "nobody", "x")], "response_id bigint, engine string, body string")
    import skein_plugins.mine

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(skein_plugins.mine)
    got = registry.responses_to_items(df).orderBy("pos").collect()
    assert [(r.response_id, r.engine_name, r.title, r.url, r.content) for r in got] == [(1, "lines", "a", "https://lines.example/0", "A"), (1, "lines", "b", "https://lines.example/1", "B")]
    source = registry.sources()["lines"]
    rows = [(" ", 5, None, {}), ("q" * 1001, 5, None, {}), ("q", 21, None, {}), ("q", 20, "day", {}), ("q", 20, None, {"sort": "1", "b": "2", "a": "1"}), ("q", 20, None, {"sort": "1"})]
    asked = spark.createDataFrame(rows, "query string, page_size int, time_range string, parameters map<string,string>")
    why = asked.select(source.problem(F.col("query"), F.col("page_size"), F.col("time_range"), F.col("parameters")).alias("p")).collect()
    assert [r.p for r in why] == ["empty query", "query too long", "page size over 20", "no time range", "no parameter a", None]


def test_a_source_has_to_be_whole():
    class Half(Source):
        name = "half"

        def build_request(self, query):
            return ""

    with pytest.raises(TypeError):
        Half()
    assert Abilities().max_page_size == 100


def test_captured_answers_with_filters_pushed_down(spark, tmp_path):
    for engine, page, n in (("bing", 1, 3), ("bing", 2, 2), ("sogou", 1, 4)):
        folder = tmp_path / f"engine={engine}" / f"page={page}"
        folder.mkdir(parents=True)
        for f in range(2):
            (folder / f"{f}.jsonl").write_text("\n".join(json.dumps({"response_id": f * 100 + i, "body": f"{engine} {page} é {i}"}) for i in range(n)) + "\n\n")
    captured.register(spark)
    every = spark.read.format("captured").load(str(tmp_path))
    assert every.count() == 18
    one = every.where((F.col("engine") == "bing") & F.col("page").isin(1, 7) & (F.col("response_id") > 0))
    assert sorted((r.response_id, r.body) for r in one.collect()) == [(i, f"bing 1 é {i % 100}") for i in (1, 2, 100, 101, 102)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (engine" not in plan and "page#" in plan and one.rdd.getNumPartitions() == 2
    assert every.where("engine = 'nobody'").count() == 0
