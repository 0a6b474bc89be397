import os
from pathlib import Path

import pytest

from skein.operators import feedstore
from skein.sources import feeds

ANSWER = "feed_url string, body string, persistent boolean, update_interval bigint"


def rss(title, *guids):
    return f"<rss><channel><title>{title}</title>" + "".join(f"<item><title>{title} {g}</title><guid>{g}</guid></item>" for g in guids) + "</channel></rss>"


def files(folder):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_ino) for p in Path(folder).rglob("*.parquet")}


def test_refreshes_write_only_what_is_due(spark, tmp_path):
    store = feedstore.FeedStore(spark, str(tmp_path))
    first = [(f"u{i}", rss(f"f{i}", "a", "b"), i % 2 == 0, 100 if i % 2 == 0 else None) for i in range(12)] + [("bad", None, True, 100), ("odd", "neither", True, 100)]
    assert store.refresh(spark.createDataFrame(first, ANSWER), 1000) == 12
    assert store.items().count() == 24 and store.meta().count() == 12
    before = files(tmp_path)
    again = spark.createDataFrame([("u0", rss("new", "b", "c", "c"), True, 100), ("u1", rss("new", "z"), False, None), ("u2", None, True, 100)], ANSWER)
    assert store.refresh(again, 1050) == 0 and files(tmp_path) == before  # nothing is due yet
    assert store.refresh(again, 1100) == 1
    after = files(tmp_path)
    bucket = {r.feed_url: (r.kind, r.bucket) for r in store.meta().collect()}
    same = lambda p: "/bucket=" + str(bucket["u0"][1]) + "/" not in p
    assert {p: t for p, t in after.items() if same(p)} == {p: t for p, t in before.items() if same(p)} and after != before
    items = sorted((r.place, r.guid, r.title) for r in store.items().where("feed_url = 'u0'").collect())
    assert items == [(0, "b", "new b"), (1, "c", "new c"), (2, "a", "f0 a")]
    meta = {r.feed_url: r for r in store.meta().collect()}
    assert (meta["u0"].name, meta["u0"].last_updated, meta["u0"].item_count, meta["u0"].expires_at) == ("new", 1100, 3, 4700)
    assert len(meta) == 12 and store.items().count() == 25
    # Expired: what is stored goes. A feed that changes its kind stands once.
    store.refresh(spark.createDataFrame([("u0", rss("late", "d"), False, None)], ANSWER), 5000)
    assert [(r.guid, r.kind) for r in store.items().where("feed_url = 'u0'").collect()] == [("d", "temporary")]
    assert store.meta().where("feed_url = 'u0'").count() == 1 and store.meta().count() == 12


def test_templates_as_their_files_say(spark, tmp_path):
    (tmp_path / "one.rss.see").write_text('[meta]\nname = "One"\ndescription = "d"\nlanguage = "zh"\nversion = "1.0"\nupdate_interval = 60\n[feeds]\nworld = "https://w"\nhome = "https://h"\n')
    (tmp_path / "two.rss.see").write_text('[meta]\nname = "Two"\ndescription = "e"\npersistent = false\nauto_update = false\n[feeds]\n')
    (tmp_path / "other.toml").write_text("x = 1")
    got = feeds.templates(spark, str(tmp_path)).orderBy("file").collect()
    assert [tuple(r) for r in got] == [("one", "One", "d", "zh", None, "1.0", True, True, 60, {"world": "https://w", "home": "https://h"}), ("two", "Two", "e", None, None, None, False, False, 3600, {})]
    (tmp_path / "bad.rss.see").write_text("[feeds]\n")
    with pytest.raises(KeyError):
        feeds.templates(spark, str(tmp_path))


def test_feeds_of_a_template_in_one_pass(spark, tmp_path):
    (tmp_path / "t.rss.see").write_text('[meta]\nname = "T"\ndescription = "d"\nupdate_interval = 60\n[feeds]\na = "ua"\nb = "ub"\nc = "uc"\n')
    store = feedstore.FeedStore(spark, os.path.join(tmp_path, "store"))
    t = feeds.templates(spark, str(tmp_path))
    answers = spark.createDataFrame([("ua", rss("A", "1")), ("uc", rss("C", "1", "2")), ("ux", rss("X", "1"))], "feed_url string, body string")
    assert store.add_template(t, answers, 1000, ["a", "b"]) == 2  # a failed feed counts
    assert [(r.feed_url, r.update_interval, r.persistent) for r in store.meta().collect()] == [("ua", 60, True)]
    assert store.add_template(t, answers, 1010) == 3
    assert sorted((r.feed_url, r.item_count, r.last_updated) for r in store.meta().collect()) == [("ua", 1, 1000), ("uc", 2, 1010)]
