"""Base and deltas: two writers, a write that was cut off, and a compaction lose nothing."""

from concurrent.futures import ThreadPoolExecutor

from crawlspark.session import shared_dir
from crawlspark.sources.versions import KEPT_MANIFESTS, Versions, added

SCHEMA, KEYS = "cache_key string, score int", ["cache_key"]


def delta(spark, *rows):
    return spark.createDataFrame([(*r, False)[:3] for r in rows], SCHEMA + ", removed boolean")


def entries(store):
    return {r.cache_key: r.score for r in store.latest("state", SCHEMA, KEYS).collect()}


def test_two_writers_at_once_keep_every_entry(spark):
    place = shared_dir(spark, "t-writers")

    def write(k):
        Versions(spark, place).append("state", delta(spark, (f"k{k}", k), ("shared", k)))

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(write, range(16)))
    store = Versions(spark, place)
    got = entries(store)
    assert {k: v for k, v in got.items() if k != "shared"} == {f"k{k}": k for k in range(16)} and got["shared"] in range(16)
    assert store.current()["number"] == 15


def test_later_deltas_win_and_remove(spark):
    store = Versions(spark, shared_dir(spark, "t-later"))
    assert entries(store) == {}
    store.append("state", delta(spark, ("a", 1), ("b", 2), ("c", 3)))
    store.append("state", delta(spark, ("a", 9), ("b", None, True)))
    assert entries(store) == {"a": 9, "c": 3}
    store.append("state", delta(spark, ("b", 5)))
    assert entries(store) == {"a": 9, "b": 5, "c": 3}


def test_a_write_that_was_cut_off_is_not_seen(spark):
    store = Versions(spark, shared_dir(spark, "t-cut"))
    store.append("state", delta(spark, ("a", 1)))
    store.write(delta(spark, ("a", 2)))  # written, never published
    assert entries(store) == {"a": 1}
    store.append("state", delta(spark, ("b", 3)))
    assert entries(store) == {"a": 1, "b": 3}


def test_compaction_keeps_what_is_published_meanwhile(spark, monkeypatch):
    store = Versions(spark, shared_dir(spark, "t-compact"))
    store.append("state", delta(spark, ("a", 1), ("b", 2)))
    store.append("state", delta(spark, ("a", None, True), ("c", 3)))
    write = Versions.write

    def write_slowly(self, df):
        folder = write(self, df)
        monkeypatch.setattr(Versions, "write", write)
        Versions(spark, store.location).append("state", delta(spark, ("b", 7), ("d", 4)))  # before the base is published
        Versions(spark, store.location).compact("state", SCHEMA, KEYS)                     # and another compaction
        return folder

    monkeypatch.setattr(Versions, "write", write_slowly)
    store.compact("state", SCHEMA, KEYS)
    assert entries(store) == {"b": 7, "c": 3, "d": 4}
    assert len(store.current()["tables"]["state"]) == 1


def test_tables_change_together_and_old_manifests_go(spark):
    store = Versions(spark, shared_dir(spark, "t-together"))
    store.publish(added({"x": store.write(delta(spark, ("a", 1))), "y": store.write(delta(spark, ("b", 2)))}, {"batch": 7}))
    now = store.current()
    assert now["marks"] == {"batch": 7} and set(now["tables"]) == {"x", "y"}
    for k in range(KEPT_MANIFESTS + 5):
        store.publish(added({}, {"batch": k}))
    names = [s.getPath().getName() for s in store._fs.listStatus(store._manifest("x").getParent())]
    assert len([n for n in names if n.isdigit()]) <= KEPT_MANIFESTS + 1 and not any("draft" in n for n in names if not n.endswith(".crc"))
    assert store.current()["marks"] == {"batch": KEPT_MANIFESTS + 4}
