"""The versioned store: upserts, drops, rebuilds, snapshots, and changes that fail half-way."""

import pytest
from pyspark.sql import functions as F

from docaudit.operators import prep, registry
from docaudit.sources import readers
from docaudit.sources.store import Conflict, Store

SCHEMA = "collection string, id long, text string, load int"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", "id", buckets=4)
    s.upsert(spark.createDataFrame([("ai", i, f"a{i}", 0) for i in range(40)] + [("gdpr", i, f"g{i}", 0) for i in range(10)], SCHEMA))
    return s


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_last_write_wins_and_only_touched_partitions_change(spark, store):
    before = store.state()
    load = [("ai", 3, "new", 1), ("ai", 3, "newer", 2), ("ai", 100, "more", 1)]
    store.upsert(spark.createDataFrame(load, SCHEMA), order="load")
    after = store.state()
    got = {(c, i): t for c, i, t, _ in rows(store.read())}
    assert got[("ai", 3)] == "newer" and got[("ai", 100)] == "more" and len(got) == 51 and got[("gdpr", 3)] == "g3"
    assert after.folders["gdpr"] == before.folders["gdpr"]
    changed = [b for b, f in after.folders["ai"].items() if before.folders["ai"].get(b) != f]
    assert 1 <= len(changed) <= 2
    assert rows(store.read(version=1)) == rows(store.read(version=1)) and ("ai", 3, "a3", 0) in rows(store.read(version=1))
    tie = [("ai", 5, "x", 1), ("ai", 5, "y", 1)]
    for t in (tie, tie[::-1]):  # ties within a load don't depend on their order
        store.upsert(spark.createDataFrame(t, SCHEMA), order="load")
    assert len({t for c, i, t, _ in rows(store.read(["ai"])) + rows(store.read(["ai"], store.versions()[-2])) if i == 5}) == 1


def test_a_failure_before_the_manifest_leaves_the_old_state(spark, store, monkeypatch):
    before = rows(store.read())

    def fail(state):
        raise OSError("lost")

    monkeypatch.setattr(store, "_commit", fail)
    for change in (lambda: store.upsert(spark.createDataFrame([("ai", 1, "half", 1)], SCHEMA)), lambda: store.rebuild(spark.createDataFrame([("ai", 1, "half", 1)], SCHEMA), ["ai"]), lambda: store.drop(["ai"])):
        with pytest.raises(OSError):
            change()
        assert rows(store.read()) == before
    monkeypatch.undo()
    assert store.vacuum() >= 2 and rows(store.read()) == before  # what the failed changes wrote is gone


def test_a_writer_that_comes_second_is_told(spark, store):
    state = store.state()
    store.drop(["gdpr"])
    with pytest.raises(Conflict):
        store._next(state, state.schema, {})
    assert store.read(["gdpr"]).count() == 0 and store.read().count() == 40


def test_rebuild_to_nothing_empties(spark, store):
    none = spark.createDataFrame([], SCHEMA)
    store.rebuild(none, ["gdpr"])
    assert store.read(["gdpr"]).count() == 0 and store.read(["ai"]).count() == 40
    store.rebuild(spark.createDataFrame([("gdpr", 1, "one", 0), ("ai", 1, "ignored", 0)], SCHEMA), ["gdpr"])
    assert rows(store.read(["gdpr"])) == [("gdpr", 1, "one", 0)] and store.read(["ai"]).count() == 40
    store.upsert(none)
    assert store.read().count() == 41


def test_snapshots_only_of_changed_content(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/snap", "id")
    data = spark.createDataFrame([(i, "t", "x") for i in range(9)], "id long, text string, label string")
    first = s.snapshot("chunks", data)
    assert (first["version"], first["n"]) == ("v1", 9) and s.snapshot("chunks", data.orderBy(F.desc("id"))) == first
    relabelled = data.withColumn("label", F.when(F.col("id") == 3, "y").otherwise(F.col("label")))
    second = s.snapshot("chunks", relabelled)  # the text is the same, a label is not
    assert second["version"] == "v2" and s.snapshot("other", data)["version"] == "v1"
    assert {r.label for r in s.read(["chunks"], second["at"]).collect()} == {"x", "y"} and {r.label for r in s.read(["chunks"], first["at"]).collect()} == {"x"}
    s.vacuum()
    assert s.read(["chunks"], first["at"]).count() == 9  # snapshots stay readable


def test_fingerprint_tells_rows_apart(spark):
    one = lambda *r: prep.fingerprint(spark.createDataFrame([r], "a string, b string"), []).first()["print"]
    prints = [one("x", "y"), one("x", "z"), one("xy", ""), one("", "xy"), one(None, "xy"), one("2:xy", None)]
    assert len(set(prints)) == len(prints)


def test_upsert_does_not_depend_on_order(spark):
    old = spark.createDataFrame([(1, "old")], "id long, text string")
    load = [(1, "b"), (1, "a")]
    got = [registry.upsert(old, spark.createDataFrame(x, "id long, text string"), "id").first().text for x in (load, load[::-1])]
    assert got[0] == got[1] != "old"


def test_a_repeated_header_key_keeps_its_last_value(spark, tmp_path):
    folder = tmp_path / "reg"
    folder.mkdir()
    (folder / "a.txt").write_text("ARTICLE: 9\nDOMAIN: risk\nARTICLE: 10\ntitle_en: x\nTITLE_EN: y\n\n=== EN ===\nText.\n")
    got = readers.read_regulatory(spark, str(folder)).first()
    assert (got.article_num, got.domain, got.title) == (10, "risk", "y")
