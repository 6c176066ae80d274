"""Versions of growing tables, kept vectors, and streams that stop, repeat a batch and go on."""

import json

import pytest

from promptmill.sources.versioned import StreamDedup, VectorStore, VersionedTable


def ids(table):
    return sorted(r.id for r in table.read().collect())


def test_a_broken_append_leaves_the_version_before(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "id bigint, x string", "id")
    assert ids(table) == [] and table.manifest()["version"] == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, x string")
    assert table.append(rows, "first") and not table.append(rows, "first")
    broken = rows.selectExpr("id", "CAST(raise_error('stop') AS STRING) AS x")
    with pytest.raises(Exception, match="stop"):
        table.append(broken)
    assert ids(table) == [1, 2] and table.manifest()["version"] == 1
    # a part without manifest, and a manifest that was cut off
    rows.write.parquet(str(tmp_path / "parts" / "lost"))
    (tmp_path / "manifests" / "000000000002.json").write_text('{"version": 2, "parts": ["lo')
    assert ids(table) == [1, 2]
    (tmp_path / "manifests" / "000000000002.json").unlink()
    for k in range(3, 10):
        table.append(spark.createDataFrame([(k, "c")], "id bigint, x string"), f"tag {k}")
    assert ids(table) == list(range(1, 10)) and len(list((tmp_path / "manifests").glob("*.json"))) <= 6
    table.compact()
    assert ids(table) == list(range(1, 10)) and len(table.manifest()["parts"]) == 1
    assert not table.append(rows, "tag 5") and json.loads(sorted((tmp_path / "manifests").glob("*.json"))[-1].read_text())["version"] == 9
    assert {p.name for p in (tmp_path / "parts").iterdir()} == {*table.manifest()["parts"], "lost"}


@pytest.mark.parametrize("loaded", [False, True])
def test_only_new_texts_are_embedded(spark, tmp_path, loaded):
    def lengths():
        import numpy as np
        return lambda texts: np.array([[len(t), t.count("a"), 1.0] for t in texts], dtype="float32")
    make = lengths if loaded else None
    store = VectorStore(spark, str(tmp_path), dim=64, make=make)
    first = spark.createDataFrame([(1, "a"), (2, "banana"), (3, "a"), (4, None), (5, "")], "id int, t string")
    rows, new = store.embed(first, "t")
    got = {r.id: r.embedding for r in rows.collect()}
    assert new == 3 and got[1] == got[3] and got[4] is None and got[5] is not None
    if make:
        assert got[2] == [6.0, 3.0, 1.0]
    again = VectorStore(spark, str(tmp_path), dim=64, make=make)
    rows, new = again.embed(first, "t")
    assert new == 0 and {r.id: r.embedding for r in rows.collect()} == got
    rows, new = again.embed(spark.createDataFrame([(9, "new"), (1, "a")], "id int, t string"), "t")
    assert new == 1 and {r.id: r.embedding for r in rows.collect()}[1] == got[1]
    again.table.compact()
    assert again.embed(first, "t")[1] == 0


BATCHES = [[(5, "A  b"), (2, "a b"), (3, "c")], [(1, "C"), (4, "d"), (9, None)], [(7, "D "), (6, "e"), (8, ""), (0, "a b")]]
KEPT = [(2, "a b"), (3, "c"), (4, "d"), (9, None), (6, "e"), (8, "")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, t string")


def test_batches_repeated_after_a_failure(spark, tmp_path):
    dedup = StreamDedup(spark, str(tmp_path), "id bigint, t string", "id", "t")
    dedup.add(frame(spark, BATCHES[0]), 0)
    dedup.add(frame(spark, BATCHES[0]), 0)
    # the driver is lost between the two appends of a batch
    seen, dedup.seen = dedup.seen, None
    with pytest.raises(AttributeError):
        dedup.add(frame(spark, BATCHES[1]), 1)
    dedup.seen = seen
    dedup = StreamDedup(spark, str(tmp_path), "id bigint, t string", "id", "t")
    dedup.add(frame(spark, BATCHES[1]), 1)
    dedup.add(frame(spark, BATCHES[1]), 1)
    dedup.add(frame(spark, BATCHES[2]), 2)
    assert sorted(dedup.kept.read().collect(), key=str) == sorted(frame(spark, KEPT).collect(), key=str)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    def source():
        return spark.readStream.schema("id bigint, t string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, rows in enumerate(BATCHES):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        StreamDedup(spark, str(tmp_path / "out"), "id bigint, t string", "id", "t").run(source())
    kept = StreamDedup(spark, str(tmp_path / "out"), "id bigint, t string", "id", "t").kept.read().collect()
    assert sorted(kept, key=str) == sorted(frame(spark, KEPT).collect(), key=str)
