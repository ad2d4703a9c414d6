"""The bucketed content table: only touched buckets are written, and no commit is lost to another."""

import hashlib
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from listing_lake.operators import snapshots, store

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
CANDIDATE = "seq int, url string, title string, category string, price bigint"


def sha(url):
    return hashlib.sha256(url.encode()).hexdigest()


def link(i):
    return f"https://shop.example/items/{i}"


def arrivals(spark, *rows):
    return spark.createDataFrame([(i, link(n), f"title {n}", category, price) for i, (n, category, price) in enumerate(rows)], CANDIDATE)


def merge(spark, root, *rows, **kw):
    return snapshots.merge(spark, root, arrivals(spark, *rows), NOW, ["seq"], n_buckets=8, **kw)


def stored(spark, root, **kw):
    return {r.url: (r.title, r.price) for r in snapshots.read_content(spark, root, **kw).collect()}


def files(root):
    return {str(p) for p in root.rglob("*.parquet")}


def test_same_rows_as_a_merge_in_memory(spark, tmp_path):
    root = str(tmp_path / "content")
    old = store.conform(spark.createDataFrame([
        {"content_id": f"FIGURE:{d}", "storage_category": "FIGURE", "doc_id": d, "url": u, "status": "KEEP", "title": t, "note": "n"}
        for d, u, t in ((sha(link(1)), link(1) + "#a", "own id"), ("zz", link(2), "z"), ("aa", link(2), "a"), ("bad", "no link", "x"), ("bad2", None, "y"))
    ], store.CONTENT_DDL))
    snapshots.write_content(old, root, n_buckets=8)
    rows = arrivals(spark, (1, "GOODS", 5), (2, "GOODS", 6), (3, "ANIME", None), (3, "GOODS", 7), (2, None, None))
    want, counts = store.merge_content(old, rows, NOW, ["seq"])
    result = snapshots.merge(spark, root, rows, NOW, ["seq"])
    assert sorted(map(str, snapshots.read_content(spark, root).collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, result.drop("product", "base").collect())) == sorted(map(str, counts.drop("product", "base").collect()))
    assert snapshots.read_content(spark, root, "FIGURE").count() == 5 and snapshots.read_content(spark, root, "ANIME").count() == 1


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = tmp_path / "content"
    merge(spark, str(root), *[(i, "GOODS", i) for i in range(200)])
    first, before = snapshots.read_version(spark, str(root)), files(root)
    assert set(first.folders) == set(range(8))
    result = merge(spark, str(root), (7, "GOODS", 700), (7, "GOODS", 701), (900, "GOODS", 1))
    assert {(r.inserted, r.existing, r.updated) for r in result.collect()} == {(0, 2, 2), (1, 0, 0)}
    second, added = snapshots.read_version(spark, str(root)), files(root) - before
    touched = {r[0] for r in arrivals(spark, (7, "", 0), (900, "", 0)).select(snapshots.bucket_of(F.col("url"), 8)).collect()}
    assert second.changed_since(first) == touched and {int(f.split("bucket=")[1].split("/")[0]) for f in added} == touched
    rows = stored(spark, str(root))
    assert len(rows) == 201 and rows[link(7)] == ("title 7", 701) and rows[link(8)] == ("title 8", 8)
    assert stored(spark, str(root), version=first.number)[link(7)] == ("title 7", 7)
    # Rows that carry no news write nothing, but the commit tells that they came.
    snapshots.merge(spark, str(root), arrivals(spark, (3, "GOODS", None)), NOW + timedelta(1), ["seq"])
    third = snapshots.read_version(spark, str(root))
    assert third.folders == second.folders and third.number == second.number + 1 and files(root) - before == added


def test_stored_rows_are_not_shuffled(spark, tmp_path):
    root = str(tmp_path / "content")
    merge(spark, root, *[(i, "GOODS", i) for i in range(50)])
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = snapshots.read_version(spark, root)
        staged = store.stage(arrivals(spark, (1, "GOODS", 3)), ["seq"])
        with snapshots.open_buckets(spark, root, state, list(range(8))) as rows:
            targets = store.pick_canonical(rows.select("content_id", "doc_id", F.col("row_key").alias("url_norm")))
            assert "Exchange" not in targets._jdf.queryExecution().executedPlan().toString()
            plan = snapshots.merged_rows(rows, store.outcome(staged, targets), F.lit(NOW))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    # Column lists are cut in plan text, so look at what stands right above the wide scan instead.
    lines = plan.splitlines()
    wide = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "detailCheckedAt" in line]
    for i in wide:
        depth = lines[i].index("FileScan")
        above = [line for line in lines[:i] if "SortMergeJoin" in line and line.index("SortMergeJoin") < depth]
        between = lines[lines.index(above[-1]):i]
        assert not any("Exchange" in line and line.index("Exchange") < depth for line in between), plan


@pytest.mark.parametrize("same_bucket", [True, False])
def test_interleaved_writers_lose_nothing(spark, tmp_path, monkeypatch, same_bucket):
    root = str(tmp_path / "content")
    merge(spark, root, *[(i, "GOODS", i) for i in range(30)])
    of = {i: b for i, b in enumerate(r[0] for r in arrivals(spark, *[(i, "", 0) for i in range(30)]).orderBy("seq").select(snapshots.bucket_of(F.col("url"), 8)).collect())}
    other = next(i for i in of if i and (of[i] == of[0]) == same_bucket)
    publish, writes, made = snapshots.publish, snapshots._write_buckets, []
    fired = []

    def slow_publish(spark_, root_, version):
        # Just before the first writer commits, a second one does its whole work.
        if not fired:
            fired.append(version.number)
            merge(spark, root, (other, "GOODS", 1000))
        return publish(spark_, root_, version)

    def counted(*args):
        made.append(writes(*args))
        return made[-1]

    monkeypatch.setattr(snapshots, "publish", slow_publish)
    monkeypatch.setattr(snapshots, "_write_buckets", counted)
    merge(spark, root, (0, "GOODS", 2000))
    rows = stored(spark, root)
    assert len(rows) == 30 and rows[link(0)][1] == 2000 and rows[link(other)][1] == 1000
    # Only a writer whose buckets changed under it does its work again; what it wrote first is gone.
    assert len(made) == (3 if same_bucket else 2)
    live = {f.split("/")[0] for f in snapshots.read_version(spark, root).folders.values()}
    left = {p.name for p in (tmp_path / "content" / "data").iterdir() if not p.name.startswith("_")}
    assert live <= left and len(left) == 3


def test_gives_up_after_lost_attempts(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "content")
    merge(spark, root, (0, "GOODS", 0))
    publish, price = snapshots.publish, iter(range(100, 200))
    busy = []

    def always_late(spark_, root_, version):
        if not busy:
            busy.append(1)
            merge(spark, root, (0, "GOODS", next(price)))
            busy.clear()
        return publish(spark_, root_, version)

    monkeypatch.setattr(snapshots, "publish", always_late)
    with pytest.raises(snapshots.Conflict):
        merge(spark, root, (0, "GOODS", 1), attempts=2)
    assert stored(spark, root)[link(0)] == ("title 0", 101)


def test_files_are_created_once(spark, tmp_path):
    path = str(tmp_path / "a" / "entry.json")
    assert snapshots.create_once(spark, path, "first") and not snapshots.create_once(spark, path, "second")
    assert snapshots._read(spark, path) == "first" and snapshots._names(spark, str(tmp_path / "a")) == ["entry.json"]
    # The same through a path that only Spark's file systems know.
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lake.link./a", f"file://{tmp_path}/a")
    far = "viewfs://lake/a/far.json"
    assert snapshots.create_once(spark, far, "first") and not snapshots.create_once(spark, far, "second")
    assert snapshots._read(spark, far) == "first"


def test_batches_count_once(spark, tmp_path):
    root = str(tmp_path / "content")
    assert merge(spark, root, (1, "GOODS", 1), stream="a", batch_id=0) is not None
    assert merge(spark, root, (1, "GOODS", 2), stream="a", batch_id=0) is None
    assert merge(spark, root, (1, "GOODS", 3), stream="b", batch_id=0) is not None
    assert stored(spark, root)[link(1)][1] == 3 and snapshots.read_version(spark, root).streams == {"a": 0, "b": 0}


def test_rewrite_and_vacuum(spark, tmp_path):
    root = tmp_path / "content"
    merge(spark, str(root), *[(i, "GOODS", i) for i in range(40)])
    before = snapshots.read_version(spark, str(root))
    snapshots.rewrite(spark, str(root), F.col("price") == 5, lambda rows: rows.filter("price <> 5"))
    after = snapshots.read_version(spark, str(root))
    assert len(after.changed_since(before)) == 1 and len(stored(spark, str(root))) == 39
    snapshots.rewrite(spark, str(root), F.col("price") == -1, lambda rows: rows.filter("false"))
    assert len(stored(spark, str(root))) == 39
    assert snapshots.vacuum(spark, str(root), keep=1) == 1
    assert len(stored(spark, str(root))) == 39 and snapshots.versions(spark, str(root)) == [after.number + 1]
    snapshots.rewrite(spark, str(root), F.lit(True), lambda rows: rows.filter("false"))
    assert stored(spark, str(root)) == {} and snapshots.read_version(spark, str(root)).folders == {}


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path / "content")
    assert snapshots.read_content(spark, root).count() == 0 and snapshots.versions(spark, root) == []
    assert merge(spark, root).count() == 0
    snapshots.write_content(spark.createDataFrame([], store.CONTENT_DDL), root)
    assert snapshots.read_content(spark, root).count() == 0
