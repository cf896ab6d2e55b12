"""Tables on shared storage: partial rewrites, and commits of several tables."""

import os

import pytest

from kbspark.operators import versions as V
from kbspark.plans.versions import _live
from kbspark.sources import files as F
from kbspark.sources import tables as T
from kbspark.sources.standins import Tables

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def names(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}


def test_replace_chunks_writes_only_touched_buckets(spark, tmp_path):
    chunks = Tables(spark, SF).chunks
    path = f"{tmp_path}/chunks"
    T.write_bucketed(chunks, path, "doc_id", 16)
    new = chunks.where("doc_id IN (3, 5)").selectExpr("chunk_id", "doc_id", "kb_id", "chunk_index", "upper(content) AS content", "is_enabled").where("chunk_index = 0")
    new = new.unionByName(spark.sql("SELECT 900000001L AS chunk_id, 900000L AS doc_id, 'src0' AS kb_id, 0L AS chunk_index, 'x' AS content, true AS is_enabled")).cache()
    want = rows_of(F.replace_chunks(chunks, new))
    before = names(path)
    T.replace_chunks_in(path, new, buckets=16)
    after = names(path)
    hit = {f"bucket={r[0]}" for r in new.select(T.bucket_of("doc_id", 16)).distinct().collect()}
    assert 0 < len(hit) < 16
    assert {d for d in after if after[d] != before.get(d)} == hit
    assert rows_of(spark.read.parquet(path).drop("bucket")) == want
    T.replace_chunks_in(path, new.limit(0), buckets=16)
    assert names(path) == after


def test_replace_that_empties_nothing_else(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "doc_id long, content string")
    path = f"{tmp_path}/c"
    T.write_bucketed(old, path, "doc_id", 4)
    T.replace_chunks_in(path, spark.createDataFrame([(1, "c"), (None, "m")], old.schema), buckets=4)
    assert rows_of(spark.read.parquet(path).drop("bucket")) == sorted([("c", 1), ("m", None), ("n", None)], key=repr)


def test_upsert_writes_only_touched_buckets(spark, tmp_path):
    vectors = Tables(spark, SF).vectors.selectExpr("kb_id", "index_version", "chunk_id", "embedding", "0 AS seq")
    path = f"{tmp_path}/v"
    T.write_bucketed(vectors, path, "chunk_id", 16)
    some = vectors.where("chunk_id IN (2, 9)")
    new = some.selectExpr("kb_id", "index_version", "chunk_id", "transform(embedding, x -> x + 1) AS embedding", "1 AS seq").unionByName(some.selectExpr("kb_id", "index_version", "chunk_id", "embedding", "2 AS seq")).unionByName(some.selectExpr("kb_id", "'v2' AS index_version", "chunk_id", "embedding", "3 AS seq")).cache()
    want, before = rows_of(F.upsert_vectors(vectors, new)), names(path)
    T.upsert_vectors_in(path, new, buckets=16)
    after = names(path)
    assert 0 < len([d for d in after if after[d] != before.get(d)]) <= 2
    assert rows_of(spark.read.parquet(path).drop("bucket")) == want


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    from pyspark.sql import functions as fn

    tables, snapshot, config = _live(Tables(spark, SF))
    store = T.TableSet(spark, f"{tmp_path}/set")
    assert store.version() == 0 and store.read() == {}
    base = store.commit(tables, 0)
    before = {n: rows_of(df) for n, df in store.read().items()}
    rolled = V.rollback_tables(store.read(), snapshot, config, Tables(spark, SF).grants, "s1", "v2")
    with pytest.raises(Exception, match="lost"):
        store.commit(rolled | {"kbs": rolled["kbs"].withColumn("name", fn.raise_error(fn.lit("lost")))}, base)
    assert store.version() == base and {n: rows_of(df) for n, df in store.read().items()} == before

    other = T.TableSet(spark, f"{tmp_path}/set")
    assert store.commit(rolled, base) == 2
    with pytest.raises(T.CommitConflict):
        other.commit({"kbs": tables["kbs"]}, base)
    after = {n: rows_of(df) for n, df in other.read().items()}
    assert all(after[n] != before[n] for n in before)
    assert {n: rows_of(df) for n, df in other.read(1).items()} == before


def test_two_writers_of_one_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path, rows = f"{tmp_path}/set", spark.range(3)

    def write(i):
        try:
            return T.TableSet(spark, path).commit({f"t{i}": rows}, 0)
        except T.CommitConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(4)))
    assert done.count(1) == 1 and len(T.TableSet(spark, path).read()) == 1


def test_rollback_of_missing_content_and_settings(spark):
    doc = "doc_id long, kb_id string, filename string, file_type string, content_hash string, chunk_count long"
    make = spark.createDataFrame
    tables = {
        "docs": make([(1, "a", "x", "txt", "h", 2, "ready"), (2, "a", "y", "txt", "h", 3, "archived"), (3, None, "z", "txt", "h", 3, "ready")], f"{doc}, status string"),
        "grants": make([("a", 1, "kb:read"), (None, 2, "kb:read")], "kb_id string, user_id long, permission_code string"),
        "kbs": make([("a", "active", 300), (None, "active", 300)], "kb_id string, status string, chunk_size int"),
        "index_versions": make([("a", "v1", "current", 5)], "kb_id string, version string, status string, chunk_count long"),
        "version_docs": make([("a", "v1", 1)], "kb_id string, version string, doc_id long"),
        "snapshots": make([], "snapshot_id string, kb_id string, trigger string"),
        "snapshot_docs": make([], f"snapshot_id string, {doc}, status string"),
    }
    snapshot = make([(4, "a", "w", "txt", None, 0), (2, "a", "y", "txt", "old", 1)], doc)
    config = make([("a", None)], "kb_id string, chunk_size int")
    none = make([], tables["grants"].schema)
    out = V.rollback_tables(tables, snapshot, config, none, "s", "v2")
    assert {(r.doc_id, r.status) for r in out["docs"].collect()} == {(1, "archived"), (2, "pending_segment"), (3, "ready"), (4, "uploaded")}
    assert {tuple(r) for r in out["kbs"].collect()} == {("a", "vectorizing", 300), (None, "active", 300)}
    assert [tuple(r) for r in out["grants"].collect()] == [(None, 2, "kb:read")]
    assert ("a", "v2", "building", 1) in {tuple(r) for r in out["index_versions"].collect()}
    part = V.rollback_tables(tables, snapshot, config, none, "s", "v2", make([(4,), (9,)], "doc_id long"))
    assert {(r.doc_id, r.status) for r in part["docs"].collect()} == {(1, "ready"), (2, "archived"), (3, "ready"), (4, "uploaded")}
    assert "grants" not in part
    assert {r.doc_id for r in part["version_docs"].where("version = 'v2'").collect()} == {1, 4}
