"""Cases on which an earlier form failed or was wrong."""

import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import duck, rows_of
from pyspark.sql import functions as F

from kbspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    """A copy of the smallest tables by links, in which a test may put its own."""
    for name in os.listdir(SF):
        os.symlink(f"{SF}/{name}", tmp_path / name)

    def put(table: str, rows: pa.Table, parts: int = 0) -> str:
        path = tmp_path / f"{table}.parquet"
        path.unlink()
        if parts:
            path.mkdir()
            for i in range(parts):
                pq.write_table(rows.slice(i * len(rows) // parts, (i + 1) * len(rows) // parts - i * len(rows) // parts), path / f"part-{i}.parquet")
        else:
            pq.write_table(rows, path)
        return str(tmp_path)

    return put


def agrees(spark, name, at):
    got = rows_of(registry.queries()[name](spark, at))
    sql = registry.oracle_sql()[name]
    for table in os.listdir(at):
        if os.path.isdir(f"{at}/{table}"):  # DuckDB names the files of a folder
            sql = sql.replace(f"FROM {table[:-8]}", f"FROM '{at}/{table}/*.parquet'")
    assert got == duck(sql, at) and got[1]


def test_lookup_meets_the_newest_entry_of_each_set_of_bases_once(spark):
    """A hundred times the entries of a key make no more pairs; sets in any order, with repeats, ties and users without bases."""
    from kbspark.operators import cache as C

    sets = [["a", "b"], ["b", "a", "a"], ["a"], [], ["c"]]
    entries = [(i, "staff", "q", i % 7 != 6, sets[i % 5], datetime.datetime(2024, 1, 1 + i // 250)) for i in range(1000)]
    cache = spark.createDataFrame(entries, "entry_id long, role string, key string, enabled boolean, source_kbs array<string>, updated_at timestamp")
    scope = {1: ["b", "a"], 2: ["c"], 3: ["x"], 4: None}
    questions = [(u * 1000 + i, "staff", u, "Q?") for u in (1, 2, 3, 4, 5) for i in range(200)]
    found = C.lookup(spark.createDataFrame(questions, "question_id long, role string, user_id long, question string"), cache, spark.createDataFrame(list(scope.items()), "user_id long, kbs array<string>"))
    want = {}
    for q, _, user, _ in questions:
        fit = [(e[5], e[0]) for e in entries if e[3] and e[4] and set(e[4]) <= set(scope.get(user) or [])]
        if fit:
            want[q] = max(fit)[1]
    assert dict(map(tuple, found.collect())) == want
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [role" in joined.split("Join Inner, ((role")[-1]  # both sides of the join by key are grouped first


@pytest.mark.parametrize("name, table", [("str01_screen_stream", "conversations"), ("str06_live_context", "conversations"), ("str07_ingest_stream", "documents")])
def test_streams_of_a_folder_of_files(spark, folder, name, table):
    """The table is a folder of part files."""
    at = folder(table, pq.read_table(f"{SF}/{table}.parquet"), parts=3)
    assert rows_of(registry.queries()[name](spark, at)) == duck(registry.oracle_sql()[name], SF)


def test_guard_stats_at_the_edges_of_a_second(spark, folder):
    """Moments within a second of the first and last one that count."""
    end = datetime.datetime(2024, 1, 31)
    edges = [end - datetime.timedelta(days=d) + datetime.timedelta(microseconds=m) for d in (0, 1, 7) for m in (-500_000, -1, 0, 1, 500_000)]
    e = pq.read_table(f"{SF}/events.parquet").slice(0, len(edges))
    agrees(spark, "agg08_guard_stats", folder("events", e.set_column(e.schema.get_field_index("ts"), "ts", pa.array(edges, e.schema.field("ts").type))))


def test_offsets_of_passages_that_recur(spark, folder):
    """A short buffer is kept whole by the overlap, so two chunks begin at one place and the search finds an earlier one."""
    from kbspark.operators import chunking as K

    unit = "word " * 98 + "ends.. "
    text = f"ab\n{unit}\nmiddle\n\n" + "x " * 300 + f"\n\nab\n{unit}\n" + "tail " * 200
    found = K.pack(text, 500, 50)
    starts = [a for a, _ in K.locate(text, found)]
    assert starts != sorted(starts)
    cut = K.placed(text, 500, 50)
    assert [c for c, _ in cut] == found and [at for _, at in cut] == sorted(at for _, at in cut) and all(text[at : at + len(c)] == c for c, at in cut)
    d = pq.read_table(f"{SF}/documents.parquet")
    texts = [text if i < 3 else t for i, t in enumerate(d["text"].to_pylist())]
    agrees(spark, "txt09_chunk_offsets", folder("documents", d.set_column(d.schema.get_field_index("text"), "text", pa.array(texts, d.schema.field("text").type))))


def test_words_that_cancel_out_have_a_direction(spark, folder):
    """Two words of opposite sign in one place; a chunk of them alone had a vector of zeros."""
    import xxhash

    place, pair = {}, None
    for i in range(10_000):
        h = xxhash.xxh64_intdigest(f"w{i}".encode())
        other = place.setdefault((h >> 1) % 64, {})
        other[h & 1] = f"w{i}"
        if len(other) == 2:
            pair = " ".join(other.values())
            break
    d = pq.read_table(f"{SF}/documents.parquet")
    texts = [pair if i < 40 else t for i, t in enumerate(d["text"].to_pylist())]
    agrees(spark, "src09_reindex", folder("documents", d.set_column(d.schema.get_field_index("text"), "text", pa.array(texts, d.schema.field("text").type))))


def test_latency_quantiles_by_the_nearest_second(spark, folder):
    """Half a second before a window begins counts in it or not as in the SQL."""
    edges = [datetime.datetime(2024, 1, 2, 6) + datetime.timedelta(microseconds=m) for m in (-1_500_000, -500_001, -500_000, -499_999, -1, 0, 1, 21_599_500_000, 21_599_499_999)]
    e = pq.read_table(f"{SF}/events.parquet").slice(0, len(edges))
    agrees(spark, "str03_latency_quantiles", folder("events", e.set_column(e.schema.get_field_index("ts"), "ts", pa.array(edges, e.schema.field("ts").type))))


def test_coverage_and_terms_settle_rows_where_they_lie(spark, monkeypatch):
    """Blocks of few queries, short and CJK queries, ties, nulls; no pair of query and chunk is shuffled."""
    from kbspark.functions import text as T
    from kbspark.operators import retrieval as R
    from kbspark.operators import scan

    monkeypatch.setattr(scan, "QUERIES", 2)
    monkeypatch.setattr(scan, "TERMS", 3)
    monkeypatch.setattr(scan, "ROWS", 4)
    words = ["alpha", "beta", "Gamma", "年假申请", "流程", "x1"]
    chunks = spark.createDataFrame([(i, " ".join(words[(i * j) % 6] for j in range(1, 5)) if i % 9 else (None, "")[i % 2]) for i in range(80)], "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "GAMMA rays"), (3, "年假申请 流程"), (4, "x1"), (5, None), (6, ""), (7, "流程"), (8, "nowhere")], "query_id long, text string")
    pairs = R.query_terms(queries).select("query_id", F.lower("term").alias("term")).join(chunks, F.expr("instr(lower(content), term) > 0")).select("query_id", "chunk_id").distinct()
    many = R.contains_any(R.query_terms(queries), chunks, small=0)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, pairs.collect()))
    want = R.top(pairs.join(queries, "query_id").join(chunks, "chunk_id").select("query_id", "chunk_id", T.lexical_coverage("text", "content").alias("score")), 5)
    got = R.coverage_search(queries, chunks)
    assert rows_of(got) == rows_of(want) and got.count()
    for plan in (many, got):
        assert "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString()  # no row for each gram of a chunk


def test_index_and_its_searches_shuffle_no_words(spark, tmp_path):
    """The index holds rows of chunks alone; word search and truth find their hits without a row for each word."""
    from kbspark.operators import retrieval as R
    from kbspark.operators import text_index as X

    chunks = spark.createDataFrame([(i, "kb", f"one two {'two ' * (i % 4)}three{i % 3}", True) for i in range(50)], "chunk_id long, kb_id string, content string, is_enabled boolean")
    index = X.TextIndex(spark, f"file://{tmp_path}/i", 2).build(chunks)
    assert os.listdir(tmp_path / "i") == ["grams"]
    queries = spark.createDataFrame([(1, "two one"), (2, "three1"), (3, None)], "query_id long, text string")
    docs, passages = chunks.selectExpr("chunk_id AS doc_id", "content AS text"), spark.createDataFrame([(1, "two three2"), (2, "two two two"), (3, "")], "query_id long, passage string")
    for found in (index.fulltext(queries), R.holding(docs, passages)):
        assert found.count() and "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_approximate_neighbours_meet_no_pairs_in_a_join(spark):
    """The same hits as the exact search, and no join of vectors with queries."""
    from kbspark.operators import retrieval as R

    v = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS chunk_id", "embedding").unionByName(spark.createDataFrame([(10**6, [0.0] * 64)], "chunk_id long, embedding array<float>"))
    q = v.where("chunk_id % 50 = 0").selectExpr("chunk_id AS query_id", "embedding")
    near = R.knn_approx(q, v, 5)
    assert rows_of(near) == rows_of(R.knn(q, v, 5))
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1 << 25, 0])
def test_trigrams_of_a_row_are_one_value(spark, tmp_path, most, monkeypatch):
    """Bytes of the hashes that Spark gives, ascending, by marks and by sorting; blocks, null, blank and CJK texts."""
    import numpy as np

    from kbspark.operators import retrieval as R
    from kbspark.operators import text_index as X

    rows = [(i, "kb", f"word{i % 50} Word{i % 7} über x{i}", True) for i in range(600)] + [(1000, "kb", None, True), (1001, "kb", " .", True), (1002, "kb", "年假申请 流程", False)]
    chunks = spark.createDataFrame(rows, "chunk_id long, kb_id string, content string, is_enabled boolean").coalesce(1)
    want = {r[0]: np.array(sorted(r[1] or []), np.int64).tobytes() for r in chunks.select("chunk_id", F.transform(R.trigrams("content"), lambda g: F.xxhash64(g))).collect()}
    if most:
        index = X.TextIndex(spark, f"file://{tmp_path}/i", 2).build(chunks)
        assert dict(index.grams().dtypes)["grams"] == "binary"  # an array goes through Spark number by number
        assert {r[0]: bytes(r[1]) for r in index.grams().select("chunk_id", "grams").collect()} == want
    words = chunks.select("chunk_id", "kb_id", "is_enabled", "content", F.array_distinct(R.lexemes("content")).alias("words")).toArrow()
    monkeypatch.setattr(X, "MARKS", most)
    for batch in X._gram_rows(iter(words.combine_chunks().to_batches())):
        assert dict(zip(batch.column("chunk_id").to_pylist(), batch.column("grams").to_pylist())) == want


def test_words_of_queries_are_found_without_a_pass_over_words():
    """The same hits as by counting word by word, over blocks of rows, with null rows and words that recur."""
    import pyarrow.compute as pc

    from kbspark.operators import scan

    rows = [None if i % 11 == 0 else [("a", "b", "c", "d")[(i * j) % 4] for j in range(i % 6)] for i in range(100)]
    asked = [(1, ["a"]), (2, ["b", "a"]), (3, ["d", "none"]), (4, ["c", "b", "a"])]
    search, seen = scan.Words(asked, 200, None), []
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["chunk_id", "words"])
    find = pc.index_in
    scan.pc.index_in, keep = (lambda *a, **k: seen.append(1) or find(*a, **k)), scan.pc.index_in
    try:
        for lo in range(0, 100, 7):
            search.add(batch.slice(lo, 7))
    finally:
        scan.pc.index_in = keep
    want = {(q, i, float(sum(r.count(t) for t in own)), len(own)) for q, (_, own) in enumerate(asked) for i, r in enumerate(rows) if r and set(own) <= set(r)}
    assert set(search.found()) == want and want and len(seen) == 15
    empty = scan.Words([], 5, None)
    empty.add(batch)
    assert empty.found() == []


def test_rewrites_of_odd_first_lines(spark, folder):
    """A first line that says nothing, and one whose quotes, white space and tags the operator would take away; the operator itself still takes them."""
    from kbspark.functions import text as T

    odd = ["", " ", "\n", "  \nnext", '"', '" "', '" a "', "a", "it's'", "'a", "`a`", "\ta", "a\rb", "a\r\nb", "　a　", "\xa0", "<think>a", "<think>a</think>b", "查询：a", '"' * 3 + "b" * 40 + '"', "b" * 41, " " + "c" * 39 + " \nd", None]
    d = pq.read_table(f"{SF}/documents.parquet")
    texts = [t for t in odd for _ in (0, 1)]  # at an even and an odd doc_id
    texts += d["text"].to_pylist()[len(texts) :]
    assert d["doc_id"].to_pylist() == list(range(len(texts)))
    agrees(spark, "txt13_clean_rewrite", folder("documents", d.set_column(d.schema.get_field_index("text"), "text", pa.array(texts, d.schema.field("text").type))))
    raw = {"<think>x</think>\n\n年假": "年假", "查询：\n`'\"a\"'`": "a", "noise\n　b\t\r\n ": "b", "员" * 41: "Q", "<think>a": "Q"}
    got = spark.createDataFrame([(r,) for r in raw], "raw string").select("raw", T.clean_rewrite("raw", F.lit("Q")).alias("q"))
    assert dict(map(tuple, got.collect())) == raw
