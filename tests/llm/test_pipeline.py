"""The pipeline's stages one by one against brute force on their own input, and the guard in the entry module."""

import base64

from pyspark.sql import functions as F
from test_operators import awkward, brute_groups, brute_lines, low_words

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp
    import public_tokenizers as p
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(900, "!!! 123", "en", "src0", 7), (901, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns
            after = sorted((r.doc_id, r.text) for r in out.collect())
        if k == 0:
            assert not {900, 901} & {i for i, _ in after} and len(after) >= len(before) - 6
        elif k == 1:
            gone, want = brute_lines(before), []
            for i, t in before:
                text = t if not gone[i, t] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in set(gone[i, t]))
                want += [(i, text)] if text.split() else []
            assert after == sorted(want)
        elif k == 2:
            stay = {i for i, _, c in brute_groups(before) if i == c}
            assert after == sorted((i, t) for i, t in before if i in stay)
        elif k == 3:
            wins = {tuple(w[a : a + 13]) for w in map(low_words, bench) for a in range(max(len(w) - 12, 1))}
            want = []
            for i, t in before:
                w, hit = low_words(t), set()
                for a in range(len(w) - 12):
                    if tuple(w[a : a + 13]) in wins:
                        hit.update(range(a, a + 13))
                want += [(i, t)] if not hit or 20 * len(hit) < len(w) else []
            assert after == sorted(want)
        else:
            raw = open(p.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
            enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert {r.doc_id: r.ids for r in out.collect()} == {i: enc.encode_ordinary(t) for i, t in before}
        docs = out
    assert awkward()


def test_near_duplicate_stage(spark):
    """Five words and 0.8; copies without an id go, unlinked texts of one id stay."""
    import corpus_pipeline as cp

    words = [f"w{i}" for i in range(100)]
    changed = [f"new{i}" if i in (30, 60) else w for i, w in enumerate(words)]
    other, third = " ".join(f"v{i}" for i in range(50)), " ".join(f"u{i}" for i in range(50))
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (None, other), (None, other), (5, third), (5, third), (5, third.replace("u", "t")), (6, "... "), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1))
    out = cp.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[6], rows[7], rows[8]], key=str)


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_oracles(spark):
    from compare import duck, rows_of

    import __spark_entry__ as e

    for name in ("op1_licenses", "op8_decontamination"):
        assert rows_of(e.queries()[name](spark, SF)) == duck(e.oracle_sql()[name], SF)
