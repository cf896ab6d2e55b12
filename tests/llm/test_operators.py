"""Every numbered operator against a brute-force version on small tables with awkward rows."""

import base64
import collections
import hashlib
import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from kbspark.llm import bpe, decontamination, language, licenses, lines, lm_score, ngram_join, pii, quality, shards

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, line string, words string, h long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low_words(x):
    return WORD.findall((x or "").translate(LOW))


def awkward():
    base = "The quick brown fox jumps over the lazy dog while seven green birds watch from a tall old tree"
    rows = [
        (1, base, "en"), (1, base, "en"), (2, base + " again", "en"), (3, base.upper(), None), (None, base, None), (4, None, "en"), (5, "", "en"), (6, " \n\t\n ", None), (7, "!!! ... 123", None),
        (8, base + "\n" + base + "\n\nUnder the MIT License under the MIT license under the mit license", "en"), (9, "ein zwei drei\n" * 3000, "de"), (10, "a", None), (11, "a b", None), (12, "b a", None), (13, "a b", None),
        (14, "wörd " * 40 + "\x1c😀 mail a.b@c.de, call +49 (30) 1234-5678 or 4111 1111 1111 1111 from 10.0.0.255", "de"), (15, "x@y.z_w@q.rs 1.2.3.4.5 999.1.1.1 4111-1111-1111-1112 +1 2", None),
        (16, "Apache License, Version 2.0; CC-BY-NC\nAll rights reserved by the owners", None), (17, "tail\r\n\x0bword\x85end x", None),
    ]
    return [(i, t, g, "src0", 5, "x", "y", 9) for i, t, g in rows]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "1 AS n_words", "'l' AS line", "'w' AS words", "1L AS h")
    return spark.createDataFrame(awkward(), SCHEMA).unionByName(real).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want, cols):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    assert got == sorted(want, key=key)


def test_licenses(docs, rows, empty):
    rules = licenses.LicenseRules()
    want = []
    for i, x in rows:
        w = low_words(x)
        found = [(a, lab) for p, lab in rules.phrases for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        more = {(lab, len(set(low_words(ln)) & s) / len(s)) for ln in (x or "").split("\n") for lab, s, need in rules.sets if len(set(low_words(ln)) & s) >= need}
        score = 1.0 if found else max((c for _, c in more), default=0.0)
        want.append((i, len(w), len(found), min((a for a, _ in found), default=None), max((a for a, _ in found), default=None), ",".join(sorted({b for _, b in found})), ",".join(sorted({b for _, b in found} | {b for b, _ in more})), score))
    same(licenses.scan_licenses(docs), want, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    assert licenses.scan_licenses(empty).count() == 0


def text_hash(text):
    """Spark's xxhash64 of a text, which orders the texts of one id."""
    return int.from_bytes(xxhash.xxh64_digest((text or "").encode(), 42), "big", signed=True)


def brute_lines(rows, num=80, den=100):
    order = sorted({(i is not None, i, t) for i, t in rows}, key=lambda r: (r[0], r[1] or 0, text_hash(r[2])))
    items = [(i, t, n, frozenset(x.lower().split())) for _, i, t in order for n, x in enumerate((t or "").split("\n")) if x.split()]
    # any earlier line counts, also one that goes
    all_sets, gone = [], collections.defaultdict(list)
    seen = set()
    for i, t, n, s in items:
        if s in seen or any(den * len(s & e) >= num * len(s | e) for e in all_sets):
            gone[i, t].append(n)
        if s not in seen:
            seen.add(s)
            all_sets.append(s)
    return gone


def test_line_dedup(docs, rows, empty):
    gone = brute_lines(rows)
    want = [(i, sum(bool(x.split()) for x in (t or "").split("\n")), len(gone[i, t]), ",".join(map(str, gone[i, t]))) for i, t in rows]
    same(lines.removed_lines(docs), want, ["doc_id", "n_lines", "n_removed", "removed"])
    kept = []
    for r in docs.collect():
        g = set(gone[r.doc_id, r.text])
        text = r.text if not g else "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in g)
        if not g or text.split():
            kept.append((r.doc_id, text, r.line, r.h))
    same(lines.drop_later_lines(docs), kept, ["doc_id", "text", "line", "h"])
    assert lines.removed_lines(empty).count() == 0 and lines.drop_later_lines(empty).columns == empty.columns


@pytest.mark.parametrize("short", [-1, 127])
def test_line_dedup_lists(docs, rows, monkeypatch, short):
    """All words by the way of long lists, and all by that of short ones."""
    monkeypatch.setattr(lines, "SHORT", short)
    want = sorted((i if i is not None else lines._LEAST, tuple(n)) for (i, _), n in brute_lines(rows).items())
    got = sorted((r.doc, tuple(sorted(r.places))) for r in lines.removed_places(docs, bits=4).collect() if r.places)
    assert got == [w for w in want if w[1]]


def test_line_dedup_clashing_ids_and_groups(spark):
    """Texts under one id are told apart; near copies of a group, some of them unlike its first line, and lines of one word."""
    words = [f"w{i}" for i in range(40)]
    rows = [(1, "alpha beta"), (1, "alpha beta\nother line"), (1, "alpha beta\nother line"), (None, "x"), (2, "x\nx\nX"), (3, "y x")]
    rows += [(10 + k, " ".join([*words[: 30 + k % 10], f"own{k}"])) for k in range(200)]
    rows += [(300 + k, " ".join(words[k % 20 : k % 20 + 20][::-1])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute_lines(rows)
    want = [(i, sum(bool(x.split()) for x in t.split("\n")), len(gone[i, t]), ",".join(map(str, gone[i, t]))) for i, t in rows]
    same(lines.removed_lines(df), want, ["doc_id", "n_lines", "n_removed", "removed"])


def test_language(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(real)
    out = language.identify(real, model).join(real.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id")))
    right, n = out.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * n
    got = {r.doc_id: r for r in language.identify(docs.where("doc_id < 100"), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 7)) and got[9].lang_pred == "de"
    kept = {r.doc_id for r in language.keep_identified(docs, model).collect()}
    assert not kept & {4, 5, 6, 7} and {100 + i for i in range(150)} <= kept
    assert language.identify(empty, model).count() == 0 and language.train(empty).langs == ()
    assert {r.lang_pred for r in language.identify(docs, language.train(empty)).collect()} == {"und"}


def test_mixture_finds_both_languages(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(real)
    a, b = (real.where(F.col("lang") == k).orderBy(F.desc("n_chars")).first().text[:3000] for k in ("en", "fr"))
    mixed = spark.createDataFrame([(1, a + "\n" + b)], "doc_id long, text string")
    mix = language.identify(mixed, model).first().mixture
    assert set(mix) == {"en", "fr"} and all(0.3 < v < 0.7 for v in mix.values())


def test_quality(docs, rows, empty):
    import zstandard

    bands, want = quality.CompressionBands(), []
    for i, x in rows:
        w = re.findall("[^\x20\x09-\x0d]+", x or "")
        grams = collections.Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
        hit = {a + j for a in range(len(w) - 7) if grams[tuple(w[a : a + 8])] > 1 for j in range(8)}
        seen, dup = set(), 0
        for ln in (x or "").split("\n"):
            if re.search("[^\x20\x09-\x0d]", ln):
                dup += ln in seen
                seen.add(ln)
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        b = (x or "").encode()
        z = zstandard.ZstdCompressor(level=bands.level)
        limit = [m for m in bands.limits if len(b) >= m[0]][-1:]
        ok = not failed and all(m[1] <= len(z.compress(b)) / len(b) <= m[2] for m in limit)
        last = len(b) - bands.chunk
        chunks = [len(z.compress(b[a : a + bands.chunk])) / bands.chunk for a in ([*range(0, last, bands.chunk), last] if last >= 0 else [])]
        ok = ok and sum(not bands.chunk_limits[0] <= r <= bands.chunk_limits[1] for r in chunks) <= bands.chunk_share * len(chunks)
        want.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", x or "")), dup, len(hit), failed, ok))
    same(quality.quality_rules(docs), want, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    assert quality.quality_rules(empty).count() == 0


def test_quality_judges_the_tail(spark):
    """A bad tail of less than a chunk counts; whole chunks are judged once."""
    import random

    rng = random.Random(5)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(150)]
    prose = " ".join(rng.choice(names) for _ in range(3000))
    noise = base64.b64encode(rng.randbytes(9000)).decode()
    rows = [(1, prose[:4096] + noise[:4095]), (2, prose[:8191]), (3, prose[:8192]), (4, prose[:4096]), (5, prose[:4095])]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].ratio <= 0.64 and (out[1].chunks, out[1].bad_chunks, out[1].kept) == (2, 1, False)
    short = quality.quality_rules(spark.createDataFrame([(6, "a " * 60), (7, " ".join(f"{c}{i}" for i, c in enumerate("qwertyuiopasdfghjklzxcvb"))), (8, "x " * 21)], "doc_id long, text string")).collect()
    assert [r.kept for r in short] == [False, True, False]
    assert [(out[i].chunks, out[i].kept) for i in (2, 3, 4, 5)] == [(2, True), (2, True), (1, True), (0, True)]


def tokenizer():
    import public_tokenizers as p
    import tiktoken

    raw = open(p.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return p, raw, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, empty):
    p, _, enc = tokenizer()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, x in rows:
        ids = enc.encode_ordinary(x or "")
        want.append((i, len(ids), digest(",".join(map(str, ids)).encode()), digest((x or "").encode()), ids))
    path = p.path("byte_bpe_multi_50k.tiktoken")
    same(bpe.encode_documents(docs, path, p.PATTERN), want, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
    assert bpe.encode_documents(empty, path, p.PATTERN).count() == 0


def test_bpe_odd_texts():
    p, raw, enc = tokenizer()
    coder = bpe.ByteBPE(raw, p.PATTERN)
    for x in ("", "a" * 300, "ab" * 900, "é漢😀" * 50, "\x1c\x85  　", " " * 70 + "x", "it's we'LL 12345 ½ ²", "\x00\xff" * 9, "!?" * 500, "ÀÉ" * 200):
        ids = enc.encode_ordinary(x)
        assert coder.encode(x) == ids and coder.decode(ids) == x.encode()


def test_bpe_long_piece_and_small_cache():
    """One pre-token of a megabyte, and a cache that is emptied all the time."""
    p, raw, enc = tokenizer()
    coder = bpe.ByteBPE(raw, p.PATTERN, cache_bytes=1000)
    import random

    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij") for _ in range(1 << 20))
    ids = coder.encode(long)
    assert coder.decode(ids) == long.encode() and ids[:2000] == enc.encode_ordinary(long[:6000])[: len(ids[:2000])] and coder.held > 0
    many = " ".join("".join(rng.choice("abcdef") for _ in range(60)) for _ in range(300))
    assert coder.encode(many) == enc.encode_ordinary(many)
    coder.trim()
    assert coder.held == 0 and not coder.cache


def brute_groups(rows, num=90, den=100):
    sets = []
    for i, x in rows:
        w = (x or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[a : a + 3]) for a in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                up[root(a)] = root(b)
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[root(a)] += [i] if i is not None else []
    return [(i, len(s), min(least[root(a)], default=None) if s else i) for a, (i, s) in enumerate(sets)]


def test_ngram_join(docs, rows, empty):
    same(ngram_join.near_duplicates(docs), brute_groups(rows), ["doc_id", "n_shingles", "component_id"])
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_borders(spark):
    """Sets just above and below the threshold, chains of links, and a large group of near copies."""
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words))]
    for k in range(1, 30):
        rows.append((k, " ".join(words[: 400 - k * 2])))
        rows.append((100 + k, " ".join([*words[:-k], *(f"z{k}_{j}" for j in range(k))])))
    rows += [(1000 + k, " ".join([*(f"v{i}" for i in range(80)), f"own{k}"])) for k in range(60)]
    rows += [(2000 + k, " ".join(f"t{k}_{i}" for i in range(n))) for k, n in enumerate((1, 2, 3, 10, 11, 12, 13, 50))]
    rows += [(2100 + k, " ".join([*(f"t{k}_{i}" for i in range(n - 1)), "q"])) for k, n in enumerate((1, 2, 3, 10, 11, 12, 13, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(ngram_join.near_duplicates(df), brute_groups(rows), ["doc_id", "n_shingles", "component_id"])


@pytest.mark.parametrize(("seeds", "slack", "num"), [(0, 0, 80), (1, 0, 80), (4, 2, 80), (4, 0, 70)])
def test_ngram_join_empty_parts(spark, monkeypatch, seeds, slack, num):
    """Sets with empty parts are dealt again, and at last meet under their prefixes."""
    monkeypatch.setattr(ngram_join, "SEEDS", seeds)
    monkeypatch.setattr(ngram_join, "SLACK", slack)
    import random

    rng = random.Random(seeds)
    rows = []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(rng.choice((4, 9, 20, 45, 90)))]
        for v in range(4):
            rows.append((len(rows), " ".join(f"{w}x{v}" if rng.random() < 0.03 * v else w for w in base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(ngram_join.near_duplicates(df, num, 100), brute_groups(rows, num), ["doc_id", "n_shingles", "component_id"])


def test_keep_one(docs, rows):
    groups = brute_groups(rows)
    want = sorted({i for i, _, c in groups if i is not None and i == c})
    out = ngram_join.keep_one(docs)
    got = [r.doc_id for r in out.collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == 1 and out.columns == docs.columns


def test_sharding(spark, docs, empty, tmp_path):
    tiers = shards.Tiers(target=60_000, small=4_000, fanout=3, growth=4)
    parts = docs.randomSplit([1.0] * 7, 3)
    store = shards.shard_arrivals(spark, [p.coalesce(1) for p in parts], f"file://{tmp_path}/s", tiers)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert store.version() > 7 and not store.due()
    assert store.manifest().agg(F.sum("n_rows")).first()[0] == docs.count()
    old = store.read(3)
    assert old.count() == sum(p.count() for p in parts[:3])
    assert max(r.n for r in store.placed("doc_id").groupBy("shard", "shard_rows").agg((F.count("*") - F.col("shard_rows")).alias("n")).collect()) == 0


def test_sharding_table(spark, docs, empty, tmp_path):
    """One table as many arrivals: generations grow, tiers are settled, old data go, every row stays once."""
    tiers = shards.Tiers(target=60_000, small=4_000, fanout=3, growth=4)
    named = docs.withColumnRenamed("line", "__path")
    store = shards.shard_table(named.coalesce(1), f"file://{tmp_path}/t", tiers=tiers)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, named.collect()))
    found = store.manifest().collect()
    assert max(r.generation for r in found) >= 2 and len(found) < 12 and not store.due() and store.version() > 12
    assert sum(r.n_rows for r in found) == docs.count() == store.placed("doc_id").count()
    kept = store.manifest().select("path").collect()
    assert all(open(r.path.removeprefix("file:").replace("///", "/"), "rb").read(4) == b"PAR1" for r in kept)
    none = shards.shard_table(empty, f"file://{tmp_path}/n")
    assert none.version() == 0 and none.read().columns == empty.columns and not none.read().collect()
    assert none.placed("doc_id").columns == ["doc_id", "shard", "generation", "shard_bytes", "shard_rows"] and not none.placed("doc_id").collect()


def test_sharding_equal_sizes(spark, tmp_path):
    """Shards of one size share a tier, and tiers are as a plain simulation over the manifest's sizes expects."""
    tiers = shards.Tiers(target=1 << 20, small=1 << 10, fanout=4, growth=4)
    store = shards.ShardStore(spark, f"file://{tmp_path}/q", tiers)
    for i in range(3):
        store.append(spark.range(1000).selectExpr("id % 7 AS doc_id", "'same' AS text").coalesce(1))
    sizes = [r.bytes for r in store.manifest().collect()]
    assert len(set(sizes)) == 1 and store.due() == []
    store.append(spark.range(1000).selectExpr("id % 7 AS doc_id", "'same' AS text").coalesce(1))
    assert len(store.due()) == 1
    store.settle()
    assert [r.n_rows for r in store.manifest().collect()] == [4000]
    for r in store.manifest().withColumn("tier", tiers.tier()).collect():
        tier, size = 0, max(r.bytes / tiers.small, 1)
        while size >= tiers.growth:
            tier, size = tier + 1, size / tiers.growth
        assert r.tier == tier


def test_sharding_two_writers(spark, docs, tmp_path):
    """Of writers that commit on one version at once, exactly one wins."""
    from concurrent.futures import ThreadPoolExecutor

    store = shards.ShardStore(spark, f"file://{tmp_path}/w")
    store.append(docs.limit(5))
    rows = store.manifest()

    def attempt(_):
        try:
            return shards.ShardStore(spark, f"file://{tmp_path}/w").commit(rows, 1)
        except shards.CommitConflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(attempt, range(6)))
    assert won.count(2) == 1 and won.count(None) == 5 and store.version() == 2


def test_sharding_conflict(spark, docs, empty, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/c")
    store.append(docs.limit(5))
    rows = store.manifest()
    store.commit(rows, 1)
    with pytest.raises(shards.CommitConflict):
        store.commit(rows, 1)
    assert store.version() == 2 and store.read().count() == 5
    other = shards.shard_arrivals(spark, [empty], f"file://{tmp_path}/e")
    assert other.version() == 1 and other.manifest().count() == 0


@pytest.mark.parametrize("most", [256 << 20, 0])
def test_decontamination(spark, docs, rows, empty, most):
    items = [(1, "seven green birds watch from a tall old tree"), (2, "The quick brown fox jumps over the lazy dog while seven green birds watch from"), (3, None), (4, ""), (5, "drei ein zwei"), (6, "..."), (7, "zwei"), (8, "b a"), (None, "quick brown fox jumps")]
    real = [(r.item_id + 10, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench = spark.createDataFrame(items + real, "item_id long, text string")
    wins = collections.defaultdict(set)
    for i, x in items + real:
        w = low_words(x)
        for a in range(len(w) - min(13, len(w)) + 1 if w and i is not None else 0):
            wins[tuple(w[a : a + 13])].add(str(i))
    want = []
    for i, x in rows:
        w, hit, got = low_words(x), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit.update(range(a, a + n))
                    got |= wins[tuple(w[a : a + n])]
        want.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    out = decontamination.contamination(docs, bench, broadcast_bytes=most)
    same(out, want, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    clean = decontamination.decontaminate(docs, bench, broadcast_bytes=most)
    assert sorted(map(str, clean.select("doc_id").collect())) == sorted(str((i,)).replace("(", "Row(doc_id=").replace(",)", ")") for i, *_, c in want if not c)
    assert decontamination.contamination(empty, bench, broadcast_bytes=most).count() == 0
    assert decontamination.contamination(docs, bench.limit(0), broadcast_bytes=most).agg(F.sum("n_hit")).first()[0] == 0
    if most:
        spans = decontamination.decontaminate(docs, bench, remove="spans")
        assert spans.columns == docs.columns and spans.count() == docs.count()


def test_lm_score(spark, docs, rows, empty):
    bits = 12
    target = spark.createDataFrame([(i,) for i in (101, 102, 103, 103)] + [(None,)], "doc_id long")
    good, every = lm_score.train(docs, target, bits)
    tokens = sum(len((x or "").encode().split()) for _, x in rows)
    assert every.word.sum() == every.pair.sum() == every.context.sum() == tokens
    assert good.word.sum() == sum(len((x or "").encode().split()) for i, x in rows if i in (101, 102, 103))
    out = {r.doc_id: r for r in lm_score.score(docs, good, every).where("doc_id IS NOT NULL AND doc_id <> 1").collect()}
    import numpy as np

    from kbspark.llm import _text

    for i, x in rows:
        if i in out:
            data = np.frombuffer((x or "").encode(), np.uint8)
            _, w, c, p = lm_score._tokens(data, np.array([0, len(data)]), bits)
            assert out[i].n_tokens == len(w) == len((x or "").encode().split())
            if not len(w):
                assert out[i].score is None
                continue
            loss = []
            for m in (good, every):
                total = 0.0
                for a, b, d in zip(w, c, p):
                    total -= math.log(min(0.6 * m.pair[d] / max(m.context[b], 1) + 0.38 * m.word[a] / max(m.word.sum(), 1), 1) + 0.02 / 2**bits)
                loss.append(total / len(w))
            assert out[i].score == pytest.approx(loss[0] - loss[1], rel=1e-4, abs=1e-5)
    assert out[101].score < 0
    assert lm_score.cross_entropy_difference(empty, target, bits).count() == 0
    _ = _text


@pytest.mark.parametrize("frequent", [200_000, 40, 0])
def test_lm_score_exact(spark, docs, rows, empty, frequent):
    """Losses from counts of the words and pairs themselves, however many pairs are sent or joined."""
    ids = (101, 102, 103)
    target = spark.createDataFrame([(i,) for i in (*ids, 103)] + [(None,)], "doc_id long")
    texts = [(i, [None, *(x or "").encode().lower().split()]) for i, x in rows]
    counts = []
    for mine in (lambda i: i in ids, lambda i: True):
        pair, context, word = collections.Counter(), collections.Counter(), collections.Counter()
        for i, w in texts:
            if mine(i):
                pair.update(zip(w, w[1:])), context.update(w[:-1]), word.update(w[1:])
        counts.append((pair, context, word, max(word.total(), 1)))
    size = len(counts[1][2])
    want = collections.defaultdict(list)
    for i, w in texts:
        loss = [-sum(math.log(0.6 * p[a, b] / max(c[a], 1) + 0.38 * u[b] / n + 0.02 / size) for a, b in zip(w, w[1:])) / (len(w) - 1) for p, c, u, n in counts] if len(w) > 1 else None
        want[i].append((len(w) - 1, loss))
    out = lm_score.exact_difference(docs, target, frequent=frequent).collect()
    assert len(out) == len(rows)
    for r in out:
        n, loss = want[r.doc_id][0]
        assert r.n_tokens == n
        got = None if r.score is None else (r.loss_target, r.loss_background, r.score)
        assert got == (loss and pytest.approx((*loss, loss[0] - loss[1]), rel=1e-9, abs=1e-9))
    if not frequent:
        full = {(r.doc_id, r.n_tokens): r.score for r in lm_score.cross_entropy_difference(docs, target).collect()}
        assert all(full[r.doc_id, r.n_tokens] == pytest.approx(r.score, rel=1e-9, abs=1e-9) if r.score is not None else full[r.doc_id, r.n_tokens] is None for r in out)
        assert lm_score.cross_entropy_difference(empty, target).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute_pii(x):
    out = [("email", *m.span()) for m in EMAIL.finditer(x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(sum(divmod(v * 2, 10)) if k % 2 else v for k, v in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_spans(docs, rows, empty):
    want = [(i, *(sum(k == kind for k, *_ in brute_pii(x or "")) for kind in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(x or "")).encode()).hexdigest()) for i, x in rows]
    out = pii.pii_digest(docs)
    same(out, want, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
    assert pii.pii_digest(empty).count() == 0


def test_pii_odd_matches():
    for x in ("a@b.c@d.e", "a@b.c_d@e.fr", "@x.y", "a@b", "a@.b.c", "..@a-b.c.", "a@b.c.d,e@f.g", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "+1 (988) 555-2485", "++1 9999999999", "4111 1111-1111 1111", "4111111111111111 2", "é4111111111111111é@a.bc", "x@y.z" * 3, "0000255.0.0.1 00300.1.1.1"):
        assert pii.find_spans(x) == brute_pii(x), x


def test_pii_long_lines():
    """A megabyte of digits, of dotted numbers and of addresses on one line each takes seconds."""
    import time

    began = time.time()
    assert pii.find_spans("7" * (1 << 20)) == [] and len(pii.find_spans("1.2.3.4 " * 130_000)) == 130_000
    text = " ".join(f"user{i}@mail{i}.example.org" for i in range(30_000))
    spans = pii.find_spans(text)
    assert len(spans) == 30_000 and list(pii._terms(text, spans)) == []
    assert time.time() - began < 20


def test_pii_terms(spark, empty):
    """A term that stands beside one person's address alone is found; a common word is not."""
    told = [(i, f"ask zorblatt about it, write joe@mail.com today {i} the end") for i in range(3)]
    plain = [(10 + i, f"the ask about write today end it line {i}") for i in range(400)]
    df = spark.createDataFrame(told + plain, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in pii.pii_digest(df).collect()}
    assert all("term:4:12" in out[i] and "email:" in out[i] for i in range(3))
    assert all("term" not in out[10 + i] for i in range(400)) and all(s.count("term") == 1 for s in (out[0], out[1], out[2]))
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "ask [TERM] about it, write [EMAIL] today 0 the end" and clean[10] == plain[0][1]
    assert pii.redact(empty).count() == 0


def test_pii_terms_of_the_whole_document(spark):
    """Names on another line, far away and repeated are found; rows of one id and text share their spans."""
    far = "and so on with many more plain words in between before it ends"
    told = [(i, f"Name: Jane Zorblatt\nMail: j@x.org\n{far} {far} Zorblatt {i}") for i in range(3)]
    told.append(told[0])
    plain = [(10 + i, f"name mail {far} line {i}") for i in range(400)]
    df = spark.createDataFrame(told + plain, "doc_id long, text string")
    out = pii.redact(df).collect()
    assert sorted(r.text for r in out if r.doc_id < 10) == sorted(f"Name: [TERM] [TERM]\nMail: [EMAIL]\n{far} {far} [TERM] {i}" for i in (0, 0, 1, 2))
    assert sorted(r.text for r in out if r.doc_id >= 10) == sorted(t for _, t in plain)
    assert list(pii._terms("abc def ghi", [("email", 4, 7)])) == [("abc", 0, 3), ("ghi", 8, 11)]


def brute_terms(rows, disclosure=0.7, support=2):
    """Every term against every entity over the distinct documents."""
    docs = {(i, t): (pii.find_spans(t or ""), t or "") for i, t in rows}
    words = {k: {w.lower() for w in re.findall(r"\w+", t)} for k, (_, t) in docs.items()}
    n = max(sum(bool(w) for w in words.values()), 1)
    df = collections.Counter(w for ws in words.values() for w in ws)
    entities = collections.defaultdict(set)
    outside = {k: list(pii._terms(t, spans)) for k, (spans, t) in docs.items()}
    for k, (spans, t) in docs.items():
        for kind, a, b in spans:
            entities[f"{kind}:{t[a:b].lower()}"].add(k)
    marks = collections.defaultdict(set)
    for held in entities.values():
        if len(held) < support:
            continue
        need = disclosure * math.log(n / min(len(held), n / 2))
        both = collections.Counter(w for k in held for w in {w for w, *_ in outside[k]})
        for w, c in both.items():
            if c >= support and math.log(c * n / (max(df[w], c) * len(held))) >= need and math.log(n / df[w]) >= need - 1e-9:
                for k in held:
                    marks[k].add(w)
    order = [*pii.KINDS, "term"]
    return {k: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted([(a, order.index(kind), b, kind) for kind, a, b in spans] + [(a, 4, b, "term") for w, a, b in outside[k] if w in marks[k]])) for k, (spans, t) in docs.items()}


def test_pii_terms_brute_force(spark, docs, rows):
    """All spans over the whole table, with user names, initials, one-character names, and documents that rows repeat many times."""
    told = [(9000 + i, f"jd42 and 王 and Q met Zorblatt at j@x.org, note {i}") for i in range(3)] * 5 + [(9100 + i, f"the note at {i}") for i in range(400)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(told, "doc_id long, text string"))
    want = brute_terms([*rows, *told])
    same(pii.pii_digest(df), [(i, want[i, t]) for i, t in [*rows, *told]], ["doc_id", "spans"])
    assert all(want[9000, told[0][1]].count(f"term:{a}:") for a in (0, 9, 15, 21)) and "term" not in want[9100, told[15][1]]


def test_pii_directories(spark):
    """Two documents that share 20,000 addresses and as many names take seconds: the addresses are one class."""
    import time

    text = " ".join(f"name{i} user{i}@mail.org" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, text + " end")] + [(10 + i, f"plain line {i}") for i in range(100)], "doc_id long, text string")
    began = time.time()
    out = {r.doc_id: r.spans for r in pii.pii_digest(df).collect()}
    assert time.time() - began < 60 and out[1].count("term") == 20_000


def test_clashing_columns(spark):
    """Columns of the names that operators use inside stay as they are."""
    odd = {c: F.lit(f"kept {c}") for c in ("__0", "__1", "__2", "__once", "__row", "__keep", "__doc", "__mark", "__lines", "__places", "__spans", "_1")}
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, line), (2, line), (3, "write to a@b.org")], "doc_id long, text string").withColumns(odd)
    bench = spark.createDataFrame([(1, line)], "item_id long, text string")
    for out, ids in ((ngram_join.keep_sets(docs, 80, 100, 5), [1, 3]), (ngram_join.keep_one(docs), [1, 3]), (lines.drop_later_lines(docs), [1, 3]), (decontamination.decontaminate(docs, bench), [3]), (decontamination.decontaminate(docs, bench, remove="spans"), [1, 2, 3]), (pii.redact(docs), [1, 2, 3])):
        assert out.columns == docs.columns
        found = out.collect()
        assert sorted(r.doc_id for r in found) == ids and all(r[c] == f"kept {c}" for r in found for c in odd)


def test_ngram_join_without_ids(spark):
    """Many texts without an id, or under one, take about as long as with ids and give the same groups."""
    import time

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.concat(F.lit("w"), (F.floor(F.col("id") / 2) * 31 + k).cast("string"))))
    rows = spark.range(4000).select("id", text.alias("text")).persist()
    took, kept = [], []
    for id_ in (F.col("id"), F.lit(None).cast("long"), F.lit(7).cast("long")):
        began = time.time()
        kept.append(sorted(r.text for r in ngram_join.keep_sets(rows.select(id_.alias("doc_id"), "text"), 90, 100, 3).collect()))
        took.append(time.time() - began)
    assert len(kept[0]) == 2000 and kept[0] == kept[1] == kept[2] and max(took[1:]) < 3 * took[0] + 10


def test_line_dedup_shared_passage(spark, monkeypatch):
    """A passage in many lines: nearly all are settled by the earliest line of each size, and few pairs are left for whole lists."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join([*(f"o{i}x{j}" for j in range((i * 7 + 3) % 10)), passage])) for i in range(600)]
    tried, settled = [], lines._settled
    monkeypatch.setattr(lines, "_settled", lambda pairs, *rest: (tried.append(pairs.count()), settled(pairs, *rest))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute_lines(rows)
    same(lines.removed_lines(df), [(i, 1, len(gone[i, t]), ",".join(map(str, gone[i, t]))) for i, t in rows], ["doc_id", "n_lines", "n_removed", "removed"])
    assert tried[1] < 5 * len(rows)


def test_ngram_join_leaves_other_texts(spark, monkeypatch):
    """Texts that meet no other are held back by a Bloom filter before the shuffle of texts."""
    plans, put = {}, ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag, **options: (plans.setdefault(tag, df._jdf.queryExecution().optimizedPlan().toString()), put(df, tag, **options))[1])
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ngram_join.keep_sets(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 80, 100, 5).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "might_contain" in plans["contents"]
