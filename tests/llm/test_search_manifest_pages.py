"""Lexical search, Merkle manifest and HTML extraction against brute force on small tables with awkward rows."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from compare import duck, rows_of
from pyspark.sql import functions as F
from test_operators import LOW, SF, awkward

from kbspark.llm import lexical, merkle, pages

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, level int, block string"


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents with a hot source, awkward rows, repeated rows and ids, and columns whose names the operators use themselves."""
    real = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "1 AS rank", "2 AS level", "'b' AS block")
    odd = [(i, t, g, s, n, 1, 2, "b") for k, (i, t, g, *_) in enumerate(awkward()) for s, n in [("src0" if k % 3 else None, k if k % 4 else None)]]
    hot = [(5000 + i, f"Hot copy {i % 3}", None, "hot", 9, 1, 2, "b") for i in range(300)] + [(7000, "Same Row", "en", "hot", 8, 1, 2, "b")] * 70 + [(7001, f"one id {i}", "en", "é", 8, 1, 2, "b") for i in range(20)]
    return spark.createDataFrame(odd + hot, DOCS).unionByName(real).persist()


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute_rank(docs, items, top=10):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
            scored += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("search", [lexical.Search(), lexical.Search(top=3, leaf=2, entries=400, terms=60)])
def test_ranking(spark, docs, search):
    items = spark.createDataFrame([(1, "The quick brown fox"), (1, "hot COPY same row"), (2, "nothingofthekind zzz"), (3, None), (4, "..."), (None, "wörd one id"), (9, "fox " * 500)], "item_id long, text string").unionByName(spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id + 10 AS item_id", "text"))
    items = items.withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("x"))
    got = sorted(map(tuple, lexical.rank_documents(docs, items, search).collect()), key=str)
    want = brute_rank([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], search.top)
    # rows with equal scores and without ids, or of one id, can't be told apart
    assert got == want


def test_ranking_of_empty_tables(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = ["item_id", "rank", "doc_id", "score"]
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items), (docs, items.withColumn("text", F.lit(None).cast("string")))):
        out = lexical.rank_documents(a, b)
        assert out.columns == columns and not out.collect()


def test_tree_shares_paths_and_bounds():
    """Nodes' bounds hold for all documents below, and documents with equal frequent terms share nodes."""
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.geometric(0.1, 12).clip(1, 50) - 1) for _ in range(500)] + [np.arange(5)] * 100 + [np.zeros(0, np.int64)] * 3
    cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    rank, tf = np.concatenate(lists).astype(np.int32), rng.integers(1, 9, cut[-1]).astype(np.int32)
    tree = lexical.FPTree(np.arange(len(lists)), cut, rank, tf, rng.integers(10, 200, len(lists)), 8, 50)
    assert len(tree.lo) > 20 and max(tree.depth) >= 3
    for node, below in enumerate(tree.children):
        if below:
            assert [tree.lo[node], *(tree.hi[b] for b in below)] == [*(tree.lo[b] for b in below), tree.hi[node]]
        a, b = tree.cut[tree.lo[node]], tree.cut[tree.hi[node]]
        most = collections.defaultdict(int)
        for r, t in zip(tree.rank[a:b].tolist(), tree.tf[a:b].tolist()):
            most[r] = max(most[r], t)
        held = {r: int(tree.most_tf[i]) for r in range(50) for i in range(tree.by_term[r], tree.by_term[r + 1]) if tree.node_of[i] == node}
        assert held == dict(most) and tree.least_m[node] == tree.m[tree.lo[node] : tree.hi[node]].min()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def climb(nodes, at, digest):
    """Siblings of a node up to the root, the root, and the root that follows from ``digest``."""
    siblings = []
    while len(nodes) > 1:
        lo = at // 16 * 16
        run = nodes[lo : lo + 16]
        siblings += run[: at - lo] + run[at - lo + 1 :]
        digest = h(*run[: at - lo], digest, *run[at - lo + 1 :])
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], at // 16
    return siblings, nodes[0], digest


def brute_manifest(rows):
    sources = collections.defaultdict(list)
    for r in rows:
        bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        leaf = leaf_of(r, r.text)
        sources[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf, leaf_of(r, r.text and r.text.translate(LOW)) if bad else leaf, r.doc_id))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted(sources[s]) for s in names]
    subroots = [climb([x[2] for x in t], 0, "")[1] for t in trees]
    for k, tree in enumerate(trees):
        leaves = [x[2] for x in tree]
        for at, (_, _, leaf, other, doc) in enumerate(tree):
            low, subroot, folded = climb(leaves, at, other)
            high, root, folded = climb(subroots, k, folded)
            yield doc, leaf, subroot, root, h(*low, *high), folded, folded == root


@pytest.mark.parametrize("block", [4096, 37])
def test_manifest(docs, block):
    got = sorted(map(tuple, merkle.manifest(docs, merkle.Shape(block=block)).collect()), key=str)
    assert got == sorted(brute_manifest(docs.collect()), key=str)
    assert {x[-1] for x in got} == {True, False}


def test_manifest_of_few_rows(spark, docs):
    assert merkle.manifest(docs.limit(0)).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert not merkle.manifest(docs.limit(0)).collect()
    for n in (1, 16, 17, 257):
        big = spark.createDataFrame([(2**60 + i, "Aa", None, None, 2, 1, 2, "b") for i in range(n)], DOCS)
        got = sorted(map(tuple, merkle.manifest(big).collect()))
        assert got == sorted(brute_manifest(big.collect()))


def test_proofs_of_some_leaves(docs):
    """Any part of the leaves can be proved: fetched nodes are those that can't be derived, and no others."""
    shape = merkle.Shape(block=1000)
    placed = merkle.place_leaves(docs, shape)
    nodes = merkle.build(placed, shape)
    some = placed.where("doc_id % 7 = 1 and other is null")
    got = {r.doc_id: r for r in merkle.prove(some, nodes, shape).collect()}
    whole = {x[0]: x for x in brute_manifest(docs.collect())}
    for i, r in got.items():
        if i not in (1, 7001):
            assert tuple(r) == whole[i]
    rng = random.Random(3)
    for n in (1, 2, 16, 17, 300, 5000):
        known = np.array(sorted(rng.sample(range(n), min(n, 9))))
        rows = merkle.missing(0, np.zeros(len(known), np.int64), known, np.full(len(known), n), 1, 16)
        have = {(0, p) for p in known.tolist()}
        lack = {(v, p) for t, v, p in rows[["tree", "level", "pos"]].itertuples(index=False) if t == 0}
        level = 0
        while n > 1:
            for up in {p // 16 for v, p in have if v == level}:
                run = {(level, p) for p in range(up * 16, min(up * 16 + 16, n))}
                assert run <= have | lack and not lack & have
                have.add((level + 1, up))
            assert {x for x in lack if x[0] == level} <= {(level, p) for v, q in have if v == level + 1 for p in range(q * 16, q * 16 + 16)}
            n, level = -(-n // 16), level + 1


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style></head><body class="has-sidebar comments-open">
<div id="cookie-banner">We use cookies on this site to make it better for you, please agree.</div>
<header><h1>Site name and a slogan that is somewhat long</h1><nav><ul><li><a href=x>Menu</a><li><a href=y>Items</a></ul></nav></header>
<div class="sidebar"><p>A long side text that has nothing at all to do with the article on this page.</p></div>
%s
<section id="comments"><h2>Comments</h2><article class="comment"><p>I do not agree with this article, because it is much too short to be useful.</p></article></section>
<form><label>Name</label><input><button>Send</button></form><script>var t = "</p>" + "<p>not text but quite long, so that it would be kept</p>";</script>
<footer>&copy; someone who owns the whole of this page and its text</footer></body></html>"""
TEXT = "<h1>Main  title</h1><p>First paragraph &amp; some\n  more &lt;b&gt; text that is long enough to matter.</p><div class='ad'>Buy this thing now, it is cheap and good.</div><p>In.</p><p>Last <b>bold</b> <a href='z'>link</a> line<br>goes on&nbsp;here &copy &#8364;.<ul><li>one<li>two</ul>"
WANT = "Main title\nFirst paragraph & some more <b> text that is long enough to matter.\nIn.\nLast bold link line goes on here © €.\none\ntwo"


def test_extraction():
    assert pages.extract(PAGE % f"<article class='post'>{TEXT}</article>") == WANT
    assert pages.extract(PAGE % f"<main id='content'><header>{TEXT}</header></main>") == WANT
    assert pages.extract(PAGE % f"<div class='content'>{TEXT}</div>") == WANT
    assert pages.extract(PAGE % "") == ""
    for bad in ("", "<", "<p", "<!--", "<script>x", "a < b", "<a href=\"x", "</p></div>", "<p>" * 5000, "<div>" * 5000 + "</li>" * 5000):
        assert isinstance(pages.extract(bad), str)
    assert pages.extract("<article>a < b &am</article>") == "a < b &am"
    long = "<article>" + "".join(f"<p>{i} text</p>" for i in range(20000)) + "</article>"
    assert pages.extract(long).count("\n") == 19999


def test_surge_and_dive():
    rules = pages.Lines(window=2, surge=50)
    assert pages.surges([0, 0, 40, 60, 0, 30, 0, 0, 90, 0, 0, 5, 0], rules) == [(2, 6), (8, 9)]
    assert pages.surges([], rules) == [] and pages.surges([49], rules) == [] and pages.surges([50], rules) == [(0, 1)]


def test_main_text(spark):
    real = spark.read.parquet(f"{SF}/pages.parquet")
    odd = [(1000, "u", None), (1001, None, ""), (None, "v", "<article>x</article>"), (1000, "u", "<article>x</article>"), (1000, "u", "<article>x</article>")]
    all_ = real.unionByName(spark.createDataFrame(odd, real.schema)).withColumn("text", F.lit("no")).withColumn("n_chars", F.lit(-1))
    got = collections.Counter(map(tuple, pages.main_text(all_).collect()))
    want = collections.Counter({(1000, "u", "", 0): 1, (1001, None, "", 0): 1, (None, "v", "x", 1): 1, (1000, "u", "x", 1): 2})
    for r in real.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        text = "\n".join(b for b in blocks if b)
        want[r.page_id, r.url, text, len(text)] += 1
    assert got == want
    assert not pages.main_text(all_.limit(0)).collect()


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_merkle_manifest"])
def test_sql(spark, name):
    import __spark_entry__ as e

    assert rows_of(e.queries()[name](spark, SF)) == duck(e.oracle_sql()[name], SF)
