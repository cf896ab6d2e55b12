"""The hit test of all questions against plain Python over the whole of sf0.001."""

import math
import re

import numpy as np
import pytest
from compare import duck
from conftest import SF

from kbspark.functions.hooks import HashingEmbedder
from kbspark.plans import registry
from kbspark.sources.standins import with_standins

CANDIDATES, TOP = 50, 5


def table(sql):
    cols, rows = duck(with_standins(sql), SF)
    return [dict(zip(cols, r)) for r in rows]


def words(text):
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def trigrams(text):
    return {p[i : i + 3] for w in words(text) for p in (f"  {w} ",) for i in range(len(p) - 2)}


def terms(text):
    out = []
    for w in re.split(r"[\s，。；、,.!?？！；：:()（）\[\]【】]+", text):
        out += [x for x in (w, *re.findall(r"[A-Za-z0-9][A-Za-z0-9._-]+", w)) if len(x) >= 2]
    return {x.lower() for x in list(dict.fromkeys(out))[:28]}


def best(scores, n):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:n]


def text_hits(text, chunks):
    need = set(words(text))
    first = {}
    for c in chunks if need else []:
        if need <= c["counts"].keys():
            first[c["chunk_id"]] = 1 - math.exp(-4 * sum(c["counts"][w] for w in need) * 0.1 / len(need))
    scores = dict(best(first, CANDIDATES))
    if len(scores) < CANDIDATES:
        asked, inside = trigrams(text), terms(text)
        near = {c["chunk_id"]: len(asked & c["grams"]) / len(asked | c["grams"]) for c in chunks if any(x in c["lower"] for x in inside)}
        for key, score in best(near, CANDIDATES):
            scores[key] = max(score, scores.get(key, 0.0))
    return best(scores, CANDIDATES)


def test_hit_test_of_all_questions(spark):
    chunks = [c for c in table("SELECT chunk_id, doc_id, content, is_enabled FROM chunks") if c["is_enabled"]]
    for c in chunks:
        found = words(c["content"])
        c.update(counts={w: found.count(w) for w in set(found)}, grams=trigrams(c["content"]), lower=c["content"].lower())
    ids, doc_of = np.array([c["chunk_id"] for c in chunks]), {c["chunk_id"]: c["doc_id"] for c in chunks}
    model = HashingEmbedder()
    vectors = model.embed([c["content"] for c in chunks]).astype(np.float64)
    docs = table("SELECT doc_id, raw_text FROM docs")

    ranks, scores_of_hits = [], []
    questions = table("SELECT question_id, question, passage FROM questions")
    for q in questions:
        variants = list({x.lower(): x for x in reversed([y.strip() for y in (q["question"], q["passage"][60:120])]) if x}.values())
        lists = [text_hits(v, chunks) for v in variants]
        for v in (*variants, q["passage"].strip()):
            cos = np.clip(vectors @ model.embed([v])[0].astype(np.float64), 0, 1)
            lists.append(best(dict(zip(ids.tolist(), cos.tolist())), CANDIDATES))
        lists = [x for x in lists if x]
        fused: dict[int, float] = {}
        for one in lists:
            for r, (key, _) in enumerate(one, 1):
                fused[key] = fused.get(key, 0.0) + 1 / (60 + r)
        top = best({key: min(s / (len(lists) / 61), 1.0) for key, s in fused.items()}, TOP)
        kept = [(r, key, s) for r, (key, s) in enumerate(top, 1) if s >= 0.3] or [(r, key, s) for r, (key, s) in enumerate(top, 1)]
        right = {d["doc_id"] for d in docs if d["raw_text"] and q["passage"] in d["raw_text"]}
        first = next(((r, s) for r, key, s in kept if not right or doc_of[key] in right), None)
        ranks.append(first and first[0])
        if first:
            scores_of_hits.append(first[1])

    (got,) = registry.flagship(spark, SF).collect()
    assert (got["total"], got["hits"]) == (len(questions), len(scores_of_hits))
    assert got["hit_rate"] == pytest.approx(len(scores_of_hits) / len(questions), abs=1e-6)
    assert got["mrr"] == pytest.approx(sum(1 / r for r in ranks if r) / len(questions), abs=1e-6)
    assert got["mean_score"] == pytest.approx(sum(scores_of_hits) / len(scores_of_hits), abs=1e-6)
