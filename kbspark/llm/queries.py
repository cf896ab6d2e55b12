"""The numbered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import bpe, decontamination, language, lexical, licenses, lines, lm_score, merkle, ngram_join, pages, pii, quality, shards
from kbspark.llm._store import new_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_docs(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed_lines(_docs(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(_docs(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=False)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_docs(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document after twelve arrivals, with compactions of all due tiers in between."""
    store = shards.shard_table(_docs(spark, sf_dir), new_path(spark, "shards"))
    return store.placed("doc_id").drop("shard").withColumn("version", F.lit(store.version()))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against those that the labels call good."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(_docs(spark, sf_dir), good)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_docs(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_docs(spark, sf_dir))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_licenses, op2_line_dedup, op3_language_id, op4_quality_rules, op5_byte_bpe, op6_ngram_join, op7_sharding, op8_decontamination, op9_lm_score, op10_pii, op11_lexical_search, op12_merkle_manifest, op13_html_text, pipeline)
    return {f.__name__: f for f in ops}


def _op1_sql() -> str:
    """Brute force: every line against every template, every word against every phrase."""
    words = "list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    rules = licenses.LicenseRules()
    sets = ", ".join(f"('{label}', [{', '.join(repr(w) for w in sorted(s))}], {len(s)}, {need})" for label, s, need in rules.sets)
    phrases = ", ".join(f"('{label}', [{', '.join(repr(w) for w in p.split())}], {len(p.split())})" for p, label in rules.phrases)
    return f"""
WITH t(label, words, size, need) AS (VALUES {sets}),
p(label, words, size) AS (VALUES {phrases}),
d AS (SELECT doc_id, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT doc_id, list_distinct({words.format("line")}) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (SELECT b.doc_id, t.label, len(list_intersect(b.w, t.words)) / t.size::DOUBLE AS c FROM b JOIN t ON len(list_intersect(b.w, t.words)) >= t.need),
u AS (SELECT doc_id, unnest(range(len(w))) AS i, w FROM d),
h AS (SELECT u.doc_id, p.label, u.i FROM u JOIN p ON list_extract(u.w, u.i + 1) = list_extract(p.words, 1) AND list_slice(u.w, u.i + 1, u.i + p.size) = p.words),
hs AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS base FROM h GROUP BY doc_id),
ms AS (SELECT doc_id, max(c) AS c FROM m GROUP BY doc_id),
ls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM h UNION ALL SELECT doc_id, label FROM m) AS x GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hs.n, 0)::BIGINT AS n_base, hs.lo::BIGINT AS first_word, hs.hi::BIGINT AS last_word,
  coalesce(hs.base, '') AS base_labels, coalesce(ls.labels, '') AS labels, CASE WHEN hs.n > 0 THEN 1.0 ELSE coalesce(ms.c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN hs ON hs.doc_id = d.doc_id LEFT JOIN ms ON ms.doc_id = d.doc_id LEFT JOIN ls ON ls.doc_id = d.doc_id
"""


def _op8_sql() -> str:
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(list_slice(w, i + 1, i + least(13, len(w))), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0) AS x),
s AS (SELECT DISTINCT size FROM g),
u AS (SELECT d.doc_id, s.size, i, array_to_string(list_slice(w, i + 1, i + s.size), ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) AS d, s WHERE i + s.size <= len(w)),
h AS (SELECT u.doc_id, u.i, u.size, g.item_id FROM u JOIN g ON u.size = g.size AND u.gram = g.gram),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM h) AS x GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) AS x GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def _op11_sql() -> str:
    """Brute force: every term of every document against every term of every item."""
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) AS x GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
g AS (SELECT q.item_id, t.doc_id, sum(floor(1000 * ln((2 * s.docs + 2)::DOUBLE / (2 * f.df + 1)))::BIGINT * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * t.n * s.docs) // s.words))))::BIGINT AS score
  FROM q JOIN t ON t.term = q.term JOIN f ON f.term = q.term, s GROUP BY q.item_id, t.doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM g WHERE score > 0) AS x WHERE rank <= 10
"""


def _op12_sql(levels: int = 6) -> str:
    """All nodes of ``levels`` levels a tree (16 ** 6 leaves a source), and the path of every leaf; CRC-32 bit by bit."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(text if c == 'text' else c) for c in merkle.FIELDS)})"
    shift = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: {shift}), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""d0 AS (SELECT doc_id, coalesce('s' || source, '') AS src, {leaf("text")} AS leaf, coalesce({crc} % 5 = 0, false) AS bad, {leaf(low)} AS other FROM documents),
d1 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d0)""", "a0 AS (SELECT src, pos, leaf AS h FROM d1)"]

    def grow(a: str) -> None:
        for k in range(levels):
            parts.append(f"{a}n{k} AS (SELECT src, count(*) AS n FROM {a}{k} GROUP BY src)")
            parts.append(f"{a}r{k} AS (SELECT src, pos // 16 AS up, list(h ORDER BY pos) AS run, any_value(n) AS n FROM {a}{k} JOIN {a}n{k} USING (src) GROUP BY src, pos // 16)")
            parts.append(f"{a}{k + 1} AS (SELECT src, up AS pos, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {a}r{k})")

    def climb(a: str, before: str) -> str:
        for k in range(levels):
            left, right = "list_slice(r.run, 1, (p.spot % 16)::INT)", "list_slice(r.run, (p.spot % 16)::INT + 2, 16)"
            parts.append(f"""{a}p{k} AS (SELECT p.* EXCLUDE (spot, proof, fold), p.spot // 16 AS spot, CASE WHEN r.n = 1 THEN p.proof ELSE p.proof || array_to_string(list_concat({left}, {right}), '') END AS proof,
  CASE WHEN r.n = 1 THEN p.fold ELSE sha256(array_to_string(list_concat({left}, [p.fold], {right}), '')) END AS fold FROM {before} AS p JOIN {a}r{k} AS r ON r.src = p.{a}src AND r.up = p.spot // 16)""")
            before = f"{a}p{k}"
        return before

    grow("a")
    parts.append(f"b0 AS (SELECT '' AS src, row_number() OVER (ORDER BY encode(src)) - 1 AS pos, h, src AS own FROM a{levels})")
    grow("b")
    parts.append("p0 AS (SELECT doc_id, leaf, src AS asrc, '' AS bsrc, pos AS spot, '' AS proof, CASE WHEN bad THEN other ELSE leaf END AS fold FROM d1)")
    last = climb("a", "p0")
    parts.append(f"q0 AS (SELECT p.* EXCLUDE (spot), b0.pos AS spot, b0.h AS subroot FROM {last} AS p JOIN b0 ON b0.own = p.asrc)")
    last = climb("b", "q0")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b.h AS verified FROM {last}, b{levels} AS b"


def oracle_sql() -> dict[str, str]:
    """Where SQL is too slow or has no such function (zstandard, EM, BPE, models, groups of near copies, HTML) there is none; tests/llm has brute force."""
    return {"op1_licenses": _op1_sql(), "op8_decontamination": _op8_sql(), "op11_lexical_search": _op11_sql(), "op12_merkle_manifest": _op12_sql()}
