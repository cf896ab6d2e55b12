"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import retrieval as R
from kbspark.operators import text_index as X
from kbspark.plans.registry import query
from kbspark.sources.shared import new_path

LEX = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
#: Trigram hits of all questions in SQL: q(query_id, text) against chunks, and by document.
TRI = f"""q AS (SELECT question_id AS query_id, question AS text FROM questions),
qw AS (SELECT DISTINCT query_id, '  ' || w || ' ' AS w FROM (SELECT query_id, unnest({LEX.format('text')}) AS w FROM q) AS x),
qg AS (SELECT DISTINCT query_id, substring(w, i::INT, 3) AS g FROM (SELECT query_id, w, unnest(range(1, length(w) - 1)) AS i FROM qw) AS x),
cw AS (SELECT DISTINCT chunk_id, '  ' || w || ' ' AS w FROM (SELECT chunk_id, unnest({LEX.format('content')}) AS w FROM chunks) AS x),
cg AS (SELECT DISTINCT chunk_id, substring(w, i::INT, 3) AS g FROM (SELECT chunk_id, w, unnest(range(1, length(w) - 1)) AS i FROM cw) AS x),
qn AS (SELECT query_id, count(*) AS n FROM qg GROUP BY query_id), cn AS (SELECT chunk_id, count(*) AS n FROM cg GROUP BY chunk_id),
tri AS (SELECT x.query_id, x.chunk_id, x.c / (qn.n + cn.n - x.c)::DOUBLE AS score FROM (SELECT qg.query_id, cg.chunk_id, count(*) AS c FROM qg JOIN cg ON qg.g = cg.g GROUP BY qg.query_id, cg.chunk_id) AS x JOIN qn ON qn.query_id = x.query_id JOIN cn ON cn.chunk_id = x.chunk_id)"""
TOP5 = "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {0}) AS r WHERE rank <= {1}"


def asked(t):
    return t.questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))


_INDEXES: dict[tuple, X.TextIndex] = {}


def index_of(t) -> X.TextIndex:
    """The stored index of a folder's chunks: built by the first query of a session that asks for it, anew if the documents have changed."""
    hadoop = t.spark.sparkContext
    files = [hadoop._jvm.org.apache.hadoop.fs.Path(f) for f in sorted(t.documents.inputFiles())]
    states = [f.getFileSystem(hadoop._jsc.hadoopConfiguration()).getFileStatus(f) for f in files]
    key = (hadoop.applicationId, *[(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in states])
    if key not in _INDEXES:
        _INDEXES[key] = X.TextIndex(t.spark, new_path(t.spark, "text-index"), 16).build(t.chunks)
    return _INDEXES[key]


def six(df):
    return df.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_PLAIN = "[A-Za-z0-9][A-Za-z0-9._-]+"


@query(f"""WITH w AS (SELECT question_id, i, list_extract(a, i) AS word FROM (SELECT question_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT question_id, list_filter(string_split_regex(question, '[\\s，。；、,.!?？！；：:()（）\\[\\]【】]+'), lambda x: x <> '') AS a FROM questions) AS x) AS y),
p AS (SELECT question_id, i, regexp_extract_all(word, '{_PLAIN}') AS b FROM w),
t AS (SELECT question_id, i * 1000 AS o, word AS term FROM w UNION ALL SELECT question_id, i * 1000 + j AS o, list_extract(b, j) AS term FROM (SELECT question_id, i, b, unnest(range(1, len(b) + 1)) AS j FROM p) AS z),
f AS (SELECT question_id, term, min(o) AS o FROM t WHERE length(term) >= 2 GROUP BY question_id, term)
SELECT question_id AS query_id, ord, term FROM (SELECT question_id, term, (row_number() OVER (PARTITION BY question_id ORDER BY o) - 1)::INT AS ord FROM f) AS g WHERE ord < 28""")
def ret01_query_terms(t):
    """The SQL is for texts without CJK characters; tests/test_units.py has those."""
    return R.query_terms(asked(t))


@query(f"SELECT term, chunk_id, kb_id, count(*) AS tf FROM (SELECT chunk_id, kb_id, unnest({LEX.format('content')}) AS term FROM chunks) AS x GROUP BY term, chunk_id, kb_id")
def ret02_postings(t):
    return R.build_postings(t.chunks).select("term", "chunk_id", "kb_id", "tf")


_WORDS2 = "concat(split_part(question, ' ', 2), ' ', split_part(question, ' ', 3))"
_FT = f"""q AS (SELECT question_id AS query_id, {LEX.format(_WORDS2)} AS terms FROM questions),
w AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(terms) AS term FROM q) AS x), n AS (SELECT query_id, count(*) AS need FROM w GROUP BY query_id),
p AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({LEX.format('content')}) AS term FROM chunks) AS x GROUP BY term, chunk_id),
ft AS (SELECT x.query_id, x.chunk_id, 1 - exp(-4 * (x.tf * 0.1 / n.need)) AS score FROM (SELECT w.query_id, p.chunk_id, count(*) AS c, sum(p.tf)::DOUBLE AS tf FROM w JOIN p ON p.term = w.term GROUP BY w.query_id, p.chunk_id) AS x JOIN n ON n.query_id = x.query_id WHERE x.c = n.need)"""


def _two_words(t):
    return t.questions.selectExpr("question_id AS query_id", f"{_WORDS2} AS text")


@query(f"WITH {_FT} {TOP5.format('ft', 5)}")
def ret03_fulltext(t):
    return six(index_of(t).fulltext(_two_words(t)))


@query()
def ret03_fulltext_covers(t):
    return six(index_of(t).fulltext(_two_words(t), rank_by="covers"))


@query("SELECT event_id, round(CASE WHEN value > 5 THEN least(greatest(1 - exp(-4 * (value - 5)), 0), 1) ELSE 0 END, 6)::DOUBLE AS score FROM events")
def ret04_squash(t):
    return t.events.select("event_id", F.round(T.squash(F.col("value") - 5), 6).alias("score"))


#: Trigram scores of the chunks that hold a term of the question, or all of it, in any case.
HELD = f"""aw AS (SELECT query_id, unnest(list_filter(string_split_regex(text, '[\\s，。；、,.!?？！；：:()（）\\[\\]【】]+'), lambda x: length(x) >= 2)) AS term FROM q),
tw AS (SELECT query_id, lower(term) AS term FROM aw UNION SELECT query_id, lower(unnest(regexp_extract_all(term, '{_PLAIN}'))) AS term FROM aw UNION SELECT query_id, lower(text) AS term FROM q),
held AS (SELECT DISTINCT tw.query_id, c.chunk_id FROM tw JOIN chunks AS c ON tw.term <> '' AND contains(lower(c.content), tw.term)),
ht AS (SELECT held.query_id, held.chunk_id, coalesce(tri.score, 0) AS score FROM held LEFT JOIN tri ON tri.query_id = held.query_id AND tri.chunk_id = held.chunk_id)"""


@query(f"WITH {TRI}, {HELD} {TOP5.format('ht', 5)}")
def ret05_trigram_similarity(t):
    """Chunks that hold a term of the question, by trigram similarity."""
    return six(index_of(t).trigram(asked(t), 5, holding=True))


@query("SELECT q.question_id AS query_id, c.chunk_id FROM questions AS q JOIN chunks AS c ON contains(lower(c.content), lower(split_part(q.question, ' ', 2)))")
def ret06_contains_any(t):
    terms = t.questions.selectExpr("question_id AS query_id", "split_part(question, ' ', 2) AS term")
    return R.contains_any(terms, t.chunks)


@query("SELECT q.question_id AS query_id, c.chunk_id FROM questions AS q JOIN chunks AS c ON contains(lower(c.content), lower(split_part(q.question, ' ', 2)))", name="ret06_contains_any_large")
def ret06_contains_any_large(t):
    """The path for many terms."""
    terms = t.questions.selectExpr("question_id AS query_id", "split_part(question, ' ', 2) AS term")
    return R.contains_any(terms, t.chunks, small=0)


@query("""WITH p AS (SELECT d.doc_id, q.question_id, regexp_replace(lower(q.question), '[^a-z0-9一-鿿]', '', 'g') AS a, regexp_replace(lower(d.text), '[^a-z0-9一-鿿]', '', 'g') AS c FROM documents AS d JOIN questions AS q ON q.question_id = d.doc_id % 20),
g AS (SELECT DISTINCT doc_id, substring(a, i::INT, 3) AS g, c FROM (SELECT doc_id, a, c, unnest(range(1, length(a) - 1)) AS i FROM p WHERE length(a) > 2) AS x)
SELECT doc_id, round(avg(CASE WHEN contains(c, g) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS coverage FROM g GROUP BY doc_id""")
def ret07_coverage(t):
    q = t.questions.select("question_id", "question")
    both = t.documents.join(q, F.col("doc_id") % 20 == F.col("question_id"))
    return both.select("doc_id", F.round(T.lexical_coverage("question", "text"), 6).alias("coverage"))


@query(f"""WITH {TRI}, {HELD}, ca AS (SELECT query_id, regexp_replace(lower(text), '[^a-z0-9一-鿿]', '', 'g') AS a FROM q),
cgs AS (SELECT DISTINCT query_id, substring(a, i::INT, 3) AS g FROM (SELECT query_id, a, unnest(range(1, length(a) - 1)) AS i FROM ca WHERE length(a) > 2) AS x),
cl AS (SELECT query_id, list(g) AS gs FROM cgs GROUP BY query_id),
cc AS (SELECT chunk_id, regexp_replace(lower(content), '[^a-z0-9一-鿿]', '', 'g') AS c FROM chunks),
cov AS (SELECT held.query_id, held.chunk_id, len(list_filter(cl.gs, lambda g: contains(cc.c, g))) / len(cl.gs)::DOUBLE AS score FROM held JOIN cl ON cl.query_id = held.query_id JOIN cc ON cc.chunk_id = held.chunk_id)
{TOP5.format('cov', 5)}""")
def ret08_coverage_search(t):
    return six(R.coverage_search(asked(t), t.chunks))


@query()
def ret09_embed(t):
    out = R.embed(t.documents.select("doc_id", "text"), "text")
    return out.select("doc_id", F.size("embedding").alias("dimension"), F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


_KNN = "(SELECT q.chunk_id AS query_id, v.kb_id, v.chunk_id, least(greatest(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 0), 1) AS score FROM vectors AS q JOIN vectors AS v ON q.chunk_id % 50 = 0)"


def _vector_queries(t):
    return t.vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


@query(f"SELECT query_id, chunk_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {_KNN} AS k) AS r WHERE rank <= 5")
def ret10_knn(t):
    return R.knn(_vector_queries(t), t.vectors, 5).select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query(f"SELECT query_id, kb_id, chunk_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {_KNN} AS k WHERE kb_id IN (SELECT kb_id FROM kbs WHERE current_index_version IS NOT NULL)) AS r WHERE rank <= 5")
def ret11_knn_targets(t):
    return R.knn_targets(_vector_queries(t), t.vectors, t.kbs, 5).select("query_id", "kb_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query()
def ret12_knn_approx(t):
    return R.knn_approx(_vector_queries(t), t.vectors, 5).select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


def _channels(t, k=20):
    """Vector and trigram hits of every question, by the chunk's embedding and text."""
    q = t.questions.selectExpr("question_id AS query_id", "question AS text", "array(substring(passage, 61, 60)) AS expansions", "passage AS hyde")
    vectors = R.embed(X.spread(t.chunks, "chunk_id").where("is_enabled").select("chunk_id", "content"), "content").drop("content")
    index = index_of(t)
    return R.search_channels(R.query_variants(q, 2), t.chunks.where("is_enabled"), vectors, k, text_search=lambda queries, k: X.text_channel(index, queries, k, enabled=True))


@query()
def ret13_search_channels(t):
    return _channels(t).select("query_id", "channel", "chunk_id", F.round("score", 5).alias("score"))


_STAGES = "a AS ({0}), b AS ({1}), tc AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE query_id NOT IN (SELECT query_id FROM a GROUP BY query_id HAVING count(*) >= 5)) AS x GROUP BY query_id, chunk_id)"
_FIRST = "SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM {0}) AS r WHERE n <= 5"


@query(f"WITH {TRI.replace('question AS text', f'{_WORDS2} AS text')}, {HELD}, {_FT.replace('q AS', 'q2 AS').replace('FROM q)', 'FROM q2)')}, {_STAGES.format(_FIRST.format('ft'), _FIRST.format('ht'))} {TOP5.format('tc', 5)}")
def ret14_text_search(t):
    return six(X.text_channel(index_of(t), _two_words(t)))


#: Word matches of whole questions.
_FTQ = _FT.replace(LEX.format(_WORDS2), LEX.format("question")).replace("q AS", "q2 AS").replace("FROM q)", "FROM q2)")


@query(f"""WITH {TRI.replace('FROM chunks)', 'FROM chunks WHERE is_enabled)')}, {HELD.replace("ON tw.term <> ''", "ON c.is_enabled AND tw.term <> ''")}, {_FTQ.replace('FROM chunks)', 'FROM chunks WHERE is_enabled)')}, {_STAGES.format(_FIRST.format('ft'), _FIRST.format('ht'))},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM tc)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5 AND (score >= 0.3 OR best < 0.3)""")
def ret18_retrieve(t):
    """The text-only form of the whole search."""
    return six(X.retrieve(asked(t), index_of(t))[0])


#: Two channels that both engines build alike: trigram hits, and word matches of two words.
_TWO = f"WITH {TRI}, {_FT.replace('q AS', 'q2 AS').replace('FROM q)', 'FROM q2)')}, ch AS (SELECT query_id, 'tri' AS channel, chunk_id, score FROM ({TOP5.format('tri', 20)}) AS a UNION ALL SELECT query_id, 'words' AS channel, chunk_id, score FROM ({TOP5.format('ft', 20)}) AS b)"


def two_channels(t, k=20):
    tri = six(index_of(t).trigram(asked(t), k)).withColumn("channel", F.lit("tri"))
    return X.stored(tri.unionByName(six(index_of(t).fulltext(_two_words(t), k)).withColumn("channel", F.lit("words"))).drop("rank"), "two-channels")


_RRF = f"""{_TWO}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, chunk_id) AS r FROM ch),
nc AS (SELECT query_id, count(DISTINCT channel) AS n FROM ch GROUP BY query_id),
fs AS (SELECT rk.query_id, rk.chunk_id, sum(1.0 / (60 + r))::DOUBLE AS f, max(score) AS raw, any_value(nc.n) AS n FROM rk JOIN nc ON nc.query_id = rk.query_id GROUP BY rk.query_id, rk.chunk_id),
fused AS (SELECT query_id, chunk_id, CASE WHEN n = 1 THEN raw ELSE least(f / (n / 61.0), 1) END AS score FROM fs)"""


@query(f"{_RRF} {TOP5.format('fused', 5)}")
def ret15_rrf(t):
    return six(R.rrf(two_channels(t)))


@query(f"{_RRF} SELECT query_id, n::BIGINT AS n_channels, round(max(f), 6) AS best FROM fs GROUP BY query_id, n")
def ret16_rrf_channels(t):
    fused = R.rrf(two_channels(t), top_k=1000)
    return fused.groupBy("query_id", "n_channels").agg(F.round(F.max("rrf_score"), 6).alias("best"))


@query(f"WITH {TRI}, h AS (SELECT tri.* FROM tri) {TOP5.format('h', 5)}")
def ret17_single_channel(t):
    """One channel keeps its own scores."""
    return six(R.rrf(X.stored(index_of(t).trigram(asked(t), R.widened()).drop("rank").withColumn("channel", F.lit("tri")), "trigram-hits")))


def _reranked(t):
    hits = X.stored(index_of(t).trigram(asked(t), R.widened()), "trigram-hits")
    scores = hits.where("query_id % 3 <> 0").selectExpr("query_id", "CAST((rank * 7) % 20 AS INT) AS index", "CAST(chunk_id % 1000 AS DOUBLE) / 700 AS relevance", "rank AS ord")
    return hits, scores


@query(f"""WITH {TRI}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM tri), h20 AS (SELECT * FROM h WHERE rank <= 20),
s AS (SELECT query_id, (rank * 7) % 20 + 1 AS at, least((chunk_id % 1000)::DOUBLE / 700, 1) AS relevance, row_number() OVER (PARTITION BY query_id, (rank * 7) % 20 ORDER BY rank) AS n FROM h20 WHERE query_id % 3 <> 0),
j AS (SELECT h20.query_id, h20.chunk_id, h20.score, h20.rank AS r0, s.relevance FROM h20 LEFT JOIN s ON s.query_id = h20.query_id AND s.at = h20.rank AND s.n = 1),
k AS (SELECT query_id, chunk_id, coalesce(relevance, score) AS score, r0 FROM j WHERE relevance IS NOT NULL OR query_id % 3 = 0)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0)::INT AS rank FROM k) AS x WHERE rank <= 5""")
def ret19_rerank(t):
    return six(R.apply_rerank(*_reranked(t)))


@query(f"""WITH {TRI}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM tri), h20 AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, sum(CASE WHEN score < 0.35 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id)::BIGINT AS filtered_out FROM h WHERE rank <= 20)
SELECT query_id, chunk_id, rank, round(score, 6) AS score, filtered_out FROM h20 WHERE score >= 0.35 OR (best < 0.35 AND rank <= 5)""")
def ret20_threshold(t):
    hits = index_of(t).trigram(asked(t), 20)
    return R.threshold(hits, 0.35).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "filtered_out")


@query(f"WITH {TRI}, {_FT.replace('q AS', 'q2 AS').replace('FROM q)', 'FROM q2)')}, a AS ({TOP5.format('ft', 5)}), b AS ({TOP5.format('tri', 5)}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE query_id NOT IN (SELECT query_id FROM a)")
def ret21_retry_empty(t):
    hits = X.stored(six(index_of(t).fulltext(_two_words(t))), "word-hits")
    return R.retry_empty(asked(t), hits, lambda q: six(index_of(t).trigram(q, 5)))


@query(f"{_TWO}, hk AS (SELECT ch.*, c.kb_id FROM ch JOIN chunks AS c ON c.chunk_id = ch.chunk_id) SELECT q.query_id, count(hk.chunk_id) AS n_hits, coalesce(string_agg(DISTINCT hk.kb_id, ',' ORDER BY hk.kb_id), '') AS kbs, round(max(hk.score), 6) AS best, count(*) FILTER (WHERE hk.channel = 'tri') AS n_text FROM q LEFT JOIN hk ON hk.query_id = q.query_id GROUP BY q.query_id")
def ret22_retrieval_meta(t):
    hits = two_channels(t).join(t.chunks.select("chunk_id", "kb_id"), "chunk_id").withColumn("channel", F.when(F.col("channel") == "tri", "text").otherwise("vector"))
    return R.retrieval_meta(asked(t), hits).select("query_id", "n_hits", "kbs", F.round("best", 6).alias("best"), "n_text")


@query(f"WITH {TRI}, a AS ({TOP5.format('tri', 5)}) SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS ids, count(*) AS n FROM a GROUP BY query_id")
def ret23_citations(t):
    hits = index_of(t).trigram(asked(t), 5)
    c = R.citations(hits)
    return c.select("query_id", F.array_join(F.transform("citations", lambda x: x["chunk_id"].cast("string")), ",").alias("ids"), F.size("citations").cast("long").alias("n"))


@query(f"WITH {TRI}, a AS ({TOP5.format('tri', 3)}) SELECT query_id, round(avg(score), 5) AS confidence, CASE WHEN avg(score) >= 0.75 THEN 'high' WHEN avg(score) >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM a GROUP BY query_id")
def ret24_answer_confidence(t):
    hits = index_of(t).trigram(asked(t), 5)
    return R.answer_confidence(R.citations(hits), T.confidence_level).select("query_id", F.round("confidence", 5).alias("confidence"), "level")


@query(f"WITH {_FT} SELECT q.query_id, CASE WHEN q.query_id % 4 = 0 THEN 'no_authorized_kb' WHEN x.query_id IS NULL THEN 'no_relevant_hits' END AS reason, CASE WHEN q.query_id % 4 <> 0 AND x.query_id IS NOT NULL THEN 'evidence' ELSE 'fallback' END AS mode FROM q LEFT JOIN (SELECT DISTINCT query_id FROM ft) AS x ON x.query_id = q.query_id")
def ret25_route(t):
    q = _two_words(t)
    targets = q.where("query_id % 4 <> 0").select("query_id", F.lit("src1").alias("kb_id"))
    return R.route(q, targets, index_of(t).fulltext(q))


def _evidence(t):
    hits = X.stored(index_of(t).trigram(asked(t), 3), "trigram-hits")
    return R.evidence(hits.join(t.chunks.select("chunk_id", "doc_id", "chunk_index", "content"), "chunk_id").join(t.docs.select("doc_id", "filename"), "doc_id"))


@query(f"WITH {TRI}, a AS ({TOP5.format('tri', 3)}) SELECT a.query_id, string_agg('[' || rank::VARCHAR || '] ' || d.filename || ' #' || c.chunk_index::VARCHAR || ' (' || printf('%.4f', a.score) || ')' || chr(10) || c.content, chr(10) || chr(10) ORDER BY rank) AS evidence FROM a JOIN chunks AS c ON c.chunk_id = a.chunk_id JOIN docs AS d ON d.doc_id = c.doc_id GROUP BY a.query_id")
def txt27_evidence(t):
    return _evidence(t)


@query()
def txt28_prompts(t):
    from kbspark.operators import sessions as S

    last = S.context_window(t.messages, 3).where("kept").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "message_id", F.struct("role", "content").alias("m")))), lambda x: x["m"]).alias("turns"))
    history = last.select(F.col("session_id").alias("query_id"), F.lit("").alias("summary"), "turns")
    return R.prompts(asked(t), _evidence(t), history, "Answer from the evidence only.").select("query_id", F.size("messages").alias("n"), F.sha2(F.to_json("messages"), 256).alias("hash"))
