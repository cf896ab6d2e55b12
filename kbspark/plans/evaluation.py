"""Queries of evaluation; ``eval03_run_metrics`` is the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import evaluation as E
from kbspark.operators import retrieval as R
from kbspark.operators.text_index import stored
from kbspark.plans.registry import query
from kbspark.plans.retrieval import TRI, _channels, asked, index_of

#: Documents that hold a whole passage, and the ranked documents of each question.
_TRUTH = "tr AS (SELECT q.question_id AS query_id, d.doc_id FROM questions AS q JOIN docs AS d ON contains(d.raw_text, q.passage))"
_HITS = f"{TRI}, h AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM tri), hd AS (SELECT h.query_id, h.rank, h.score, c.doc_id FROM h JOIN chunks AS c ON c.chunk_id = h.chunk_id WHERE rank <= 10)"
_CHECK = f"WITH {_HITS}, {_TRUTH}, good AS (SELECT hd.query_id, hd.rank, hd.score FROM hd JOIN tr ON tr.query_id = hd.query_id AND tr.doc_id = hd.doc_id UNION ALL SELECT query_id, rank, score FROM hd WHERE query_id NOT IN (SELECT query_id FROM tr)), best AS (SELECT query_id, min(rank) AS rank, arg_min(score, rank) AS score FROM good GROUP BY query_id), res AS (SELECT q.query_id, b.rank IS NOT NULL AS hit, b.rank, round(b.score, 6) AS score FROM q LEFT JOIN best AS b ON b.query_id = q.query_id)"


def truth(t):
    """Documents that hold a question's whole passage."""
    return stored(R.holding(t.docs.select("doc_id", F.col("raw_text").alias("text")), t.questions.select(F.col("question_id").alias("query_id"), "passage")), "truth")


def hits(t, k=10):
    found = stored(index_of(t).trigram(asked(t), k), "trigram-hits")
    return found.join(t.chunks.select("chunk_id", "doc_id"), "chunk_id")


def checked(t):
    return E.check_hits(asked(t), hits(t), truth(t))


@query("WITH b AS (SELECT question_id % 5 AS case_id, question_id AS ord, CASE WHEN question_id % 3 = 0 THEN 0 ELSE 1 END AS part FROM questions) SELECT case_id, ord, row_number() OVER (PARTITION BY case_id ORDER BY part, ord)::INT AS position FROM b")
def eval01_assemble(t):
    q = t.questions.selectExpr("question_id % 5 AS case_id", "question_id AS ord", "question_id AS id")
    return E.assemble_questions(q.where("ord % 3 = 0"), q.where("ord % 3 <> 0")).select("case_id", F.col("id").alias("ord"), "position")


@query("WITH b AS (SELECT question_id % 5 AS case_id, question_id AS p, question_id % 7 = 0 AS bare FROM questions) SELECT case_id, count(*) FILTER (WHERE NOT bare) AS labelled, string_agg(p::VARCHAR, ',' ORDER BY p) FILTER (WHERE bare) AS unlabelled FROM b GROUP BY case_id HAVING count(*) FILTER (WHERE bare) > 0 AND count(*) FILTER (WHERE NOT bare) > 0", name="eval01_validate")
def eval01_validate(t):
    q = t.questions.selectExpr("question_id % 5 AS case_id", "question_id AS position", "CASE WHEN question_id % 7 <> 0 THEN array(question_id) END AS expected")
    out = E.validate_ground_truth(q, 100)
    return out.select("case_id", "labelled", F.array_join(F.transform("unlabelled", lambda x: x.cast("string")), ",").alias("unlabelled"))


@query(f"{_CHECK} SELECT * FROM res")
def eval02_check_hits(t):
    return checked(t).select("query_id", "hit", "rank", F.round("score", 6).alias("score"))


@query(f"{_CHECK} SELECT query_id % 4 AS run_id, count(*) AS total, sum(hit::INT)::BIGINT AS hits, round(avg(hit::INT), 6) AS hit_rate, round(avg(CASE WHEN hit THEN 1.0 / res.rank ELSE 0 END), 6)::DOUBLE AS mrr, round(coalesce(avg(best.score), 0), 6) AS mean_score, round(avg(length(q.question) * 3), 6)::DOUBLE AS mean_elapsed_ms FROM res JOIN questions AS q ON q.question_id = res.query_id LEFT JOIN best USING (query_id) GROUP BY query_id % 4", name="eval03_metrics_text")
def eval03_metrics_text(t):
    """Latencies stand in: three milliseconds a character of the question."""
    elapsed = t.questions.select(F.col("question_id").alias("query_id"), (3 * F.length("question")).alias("elapsed_ms"))
    return E.run_metrics(checked(t).join(elapsed, "query_id").withColumn("run_id", F.col("query_id") % 4), elapsed="elapsed_ms")


@query()
def eval03_run_metrics(t):
    """Hit test of all benchmark passages: vector and text channels, fusion, threshold, hits against the documents that hold the passage."""
    kept = R.threshold(R.rrf(stored(_channels(t, R.CANDIDATES), "channel-hits"), top_k=R.TOP_K), 0.3)
    found = kept.join(t.chunks.select("chunk_id", "doc_id"), "chunk_id")
    return E.run_metrics(E.check_hits(asked(t), found, truth(t)).withColumn("run_id", F.lit(1)))


@query(f"WITH {_HITS}, {_TRUTH} SELECT tr.query_id, round(avg(CASE WHEN x.doc_id IS NULL THEN 0 ELSE 1 END), 6)::DOUBLE AS recall FROM (SELECT DISTINCT query_id, doc_id FROM tr) AS tr LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM hd) AS x ON x.query_id = tr.query_id AND x.doc_id = tr.doc_id GROUP BY tr.query_id", name="eval03_true_recall")
def eval03_true_recall(t):
    return E.true_recall(hits(t), truth(t)).select("query_id", F.round("recall", 6).alias("recall"))


@query(f"{_CHECK}, b3 AS (SELECT query_id, min(rank) AS rank FROM good WHERE rank <= 3 GROUP BY query_id) SELECT res.query_id, res.rank AS top10, b3.rank AS top3 FROM res LEFT JOIN b3 ON b3.query_id = res.query_id")
def eval04_compare(t):
    ten = checked(t).withColumn("strategy", F.lit("top10"))
    three = E.check_hits(asked(t), hits(t, 3), truth(t)).withColumn("strategy", F.lit("top3"))
    return E.compare_strategies(ten.unionByName(three), ["top10", "top3"])


@query(f"WITH {_HITS} SELECT query_id, rank, doc_id FROM hd WHERE doc_id IN (SELECT doc_id FROM docs WHERE file_type = 'md')")
def eval05_restrict_docs(t):
    return E.restrict_docs(hits(t), t.docs.where("file_type = 'md'")).select("query_id", "rank", "doc_id")


@query("SELECT run_id, started_at, status, total_questions, hit_count, round(coalesce(hit_count / nullif(total_questions, 0)::DOUBLE, 0), 6) AS hit_rate, count(*) OVER () AS total FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 25 OFFSET 50")
def eval06_list_runs(t):
    """The third page of 25."""
    return E.list_runs(t.runs, 3, 25)


@query(f"WITH {_HITS} SELECT query_id, count(*) AS n, sum(doc_id)::BIGINT AS docs FROM hd GROUP BY query_id")
def eval06_run_detail(t):
    payload = hits(t).groupBy("query_id").agg(F.collect_list(F.to_json(F.struct("doc_id", "score"))).alias("actual_chunks"))
    out = E.run_detail(payload, "doc_id long, score double")
    return out.select("query_id", F.size("chunks").cast("long").alias("n"), F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["doc_id"]).alias("docs"))


def _cited(t):
    body = "array(named_struct('doc_id', message_id % 97, 'content', content), named_struct('doc_id', message_id % 89, 'content', reverse(content)))"
    return t.messages.withColumn("citations", F.expr(body))


_SAMPLES = """c AS (SELECT message_id, request_id, created_at, content, 0 AS pos, message_id % 97 AS doc_id, trim(content) AS text FROM messages WHERE role = 'assistant' UNION ALL SELECT message_id, request_id, created_at, content, 1, message_id % 89, trim(reverse(content)) FROM messages WHERE role = 'assistant'),
k AS (SELECT c.* FROM c WHERE text <> '' AND doc_id IN (SELECT doc_id FROM docs WHERE doc_id % 3 <> 0)),
p AS (SELECT message_id, any_value(request_id) AS request_id, any_value(created_at) AS created_at, any_value(content) AS response, string_agg(text, '|' ORDER BY pos) AS contexts FROM k GROUP BY message_id),
u AS (SELECT request_id, arg_max(content, message_id) AS question FROM messages WHERE role = 'user' GROUP BY request_id)"""


def samples(t, n=200):
    return E.harvest_samples(_cited(t), t.docs.where("doc_id % 3 <> 0"), n)


@query(f"WITH {_SAMPLES} SELECT p.message_id, u.question, p.contexts FROM p JOIN u ON u.request_id = p.request_id ORDER BY p.created_at DESC, p.message_id DESC LIMIT 200")
def eval07_harvest(t):
    return samples(t).select("message_id", "question", F.array_join("contexts", "|").alias("contexts"))


@query("""WITH a AS (SELECT message_id, request_id FROM messages WHERE role = 'assistant'), u AS (SELECT request_id, arg_max(content, message_id) AS question FROM messages WHERE role = 'user' GROUP BY request_id)
SELECT a.message_id AS spec_id, a.message_id % 3 <> 0 AS needs_retrieval FROM a JOIN u ON u.request_id = a.request_id""")
def eval08_resolve(t):
    answered = t.messages.where("role = 'assistant'").select("message_id", "request_id", F.col("content").alias("response"))
    asked_ = t.messages.where("role = 'user'").groupBy("request_id").agg(F.max_by("content", "message_id").alias("question"))
    m = answered.join(asked_, "request_id").select("message_id", "question", "response")
    specs = m.select(F.col("message_id").alias("spec_id"), "message_id", F.when(F.col("message_id") % 3 == 0, F.concat(F.upper(F.lit("")), F.col("question"), F.lit(" ?"))).otherwise(F.concat(F.lit("x "), "question")).alias("question"))
    return E.resolve_samples(specs, m).select("spec_id", "needs_retrieval")


@query("SELECT kb_id, ref, doc_id, chunk_index, content FROM (SELECT c.kb_id, c.doc_id, c.chunk_index, substring(c.content, 1, 800) AS content, row_number() OVER (PARTITION BY c.kb_id ORDER BY c.doc_id DESC, c.chunk_index)::INT AS ref FROM chunks AS c JOIN docs AS d ON d.doc_id = c.doc_id WHERE c.is_enabled AND d.status = 'ready') AS x WHERE ref <= 30")
def eval09_materials(t):
    return E.select_materials(t.chunks, t.docs)


@query("""WITH m AS (SELECT kb_id, doc_id, row_number() OVER (PARTITION BY kb_id ORDER BY doc_id DESC, chunk_index) AS ref FROM (SELECT c.kb_id, c.doc_id, c.chunk_index FROM chunks AS c JOIN docs AS d ON d.doc_id = c.doc_id WHERE c.is_enabled AND d.status = 'ready') AS x), r AS (SELECT * FROM m WHERE ref <= 30)
SELECT kb_id, 0 AS ord, kb_id || ' a?' AS question, (SELECT count(DISTINCT doc_id) FROM r WHERE r.kb_id = k.kb_id AND ref IN (1, 2))::INT AS n FROM kbs AS k WHERE (SELECT count(*) FROM r WHERE r.kb_id = k.kb_id) > 0""")
def eval10_ground_items(t):
    reply = F.expr("""concat('Here: {"items":[{"question":"', kb_id, ' a?","answer":"x","refs":[1,2,99]},{"question":"', upper(kb_id), '  A","answer":"y","refs":[1]},{"question":"q","answer":"","refs":[1]},{"question":"z","answer":"w","refs":[99]}]}')""")
    out = E.ground_items(t.kbs.select("kb_id", reply.alias("reply")), E.select_materials(t.chunks, t.docs), 3)
    return out.select("kb_id", "ord", "question", F.size("doc_ids").alias("n"))


_RAW = "SELECT event_id AS sample_id, user_id % 6 AS run_id, CASE WHEN event_type = 'view' THEN 'context_recall' ELSE event_type END AS metric, event_id % 2 = 0 AS has_reference, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 50 - 0.1 END AS score FROM events"


def _raw_scores(t):
    return t.spark.sql(_RAW.replace("FROM events", "FROM {events}"), events=t.events).withColumn("reason", F.concat(F.lit("bad "), F.col("sample_id").cast("string")))


@query(f"WITH r AS ({_RAW}) SELECT sample_id, metric, CASE WHEN score IS NOT NULL THEN round(least(greatest(score, 0), 1), 6) END::DOUBLE AS score, CASE WHEN score IS NULL THEN 'bad ' || sample_id::VARCHAR END AS error FROM r WHERE metric <> 'context_recall' OR has_reference")
def eval11_fold_scores(t):
    return E.fold_scores(_raw_scores(t))


@query(f"WITH r AS ({_RAW}) SELECT run_id, metric, round(avg(CASE WHEN score IS NOT NULL THEN least(greatest(score, 0), 1) END), 4)::DOUBLE AS mean, count(score) AS good, 'completed' AS status FROM r WHERE metric <> 'context_recall' OR has_reference GROUP BY run_id, metric")
def eval12_ragas_run(t):
    raw = _raw_scores(t)
    scores = E.fold_scores(raw).join(raw.select("sample_id", "run_id"), "sample_id")
    return E.ragas_run(scores).select("run_id", "metric", F.round("mean", 4).alias("mean"), "good", "status")


@query()
def eval13_proxy_scores(t):
    return E.proxy_scores(samples(t, None))


@query("SELECT question_id AS case_id, question_id % 4 <> 1 AS found, (question_id % 4 <> 1) = (question_id % 2 = 0) AS passed FROM questions")
def eval14_check_cases(t):
    cases = t.questions.selectExpr("question_id AS case_id", "question_id % 2 = 0 AS expect_hit", "array(substring(passage, 3, 10), CASE WHEN question_id % 4 = 1 THEN '~no~' ELSE substring(passage, 15, 5) END) AS keywords")
    return E.check_cases(cases, t.questions.selectExpr("question_id AS case_id", "passage AS answer"))
