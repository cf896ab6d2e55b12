"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import clamp, extract_json, lexical_coverage, question_key


def assemble_questions(questions: DataFrame, examples: DataFrame) -> DataFrame:
    """Questions of a case followed by its examples, numbered from 1."""
    both = questions.withColumn("part", F.lit(0)).unionByName(examples.withColumn("part", F.lit(1)))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy("part", "ord"))).drop("part", "ord")


def validate_ground_truth(questions: DataFrame, first: int = 10) -> DataFrame:
    """Cases that mix labelled and unlabelled questions, with the positions of the first unlabelled ones."""
    bare = F.coalesce(F.size(F.when(F.col("expected").isNotNull(), F.col("expected"))), F.lit(0)) == 0
    per = questions.groupBy("case_id").agg(F.sum(F.when(bare, 0).otherwise(1)).alias("labelled"), F.slice(F.sort_array(F.collect_list(F.when(bare, F.col("position")))), 1, first).alias("unlabelled"))
    return per.where((F.col("labelled") > 0) & (F.size("unlabelled") > 0))


def check_hits(questions: DataFrame, hits: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, hit, rank, score``: the first hit whose document is expected; without expectations any hit counts."""
    asked = expected.select("query_id").distinct().withColumn("labelled", F.lit(True))
    right = hits.join(expected.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    free = hits.join(asked, "query_id", "left_anti")
    best = right.select("query_id", "rank", "score").unionByName(free.select("query_id", "rank", "score")).groupBy("query_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    return questions.select("query_id").join(best, "query_id", "left").select("query_id", F.col("rank").isNotNull().alias("hit"), "rank", "score")


def run_metrics(results: DataFrame, by: str = "run_id", elapsed: str | None = None) -> DataFrame:
    """Hits, hit rate, mean reciprocal rank with misses as 0, mean score of hits; with ``elapsed`` the mean latency of all questions that have one, else 0."""
    hit = F.col("hit").cast("int")
    latency = [] if elapsed is None else [F.round(F.coalesce(F.avg(elapsed), F.lit(0.0)), 6).alias("mean_elapsed_ms")]
    return results.groupBy(by).agg(F.count("*").alias("total"), F.sum(hit).alias("hits"), F.round(F.avg(hit), 6).alias("hit_rate"), F.round(F.avg(F.when(F.col("hit"), 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.avg(F.when(F.col("hit"), F.col("score"))), F.lit(0.0)), 6).alias("mean_score"), *latency)


def true_recall(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of each query's expected documents among its hits."""
    found = hits.select("query_id", "doc_id").distinct().withColumn("got", F.lit(1))
    return expected.select("query_id", "doc_id").distinct().join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("got", F.lit(0))) / F.count("*")).alias("recall"))


def compare_strategies(results: DataFrame, strategies: list[str]) -> DataFrame:
    """Rank of each question side by side."""
    if len(set(strategies)) < 2:
        raise ValueError("two strategies at least")
    return results.groupBy("query_id").pivot("strategy", strategies).agg(F.min("rank"))


def restrict_docs(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """Hits of some documents, after the cut."""
    return hits.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def list_runs(runs: DataFrame, number: int, size: int) -> DataFrame:
    """One page of the test runs, the newest first, with their hit rate and the number of all runs as ``total``.

    Spark keeps only the first ``number * size`` rows of each task for the page. A page beyond the end is empty.
    """
    rate = F.round(F.coalesce(F.col("hit_count") / F.nullif("total_questions", F.lit(0)), F.lit(0.0)), 6)
    page = runs.select("run_id", "started_at", "status", "total_questions", "hit_count", rate.alias("hit_rate")).orderBy(F.desc("started_at"), F.desc("run_id")).offset((number - 1) * size).limit(size)
    return page.select("*", runs.agg(F.count("*")).scalar().alias("total"))


def run_detail(results: DataFrame, schema: str = "chunk_id long, score double") -> DataFrame:
    """Results with their JSON chunk payloads parsed."""
    return results.withColumn("chunks", F.transform("actual_chunks", lambda c: F.from_json(c, schema)))


def harvest_samples(messages: DataFrame, docs: DataFrame, n: int | None, contexts: int = 10, longest: int = 3000) -> DataFrame:
    """Latest assistant messages that cite ``docs``: question of the same request, answer, the cited texts in order; the latest ``n``, or all without ``n``.

    ``messages(message_id, session_id, role, content, request_id, created_at, citations array<struct<doc_id,content>>)``.
    """
    cited = messages.where("role = 'assistant'").select("message_id", "request_id", "created_at", "content", F.posexplode("citations").alias("at", "c")).select("*", F.col("c.doc_id").alias("doc_id"), F.substring(F.trim("c.content"), 1, longest).alias("text")).where("text <> ''")
    kept = cited.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    per = kept.groupBy("message_id").agg(F.first("request_id").alias("request_id"), F.first("created_at").alias("created_at"), F.first("content").alias("response"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "text"))), 1, contexts), lambda x: x["text"]).alias("contexts"))
    asked = messages.where("role = 'user'").groupBy("request_id").agg(F.max_by("content", F.struct("created_at", "message_id")).alias("question"))
    found = per.join(asked, "request_id")
    return found if n is None else found.orderBy(F.desc("created_at"), F.desc("message_id")).limit(n)


def resolve_samples(specs: DataFrame, messages: DataFrame) -> DataFrame:
    """Specs bound to their message if the question is the same; others need retrieval."""
    m = messages.select(F.col("message_id").alias("__m"), F.col("question").alias("asked"), "response")
    both = specs.join(m, specs["message_id"] == m["__m"], "left")
    same = F.coalesce(question_key("question") == question_key("asked"), F.lit(False))
    return both.select("spec_id", "question", F.when(same, F.col("response")).alias("response"), (~same).alias("needs_retrieval"))


def select_materials(chunks: DataFrame, docs: DataFrame, most: int = 30, longest: int = 800) -> DataFrame:
    """Numbered texts per base: enabled chunks of ready documents, newest document first."""
    rows = chunks.where("is_enabled").join(docs.where("status = 'ready'").select("doc_id"), "doc_id", "left_semi")
    w = Window.partitionBy("kb_id").orderBy(F.desc("doc_id"), "chunk_index")
    return rows.withColumn("ref", F.row_number().over(w)).where(F.col("ref") <= most).select("kb_id", "ref", "doc_id", "chunk_index", F.substring("content", 1, longest).alias("content"))


def ground_items(raw: DataFrame, materials: DataFrame, n: int) -> DataFrame:
    """``kb_id, ord, question, answer, doc_ids`` from ``raw(kb_id, reply)``: items whose first three refs point at materials."""
    items = raw.select("kb_id", extract_json("reply", "items array<struct<question string, answer string, refs array<int>>>")["items"].alias("items")).select("kb_id", F.posexplode("items").alias("ord", "i")).select("kb_id", "ord", F.trim("i.question").alias("question"), F.trim("i.answer").alias("answer"), F.slice("i.refs", 1, 3).alias("refs"))
    items = items.where("question <> '' AND answer <> ''")
    refs = items.select("kb_id", "ord", F.explode(F.array_distinct("refs")).alias("ref")).join(materials.select("kb_id", "ref", "doc_id"), ["kb_id", "ref"]).groupBy("kb_id", "ord").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))
    once = items.join(refs, ["kb_id", "ord"]).withColumn("key", question_key("question"))
    once = once.withColumn("k", F.row_number().over(Window.partitionBy("kb_id", "key").orderBy("ord"))).where("k = 1")
    return once.withColumn("m", F.row_number().over(Window.partitionBy("kb_id").orderBy("ord"))).where(F.col("m") <= n).select("kb_id", "ord", "question", "answer", "doc_ids")


def fold_scores(raw: DataFrame) -> DataFrame:
    """Scores by sample and metric: not finite is an error, others are cut to 0..1; recall needs a reference."""
    x = F.col("score")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = raw.where((F.col("metric") != "context_recall") | F.col("has_reference"))
    return kept.select("sample_id", "metric", F.when(~bad, F.round(clamp("score"), 6)).alias("score"), F.when(bad, F.substring("reason", 1, 2000)).alias("error"))


def ragas_run(scores: DataFrame, by: str = "run_id") -> DataFrame:
    """Mean and number of good scores per metric; a run without any has failed."""
    per = scores.groupBy(by, "metric").agg(F.avg("score").alias("mean"), F.count("score").alias("good"))
    ok = F.sum("good").over(Window.partitionBy(by)) > 0
    return per.select(by, "metric", F.round("mean", 6).alias("mean"), "good", F.when(ok, "completed").otherwise("failed").alias("status"))


def proxy_scores(samples: DataFrame) -> DataFrame:
    """Coverage proxies per sample: answer relevancy, rank-weighted context precision, faithfulness of answer sentences."""
    context = F.array_join("contexts", "\n")
    sentences = F.filter(F.transform(F.split("response", r"[.!?。！？\n]+"), F.trim), lambda s: F.length(s) > 2)
    faithful = F.filter(sentences, lambda s: lexical_coverage(s, context) >= 0.6)
    weights = F.transform("contexts", lambda c, i: F.when(lexical_coverage(F.col("question"), c) >= 0.3, 1 / (i + 1)).otherwise(0.0))
    best = F.transform("contexts", lambda c, i: 1 / (i + 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return samples.select("message_id", F.round(lexical_coverage("question", "response"), 6).alias("answer_relevancy"), F.round(F.coalesce(F.try_divide(total(weights), total(best)), F.lit(0.0)), 6).alias("context_precision"), F.round(F.when(F.size(sentences) > 0, F.size(faithful) / F.size(sentences)).otherwise(0.0), 6).alias("faithfulness"))


def check_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Cases whose answer has all keywords, and whether that was expected."""
    both = cases.join(answers, "case_id", "left")
    found = F.forall("keywords", lambda k: F.instr(F.coalesce("answer", F.lit("")), k) > 0)
    return both.select("case_id", found.alias("found"), (found == F.col("expect_hit")).alias("passed"))
