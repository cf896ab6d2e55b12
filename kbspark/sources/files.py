"""Sources and sinks: corpus scans, upload gate, decoding, malware heuristics, table rewrites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Accepted and refused types, and the upload cap.
ACCEPTED, REFUSED, MAX_BYTES = ("pdf", "doc", "docx", "txt", "md"), ("csv", "xlsx", "pptx"), 100 << 20
TEXT_TYPES = ("txt", "md", "markdown", "csv", "json", "xml", "html", "htm")
OFFICE_TYPES = ("doc", "docx", "xls", "xlsx", "ppt", "pptx", "pdf")
EICAR = "X5O!P%@AP[4\\PZX54(P^)7CC)7}$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*"
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk", "gb2312", "big5", "latin-1")


def scan_documents(docs: DataFrame, kb_ids: list[str] | None = None, keyword: str | None = None) -> DataFrame:
    """Documents that are not archived, of some bases, with a part of their name; all predicates reach the scan or its row filter."""
    out = docs.where(F.col("status") != "archived")
    if kb_ids is not None:
        out = out.where(F.col("kb_id").isin(*kb_ids))
    return out if not keyword else out.where(F.contains(F.lower("filename"), F.lit(keyword.lower())))


def extension(name: str | Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).withColumn("filename", F.element_at(F.split("path", "/"), -1))


def admit_files(files: DataFrame) -> DataFrame:
    """``accepted, reason`` from name and length alone, so that the content is not read."""
    ext = extension("filename")
    reason = F.when(F.col("length") <= 0, "empty").when(F.col("length") > MAX_BYTES, "too_large").when(ext.isin(*REFUSED), "unsupported_type").when(~ext.isin(*ACCEPTED), "unknown_type")
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def _detected(raw: bytes) -> tuple[str, ...]:
    """Encodings that the bytes themselves point to: a byte order mark, or high bytes that often stand alone between ASCII, as hardly any double-byte text has them."""
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return ("utf-16",)
    sample = np.frombuffer(raw[: 1 << 16], np.uint8)
    high = np.concatenate([[False], sample >= 128, [False]])
    alone = high[1:-1] & ~high[:-2] & ~high[2:]
    return ("latin-1",) if high.any() and 4 * alone.sum() >= high.sum() else ()


def decode_bytes(raw: bytes) -> tuple[str | None, str | None]:
    """Text and encoding by the first candidate that decodes every byte and whose output is not garbled; detected ones come after UTF-8."""
    for name in (*ENCODINGS[:2], *_detected(raw), *ENCODINGS[2:]):
        try:
            text = raw.decode(name).removeprefix("﻿")
        except UnicodeDecodeError:
            continue
        odd = text.count("�") > max(8, len(text) // 20)
        shown = sum(c.isprintable() or c in "\n\r\t" for c in text)
        if not odd and (not text or shown >= 0.6 * len(text)):
            return text, name
    return None, None


def _readable(text: Column) -> Column:
    """The test of garbled text in ``decode_bytes``, for text that Spark has decoded."""
    size = F.length(text)
    odd = F.length(F.regexp_replace(text, "[^�]", "")) > F.greatest(F.lit(8), F.floor(size / 20))
    return (size == 0) | (~odd & (F.length(F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ \n\r\t]]", "")) >= 0.6 * size))


def decode_files(files: DataFrame) -> DataFrame:
    """``filename, text, encoding, error``: readable UTF-8 is decoded by Spark, only the rest in Python."""
    own = F.col("content").cast("string")
    plain = F.coalesce(F.is_valid_utf8(own) & _readable(own), F.lit(False))
    easy = files.where(plain).select("filename", F.regexp_replace(own, "^﻿", "").alias("text"), F.lit("utf-8").alias("encoding"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [decode_bytes(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"filename": pdf["filename"], "text": [f[0] for f in found], "encoding": [f[1] for f in found], "error": [None if f[1] else "undecodable" for f in found]})

    return easy.unionByName(files.where(~plain).select("filename", "content").mapInPandas(run, "filename string, text string, encoding string, error string"))


def with_content_hash(df: DataFrame, content: str, name: str = "content_hash") -> DataFrame:
    return df.withColumn(name, F.sha2(F.col(content).cast("binary"), 256))


def malware_rule(name: str | Column, content: str | Column) -> Column:
    """The first rule that the file's bytes break, or null; ``content`` is binary."""
    ext = extension(name)
    text = F.decode(F.col(content) if isinstance(content, str) else content, "ISO-8859-1")
    head = F.substring(text, 1, 64 * 1024)
    return (
        F.when(F.instr(text, EICAR) > 0, "eicar")
        .when(F.startswith(text, F.lit("MZ")) & ~ext.isin(*OFFICE_TYPES), "pe_executable")
        .when(F.startswith(text, F.lit("\x7fELF")), "elf_executable")
        .when(ext.isin(*TEXT_TYPES) & text.rlike(r"^\s*#!/"), "shebang")
        .when(head.rlike(r"(?i)<script[\s>]") & ~ext.isin("html", "htm", "xml"), "script")
        .when(head.rlike(r"(?i)AutoOpen|Auto_Open|Document_Open") & ~ext.isin(*OFFICE_TYPES), "auto_macro")
    )


def replace_chunks(target: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """All chunks of the documents in ``new`` are replaced."""
    return target.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_vectors(target: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Last write wins for each base, version and chunk; of repeats in ``new`` that with the largest ``order``."""
    keys = ["kb_id", "index_version", "chunk_id"]
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    return target.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(last)


def delete_vectors(target: DataFrame, docs: DataFrame, version: str | None = None, key: str = "doc_id") -> DataFrame:
    gone = docs.select(key).distinct()
    if version is None:
        return target.join(gone, key, "left_anti")
    return target.where(F.col("index_version") == version).join(gone, key, "left_anti").unionByName(target.where(~F.col("index_version").eqNullSafe(F.lit(version))))


def reindex(kbs: DataFrame, docs: DataFrame, chunks: DataFrame, embed) -> DataFrame:
    """Vectors of all enabled, non-blank chunks of ready documents in active bases with a version."""
    live = kbs.where("status = 'active' AND current_index_version IS NOT NULL").select("kb_id", F.col("current_index_version").alias("index_version"))
    ready = docs.where("status = 'ready'").select("doc_id", "kb_id").join(live, "kb_id")
    rows = chunks.where("is_enabled").where(F.trim("content") != "").select("chunk_id", "doc_id", "content").join(ready, "doc_id")
    return embed(rows, "content")


def append_events(df: DataFrame, path: str, ts: str = "ts") -> None:
    df.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def read_usage(raw: DataFrame, body: str = "body") -> DataFrame:
    """Days with an array of usages by model, as one row for each day and model."""
    schema = "date string, usage array<struct<model string, input_tokens long, output_tokens long, cost double>>"
    return raw.select(F.from_json(body, schema).alias("d")).select("d.date", F.explode_outer("d.usage").alias("u")).select("date", "u.*")


def export_run(results: DataFrame, path: str, run_id: int | None = None) -> None:
    """Results of one run (or all) as CSV with a header, quotes doubled."""
    rows = results if run_id is None else results.where(F.col("run_id") == run_id)
    rows.select("question", "hit", "rank", "score", "strategy", "elapsed_ms").write.option("header", True).option("escape", '"').csv(path)


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the number of those that go."""
    one = ids.select(key).distinct()
    return df.join(one, key, "left_anti"), df.join(one, key, "left_semi").agg(F.count("*").alias("removed"))
