"""Corpus text: normalising, segmenting, locating segments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import rstrip, strip

#: Defaults of segment rules.
SIZE, OVERLAP, SEPARATORS = 500, 50, ("\n\n", "\n", "。", ".", " ")
CHUNK = "chunk_index int, content string, char_count int, start int, end int, heading string, heading_level int, heading_path string"


def normalize(df: DataFrame, text: str) -> DataFrame:
    """Add ``normalized_text`` and four counts; two look-back passes over the array of lines, no shuffle."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n")
    lines = F.transform(F.split(raw, "\n"), rstrip)
    blank = lambda a, i: (i > 0) & (F.get(a, i - 1) == "")
    df = df.withColumn("__l", lines)
    df = df.withColumn("__c", F.filter("__l", lambda x, i: ~((x == "") & blank(F.col("__l"), i))))
    squeeze = F.transform("__c", lambda x: F.when(x.rlike(r"^#{1,6}\s"), x).otherwise(F.regexp_replace(x, r"[ \t]{2,}", " ")))
    df = df.withColumn("__s", squeeze)
    df = df.withColumn("__d", F.filter("__s", lambda x, i: (x == "") | (i == 0) | (F.get(F.col("__s"), i - 1) != x)))
    body = strip(F.array_join("__d", "\n"))
    out = F.when(body == "", F.lit("")).otherwise(F.concat(body, F.lit("\n")))
    df = df.withColumn("normalized_text", out).withColumn("removed_blank_lines", (F.size("__l") - F.size("__c")).cast("long"))
    df = df.withColumn("removed_duplicate_blocks", (F.size("__s") - F.size("__d")).cast("long"))
    df = df.withColumn("char_count_before", F.length(F.coalesce(text, F.lit(""))).cast("long")).withColumn("char_count_after", F.length("normalized_text").cast("long"))
    return df.drop("__l", "__c", "__s", "__d")


def resolve_rules(docs: DataFrame, kb_rules: DataFrame, defaults: tuple[int, int, str] = (SIZE, OVERLAP, "fixed")) -> DataFrame:
    """Rules of each document: own, else its base's, else defaults; a mode of ``fixed`` is upgraded by file type."""
    size, overlap, mode = defaults
    r = docs.join(kb_rules.select("kb_id", F.col("chunk_size").alias("kb_size"), F.col("chunk_overlap").alias("kb_overlap"), F.col("split_mode").alias("kb_mode")), "kb_id", "left")
    chosen = F.coalesce("split_mode", "kb_mode", F.lit(mode))
    by_type = F.when(F.col("file_type") == "md", "markdown").when(F.col("file_type").isin("txt", "pdf", "doc", "docx"), "paragraph").otherwise("fixed")
    return r.select("doc_id", "kb_id", F.coalesce("chunk_size", "kb_size", F.lit(size)).alias("chunk_size"), F.coalesce("chunk_overlap", "kb_overlap", F.lit(overlap)).alias("chunk_overlap"), F.when(chosen == "fixed", by_type).otherwise(chosen).alias("split_mode"))


def sliding(df: DataFrame, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each window of ``size`` characters, ``max(size - overlap, 1)`` apart, up to the one that reaches the end."""
    step = max(size - overlap, 1)
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0)).cast("int")
    rows = df.where(F.length(text) > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_index") * step
    return rows.withColumns({"start": start, "content": F.substring(F.col(text), start + 1, F.lit(size))}).withColumn("end", F.col("start") + F.length("content"))


def _split_rows(df: DataFrame, parts) -> DataFrame:
    return df.select("*", F.posexplode(F.filter(F.transform(parts, strip), lambda x: x != "")).alias("chunk_index", "content"))


def paragraphs(df: DataFrame, text: str) -> DataFrame:
    return _split_rows(df, F.split(text, r"\n\s*\n"))


def headings(df: DataFrame, text: str) -> DataFrame:
    return _split_rows(df, F.split(text, r"(?m)(?=^#{1,6}\s)"))


def _units(text: str, size: int, separators: tuple[str, ...]) -> Iterator[str]:
    """Pieces of at most ``size`` where a separator allows it; separators stay at the end of their piece."""
    if len(text) <= size or not separators:
        yield text
        return
    for piece in re.findall(rf"(?s).*?{re.escape(separators[0])}|.+\Z", text):
        yield from _units(piece, size, separators[1:]) if len(piece) > size else (piece,)


def placed(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[str, int]]:
    """Greedy chunks of units with their start; one begins with the last ``overlap`` characters of the one before; a long unit is sliced."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is needed")
    out: list[tuple[str, int]] = []
    buffer, start, behind = "", 0, 0
    for unit in _units(text, size, separators):
        behind += len(unit)
        if len(unit) > size:
            if buffer.strip():
                out.append((buffer, start))
            buffer, at = "", 0
            while True:
                out.append((unit[at : at + size], behind - len(unit) + at))
                if at + size >= len(unit):
                    break
                at += size - overlap
            start = behind
            continue
        if buffer and len(buffer) + len(unit) > size:
            out.append((buffer, start))
            buffer = buffer[-overlap:] if overlap else ""
            start = behind - len(unit) - len(buffer)
        buffer += unit
    if buffer.strip():
        out.append((buffer, start))
    return [(c.strip(), at + len(c) - len(c.lstrip())) for c, at in out if c.strip()]


def pack(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    return [c for c, _ in placed(text, size, overlap, separators)]


def _fixed(text: str, size: int, overlap: int) -> list[tuple]:
    return [(c, None, None, None) for c in pack(text, size, overlap)]


def _refined(parts: list[str], size: int, overlap: int) -> list[tuple]:
    """Parts, those over ``size`` cut again."""
    out = []
    for p in (p.strip() for p in parts):
        if p:
            out += _fixed(p, size, overlap) if len(p) > size else [(p, None, None, None)]
    return out


def _markdown(text: str, size: int, overlap: int) -> list[tuple]:
    """Sections under ATX headings outside fences, in blocks parted by blank lines; a fence is one block and is never cut."""
    out: list[tuple] = []
    path: list[tuple[int, str]] = []
    blocks: list[list[str]] = [[]]
    fenced = False

    def flush() -> None:
        level, name = path[-1] if path else (None, None)
        trail = " > ".join(h for _, h in path) or None
        ready, buffer = ["\n".join(b).strip("\n") for b in blocks if any(x.strip() for x in b)], ""
        for b in ready:
            if buffer and len(buffer) + 2 + len(b) > size:
                out.append((buffer, name, level, trail))
                buffer = ""
            if len(b) > size and not b.lstrip().startswith(("```", "~~~")):
                if buffer:
                    out.append((buffer, name, level, trail))
                    buffer = ""
                out.extend((c, name, level, trail) for c in pack(b, size, overlap))
            else:
                buffer = f"{buffer}\n\n{b}" if buffer else b
        if buffer:
            out.append((buffer, name, level, trail))
        blocks[:] = [[]]

    for line in text.split("\n"):
        mark = line.lstrip().startswith(("```", "~~~"))
        m = None if fenced or mark else re.match(r"(#{1,6})\s+(.*)", line)
        if m:
            flush()
            level = len(m[1])
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, m[2].strip()))
        elif mark:
            if not fenced:
                blocks.append([line])
            else:
                blocks[-1].append(line)
                blocks.append([])
            fenced = not fenced
            continue
        if fenced or line.strip():
            blocks[-1].append(line)
        elif blocks[-1]:
            blocks.append([])
    flush()
    return out


#: Modes by name: a function of text, size and overlap that gives (content, heading, level, path).
MODES: dict[str, Callable[[str, int, int], list[tuple]]] = {
    "fixed": _fixed,
    "markdown": _markdown,
    "paragraph": lambda t, s, o: _refined(re.split(r"\n\s*\n", t), s, o),
    "heading": lambda t, s, o: _refined(re.split(r"(?m)(?=^#{1,6}\s)", t), s, o),
    "sliding": lambda t, s, o: [(t[i : i + s], None, None, None) for i in range(0, max(len(t) - s, 0) + max(s - o, 1) if len(t) > s else 1, max(s - o, 1)) if t[i : i + s] and (i == 0 or i - max(s - o, 1) + s < len(t))],
}


def locate(text: str, contents: list[str]) -> list[tuple[int, int]]:
    """Start and end of each chunk: its next place behind the last start found, else its first place anywhere, else its length from there on."""
    out: list[tuple[int, int]] = []
    behind = 0
    for c in contents:
        places = (text.find(c, behind), text.find(c))
        found = next((p for p in places if p >= 0), None)
        out.append((behind, behind + len(c)) if found is None else (found, found + len(c)))
        if found is not None:
            behind = found + 1
    return out


def chunk(df: DataFrame, key: str, text: str, mode: str = "fixed", size: int = SIZE, overlap: int = OVERLAP, exact: bool = False) -> DataFrame:
    """``key`` and the chunks of ``text`` with their offsets; one narrow pass, a document stays in its task.

    Offsets are sought in the text (``locate``), where a passage that recurs may be found at another of its
    places; with ``exact`` (mode ``fixed`` alone) they are where the chunk was cut.
    """
    if exact and mode != "fixed":
        raise ValueError("exact offsets are those of fixed chunks")
    split = MODES[mode]
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                if exact:
                    cut = placed(t, size, overlap) if t else []
                    found, places = [(c, None, None, None) for c, _ in cut], [(at, at + len(c)) for c, at in cut]
                else:
                    found = split(t, size, overlap) if t else []
                    places = locate(t, [f[0] for f in found]) if found else []
                rows += [(k, i, c, len(c), a, b, h, lv, p) for i, ((c, h, lv, p), (a, b)) in enumerate(zip(found, places))]
            out = pd.DataFrame(rows, columns=[key, "chunk_index", "content", "char_count", "start", "end", "heading", "heading_level", "heading_path"])
            out["heading_level"] = out["heading_level"].astype("Int32")
            yield out

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {CHUNK}")


def preview(docs: DataFrame, longest: int = 80_000) -> DataFrame:
    """Text cut for display, with a flag and the source of the text."""
    return docs.select("doc_id", F.substring("raw_text", 1, longest).alias("preview"), (F.length("raw_text") > longest).alias("truncated"), F.when(F.length("raw_text") > 0, "raw_text").otherwise("none").alias("preview_source"))


def offsets_by_document(chunks: DataFrame) -> DataFrame:
    """Chunks whose start lies before that of the chunk before, per document: none in a sound table."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumn("before", F.lag("start").over(w)).where(F.col("start") < F.col("before"))
