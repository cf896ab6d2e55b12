"""Personal data: patterns, and information-theoretic sanitisation of the terms around them.

An entity is a value that a pattern finds. For every term of a document with an entity, the corpus
tells how much the term reveals: the pointwise mutual information of term and entity over all
documents, as a share of the entity's own information. Wherever a term whose share reaches
``disclosure`` with at least ``support`` common documents stands in a document with that entity,
it is removed, or generalised to its kind.

Terms are all words outside the patterns' matches: letters, digits and underscores in any number.
Documents are counted once, however many rows repeat them. Entities that the same documents hold
are one class, so the entities of a directory do not each meet all its words.

A term and an entity have at most as many common documents as the entity has, so a term in too
many documents cannot reach the share; such terms are dropped before pairs are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm._store import materialize, small_batches
from kbspark.llm._words import doc_key, own_names

KINDS = ("email", "ip", "card", "phone")
#: Fixed values of the contract.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match begins where its run of digits begins, so no digit is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class SanitiseRules:
    """``disclosure``: least share of the entity's information; ``support``: least number of documents."""

    disclosure: float = 0.7
    support: int = 2


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @: a match starts where its run of local characters starts."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of all valid matches by start, then kind."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def _terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The words outside all spans: term, start, end."""
    ends, at = sorted((a, b) for _, a, b in spans), 0
    done = 0  # end of the spans that start before the word
    for m in _WORD.finditer(text):
        while at < len(ends) and ends[at][0] < m.end():
            done = max(done, ends[at][1])
            at += 1
        if m.start() >= done:
            yield m.group().lower(), m.start(), m.end()


def _scan(docs: DataFrame) -> DataFrame:
    """``k1, k2, doc_id, base array<struct<kind,start,end>>, entities array<string>, words array<struct<term,start,end>>`` for every row; words only beside entities."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                base, entities, cut, words = [], [], [0], []
                for cell in part.column(3):
                    text = cell.as_py() or ""
                    spans = find_spans(text)
                    base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                    entities.append(sorted({f"{k}:{text[a:b].lower()}" for k, a, b in spans}))
                    words += _terms(text, spans) if spans else ()
                    cut.append(len(words))
                term, start, end = zip(*words) if words else ((), (), ())
                inner = pa.StructArray.from_arrays([pa.array(term, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["term", "start", "end"])
                cols = [part.column(0), part.column(1), part.column(2), pa.array(base, kinds), pa.array(entities, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), inner)]
                yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "doc_id", "base", "entities", "words"])

    rows = docs.select(*doc_key(), docs["doc_id"].cast("long").alias("doc_id"), "text")
    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long, base array<struct<kind:string,start:long,end:long>>, entities array<string>, words array<struct<term:string,start:long,end:long>>")


def _bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits places (a fixed size) with those of ``slots(slot)`` set."""
    found = slots.select((F.col("slot") / 8).cast("int").alias("at"), (F.col("slot") % 8).cast("int").alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[found.column("at").to_numpy()] = found.column("v").to_numpy()
    return out


def _slot(*columns: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << bits)).alias("slot")


def _repeated(docs: DataFrame, found: DataFrame, bits: int) -> tuple[np.ndarray, DataFrame]:
    """A bitmap of the keys that rows repeat, and ``slot, text`` of the documents under its places, each document once."""
    again = _bitmap(found.groupBy("k1", "k2").count().where(F.col("count") > 1).select(_slot("k1", "k2", bits=bits)), bits)
    sent = docs.sparkSession.sparkContext.broadcast(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            slot = batch.column(2).to_numpy()
            some = np.flatnonzero(sent.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            keys = list(zip(batch.column(0).to_numpy()[some].tolist(), batch.column(1).to_numpy()[some].tolist()))
            fresh = [i for i, k in zip(some.tolist(), keys) if k not in seen and not seen.add(k)]
            if len(seen) > 500_000:
                seen.clear()
            yield batch.take(pa.array(fresh, pa.int64()))

    rows = docs.select(*doc_key(), "text").select("k1", "k2", _slot("k1", "k2", bits=bits), "text")
    once = rows.mapInArrow(run, "k1 long, k2 long, slot long, text string").dropDuplicates(["k1", "k2"])
    return again, once.select(F.lit(None).cast("long").alias("slot"), "text") if again.any() else docs.sparkSession.createDataFrame([], "slot long, text string")


def _doc_counts(docs: DataFrame, found: DataFrame, terms: DataFrame, bits: int = 22) -> tuple[DataFrame, int]:
    """``term, df``: the documents that hold a term of ``terms``, and the number of documents with a word; rows that repeat an id and a text are one.

    A bitmap of 2**bits hashed terms goes to the executors, so only words that may be asked for
    are shuffled; the join with ``terms`` drops the few others. A second one tells which rows
    may repeat others; these are counted by themselves, each document once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(terms.select(_slot("term", bits=bits)), bits))
    again, once = _repeated(docs, found, bits)
    skipped = docs.sparkSession.sparkContext.broadcast(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def wanted(word: str) -> bool:
            x = xxhash.xxh64_intdigest(word.encode(), 42) % (1 << bits)  # Spark's xxhash64 has the seed 42
            return bool(sent.value[x >> 3] >> (x & 7) & 1)

        known: dict[str, bool] = {}
        counts: dict[str, int] = {}
        total = 0
        for batch in batches:
            for slot, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                if slot is not None and skipped.value[slot >> 3] >> (slot & 7) & 1:
                    continue
                words = {w.lower() for w in set(_WORD.findall(cell.as_py() or ""))}
                total += bool(words)
                for w in words:
                    k = known.get(w)
                    if k is None:
                        if len(known) > 500_000:
                            known.clear()
                        k = known[w] = wanted(w)
                    if k:
                        counts[w] = counts.get(w, 0) + 1
            if len(counts) > 500_000:
                yield pa.RecordBatch.from_pydict({"term": list(counts), "df": list(counts.values())})
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), total], pa.int64())], ["term", "df"])

    small_batches(docs.sparkSession)
    rows = docs.select(*doc_key(), "text").select(_slot("k1", "k2", bits=bits), "text").unionByName(once)
    counted = materialize(rows.mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")), "pii-terms")
    total = counted.where("term is null").first()
    return counted.where("term is not null").join(terms, "term"), int(total["df"]) if total else 0


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, rules: SanitiseRules = SanitiseRules()) -> DataFrame:
    """``k1, k2, doc_id, base, spans`` for every row of ``docs(doc_id, text)``; arrays of ``kind, start, end`` in code points.

    ``base`` are the patterns' matches, ``spans`` also the revealing terms, of kind ``term``; by
    start, then kind. Null and empty texts have none. Rows that repeat an id and a text get the
    same spans, null ids are ids, other columns are not looked at, an empty table gives an
    empty result, long texts are read whole.
    """
    found = materialize(_scan(docs), "pii")
    each = found.where(F.size("entities") > 0).select("k1", "k2", F.explode("entities").alias("entity")).distinct()
    # entities in the same documents (told by 128 bits) reveal and are revealed alike: they are one class
    class_ = F.struct(F.count("*").alias("of_entity"), F.bit_xor(F.xxhash64("k1", "k2")).alias("x"), F.bit_xor(F.xxhash64("k2", F.lit(1), "k1")).alias("y")).alias("class")
    of = each.groupBy("entity").agg(class_).where(F.col("class.of_entity") >= rules.support)
    held = materialize(each.join(of, "entity").select("k1", "k2", "class.*").distinct(), "pii-held")
    worded = found.where(F.size("words") > 0).join(held.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    terms = materialize(worded.select("k1", "k2", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term")).distinct(), "pii-words")
    counts, total = _doc_counts(docs, found, terms.groupBy("term").count().where(F.col("count") >= rules.support).select("term"))
    n = float(max(total, 1))
    need = rules.disclosure * F.log(n / F.least(F.col("of_entity").cast("double"), F.lit(n / 2)))
    most = held.agg(F.max("of_entity").alias("x")).first()["x"] or 1
    rare = counts.where(F.log(F.lit(n) / F.col("df")) >= rules.disclosure * F.log(F.lit(n / min(float(most), n / 2))) - 1e-9)
    pairs = terms.join(rare, "term").join(held, ["k1", "k2"]).where(F.log(F.lit(n) / F.col("df")) >= need - 1e-9)
    pairs = materialize(pairs.select("k1", "k2", "of_entity", "x", "y", "term", "df"), "pii-pairs")
    told = pairs.groupBy("of_entity", "x", "y", "term", "df").agg(F.count("*").alias("both")).where(F.col("both") >= rules.support)
    pmi = F.log(F.col("both") * n / (F.greatest("df", "both") * F.col("of_entity")))
    told = told.where(pmi >= need).select("of_entity", "x", "y", "term")
    marks = pairs.join(told, ["of_entity", "x", "y", "term"]).groupBy("k1", "k2").agg(F.collect_set("term").alias("marks"))
    marked = found.where(F.size("words") > 0).select("k1", "k2", "words").join(marks, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    span = lambda w: F.struct(F.lit("term").alias("kind"), w["start"].alias("start"), w["end"].alias("end"))
    extra = materialize(marked.select("k1", "k2", F.transform(F.filter("words", lambda w: F.array_contains("marks", w["term"])), span).alias("extra")), "pii-extra")
    rows = found.select("k1", "k2", "doc_id", "base").join(extra, ["k1", "k2"], "left")
    place = F.create_map(*[x for i, k in enumerate((*KINDS, "term")) for x in (F.lit(k), F.lit(i))])
    both = F.concat("base", F.coalesce("extra", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    keyed = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return rows.select("k1", "k2", "doc_id", "base", F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def pii_digest(docs: DataFrame, rules: SanitiseRules = SanitiseRules()) -> DataFrame:
    """Counts of each kind and digests of the spans of every row."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return sanitise(docs, rules).select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: SanitiseRules = SanitiseRules(), generalise: bool = True) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced by their kind in brackets, or taken out; overlapping spans are one."""
    one, two, marks = own_names(docs, "__1", "__2", "__spans")
    spans = sanitise(docs, rules).select(F.col("k1").alias(one), F.col("k2").alias(two), F.col("spans").alias(marks)).dropDuplicates([one, two])
    k1, k2 = doc_key()
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], k1.alias(one), k2.alias(two)).join(spans, [one, two], "left")
    empty = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["text"].alias("text"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(F.struct(F.concat(acc["text"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")) if generalise else F.lit("")).alias("text"), s["end"].alias("at")))
    clean = F.aggregate(marks, empty, step, lambda acc: F.concat(acc["text"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return rows.select(*[(F.when(F.size(marks) > 0, clean).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns])


__all__ = ["KINDS", "SanitiseRules", "find_spans", "pii_digest", "redact", "sanitise"]
