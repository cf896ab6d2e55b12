"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only.

A line is the set of its lower-case words. Equal wordings are one node. Words are ordered by rarity
(a table of 2**bits hashed counts gives the rarity; any one order keeps the join exact), and two
wordings that reach the threshold share a word among the first ``n - ceil(t n) + 1`` words of each.
They meet under these words; length, positional and bit-count filters bound the overlap from above,
and the rest is verified on the sorted arrays of 64-bit word hashes.

A line is removed when an earlier line of the corpus matches it, whether that one stays or not. So
one earlier match settles a wording: in the lists of frequent words every wording is first held
against the earliest one of each size there, and only the unsettled ones meet the whole list.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm._store import bloom_filters, discard, materialize
from kbspark.llm._words import own_names

_LEAST = -(2**63)
_AT = ("doc", "mark", "pos")
#: Word hashes return often: with dictionaries of this size a table of them takes two bytes or three a word.
_DICTIONARY = {"parquet.dictionary.page.size": 8 << 20}


def line_table(docs: DataFrame) -> DataFrame:
    """``doc, mark, pos, h, line`` for every line with a word: ``mark`` is a hash of the text, ``h`` one of the line, which is in lower case with single blanks."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc"), F.xxhash64("text").alias("mark"), F.split("text", "\n").alias("raw"))
    rows = rows.select("doc", "mark", F.posexplode("raw").alias("pos", "raw"))  # the text itself does not go with every line
    rows = rows.where(F.ltrim("raw", F.lit(" \t\x0b\f\r")) != "")  # not by the line, which would be made twice
    odd = F.contains("raw", F.lit("  "))
    for blank in "\t\x0b\f\r":
        odd |= F.contains("raw", F.lit(blank))
    line = F.trim(F.when(odd, F.regexp_replace("raw", r"\s+", " ")).otherwise(F.col("raw")))
    rows = rows.select("doc", "mark", F.col("pos").cast("long").alias("pos"), F.lower(line).alias("line"))
    return rows.select("doc", "mark", "pos", F.xxhash64("line").alias("h"), "line")


def _wordings(lines: DataFrame) -> DataFrame:
    """``h, doc, mark, pos, uses, n, words``: each wording once, with its first place and the ascending hashes of its words."""
    once = lines.groupBy("h").agg(F.min(F.struct(*_AT)).alias("at"), F.count("*").alias("uses"), F.any_value("line").alias("line"))
    words = F.sort_array(F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))))
    return once.select("h", "at.*", "uses", words.alias("words")).withColumn("n", F.size("words").cast("long"))


def rarity_table(wordings: DataFrame, bits: int) -> bytes:
    """One byte for each of 2**bits buckets of words: four times the binary logarithm of the bucket's count of wordings."""
    bucket = F.col("word").bitwiseAND(F.lit((1 << bits) - 1))
    counts = wordings.select(F.explode("words").alias("word")).groupBy(bucket.alias("bucket")).agg(F.least(F.lit(127), F.floor(4 * F.log2(F.count("*") + 1))).cast("tinyint").alias("rank"))
    counts = materialize(counts, "line-rarity").toArrow()
    table = np.zeros(1 << bits, np.uint8)
    table[counts.column("bucket").to_numpy()] = counts.column("rank").to_numpy()
    return table.tobytes()


def _ceil_share(n: Column, num: int, den: int) -> Column:
    return F.floor((n * num + (den - 1)) / F.lit(den)).cast("long")


#: A word of this rank has a list of at most 2**(SHORT / 4 + 1 / 4) wordings, which give all their pairs at once.
SHORT = 34
#: Sizes and places in a posting are told up to this; beyond it filters let pairs through.
_FULL = 4095


def _prefixes(wordings: DataFrame, table: bytes, bits: int, num: int, den: int) -> DataFrame:
    """``h, doc, n, sig, sig2, prefix``: a signature of 128 bits and the rare words of each wording, rarest first, each with its rank in the top byte."""

    def ranked(w: Column) -> Column:
        at = w.bitwiseAND(F.lit((1 << bits) - 1)) + 1
        rank = F.ascii(F.substring(F.lit(table), at.cast("int"), 1).cast("string")).cast("long")  # ranks are below 128
        return F.shiftleft(rank, 56).bitwiseOR(F.shiftrightunsigned(w, 8))

    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    half = lambda own: F.aggregate("words", F.lit(0).cast("long"), lambda acc, x: F.when(x.bitwiseAND(F.lit(64)) == own, acc.bitwiseOR(bit(x))).otherwise(acc))
    rows = wordings.select("h", "doc", "n", half(0).alias("sig"), half(64).alias("sig2"), F.sort_array(F.transform("words", ranked)).alias("ranked"))
    return rows.select("h", "doc", "n", "sig", "sig2", F.slice("ranked", F.lit(1), (F.col("n") - _ceil_share(F.col("n"), num, den) + 1).cast("int")).alias("prefix"))


def _postings(prefixes: DataFrame, long: bool) -> DataFrame:
    """``key, h, doc, n, i, sig, sig2``: the words of short or long lists, each wording once in a list."""
    rows = prefixes.select("h", "doc", F.least("n", F.lit(_FULL)).alias("n"), "sig", "sig2", F.posexplode("prefix").alias("i", "word"))
    rank = F.shiftright("word", 56)
    rows = rows.where(rank > SHORT if long else rank <= SHORT)
    return rows.select(F.col("word").bitwiseAND(F.lit((1 << 56) - 1)).alias("key"), "h", "doc", "n", F.least("i", F.lit(_FULL)).cast("long").alias("i"), "sig", "sig2")


def _may_match(x: str, y: str, num: int, den: int) -> Column:
    """Length, positional and bit-count filters for two postings of one word."""
    c = lambda side, name: F.col(f"{side}.{name}")
    nx, ny = c(x, "n"), c(y, "n")
    lacks = lambda a, b, s: F.bit_count(c(a, s).bitwiseAND(F.bitwise_not(c(b, s))))
    lost = lambda a, b: lacks(a, b, "sig") + lacks(a, b, "sig2")
    most = F.least(nx - c(x, "i"), ny - c(y, "i"), nx - lost(x, y), ny - lost(y, x))
    fits = (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (most * (num + den) >= (nx + ny) * num)
    return (nx == _FULL) | (ny == _FULL) | fits


def _settled(pairs: DataFrame, wordings: DataFrame, num: int, den: int) -> DataFrame:
    """``h`` of the later wording of each of ``pairs(a, b)`` whose words reach the threshold; only wordings of pairs are shuffled."""
    pairs = materialize(pairs.distinct(), "line-pairs")
    need = (F.col("xn") + F.col("yn")) * num
    asked = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).groupBy("h").agg(F.count("*").alias("asked"))
    asked = materialize(asked, "line-need").where("asked > 0").select("h")
    with bloom_filters(pairs.sparkSession):  # keeps wordings that are not asked for out of the shuffle
        full = materialize(wordings.select("h", F.struct(*_AT).alias("at"), "n", "words").join(asked, "h"), "line-words")
    x = full.select(F.col("h").alias("a"), F.col("at").alias("xa"), F.col("n").alias("xn"), F.col("words").alias("xw"))
    y = full.select(F.col("h").alias("b"), F.col("at").alias("ya"), F.col("n").alias("yn"), F.col("words").alias("yw"))
    # one use of the intersection in the predicate, as it may be put into the join
    good = pairs.join(x, "a").join(y, "b").where(F.size(F.array_intersect("xw", "yw")) * (num + den) >= need)
    late = materialize(good.select(F.when(F.col("xa") < F.col("ya"), F.col("b")).otherwise(F.col("a")).alias("h")).distinct(), "line-late")
    discard(pairs), discard(full)
    return late


def _late(wordings: DataFrame, num: int, den: int, bits: int) -> DataFrame:
    """``h`` of every wording that an earlier one matches."""
    table = rarity_table(wordings, bits)
    prefixes = materialize(_prefixes(wordings, table, bits, num, den), "line-prefixes")
    short, long = _postings(prefixes, False), _postings(prefixes, True)
    pair = F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")
    may = _may_match("x", "y", num, den)
    pairs = short.alias("x").join(short.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.h") < F.col("y.h")) & may).select(*pair)
    first = long.groupBy("key", "n").agg(F.min(F.struct("doc", "h", "i", "sig", "sig2")).alias("first")).select("key", "n", "first.*")
    hubs = long.alias("y").join(first.alias("x"), (F.col("x.key") == F.col("y.key")) & (F.col("x.doc") <= F.col("y.doc")) & (F.col("x.h") != F.col("y.h")) & may).select(*pair)
    pairs = materialize(pairs.distinct(), "line-pairs").unionByName(materialize(hubs.distinct(), "line-pairs"))
    late = _settled(pairs, wordings, num, den)
    rest = _postings(prefixes.join(late, "h", "left_anti"), True)
    more = long.alias("x").join(rest.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.doc") <= F.col("y.doc")) & (F.col("x.h") != F.col("y.h")) & may).select(*pair)
    late = late.unionByName(_settled(more, wordings, num, den))
    discard(prefixes)
    return late


def removed_places(docs: DataFrame, num: int = 80, den: int = 100, bits: int = 20) -> DataFrame:
    """``doc, mark, n_lines, places`` for every document with words: the number of its lines with a word, and the places of those that match an earlier line.

    ``2**bits`` bytes is the fixed size of the table of word rarities, which every task gets. The
    order of lines is that of doc_id, text hash and line number.
    """
    full = materialize(line_table(docs), "lines")
    wordings = materialize(_wordings(full), "line-wordings", **_DICTIONARY)
    lines = materialize(full.drop("line"), "line-places")
    discard(full)
    late = _late(wordings, num, den, bits).withColumn("late", F.lit(True))
    known = wordings.select("h", F.struct(*_AT).alias("at"), "uses").join(late, "h", "left").where("late or uses > 1")
    rows = lines.join(known.select("h", "at", "late"), "h", "left")
    gone = F.coalesce(F.col("late") | (F.struct(*_AT) != F.col("at")), F.lit(False))
    found = rows.groupBy("doc", "mark").agg(F.collect_set(F.struct("pos", gone.alias("gone"))).alias("found"))
    found = found.select("doc", "mark", F.size("found").cast("long").alias("n_lines"), F.transform(F.filter("found", lambda x: x["gone"]), lambda x: x["pos"]).alias("places"))
    found = materialize(found, "line-removed")
    discard(lines), discard(wordings)
    return found


def _with_places(docs: DataFrame, found: DataFrame, columns: list[Column]) -> tuple[DataFrame, str, str]:
    """``columns`` of ``docs`` beside the number of lines and the removed places, and the names of these two."""
    doc, mark, lines, places = own_names(docs, "__doc", "__mark", "__lines", "__places")
    keyed = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias(doc), F.xxhash64("text").alias(mark))
    named = found.select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("n_lines").alias(lines), F.col("places").alias(places))
    return keyed.join(named, [doc, mark], "left"), lines, places


def removed_lines(docs: DataFrame, num: int = 80, den: int = 100, bits: int = 20) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` for every row of ``docs(doc_id, text)``.

    ``n_lines`` counts lines with a word, ``removed`` are the numbers (from 0) of those that match
    an earlier line, comma-joined in ascending order. Blank lines are never removed. A null or
    empty text has no lines. Rows that repeat an id and a text are one document and get the same
    result; of different texts under one id the one of least text hash comes first; a null id
    comes before all others; other columns are not looked at; an empty table gives an empty
    result; long texts are read whole. Wordings and words are told apart by 64-bit hashes.
    """
    rows, n_lines, places = _with_places(docs, removed_places(docs, num, den, bits), [F.col("doc_id")])
    gone = F.sort_array(F.coalesce(places, F.array().cast("array<bigint>")))
    return rows.select("doc_id", F.coalesce(n_lines, F.lit(0).cast("long")).alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), F.array_join(gone, ",").alias("removed"))


def drop_later_lines(docs: DataFrame, num: int = 80, den: int = 100, bits: int = 20) -> DataFrame:
    """``docs`` with the matching lines taken out of ``text``; all other columns as they are.

    Documents that had lines with words and lose them all go; others stay, blank ones too.
    """
    rows, n_lines, places = _with_places(docs, removed_places(docs, num, den, bits), [F.col(f"`{c}`") for c in docs.columns])
    some = F.coalesce(F.size(places) > 0, F.lit(False))
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), F.col(places))
    text = F.when(some, F.array_join(F.transform(stay, lambda i: F.get(lines, i.cast("int"))), "\n")).otherwise(F.col("text"))
    rows = rows.where(~some | (F.size(places) < F.col(n_lines)))
    return rows.select(*[(text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns])
