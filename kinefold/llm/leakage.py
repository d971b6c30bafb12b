"""Evaluation passages leaking into training text (problem 6).

A distributed positional inverted index stores the token postings of the corpus, each task's
part in the order of terms (only terms that some test item holds can ever match, so only those
are kept).  For every item the few rarest terms of each part of its passage are looked up, and
postings are intersected after taking the term's place in the passage from its place in the
document: places that agree on the offset, or nearly so, are an exact phrase or a proximity
match.  Only documents with enough such places are read again, whole (pieces of a passage may
stand far apart), and aligned with it word by word (spelling, joined, split, added and lost
words allowed), which decides.  Passages of fewer than ``whole_below`` words must stand there whole,
as an exact phrase.

The test items are a given set; their term tables, and the pairs to align, are broadcast only
while below ``BROADCAST_ROWS`` (counted), and shuffled otherwise.  A looked-up term is the
rarest of its part of a passage, so a common word is joined only where all words of a part are.

Defined results: null or empty texts and passages match nothing; copies of a document count
each; repeated items each report; instructions are not searched; extra columns are ignored.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinefold.llm.textnorm import words
from kinefold.session import stored

BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class LeakParams:
    """How many places must agree, and how much of the passage must be found."""

    parts: int = 5           # a passage is looked up in so many parts ...
    rare_per_part: int = 2   # ... by so many of its rarest terms each
    slack: int = 12          # offsets within this many words agree
    places: int = 3          # agreeing places that make a candidate (half a passage holds about five) ...
    pieces: int = 4          # ... or so many in several pieces of two at least
    share: float = 0.5       # share of the passage's words, in order
    gap: int = 4             # words between pieces that still belong together
    whole_below: int = 6     # passages of fewer words must stand whole

    def __post_init__(self):
        if self.parts * self.rare_per_part > 63:
            raise ValueError("at most 63 places of a passage can be looked up")


def tokenised(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, words``: plain words of every text, in order."""
    return documents.where(F.length(text) > 0).select(key, words(F.col(text)).alias("words"))


def postings(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """``term, key, pos``: the positional inverted index, a row per posting (no lists, so no term is a large row)."""
    return tokens.select(key, F.posexplode("words").alias("pos", "term")).select("term", key, "pos")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where ``rows``, counted before, is below the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def phrase_matches(index: DataFrame, phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """``item_id, key, start``: exact occurrences of whole phrases (``item_id, words``) by offset-adjusted intersection."""
    parts = phrases.where(F.size("words") > 0).select("item_id", F.size("words").alias("_n"), F.posexplode("words").alias("_at", "term"))
    rows = parts.count()
    return (index.join(_small(parts, rows), "term").select("item_id", "_n", key, (F.col("pos") - F.col("_at")).alias("start"))
            .groupBy("item_id", "_n", key, "start").count().where("count = _n").select("item_id", key, "start"))


def looked_up(items: DataFrame, frequency: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """``term, item_id, at, _bit, _need``: the rarest terms of each part of a passage, all terms of a short one."""
    n = F.size("words")
    parts = F.when(n < params.whole_below, n).otherwise(F.least(F.lit(params.parts), n))
    terms = (items.select("item_id", n.alias("_n"), parts.alias("_parts"), F.posexplode("words").alias("at", "term"))
             .withColumn("part", F.floor(F.col("at") * F.col("_parts") / F.col("_n"))))
    first = Window.partitionBy("item_id", "part", "term").orderBy("at")
    rank = Window.partitionBy("item_id", "part").orderBy(F.coalesce("df", F.lit(0)), F.desc(F.length("term")), "term")
    all_of = Window.partitionBy("item_id")
    return (terms.withColumn("_k", F.row_number().over(first)).where("_k = 1").join(frequency, "term", "left")
            .withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= params.rare_per_part)
            .withColumn("_need", F.when(F.col("_n") < params.whole_below, F.count("*").over(all_of)).otherwise(F.least(F.lit(params.places), F.count("*").over(all_of))))
            .select("term", "item_id", "at", F.expr(f"shiftleft(1L, cast(part * {params.rare_per_part} + _r - 1 as int))").alias("_bit"), "_need"))


def candidates(index: DataFrame, items: DataFrame, params: LeakParams = LeakParams(), key: str = "doc_id") -> DataFrame:
    """``key, item_id``: documents in which enough rare terms of an item stand at agreeing offsets.

    ``index`` is used twice (document frequencies, then postings): pass a stored one.
    """
    rows = items.agg(F.sum(F.size("words"))).first()[0] or 0
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    rare = looked_up(items, frequency, params)
    hits = index.join(_small(rare, rows), "term").select(key, "item_id", "_bit", "_need", (F.col("pos") - F.col("at")).alias("_offset"))
    bands = F.explode(F.array(F.floor(F.col("_offset") / (2 * params.slack)) * 2, F.floor((F.col("_offset") + params.slack) / (2 * params.slack)) * 2 + 1))
    # a bit for each looked-up place: distinct places are counted in one aggregation, combined before the shuffle
    near = (hits.select(key, "item_id", "_bit", "_need", bands.alias("_band")).groupBy(key, "item_id", "_band")
            .agg(F.bit_or("_bit").alias("_places"), F.first("_need").alias("_need"))
            .withColumn("_n", F.bit_count("_places")).where("_n >= least(2, _need)"))
    return (near.groupBy(key, "item_id").agg(F.max("_n").alias("_n"), F.bit_count(F.bit_or("_places")).alias("_all"), F.first("_need").alias("_need"))
            .where((F.col("_n") >= F.col("_need")) | (F.col("_all") >= F.greatest(F.col("_need"), F.lit(params.pieces)))).select(key, "item_id"))


def _deletes(word: str) -> set[str]:
    return {word[:i] + word[i + 1:] for i in range(len(word))}


class Passage:
    """A passage ready for alignment: its words, close spellings and joined pairs."""

    def __init__(self, words_: list[str]):
        self.words = words_
        self.vocabulary = set(words_)
        self.counts = Counter(words_)
        self.close: dict[str, str] = {}
        for w in self.vocabulary:
            if len(w) >= 4 and not w.isdigit():
                for d in _deletes(w):
                    self.close.setdefault(d, w)
        self.pairs = {a + b: (a, b) for a, b in zip(words_, words_[1:])}

    def read(self, text: list[str]) -> list[str | None]:
        """The text in the passage's words; None where a word is not of it."""
        out: list[str | None] = []
        k, n = 0, len(text)
        while k < n:
            w = text[k]
            if w in self.vocabulary:
                out.append(w)
            elif w in self.pairs:
                out += self.pairs[w]
            elif k + 1 < n and len(w) + len(text[k + 1]) >= 4 and w + text[k + 1] in self.vocabulary and text[k + 1] not in self.vocabulary:
                out.append(w + text[k + 1])
                k += 1
            elif k + 2 < n and w + text[k + 1] + text[k + 2] in self.vocabulary and len(w) + len(text[k + 1]) + len(text[k + 2]) >= 5:
                out.append(w + text[k + 1] + text[k + 2])
                k += 2
            else:
                out.append(self.near(w))
            k += 1
        return out

    def near(self, w: str) -> str | None:
        """The passage's word one edit away, if any."""
        if len(w) < 3 or w.isdigit():
            return None
        if w in self.close:
            return self.close[w]
        for d in _deletes(w):
            if d in self.vocabulary and len(d) >= 4:
                return d
            if len(w) >= 4 and d in self.close and abs(len(self.close[d]) - len(w)) == 0:
                return self.close[d]
        return None


def aligned_share(passage: Passage, text: list[str], gap: int = 4, least: int = 3, whole_below: int = 6, enough: float = 0.0) -> float:
    """Share of the passage's words found in order in the text, single stray words aside.

    The text is first cut to stretches in which the passage's words stand close together.
    A passage of fewer than ``whole_below`` words counts only whole and word by word.
    Shares that cannot reach ``enough`` come out as 0.
    """
    if len(passage.words) < whole_below:
        n = len(passage.words)
        return float(n > 0 and any(text[k:k + n] == passage.words for k in range(len(text) - n + 1)))
    read = passage.read(text)
    at = [k for k, w in enumerate(read) if w is not None]
    stretches: list[list[int]] = []
    for k in at:
        if stretches and k - stretches[-1][-1] <= gap:
            stretches[-1].append(k)
        else:
            stretches.append([k])
    kept: list[str | None] = []
    for s in stretches:
        if len(s) >= least and len({read[k] for k in s}) >= least:
            kept += [*read[s[0]:s[-1] + 1], None, None, None]
    # no alignment finds more words than the text holds of the passage's, order aside
    if not passage.words or sum((Counter(w for w in kept if w is not None) & passage.counts).values()) < enough * len(passage.words):
        return 0.0
    blocks = difflib.SequenceMatcher(None, passage.words, kept, autojunk=False).get_matching_blocks()[:-1]
    found = 0
    for k, b in enumerate(blocks):
        close = any(0 <= j < len(blocks) and abs(blocks[j].a - b.a) <= gap + max(b.size, blocks[j].size)
                    and abs(blocks[j].b - b.b) <= gap + max(b.size, blocks[j].size) for j in (k - 1, k + 1))
        found += b.size if b.size >= 3 or close else 0
    return found / len(passage.words)


def leaked(documents: DataFrame, items: DataFrame, params: LeakParams = LeakParams(), key: str = "doc_id") -> DataFrame:
    """``key, item_id, share``: every document that holds a passage in whole or large part."""
    slim = documents.select(key, F.col("text").alias("_text"))
    test = items.where(F.length("passage") > 0).select("item_id", words(F.col("passage")).alias("words")).where(F.size("words") > 0)
    rows = test.count()
    vocabulary = test.select(F.explode("words").alias("term")).distinct()
    size = vocabulary.count()
    index = stored(postings(tokenised(slim, key, "_text"), key).join(_small(vocabulary, size), "term", "left_semi").sortWithinPartitions("term"), "postings")
    pairs = stored(candidates(index, test, params, key), "pairs")
    # a document's candidates are at most the items; its text is read again once, for all of them
    wanted = pairs.groupBy(key).agg(F.collect_list("item_id").alias("_items"))
    texts = slim.join(_small(wanted, pairs.count()), key).select(key, words(F.col("_text")).alias("words"), "_items")
    ready = texts.select(key, F.explode("_items").alias("item_id"), "words").join(_small(test.withColumnRenamed("words", "passage"), rows), "item_id").select(key, "item_id", "words", "passage")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Passage] = {}
        for batch in batches:
            share = []
            for item, text, passage in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if item not in known or known[item].words != passage:
                    if len(known) > 10_000:
                        known.clear()
                    known[item] = Passage(passage)
                share.append(aligned_share(known[item], text, params.gap, whole_below=params.whole_below, enough=params.share))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, type=pa.float64())], names=[key, "item_id", "share"])

    kinds = dict(ready.dtypes)
    scored = ready.mapInArrow(align, f"{key} {kinds[key]}, item_id {kinds['item_id']}, share double")
    return scored.where(F.col("share") >= params.share)


def leaks_by_item(found: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, suite, documents, highest_share``: every item with the number of documents that leak it."""
    per = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("highest_share"))
    return items.select("item_id", "suite").join(per, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
