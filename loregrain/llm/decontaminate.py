"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over ``SPAN`` words: it hashes the words at its marked positions and ignores the others, so words may be
substituted there. Windows of benchmark items and of documents meet where a seed's hash is equal. Around such a hit the item is
laid over the document at the hit's offset, and the stretch of agreeing words through the hit is verified: of at least
``min_words`` places, or the whole item if it is shorter, ``percent`` agree.

A contiguous window of 5 agreeing words is a seed too; it finds overlaps with substitutions at regular places. Items of fewer than ``min_words``
words have seeds of three words: with up to ``percent`` agreeing, one of these is always hit. They have to be in the document as a whole.

Seeds of items and of documents meet in a join on their hashes. First, documents leave out the seeds that a bitmap of the items' hashes, of ``BITS`` bits
whatever the benchmark's size, is certain not to have; few rows remain. Places in a row with the same seed, as in texts that repeat one word, are one run on
either side, and two runs that meet are one range of offsets, so that such texts cost no more than others. Every item's words join the ranges of a document once; the
documents that have any are verified in a second reading, ``ITEMS_AT_ONCE`` items at most in a row, and of equal stretches of a document's words only one is looked at.

Words are runs of letters and digits, lower-cased. Defined results: null and empty texts, and items of fewer than 5 words, match nothing.
Rows with equal (doc_id, item_id) come out once, with the longest overlap.
Null ids stay null. Empty tables give empty results. Other columns are not read; ``drop_contaminated`` keeps them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, mix, rows_of, staged

#: Fixed masks; 1 marks a position that is hashed.
MASKS = ("11111", "1101100011", "1010011011", "1100101101")
#: For items of fewer than SHORT words.
SHORT_MASKS = ("111", "1101")
SHORT = 13
SPAN = 10
#: Of the bitmap, a power of two: 4 MB are broadcast.
BITS = 1 << 25
#: About so many items of a document are verified in one row; a document that hits more has several rows.
ITEMS_AT_ONCE = 256
#: An odd number, and its inverse modulo 2**64, for rolling hashes of stretches of words.
ROLL = 0x9E3779B97F4A7C15
ROLL_BACK = pow(ROLL, -1, 1 << 64)
WORD = re.compile(rb"(?:[0-9a-z]|[\x80-\xff])+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").lower().encode())


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(int(mask, 2)))
    for i, bit in enumerate(mask):
        if bit == "1":
            h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h


def best_stretch(same: np.ndarray, least: int, percent: int) -> int:
    """The longest stretch, of at least ``least`` places, whose agreeing share is at least percent and whose ends agree; 0 if none."""
    n = len(same)
    if n < least:
        return 0
    # value[i] <= value[j] means that places i..j-1 agree often enough
    value = np.r_[0, np.cumsum(np.where(same, 100 - percent, -percent))]
    # for the longest one: running minimum from the left, running maximum from the right
    low = np.minimum.accumulate(value)
    best, i = 0, 0
    for j in range(n, 0, -1):
        if not same[j - 1]:
            continue
        i = int(np.searchsorted(-low[: j + 1], -value[j]))
        while i < j and not same[i]:
            i += 1
        if j - i >= least and value[i] <= value[j]:
            best = max(best, j - i)
    return best


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last places of the runs of equal values."""
    cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
    return np.r_[0, cuts][: len(h)], np.r_[cuts - 1, len(h) - 1][: len(h)]


def _masks(n: int) -> tuple[str, ...]:
    return SHORT_MASKS if 5 <= n < SHORT else MASKS


def _bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, the hashes of its words, whether it is short and the hash of it all, of each different item."""

    def run(batches):
        known = WordHashes()
        for rows in rows_of(batches, "item_id", "text"):
            words = [known.of(words_of(text)) for _, text in rows]
            keys = [int(mix(np.r_[np.uint64(len(w)), w] * np.arange(1, 2 * len(w) + 3, 2, dtype=np.uint64)).sum().view(np.int64)) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())), pa.array(keys, pa.int64())], ["item_id", "words", "item"])

    return benchmark.select("item_id", "text").mapInArrow(run, "item_id long, words array<bigint>, item long").distinct()


def _item_seeds(items: DataFrame) -> DataFrame:
    """h, item, place, place_last: the seeds of every item, runs of one seed as one."""

    def run(batches):
        for rows in rows_of(batches, "item", "words"):
            for item, words in rows:
                w = np.array(words, np.int64).view(np.uint64)
                for mask in _masks(len(w)):
                    h = seeds(w, mask)
                    if len(h):
                        first, last = runs(h)
                        columns = h[first].view(np.int64), np.full(len(first), item), first.astype(np.int32), last.astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "item", "place", "place_last"])

    return items.select("item", "words").distinct().mapInArrow(run, "h long, item long, place int, place_last int")


def _bitmap(item_seeds: DataFrame) -> np.ndarray:
    """Which values the leading bits of seed hashes have; summed up in Spark, at most BITS / 64 words come to the driver."""
    word = F.shiftrightunsigned("h", 64 - BITS.bit_length() + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (word % 64).cast("int"))
    words = item_seeds.select(F.floor(word / 64).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(BITS // 64, np.int64)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bits


def _document_seeds(rows: DataFrame, bits: np.ndarray, masks: tuple[str, ...]) -> DataFrame:
    """row, h, p, p_last: the seeds of rows (row, text) that the bitmap may have, with the places of the first words of a run's first and last."""
    shipped = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known, maybe = WordHashes(), shipped.value.view(np.uint64)
        for some in rows_of(batches, "row", "text"):
            out = []
            for row, text in some:
                words = known.of(words_of(text))
                for mask in masks:
                    h = seeds(words, mask)
                    if not len(h):
                        continue
                    first, last = runs(h)
                    h = h[first]
                    bit = _bits(h)
                    at = np.flatnonzero((maybe[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
                    if len(at):
                        out.append((np.full(len(at), row), h[at].view(np.int64), first[at].astype(np.int32), last[at].astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["row", "h", "p", "p_last"])

    return rows.mapInArrow(run, "row long, h long, p int, p_last int")


def _overlap(item: np.ndarray, words: np.ndarray, offset: int, min_words: int, percent: int) -> int:
    """The words of the verified overlap of an item that is laid over a document at an offset; 0 if there is none."""
    low = max(0, -offset)
    high = max(low, min(len(item), len(words) - offset))
    same = item[low:high] == words[low + offset : high + offset]
    if len(item) < min_words:
        return len(item) * bool(len(same) == len(item) and 100 * int(same.sum()) >= percent * len(item))
    return best_stretch(same, min_words, percent)


def _offsets(ranges: list[dict], item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The offsets of the ranges at which item and words have a place in common, each once."""
    out, done = [], -len(item)
    for low, high in sorted((r["low"], r["high"]) for r in ranges):
        if high > done:
            out.append(np.arange(max(low, done + 1), min(high, len(words) - 1) + 1))
            done = high
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _longest(ranges: list[dict], item: np.ndarray, words: np.ndarray, min_words: int, percent: int) -> int:
    """The longest verified overlap at any offset of the ranges."""
    at = _offsets(ranges, item, words)
    inside = (at >= 0) & (at <= len(words) - len(item))
    if inside.sum() > 2:
        # the whole item lies on the words there: equal stretches of them have equal overlaps
        some = at[inside]
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(words), np.uint64(ROLL))])
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(words), np.uint64(ROLL_BACK))])
        rolled = np.r_[np.uint64(0), np.cumsum(words * power[: len(words)])]
        stretch = (rolled[some + len(item)] - rolled[some]) * back[some]
        at = np.r_[at[~inside], some[np.unique(stretch, return_index=True)[1]]]
    return max((_overlap(item, words, int(offset), min_words, percent) for offset in at), default=0)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_words): documents that hold a part of an item, and the longest part's length in words."""
    items = staged(_items(benchmark), "benchmark-items")
    found = staged(_item_seeds(items), "benchmark-seeds")
    short = not items.where(F.size("words").between(5, SHORT - 1)).isEmpty()
    # rows that share a key are verified each by itself
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text")).alias("row"))
    met = _document_seeds(rows.select("row", "text"), _bitmap(found), MASKS + SHORT_MASKS * short).join(found, "h")
    hits = met.select("row", "item", (F.col("p") - F.col("place_last")).alias("low"), (F.col("p_last") - F.col("place")).alias("high")).distinct()
    ranges = hits.groupBy("row", "item").agg(F.collect_list(F.struct("low", "high")).alias("ranges")).join(items, "item")
    part = F.pmod(F.xxhash64("item"), F.ceil(F.count("*").over(Window.partitionBy("row")) / ITEMS_AT_ONCE))
    hits = ranges.withColumn("part", part).groupBy("row", "part").agg(F.collect_list(F.struct("item_id", "ranges", "words")).alias("hits"))

    def run(batches):
        known = WordHashes()
        for some in rows_of(batches, "doc_id", "text", "hits"):
            out = []
            for doc_id, text, own in some:
                words = known.of(words_of(text))
                for hit in own:
                    n = _longest(hit["ranges"], np.array(hit["words"], np.int64).view(np.uint64), words, min_words, percent)
                    if n:
                        out.append((doc_id, hit["item_id"], n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "item_id", "n_words"])

    verified = rows.join(hits, "row").select("doc_id", "text", "hits").mapInArrow(run, "doc_id long, item_id long, n_words long")
    return verified.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, percent: int = 80) -> DataFrame:
    """docs less the documents that hold a part of an item; rows with a null doc_id stay."""
    gone = contaminated(docs, benchmark, min_words, percent).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
