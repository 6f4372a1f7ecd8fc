"""Quality rules over each document's own repetition, found with a suffix array.

The words of a document get a suffix array by prefix doubling; many documents are sorted together, with symbols that no two
documents share. The longest common prefixes of neighbours in the array give the LCP intervals, whose strings are the
maximal repeated substrings. The union of the spans of those of at least ``min_repeat`` words is the covered part. A
document is rejected if it fails a base rule, if the covered part is too large, or if its longest repeat is too long.

Words are ``[^\\x20\\x09-\\x0D]+``, case and punctuation kept. Defined results: null and empty text have no words and
fail the base rule on length; every row is judged by itself, so repeated rows get the same verdict twice; a null doc_id
stays null; empty tables give empty results. Only doc_id and text are read, other columns stay untouched in
``keep_good``. Texts are never cut; one very long text makes one batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordHashes, mix, rows_of

SPACES = "\t\n\v\f\r "
NO_SPACES = dict.fromkeys(map(ord, SPACES))
SYMBOLS = "#*$%&|<>"
WORDS_AT_ONCE = 200_000


@dataclass(frozen=True)
class Rules:
    """min_words and max_repeat_share are the base rules; the rest limits maximal repeated substrings.

    Words of long repeats also lie in repeated windows, so max_covered_share acts only below max_repeat_share. Of the labelled good documents
    that pass the base rules, at most 28 % are covered, by repeats of 13 words at most; the limits stand a little above that.
    """

    min_words: int = 50
    max_repeat_share: int = 50
    min_repeat: int = 8
    max_covered_share: int = 30
    max_longest: int = 50


def repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every word position, the longest string of words from it on that starts elsewhere in its document too.

    words: hashes of the words of some documents, one document after the other; doc: the number of each word's document.
    """
    n = len(words)
    end = np.searchsorted(doc, doc, side="right")
    symbol = mix(words ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(symbol, kind="stable")
    first = np.r_[True, symbol[order][1:] != symbol[order][:-1]]
    slots = np.arange(n)  # places in the suffix array whose suffixes are not told apart yet
    place = np.empty(n, np.int64)  # of each suffix, the first slot of those that are equal so far
    levels: list[np.ndarray] = []
    step = 1
    while True:
        group = np.cumsum(first) - 1
        place[order[slots]] = slots[first][group]
        shared = np.bincount(group, minlength=1)[group] > 1
        slots, group = slots[shared], group[shared]
        if not len(slots):
            break
        at = order[slots]
        rank = np.full(n, -1, np.int64)  # equal and not -1: the same string of `step` words, found at least twice
        rank[at] = place[at]
        levels.append(rank)
        beyond = at + step
        key = np.where(beyond < end[at], place[np.minimum(beyond, n - 1)], -1)  # a suffix that ends here comes first
        into = np.lexsort((key, group))
        order[slots] = at[into]
        group, key = group[into], key[into]
        first = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        step *= 2
    a, b = order[:-1], order[1:]
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        ok = (i < n) & (j < n)
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        lcp += np.where(ok & (levels[k][i] >= 0) & (levels[k][i] == levels[k][j]), 1 << k, 0)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    return longest


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the spans cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step)[:n] > 0


def _duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n += line in seen
            seen.add(line)
    return n


def _judge(rows: list[tuple], rules: Rules, known: WordHashes) -> list[tuple]:
    """The result columns but doc_id, for rows of (doc_id, text)."""
    texts = [text or "" for _, text in rows]
    words = [text.encode().split() for text in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(rows)), sizes)
    n = int(sizes.sum())
    if n:
        longest = repeats(np.concatenate([known.of(w) for w in words]), doc)
        often = np.flatnonzero(longest >= 3)
        in_windows = np.bincount(doc[covered(often, np.full(len(often), 3), n)], minlength=len(rows))
        long = np.flatnonzero(longest >= rules.min_repeat)
        in_repeats = np.bincount(doc[covered(long, longest[long], n)], minlength=len(rows))
        most = np.zeros(len(rows), np.int64)
        np.maximum.at(most, doc, longest)
    else:
        in_windows = in_repeats = most = np.zeros(len(rows), np.int64)
    out = []
    for text, n_words, repeat_words, span_words, top in zip(texts, sizes.tolist(), in_windows.tolist(), in_repeats.tolist(), most.tolist(), strict=True):
        failed = n_words < rules.min_words or 100 * repeat_words > rules.max_repeat_share * n_words
        good = 100 * span_words <= rules.max_covered_share * n_words and top <= rules.max_longest
        chars = len(text) - sum(map(text.count, SPACES))
        out.append((n_words, chars, sum(map(text.count, SYMBOLS)), _duplicate_lines(text), repeat_words, failed, good and not failed, span_words, top))
    return out


def _batches(pieces, size_of):
    """Joins lists of rows until they hold WORDS_AT_ONCE words or so."""
    held, size = [], 0
    for rows in pieces:
        for row in rows:
            held.append(row)
            size += size_of(row)
            if size >= WORDS_AT_ONCE * 6:
                yield held
                held, size = [], 0
    if held:
        yield held


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"]


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each row of docs: doc_id, the base figures, base_failed, kept, covered_words and longest_repeat."""

    def run(batches):
        known = WordHashes()
        for rows in _batches(rows_of(batches, "doc_id", "text"), lambda r: len(r[1] or "") + 1):
            cols = list(zip(*_judge(rows, rules, known), strict=True))
            kinds = [pa.bool_() if name in ("base_failed", "kept") else pa.int64() for name in RESULT]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *RESULT])

    schema = "doc_id long, " + ", ".join(f"{name} {'boolean' if name in ('base_failed', 'kept') else 'long'}" for name in RESULT)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs less the rows that the rules reject, with all their columns."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                kept = [row[RESULT.index("kept")] for row in _judge([(None, text) for text in part.column("text").to_pylist()], rules, known)]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
