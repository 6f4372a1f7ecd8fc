"""Source divergence audit: how far the word shares of each (lang, source) group lie from each other and from their language.

Words are counted inside tasks, a task's groups and words together, and meet in one shuffle by (lang, term). What is kept is cut into
vocabulary chunks; a group's counts within a chunk are a packed vector. Groups are dealt to blocks, and each pair of blocks is a tile: it
gets the vectors of both blocks, chunk after chunk, and sums its pairs' differences in a matrix of block x block. Neither a language's
vocabulary nor its groups are ever in one task together; very large vocabularies are cut into slabs of chunks, whose sums Spark adds.

All arithmetic is on whole numbers. Defined results: null text, lang and source are ''; each row is a document, repeated rows too; a
language without kept terms has pairs of value 0; a language with one source has no pairs; texts of any length are counted whole; an
empty table gives no rows; other columns are ignored and may have any name.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, staged

#: Bytes of terms: letters, lower-cased if A-Z, and all of UTF-8 beyond ASCII; every other byte is a space.
TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in LOWER_ASCII)
#: Counts that a task holds before it hands them on.
HELD = 300_000
#: Kept terms of a chunk on average, chunks of a slab, and groups of a block on average.
CHUNK, SLAB, BLOCK = 1024, 256, 64
#: Shares are in parts of this, with so much added to every count.
PARTS, ADDED = 1_000_000_000, 5


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of occurrences and documents; a row with null term for each group that a task has met."""

    def rows(n: dict, d: dict):
        for (lang, source), own in n.items():
            docs_of = d[lang, source]
            terms = [None, *own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array([0, *own.values()], pa.int64()), pa.array([0, *(docs_of[t] for t in own)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )

    def run(batches):
        n, d, held = {}, {}, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                key = lang.as_py(), source.as_py()
                if key not in n:
                    n[key], d[key] = Counter(), Counter()
                words = text.as_py().encode().translate(TERM_BYTES).split()
                own, before = n[key], len(n[key])
                own.update(words)
                d[key].update(set(words))
                held += len(own) - before
                if held > HELD:
                    yield from rows(n, d)
                    n, d, held = {}, {}, 0
        yield from rows(n, d)

    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return text.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Counts of terms that enough documents of their language have, (lang, source, term, n, lang_n, first), and all groups (lang, source).

    lang_n: the term's count in the language; first: true for one row of each (lang, term).
    """
    whole = Window.partitionBy("lang", "term")
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    seen = counts.withColumn("df", F.sum("docs").over(whole)).withColumn("lang_n", F.sum("n").over(whole)).withColumn("first", F.min("source").over(whole) == F.col("source"))
    both = staged(seen.where((F.col("df") >= least) | F.col("term").isNull()).drop("docs", "df"), "divergence-counts")
    return both.where("term is not null"), both.where("term is null").select("lang", "source")


def share(count: str, total: str, terms: str):
    """1 + floor(PARTS * (count + ADDED) / (total + ADDED * terms)), by decimals wide enough for any long."""
    return F.expr(f"1 + ({PARTS} * (cast({count} as decimal(20,0)) + {ADDED})) div (cast({total} as decimal(20,0)) + {ADDED} * cast({terms} as decimal(20,0)))")


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same for rows of counts and each row's total + ADDED * terms, by long division: three digits at a time stay within 64 bits."""
    wide = int(whole.max(initial=0)) >= 1 << 53
    whole = np.maximum(whole, 1)[:, None].astype(object if wide else np.int64)
    rest = counts.astype(whole.dtype) + ADDED
    q, rest = rest // whole, rest % whole
    for _ in range(3):
        q, rest = q * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return (1 + q).astype(np.int64)


class Tile:
    """The pairs of two blocks, or of one with itself, over the chunks of a slab."""

    def __init__(self, key: tuple, left: dict, right: dict, width: int):
        self.key, self.sides = key, [left] if key[1] == key[2] else [left, right]
        self.names = [list(s) for s in self.sides]
        self.at = [{name: i for i, name in enumerate(s)} for s in self.sides]
        self.whole = [np.array(list(s.values()), object if any(v >= 1 << 62 for v in s.values()) else np.int64) for s in self.sides]
        self.left_over = width  # terms of the slab in which no group of the tile has a count
        self.sums = np.zeros((len(left), len(self.names[-1])), np.int64)
        self.counts: list[np.ndarray] | None = None

    def begin(self, width: int) -> None:
        self.end()
        self.left_over -= width
        self.counts = [np.zeros((len(s), width), np.int64) for s in self.sides]

    def put(self, side: int, source: str, cols: np.ndarray, n: np.ndarray) -> None:
        self.counts[side][self.at[side][source], cols] = n

    def _add(self, counts: list[np.ndarray], times: int = 1) -> None:
        p = [shares(c, w) for c, w in zip(counts, self.whole, strict=True)]
        for i, row in enumerate(p[0]):
            self.sums[i] += np.abs(p[-1] - row).sum(axis=1) * times

    def end(self) -> None:
        if self.counts is not None:
            self._add(self.counts)
            self.counts = None

    def rows(self) -> pa.RecordBatch | None:
        self.end()
        if self.left_over:
            self._add([np.zeros((len(s), 1), np.int64) for s in self.sides], self.left_over)
        pairs = [(a, b, int(self.sums[i, j])) for i, a in enumerate(self.names[0]) for j, b in enumerate(self.names[-1]) if a != b]
        if len(self.sides) == 2:
            pairs += [(b, a, v) for a, b, v in pairs]
        if not pairs:
            return None
        source, item, value = zip(*pairs, strict=True)
        return pa.RecordBatch.from_pydict({"lang": pa.array([self.key[0]] * len(pairs)), "source": pa.array(source), "item": pa.array(item), "value": pa.array(value, pa.int64())})


def _tiles(batches):
    """Rows sorted by (lang, bi, bj, slab, chunk): of each tile its groups first, as chunk -1, then vectors."""
    tile, key, chunk, groups = None, None, None, ({}, {})
    for batch in batches:
        head = zip(*(batch.column(c).to_pylist() for c in ("lang", "bi", "bj", "slab", "chunk", "side", "source", "width", "whole")), strict=True)
        cols, ns = batch.column("cols"), batch.column("ns")
        for r, (lang, bi, bj, slab, own_chunk, side, source, width, whole) in enumerate(head):
            if key != (lang, bi, bj, slab):
                if key is not None and (out := (tile or Tile(key, *groups, slab_width)).rows()):
                    yield out
                key, tile, groups, slab_width = (lang, bi, bj, slab), None, ({}, {}), 0
            if own_chunk < 0:
                groups[side][source], slab_width = int(whole), width
                continue
            if tile is None:
                tile, chunk = Tile(key, *groups, slab_width), None
            if own_chunk != chunk:
                tile.begin(width)
                chunk = own_chunk
            tile.put(side, source, cols[r].values.to_numpy(), ns[r].values.to_numpy())
    if key is not None and (out := (tile or Tile(key, *groups, slab_width)).rows()):
        yield out


def pair_sums(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all pairs of sources of a language. groups: lang, source, total; langs: lang, terms, blocks, chunks."""
    with_chunk = kept.join(langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
    chunk = Window.partitionBy("lang", "chunk")
    placed = with_chunk.withColumn("col", F.dense_rank().over(chunk.orderBy("term")) - 1).withColumn("width", F.count_if("first").over(chunk))
    packed = placed.groupBy("lang", "chunk", "source").agg(F.max("width").cast("int").alias("width"), F.collect_list(F.struct("col", "n")).alias("v"))
    vectors = packed.select("lang", "source", F.floor(F.col("chunk") / SLAB).alias("slab"), "chunk", "width", F.lit(None).cast("decimal(38,0)").alias("whole"), F.col("v.col").alias("cols"), F.col("v.n").alias("ns"))
    slabs = with_chunk.where("first").groupBy("lang", F.floor(F.col("chunk") / SLAB).alias("slab")).agg(F.count("*").cast("int").alias("width"))
    # a language without kept terms has one slab of no width
    slabs = langs.select("lang", "terms").join(slabs, "lang", "left").select("lang", "terms", F.coalesce("slab", F.lit(0)).alias("slab"), F.coalesce("width", F.lit(0)).alias("width"))
    whole = (F.col("total").cast("decimal(38,0)") + F.lit(ADDED) * F.col("terms")).cast("decimal(38,0)")
    heads = groups.join(slabs, "lang").select(
        "lang", "source", "slab", F.lit(-1).cast("long").alias("chunk"), "width", whole.alias("whole"), F.array().cast("array<int>").alias("cols"), F.array().cast("array<bigint>").alias("ns")
    )
    rows = heads.unionByName(vectors).join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("source", F.lit(1)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tiled = rows.select("*", other.alias("other")).select(
        "lang", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "slab", "chunk", F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "source", "width", "whole", "cols", "ns"
    )
    tile = ["lang", "bi", "bj", "slab"]
    sums = tiled.repartition(*tile).sortWithinPartitions(*tile, "chunk").mapInArrow(_tiles, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = 30, most: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the distance of each group to the other sources of its language, part ``term`` the
    first ``most`` terms of which it has more than its language."""
    kept, groups = kept_counts(docs, least)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    vocabulary = kept.where("first").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    langs = staged(
        groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")).join(vocabulary, "lang", "left").select("lang", "blocks", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.greatest(F.lit(1), F.ceil(F.col("terms") / F.lit(CHUNK))).alias("chunks")),
        "divergence-langs",
    )
    pairs = pair_sums(kept, groups, langs).withColumn("part", F.lit("pair"))
    own = kept.join(groups, ["lang", "source"]).join(langs, "lang")
    above = (share("n", "total", "terms") - share("lang_n", "lang_total", "terms")).alias("value")
    terms = own.select("lang", "source", F.col("term").alias("item"), above).where("value > 0").withColumn("part", F.lit("term"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= most))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
