"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference-count tables.

An index has two tables. ``refs`` holds, for every line key, in how many documents it occurs. ``filters`` holds for every
shard of the key space a cuckoo filter over the shard's keys. When documents are added, keys that the filter has never
seen go into ``refs`` as they are; only the others are added up with ``refs``. Keys that ``refs`` lacked are inserted into the filter even if it answered
"maybe": each lower half of a live key owns a mark, and takes out its own only. When documents are taken away, counts go down, and
keys that nobody refers to any more leave both tables, which a Bloom filter could not do. A filter that gets full is made anew from its shard's keys, and the
shards are dealt anew when there are too many keys for them.

Lines are looked up through filters too, over the keys that enough documents have: every line of every document asks its shard's filter, and
only lines that the filter may know are joined with the exact counts. A shard is given to as many tasks as its lines need, so that a line of very many
documents is spread.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased, as a 128-bit hash. Lines with a
key shorter than ``min_chars`` code points have none and always stay.

Defined results: null and empty text are one empty line. Every row counts as a document of its own, so a repeated row
adds to the counts of its lines. Rows with a null doc_id are told apart by their text. Empty tables give
empty results. Other columns are not looked at, and ``dedup_lines`` returns them as they are, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ddl, mix, rows_of, staged

KEYS_PER_SHARD = 500_000
#: Lines that a task looks up in a shard's filter.
LINES_AT_ONCE = 1_000_000
SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key can be taken out again. add() and discard() take many keys at once."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        size = 1 << max(1, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.85)))))
        return cls(np.zeros((size, SLOTS), np.uint16))

    @classmethod
    def of_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.buckets.tobytes()

    def _marks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        return np.where(mark == 0, np.uint16(1), mark), (h % np.uint64(len(self.buckets))).astype(np.int64)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ (mix(mark.astype(np.uint64)) % np.uint64(len(self.buckets))).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, at = self._marks(keys)
        return ((self.buckets[at] == mark[:, None]) | (self.buckets[self._other(at, mark)] == mark[:, None])).any(axis=1)

    def _place(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts marks into free slots of their buckets; true where there was one."""
        order = np.argsort(at, kind="stable")
        spot = at[order]
        rank = np.arange(len(spot)) - np.searchsorted(spot, spot)
        free = self.buckets[spot] == 0
        fits = rank < free.sum(axis=1)
        # the rank-th free slot of the bucket
        slot = (np.cumsum(free, axis=1) == (rank + 1)[:, None]).argmax(axis=1)
        self.buckets[spot[fits], slot[fits]] = mark[order][fits]
        done = np.zeros(len(at), bool)
        done[order[fits]] = True
        return done

    def add(self, keys: np.ndarray) -> bool:
        """Adds distinct keys; false if the filter is too full, when it must be made anew with more buckets."""
        mark, at = self._marks(keys)
        chance = np.random.default_rng(len(keys))
        for kick in range(500):
            left = ~self._place(at, mark)
            mark, at = mark[left], at[left]
            if not len(mark):
                return True
            at = self._other(at, mark)
            if kick % 2:  # both buckets were full: change places with one that is there, one newcomer a bucket
                _, first = np.unique(at, return_index=True)
                slot = chance.integers(0, SLOTS, len(first))
                out = self.buckets[at[first], slot].copy()
                self.buckets[at[first], slot] = mark[first]
                there = at[first]
                mark[first], at[first] = out, self._other(there, out)
                empty = mark == 0
                mark, at = mark[~empty], at[~empty]
        return False

    def discard(self, keys: np.ndarray) -> None:
        """Takes out keys that are known to be in."""
        for mark, at in zip(*self._marks(keys), strict=True):
            for spot in (at, self._other(np.array([at]), np.array([mark]))[0]):
                hit = np.flatnonzero(self.buckets[spot] == mark)
                if len(hit):
                    self.buckets[spot, hit[0]] = 0
                    break


@dataclass
class LineIndex:
    """refs: (shard, hi, lo, n_docs); filters: (shard, cuckoo)."""

    refs: DataFrame
    filters: DataFrame | None  # None: only counts are asked for
    shards: int


def line_key(line: bytes, min_chars: int) -> bytes | None:
    line = line.strip().lower()
    if len(line) < min_chars or min_chars > 1 and len(line.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line)


def _lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _row() -> Column:
    """What lines to drop are gathered by: the doc_id, or where it is null the text's hash. Rows that share it share only lines that all documents lose."""
    return F.coalesce("doc_id", F.xxhash64("text")).alias("row")


def document_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(row, hi, lo): the distinct line keys of every row."""

    def run(batches):
        for rows in rows_of(batches, "row", "text"):
            ids, keys = [], []
            for row, text in rows:
                own = {k for line in _lines_of(text) if (k := line_key(line, min_chars))}
                ids += [row] * len(own)
                keys += own
            both = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["row", "hi", "lo"])

    return docs.select(_row(), "text").mapInArrow(run, "row long, hi long, lo long")


def _counted(keys: DataFrame, shards: int) -> DataFrame:
    return keys.groupBy("hi", "lo").agg(F.count("*").alias("n_docs")).withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))


def _filters(refs: DataFrame) -> DataFrame:
    """One cuckoo filter a shard; a shard has a bounded number of keys, as the number of shards follows the keys."""

    def build(key, table):
        keys = np.unique(table["lo"].to_numpy().astype(np.uint64))
        size = len(keys)
        while not (cuckoo := CuckooFilter.for_keys(size)).add(keys):
            size *= 2
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cuckoo": pa.array([cuckoo.to_bytes()], pa.binary())})

    return refs.select("shard", "lo").groupBy("shard").applyInArrow(build, "shard int, cuckoo binary")


def build_index(docs: DataFrame, min_chars: int = 1) -> LineIndex:
    """An index of docs' lines."""
    return index_of_keys(document_keys(docs, min_chars))


def index_of_keys(keys: DataFrame) -> LineIndex:
    index = counts_of_keys(keys)
    return LineIndex(index.refs, staged(_filters(index.refs), "line-filters"), index.shards)


def counts_of_keys(keys: DataFrame) -> LineIndex:
    """An index without filters, which look-ups of lines make for themselves from the keys that many documents have."""
    counts = staged(keys.groupBy("hi", "lo").agg(F.count("*").alias("n_docs")), "line-counts")
    shards = 1 + counts.count() // KEYS_PER_SHARD
    refs = counts.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return LineIndex(refs, None, shards)


def maybe_known(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """keys (shard, part, hi, lo, ...) with ``maybe``: false where the shard's filter, of filters (shard, part, cuckoo), is certain to lack the key."""
    names = keys.columns

    def probe(key, left, right):
        lo = left["lo"].to_numpy().astype(np.uint64)
        known = np.zeros(len(lo), bool)
        for data in right["cuckoo"].to_pylist():
            known |= CuckooFilter.of_bytes(data).has(lo)
        return left.select(names).append_column("maybe", pa.array(known))

    schema = ddl(keys.schema) + ", maybe boolean"
    return keys.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInArrow(probe, schema)


def add_documents(index: LineIndex, docs: DataFrame, min_chars: int = 1) -> LineIndex:
    """The index after docs came in. Keys that the filters don't know need no look at the old counts; those that turn out new all get marks of their own."""
    whole = F.lit(0).alias("part")
    new = staged(maybe_known(_counted(document_keys(docs, min_chars), index.shards).select("*", whole), index.filters.select("*", whole)).drop("part"), "line-new")
    known = new.where("maybe").drop("maybe")
    fresh = new.where("not maybe").drop("maybe")
    merged = index.refs.unionByName(known).groupBy("shard", "hi", "lo").agg(F.sum("n_docs").alias("n_docs"))
    refs = staged(merged.unionByName(fresh), "line-refs")
    shards = 1 + refs.count() // KEYS_PER_SHARD
    if shards > 2 * index.shards:
        refs = refs.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
        return LineIndex(refs, staged(_filters(refs), "line-filters"), shards)

    def insert(key, filters, keys):
        lo = np.unique(keys["lo"].to_numpy().astype(np.uint64))
        cuckoo = CuckooFilter.of_bytes(filters["cuckoo"][0].as_py()) if filters.num_rows else CuckooFilter.for_keys(len(lo))
        data = cuckoo.to_bytes() if cuckoo.add(lo) else None  # null: too full
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cuckoo": pa.array([data], pa.binary())})

    # lower halves that the table had not: those that the filter lacks, and its false positives; keys with an equal lower half share a mark
    lower = index.refs.select("shard", "lo").distinct()
    unmarked = fresh.select("shard", "lo").unionByName(known.select("shard", "lo").join(lower, ["shard", "lo"], "left_anti"))
    inserted = staged(index.filters.groupBy("shard").cogroup(unmarked.groupBy("shard")).applyInArrow(insert, "shard int, cuckoo binary"), "line-inserted")
    full = inserted.where("cuckoo is null").select("shard")
    filters = inserted.where("cuckoo is not null").unionByName(_filters(refs.join(full, "shard", "left_semi")))
    return LineIndex(refs, staged(filters, "line-filters"), index.shards)


def delete_documents(index: LineIndex, docs: DataFrame, min_chars: int = 1) -> LineIndex:
    """The index after docs, which are in it, went out. Keys without documents leave the table and the filters."""
    gone = _counted(document_keys(docs, min_chars), index.shards).withColumn("n_docs", -F.col("n_docs"))
    counts = staged(index.refs.unionByName(gone).groupBy("shard", "hi", "lo").agg(F.sum("n_docs").alias("n_docs")), "line-refs")

    def take_out(key, filters, dead):
        if not filters.num_rows:
            return filters
        cuckoo = CuckooFilter.of_bytes(filters["cuckoo"][0].as_py())
        cuckoo.discard(np.unique(dead["lo"].to_numpy().astype(np.uint64)))
        return pa.table({"shard": filters["shard"], "cuckoo": pa.array([cuckoo.to_bytes()], pa.binary())})

    # one mark stands for all keys with the same low half: it goes with the last of them
    dead = counts.groupBy("shard", "lo").agg(F.max("n_docs").alias("most")).where("most <= 0").select("shard", "lo")
    filters = index.filters.groupBy("shard").cogroup(dead.groupBy("shard")).applyInArrow(take_out, "shard int, cuckoo binary")
    return LineIndex(counts.where("n_docs > 0"), staged(filters, "line-filters"), index.shards)


def _repeated_keys(keys: DataFrame, index: LineIndex, min_docs: int) -> DataFrame:
    """(row, gone): the keys of each row that at least min_docs documents have."""
    often = staged(index.refs.where(F.col("n_docs") >= min_docs), "line-often")
    # a shard is given to as many tasks as its lines need; counts are of all lines, or more where the index has more documents
    parts = often.groupBy("shard").agg(F.ceil(F.sum("n_docs") / F.lit(LINES_AT_ONCE)).cast("int").alias("parts"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    filters = _filters(often).join(parts, "shard").select("shard", "cuckoo", every)
    asked = keys.withColumn("shard", F.pmod("hi", F.lit(index.shards)).cast("int")).join(F.broadcast(parts), "shard")  # a row for each KEYS_PER_SHARD keys
    asked = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    maybe = maybe_known(asked, filters).where("maybe").select("row", "hi", "lo", "part")
    exact = often.join(parts, "shard").select("hi", "lo", every)
    return maybe.join(exact, ["hi", "lo", "part"]).groupBy("row").agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))


def _with_drops(docs: DataFrame, index: LineIndex | None, min_docs: int, min_chars: int, out: str, build) -> DataFrame:
    """What build makes of (whole, gone): each row as a struct and the keys of the lines to drop."""
    keys = staged(document_keys(docs, min_chars), "line-keys")
    drops = _repeated_keys(keys, index or counts_of_keys(keys), min_docs)
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("whole"), _row())
    return whole.join(drops, "row", "left").select("whole", "gone").mapInArrow(build, out)


def _parts(batches):
    """Slices of batches of (whole, gone): the columns of whole, and gone as a list."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part.column("whole").flatten(), part.column("gone").to_pylist()


def _kept(text: str | None, drop, min_chars: int) -> tuple[int, list[bytes]]:
    lines = _lines_of(text)
    if not drop:
        return len(lines), lines
    dropped = {x["hi"].to_bytes(8, "big", signed=True) + x["lo"].to_bytes(8, "big", signed=True) for x in drop}
    return len(lines), [line for line in lines if line_key(line, min_chars) not in dropped]


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with ``text`` less every line whose key at least min_docs documents have; null text stays null.

    index: what to count in, if it is more than docs. Every other column stays.
    """
    names = docs.columns
    at = names.index("text")

    def build(batches):
        for cols, gone in _parts(batches):
            texts = [None if text is None else b"\n".join(_kept(text, keys, min_chars)[1]).decode() for text, keys in zip(cols[at].to_pylist(), gone, strict=True)]
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return _with_drops(docs, index, min_docs, min_chars, ddl(docs.schema), build)


def line_dedup_digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row of docs."""

    def build(batches):
        for (ids, texts), gone in _parts(batches):
            out = []
            for text, keys in zip(texts.to_pylist(), gone, strict=True):
                n, kept = _kept(text, keys, min_chars)
                out.append((n, n - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
            n, dropped, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _with_drops(docs.select("doc_id", "text"), None, min_docs, min_chars, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", build)
