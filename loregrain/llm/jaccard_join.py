"""Exact Jaccard join on word n-grams, size-aware: light sets enumerate subsets of a fixed size, heavy ones scan inverted lists.

Light sets. Two sets of n and m shingles are linked exactly if they share at least c(n, m) of them, so they share a subset of
that size. Sets of up to ``boundary`` shingles list all their subsets of the sizes that a partner of up to that size may ask for.

Heavy sets. Of n shingles in an order that all sets have in common, a linked pair has one among each set's first
n - smallest(n) + 1, where smallest(n) is the least size of a partner. Each set stands in the inverted lists of those shingles. The order puts
shingles that many sets have at the end, so that shared passages make no long lists; any order finds all pairs. Shingles are
counted over all different sets, in tasks first, where fewer than ``OFTEN`` in a task's part go uncounted; the ``HOT`` most frequent ones are broadcast.

The boundary is where enumerating a set's subsets begins to cost more than standing in lists and being compared with those met there. How
many are met is measured on all sets while shingles are counted.

Equal sets are one class and are joined as one. The members of a list are tied together where their sizes and sketches, counts of
shingles by bucket, allow a link, or all of them in lists too long for that; families, the components of those ties, are then scanned exactly: breadth first, a set at a time against all sets of its family that no link has reached
yet, so a group of copies takes a few scans and not all its pairs. A family of more than ``FAMILY`` shingles is dealt into blocks and
each pair of blocks is scanned by a task of its own.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Defined results: a text with fewer words than a shingle has its whole
sequence as one; null texts and texts without words have an empty set and no links. A row with a null doc_id links with
nothing and has a null component. Rows that repeat a doc_id are one node with all their links. Empty tables give empty results. Other columns are
not read by ``jaccard_components``; ``one_of_each`` keeps them.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, WordHashes, components, groups_of, mix, rows_of, shingle_hashes, staged

FAMILY = 2_000_000
#: Sets in a list from which on they are tied together unseen.
CROWD = 20_000
#: Shingles that stand last in the common order, at most; a bound of 4 MB on what is broadcast.
HOT = 1 << 18
#: How often a shingle is in the different sets of a task's part for it to be counted.
OFTEN = 4
#: Shingles that a task counts at once.
COUNTED = 2_000_000
#: What comparing two sets of a list costs, in rows of lists.
COMPARE = 3


@dataclass(frozen=True)
class Likeness:
    """words: of a shingle; percent: of the union that two linked sets share at least."""

    words: int = 4
    percent: int = 85

    def shared(self, n: int, m: int) -> int:
        """The least intersection of linked sets of n and m."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def differ(self, n: int, m: int) -> int:
        return n + m - 2 * self.shared(n, m)

    def largest(self, n: int) -> int:
        """The largest set that a set of n can be linked with."""
        return n * 100 // self.percent

    def smallest(self, n: int) -> int:
        return -(-n * self.percent // 100)

    def subset_sizes(self, n: int, most: int) -> list[int]:
        return sorted({self.shared(n, m) for m in range(self.smallest(n), min(self.largest(n), most) + 1)})

    def listed(self, n: int) -> int:
        """In how many inverted lists a set of n stands."""
        return n - self.smallest(n) + 1

    def boundary(self, met: float) -> int:
        """The largest n up to which enumerating subsets costs no more than standing in lists, with met other sets in each."""
        n = 1
        while sum(math.comb(n + 1, c) for c in self.subset_sizes(n + 1, self.largest(n + 1))) <= self.listed(n + 1) * (1 + COMPARE * met):
            n += 1
        return n


class Signatures:
    """The keys under which a set stands in lists. hot: frequent shingles, the least frequent first."""

    def __init__(self, like: Likeness, light: int, hot: np.ndarray = np.empty(0, np.uint64)):
        self.like, self.light = like, light
        self.rank = np.argsort(hot, kind="stable")
        self.hot = hot[self.rank]

    def _first(self, s: np.ndarray, n: int) -> np.ndarray:
        """The first n shingles of s, which is sorted, in the common order."""
        if not len(self.hot):
            return s[:n]
        at = np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)
        hot = self.hot[at] == s
        out = s[~hot][:n]
        if len(out) < n:
            out = np.r_[out, s[hot][np.argsort(self.rank[at[hot]])[: n - len(out)]]]
        return out

    def of(self, s: np.ndarray) -> np.ndarray:
        n, like = len(s), self.like
        out = []
        if n <= self.light:
            h = mix(s)
            for c in like.subset_sizes(n, self.light):
                left_out = np.array(list(combinations(range(n), n - c)), np.int64).reshape(math.comb(n, c), n - c)
                out.append(mix(np.full(len(left_out), h.sum()) - h[left_out].sum(axis=1, dtype=np.uint64) + np.uint64(c)))
        if like.largest(n) > self.light:
            out.append(self._first(s, like.listed(n)))
        return np.concatenate(out)


def _sets(texts, words: int, known: WordHashes):
    for text in texts:
        yield shingle_hashes(known.of((text or "").encode().translate(LOWER_ASCII).split()), words)


def sketch(s: np.ndarray) -> bytes:
    """How many shingles fall into each of about n / 8 buckets. Sets differ in at least as many shingles as their sketches do."""
    buckets = 8
    while buckets * 8 < len(s):
        buckets *= 2
    counts = np.bincount((mix(s) >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


class Sketches:
    """The sketches of a list's sets, compared at the width that the narrower one of a pair has."""

    def __init__(self, sketches: list[bytes]):
        self.sketches = sketches
        self.width = np.array([len(x) for x in sketches])
        self.folds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the sets that have so many buckets or more, folded to it, and each set's row."""
        if width not in self.folds:
            own = np.flatnonzero(self.width >= width)
            row = np.full(len(self.width), -1)
            row[own] = np.arange(len(own))
            kind = np.int16 if int(self.width.max()) // width < 128 else np.int32
            self.folds[width] = np.stack([np.frombuffer(self.sketches[i], np.uint8).reshape(-1, width).sum(axis=0, dtype=kind) for i in own.tolist()]), row
        return self.folds[width]

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """In how many shingles, at least, each of others differs from set i."""
        out = np.empty(len(others), np.int64)
        widths = np.minimum(self.width[others], self.width[i])
        for width in np.unique(widths).tolist():
            own = widths == width
            rows, row = self._at(width)
            out[own] = np.abs(rows[row[others[own]]] - rows[row[i]]).sum(axis=1, dtype=np.int64)
        return out


SIZE_ROWS = "doc_id long, n long, k1 long, k2 long, sketch binary, shingle long, times long, met double"


def _sizes(docs: DataFrame, like: Likeness) -> DataFrame:
    """Of each row its doc_id and its set's n, 128-bit hash and sketch; and, with null n, of each task's parts the times that frequent shingles
    have, and one row with the number of sets as n negated, the shingles as times and how many others a shingle meets on average."""
    names, kinds = zip(*((x.split()[0], {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[x.split()[1]]) for x in SIZE_ROWS.split(", ")), strict=True)

    def batch(**cols) -> pa.RecordBatch:
        size = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names)

    def counted(held: list[np.ndarray]):
        shingle, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= OFTEN
        yield batch(shingle=shingle[often].view(np.int64), times=times[often])
        cold = times[~often]
        yield batch(n=[-len(held)], times=[int(cold.sum())], met=[float((cold * (cold - 1)).sum())])

    def run(batches):
        known, seen, held, size = WordHashes(), set(), [], 0
        for rows in rows_of(batches, "doc_id", "text"):
            out = []
            for (doc_id, _), s in zip(rows, _sets([t for _, t in rows], like.words, known), strict=True):
                key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                out.append((doc_id, len(s), int(key[0]), int(key[1]), sketch(s)))
                if len(s) and key[0] not in seen:
                    seen.add(key[0])
                    held.append(s)
                    size += len(s)
            yield batch(**dict(zip(names, zip(*out, strict=True), strict=False)))
            if size > COUNTED:
                yield from counted(held)
                held, size = [], 0
                if len(seen) > 1_000_000:
                    seen.clear()
        if held:
            yield from counted(held)

    return docs.select("doc_id", "text").mapInArrow(run, SIZE_ROWS)


def _order(sizes: DataFrame, like: Likeness) -> tuple[int, np.ndarray]:
    """The boundary, and the frequent shingles with the least frequent first."""
    often = sizes.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    hot = [r["shingle"] for r in often.orderBy(F.desc("times"), "shingle").limit(HOT).collect()]
    # a part of so many sets meets its share of what all of them would
    part = sizes.where("n < 0").agg(F.sum(-F.col("n")).alias("sets"), F.sum("times").alias("shingles"), F.sum("met").alias("met"), F.count("*").alias("parts")).first()
    met = part["met"] / max(1, part["shingles"]) * part["parts"] if part["parts"] else 0.0
    return like.boundary(met), np.array(hot[::-1], np.int64).view(np.uint64)


LIST_ROWS = "sig long, a long, b long"


def _batch(sig, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())], ["sig", "a", "b"])


def _chained(sigs: list[np.ndarray], keys: list[np.ndarray]) -> list[pa.RecordBatch]:
    """A task's part of the lists. Of a list with more than ``CROWD`` of its sets only the first goes on (b is null); edges (a, b) tie the others to it."""
    sig, key = np.concatenate(sigs).view(np.int64), np.concatenate(keys)
    order = np.argsort(sig, kind="stable")
    sig, key = sig[order], key[order]
    first = np.r_[True, sig[1:] != sig[:-1]]
    part = np.cumsum(first) - 1
    tied = ~first & (np.bincount(part)[part] > CROWD)
    edges = np.unique(np.c_[key[first][part][tied], key[tied]], axis=0)
    return [_batch(sig[~tied], key[~tied], None), _batch(edges[:, 0], edges[:, 0], edges[:, 1])]


def _listed(docs: DataFrame, like: Likeness, light: int, hot: np.ndarray) -> DataFrame:
    """What each task found for the lists, chained already: a list gets a row from each task at most a million keys."""
    shipped = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        known, signatures, seen = WordHashes(), Signatures(like, light, shipped.value), set()
        sigs, keys, held = [], [], 0
        for rows in rows_of(batches, "text"):
            for s in _sets([t for (t,) in rows], like.words, known):
                if not len(s):
                    continue
                key = int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0])
                if key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                own = signatures.of(s)
                sigs.append(own)
                keys.append(np.full(len(own), key))
                held += len(own)
            if held > 1_000_000:
                yield from _chained(sigs, keys)
                sigs, keys, held = [], [], 0
        if held:
            yield from _chained(sigs, keys)

    return docs.where("doc_id is not null").select("text").mapInArrow(run, LIST_ROWS)


def _shared_lists(listed: DataFrame) -> DataFrame:
    """(list, a, b): the members of each different list of two sets or more, or where b is not null, edges.

    Lists are read as a stream. Those with equal members are the same list. One of more than ``CROWD`` sets is tied together by edges.
    """

    def run(batches):
        seen: set[int] = set()
        sig, key = np.empty(0, np.int64), np.empty(0, np.int64)

        def lists(sig, key):
            cut = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True])
            size = np.diff(cut)
            for start, n in zip(cut[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
                own = np.unique(key[start : start + n])
                if len(own) > CROWD:
                    yield np.zeros(len(own) - 1, np.int64), np.full(len(own) - 1, own[0]), own[1:]
                elif len(own) > 1:
                    name = int(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)[0])
                    if name not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(name)
                        yield np.full(len(own), name), own, None

        def batch(found):
            plain, edges = [x for x in found if x[2] is None], [x for x in found if x[2] is not None]
            for some in (plain, edges):
                if some:
                    name, a, b = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(name)), pa.array(np.concatenate(a)), pa.nulls(sum(map(len, a)), pa.int64()) if b[0] is None else pa.array(np.concatenate(b))], ["list", "a", "b"])

        for new in batches:
            edges = new.filter(new.column("b").is_valid())
            if edges.num_rows:
                yield pa.RecordBatch.from_arrays(edges.columns, ["list", "a", "b"])
            new = new.filter(new.column("b").is_null())
            if not new.num_rows:
                continue
            sig, key = np.r_[sig, new.column("sig").to_numpy()], np.r_[key, new.column("a").to_numpy()]
            open_ = int(np.searchsorted(sig, sig[-1]))
            yield from batch(list(lists(sig[:open_], key[:open_])))
            sig, key = sig[open_:], key[open_:]
            if len(sig) > 10 * CROWD:  # a list without end: what came so far is tied together
                yield pa.RecordBatch.from_arrays([pa.array(sig[1:]), pa.array(np.full(len(key) - 1, key[0])), pa.array(key[1:])], ["list", "a", "b"])
                sig, key = sig[:1], key[:1]
        if len(sig):
            yield from batch(list(lists(sig, key)))

    return listed.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "list long, a long, b long")


def _chains(shared: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Edges (a, b) that tie together the sets of each list which may be linked by their sizes and sketches."""
    members = shared.where("b is null").select("list", "a").distinct()
    sketched = members.join(classes.select(F.col("k1").alias("a"), "n", "sketch"), "a").select("list", "a", "n", "sketch")

    def run(batches):
        for table in groups_of(batches, "list", 4096):
            name, a, n = (table[c].to_numpy() for c in ("list", "a", "n"))
            sketches = table["sketch"].to_pylist()
            cut = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True])
            out = []
            for start, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if end - start < 2:
                    continue
                near_by, size = Sketches(sketches[start:end]), n[start:end]
                left = np.arange(1, end - start)
                queue = [0]
                while len(left):
                    if not queue:
                        queue.append(int(left[0]))
                        left = left[1:]
                        continue
                    i = queue.pop()
                    some = np.flatnonzero((100 * size[left] >= like.percent * size[i]) & (like.percent * size[left] <= 100 * size[i]))
                    both = size[left[some]] + size[i]
                    near = some[near_by.apart(i, left[some]) <= both - 2 * -(-like.percent * both // (100 + like.percent))]
                    out += [(a[start + i], a[start + j]) for j in left[near].tolist()]
                    queue += left[near].tolist()
                    left = np.delete(left, near)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    edges = sketched.repartition("list").sortWithinPartitions("list").mapInArrow(run, "a long, b long")
    return edges.unionByName(shared.where("b is not null").select("a", "b")).distinct()


def _scan(sets: list[np.ndarray], mine: np.ndarray, both: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with both, of those between sets that differ in mine."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(size)]
    flag = np.zeros(int(flat.max()) + 1, bool)
    left = np.ones(n, bool)
    links, queue = [], []
    ids = np.arange(n)
    while left.any():
        if not queue:
            queue.append(int(np.argmax(left)))
            left[queue[0]] = False
        i = queue.pop()
        rest = ids[left & (100 * size >= percent * size[i]) & (percent * size <= 100 * size[i])]
        if both:
            rest = rest[mine[rest] != mine[i]]
        if not len(rest):
            continue
        own = flat[start[i] : start[i + 1]]
        flag[own] = True
        lengths = size[rest]
        begin = np.r_[0, np.cumsum(lengths)[:-1]]
        where = np.arange(int(lengths.sum())) - np.repeat(begin - start[rest], lengths)
        shared = np.add.reduceat(flag[flat[where]].astype(np.int64), begin)
        flag[own] = False
        near = rest[100 * shared >= percent * (size[i] + lengths - shared)]
        left[near] = False
        links += [(i, j) for j in near.tolist()]
        queue += near.tolist()
    return links


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text of each row that has both."""

    def run(batches):
        for rows in rows_of(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([zlib.compress(t.encode(), 3) for _, t in rows], pa.binary())], ["doc_id", "packed"])

    return docs.select("doc_id", "text").where("doc_id is not null and text <> ''").mapInArrow(run, "doc_id long, packed binary")


def _links(docs: DataFrame, members: DataFrame, like: Likeness) -> DataFrame:
    """Spanning links (a, b) between the doc_ids of members (doc_id, k1, n, family)."""
    weight = members.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(FAMILY)).cast("int").alias("blocks"))
    own = members.join(weight, "family").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # a set of a family in blocks goes to all pairs of its block with another
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    # merged at every size: neither ids nor texts are broadcast
    texts = _packed(docs).join(own.select("doc_id", "k1", "family", "block", "blocks").hint("merge"), "doc_id").withColumn("pair", F.explode(pair))
    texts = texts.withColumn("task", F.xxhash64("family", "pair.i", "pair.j")).withColumn("whole", F.col("pair.i") == F.col("pair.j"))

    def run(batches):
        known = WordHashes()
        for table in groups_of(batches, "task"):
            sets, ids, blocks, seen = [], [], [], set()
            cols = (table[c].to_pylist() for c in ("doc_id", "k1", "block", "packed"))
            for doc_id, k1, block, packed in zip(*cols, strict=True):
                if (doc_id, k1) in seen:
                    continue
                (s,) = _sets([zlib.decompress(packed).decode()], like.words, known)
                if int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0]) == k1:  # else another row of the same doc_id
                    seen.add((doc_id, k1))
                    sets.append(s)
                    ids.append(doc_id)
                    blocks.append(block)
            if len(sets) > 1:
                links = _scan(sets, np.array(blocks), not table["whole"][0].as_py(), like.percent)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links], pa.int64()), pa.array([ids[j] for _, j in links], pa.int64())], ["a", "b"])

    return texts.repartition("task").sortWithinPartitions("task").select("task", "doc_id", "k1", "block", "whole", "packed").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the least doc_id that it reaches by links, itself included."""
    found = staged(_sizes(docs, like), "jaccard-sizes")
    sizes = found.where("n >= 0")
    light, hot = _order(found, like)
    full = sizes.where("n > 0 and doc_id is not null")
    classes = staged(full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "jaccard-classes")
    shared = staged(_shared_lists(_listed(docs, like, light, hot)), "jaccard-lists")
    families = components(_chains(shared, classes, like))
    members = classes.join(families, classes["k1"] == families["node"]).select(F.col("rep").alias("doc_id"), "k1", "n", F.col("component").alias("family"))
    links = _links(docs, staged(members, "jaccard-members"), like)
    # equal sets hang on their class's least row
    equal = full.join(classes, ["k1", "k2", "n"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    reached = components(links.unionByName(equal)).withColumnRenamed("node", "doc_id")
    return sizes.join(reached, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, like: Likeness = Likeness(5, 80)) -> DataFrame:
    """docs less all rows but one of each component; rows with a null doc_id or without words stay."""
    gone = jaccard_components(docs, like).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
