"""Clusters of sparse vectors: ``clustered`` for any number of small groups, in long form by rounds of joins and sums; ``large_clusters`` for large groups.

Weights are whole numbers in double columns, so sums are exact up to 2**53 and results don't depend on how rows are dealt. A group's first
centres are its different vectors whose ids hash lowest; a centre is the mean of its vectors, rounded to whole numbers, half up. Ties go to the lower cluster. A
cluster that loses all its vectors is gone. Each round is written to the shared folder.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.tables import opened, shared_folder, shuffles_removed, staged, unstaged
from .records import bounded_groups


def whole_weight(weight: Column) -> Column:
    """A weight in thousandths."""
    return F.round(weight * 1000, 0)


def unit_weights(weights: DataFrame) -> DataFrame:
    """(doc_id, term, w): the vectors of weights (doc_id, term, weight) at one length of a million, in whole numbers."""
    whole = weights.select("doc_id", "term", whole_weight(F.col("weight")).alias("w")).where("w > 0 and doc_id is not null")
    long = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return whole.select("doc_id", "term", F.floor(1_000_000 * F.col("w") / long + 0.5).cast("double").alias("w"))


UNIT_SQL = """SELECT doc_id, term, floor(1000000 * w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) + 0.5) AS w FROM (SELECT doc_id, term, round(weight * 1000) AS w FROM w) WHERE w > 0"""


def vector_digest(weights: DataFrame) -> DataFrame:
    """(grp, doc_id, s1, s2, n): sums over the terms of a vector that differ for different vectors, but for chance; nothing is gathered."""
    told = F.md5(F.concat_ws("=", "term", F.col("w").cast("long").cast("string")))
    part = lambda at: F.sum(F.conv(F.substring(told, at, 8), 16, 10).cast("long"))
    return weights.groupBy("grp", "doc_id").agg(part(1).alias("s1"), part(9).alias("s2"), F.count("*").alias("n"))


def first_centres(weights: DataFrame, most: int, by_group: bool = False) -> DataFrame:
    """(grp, doc_id, c): up to ``most`` different vectors of each group, numbered from 0. by_group: groups of the same documents choose others."""
    told = F.col("doc_id").cast("string")
    ids = vector_digest(weights).withColumn("h", F.md5(F.concat_ws(":", "grp", told) if by_group else told))
    one = ids.groupBy("grp", "s1", "s2", "n").agg(F.min(F.struct("h", "doc_id")).alias("r")).select("grp", "r.*")
    place = F.row_number().over(Window.partitionBy("grp").orderBy("h", "doc_id"))
    return one.withColumn("c", place - 1).where(F.col("c") < most).select("grp", "doc_id", "c")


def clustered(weights: DataFrame, docs: DataFrame, most: int, rounds: int, by_group: bool = False) -> DataFrame:
    """(grp, doc_id, cluster) for docs (grp, doc_id) by weights (grp, doc_id, term, w): up to ``most`` clusters a group, one for each different vector at most.

    Documents without weights go to the shortest centre; a group without any has one cluster, 0. Ends after ``rounds``, or when nothing changes.
    """
    weights = staged(weights.select("grp", "doc_id", "term", "w"), "cluster-weights")
    each, none = range(most), F.array_repeat(F.lit(0.0), most)
    member = staged(first_centres(weights, most, by_group), "cluster-centres")
    for _ in range(rounds):
        # sums and sizes by cluster, then centres, as one row for each term of a group and one for each group
        n = member.groupBy("grp").agg(F.array(*(F.count_if(F.col("c") == i) for i in each)).alias("n"))
        sums = weights.join(member, ["grp", "doc_id"]).groupBy("grp", "term").agg(F.array(*(F.sum(F.when(F.col("c") == i, F.col("w")).otherwise(0.0)) for i in each)).alias("s"))
        mean = F.zip_with("s", "n", lambda s, m: F.when(m > 0, F.floor((2 * s + m) / (2 * m)).cast("double")).otherwise(0.0))
        centres = staged(sums.join(n, "grp").select("grp", "term", mean.alias("m")), "cluster-centres")
        long = centres.groupBy("grp").agg(F.array(*(F.sum(F.col("m")[i] * F.col("m")[i]) for i in each)).alias("q"))
        lengths = n.join(long, "grp", "left").select("grp", F.zip_with("n", F.coalesce("q", none), lambda m, q: F.when(m > 0, q)).alias("q"))
        dots = weights.join(centres, ["grp", "term"]).groupBy("grp", "doc_id").agg(F.array(*(F.sum(F.col("w") * F.col("m")[i]) for i in each)).alias("d"))
        near = docs.select("grp", "doc_id").join(dots, ["grp", "doc_id"], "left").join(lengths, "grp", "left")
        score = F.zip_with("q", F.coalesce("d", none), lambda q, d: q - 2 * d)
        place = F.coalesce(F.array_position(score, F.array_min(score)) - 1, F.lit(0)).cast("int")
        moved = Observation()
        now = near.join(member.withColumnRenamed("c", "was"), ["grp", "doc_id"], "left").select("grp", "doc_id", place.alias("c"), "was")
        member = staged(now.observe(moved, F.count_if(~F.col("c").eqNullSafe(F.col("was"))).alias("n")).drop("was"), "cluster-members")
        if not moved.get["n"]:
            break
    return member.withColumnRenamed("c", "cluster")


def vectors(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """(g, grp, doc_id, terms, w): a row for each of docs (grp, doc_id), its weights (doc_id, term, w) as sorted arrays of 64-bit term hashes and weights, by group within each task.

    g is a hash of grp. Documents come to where their weights are packed, dealt by doc_id, however few files docs has.
    """
    entry = F.struct(F.xxhash64("term").alias("t"), F.col("w").cast("double").alias("w"))
    packed = weights.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    e = F.coalesce("e", F.array().cast("array<struct<t:bigint,w:double>>"))
    rows = docs.join(packed.hint("merge"), "doc_id", "left").select(F.xxhash64("grp").alias("g"), "grp", "doc_id", e["t"].alias("terms"), e["w"].alias("w"))
    return staged(rows.sortWithinPartitions("g"), "vectors")


class Centres:
    """A group's centres, as sums of weights by term and sizes were written by the round before: means of terms that have one, and squared lengths, infinite for clusters that are gone."""

    def __init__(self, path: str, g: int, most: int):
        files, at = opened(path)
        at = f"{at}/g={g}"
        self.q = None
        if files.get_file_info(at).type == pa.fs.FileType.NotFound:
            return
        held = pa.dataset.dataset(at, format="parquet", filesystem=files).to_table()
        sums = np.column_stack([held.column(f"s{i}").to_numpy() for i in range(most)])
        size = held.column("term").is_null().to_numpy()
        n = sums[size].sum(axis=0)
        terms, sums = held.column("term").filter(pa.array(~size)).to_numpy(), sums[~size]
        mean = np.where(n > 0, np.floor((2 * sums + n) / np.maximum(2 * n, 1)), 0.0)
        some = mean.any(axis=1)
        by = np.argsort(terms[some])
        self.terms = terms[some][by]
        # a row of zeros at the end is for terms without a mean
        self.mean = np.vstack([mean[some][by], np.zeros((1, most))])
        self.q = np.where(n > 0, (self.mean * self.mean).sum(axis=0), np.inf)

    def nearest(self, terms: np.ndarray, number: np.ndarray, w: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """The nearest cluster of each of n vectors, the lowest of equals; entries are (row, place in terms, weight)."""
        if self.q is None:
            return np.zeros(n, np.int32)
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        mean = self.mean[np.where(known, at, len(self.terms))]
        dots = np.column_stack([np.bincount(row, w * mean[number, i], n) for i in range(len(self.q))])
        return (self.q - 2 * dots).argmin(axis=1).astype(np.int32)


def _groups(batches, path: str, most: int, weigh=None):
    """(rows of a group, g, its Centres, distinct terms, number, w, row, nearest clusters) for every group of every batch; entries as in Centres.nearest. weigh: makes weights of what is read; rows are as they were."""
    held: dict[int, Centres] = {}
    for read in batches:
        batch = weigh(read) if weigh else read
        keys = batch.column("g").to_numpy(zero_copy_only=False)
        for g in np.unique(keys).tolist():
            if g not in held:
                held = {**dict(list(held.items())[-1:]), g: Centres(path, g, most)}
            at = np.flatnonzero(keys == g)
            own = batch.take(pa.array(at)) if len(at) < len(keys) else batch
            sizes = own.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(at)), sizes)
            terms, number = _distinct(own.column("terms").flatten().to_numpy())
            w = own.column("w").flatten().to_numpy()
            yield read.take(pa.array(at)) if own is not batch else read, g, held[g], terms, number, w, row, held[g].nearest(terms, number, w, row, len(at))


def _distinct(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different terms in order, and of each entry its term's place among them; terms that are numbers are marked in a list, not sorted."""
    if terms.dtype != np.int32 or not len(terms) or terms.max() > 20 * len(terms) + 1_000_000:
        return np.unique(terms, return_inverse=True)
    there = np.zeros(int(terms.max()) + 1, bool)
    there[terms] = True
    known = np.flatnonzero(there)
    place = np.zeros(len(there), np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    return known, place[terms]


def large_clusters(rows: DataFrame, most: int, rounds: int, by_group: bool = False, keep: tuple[str, ...] = ("grp", "doc_id"), weigh=None, reads: list | None = None) -> DataFrame:
    """The columns ``keep`` of rows (as ``vectors`` makes them) and their cluster: the same clusters as those of ``clustered``, for few large groups.

    Vectors stay where they are. In each round a task reads the centres of its groups from the shared folder, and only its sums of weights by group, term
    and cluster are shuffled, whose files go with the round, as the centres of the round before do. A task holds the centres of a few groups, which have no more terms than the group's vocabulary.
    weigh: makes w of a batch of rows where it is read, from what stands there. reads: gets the folder of centres that the result reads.
    """
    spark = rows.sparkSession
    full = lambda some: some if weigh is None else some.mapInArrow(lambda batches: map(weigh, batches), some.withColumns({"terms": F.col("terms"), "w": F.col("w").cast("array<double>")}).schema)
    s = [f"s{i}" for i in range(most)]

    def written(sums: DataFrame) -> tuple[str, int | None]:
        """Where the centres are, and a hash of them."""
        path, told = f"{shared_folder(spark)}/centres-{uuid.uuid4().hex}", Observation()
        whole = sums.groupBy("g", "term").agg(*(F.sum(c).alias(c) for c in s))
        with shuffles_removed(spark):
            whole.observe(told, F.bit_xor(F.xxhash64("g", "term", *s)).alias("h")).write.partitionBy("g").parquet(path)
        return path, told.get.get("h")

    name = F.col("doc_id").cast("string")

    def told(batches):
        for read in batches:
            batch = weigh(read)
            sizes, (terms, w) = batch.column("terms").value_lengths().to_numpy(), (batch.column(c).flatten().to_numpy() for c in ("terms", "w"))
            some, ends = np.flatnonzero(sizes), np.cumsum(sizes)
            by_row = (slice(high - n, high) for high, n in zip(ends[some].tolist(), sizes[some].tolist(), strict=True))
            seen = np.frombuffer(b"".join(hashlib.blake2b(terms[at].tobytes() + w[at].tobytes(), digest_size=16).digest() for at in by_row), np.int64).reshape(-1, 2)
            rest = read.select(["g", "grp", "doc_id"]).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(seen[:, 0]), pa.array(seen[:, 1])], [*rest.schema.names, "d1", "d2"])

    if weigh is None:
        some = rows.where("size(terms) > 0").select("g", "grp", "doc_id", *(F.xxhash64(F.lit(seed), "terms", "w").alias(f"d{seed}") for seed in (1, 2)))
    else:
        some = rows.select("g", "grp", "doc_id", "terms", "w").mapInArrow(told, f"g long, grp string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, d1 long, d2 long")
    ids = some.select("g", "doc_id", F.md5(F.concat_ws(":", "grp", name) if by_group else name).alias("h"), "d1", "d2")
    one = ids.groupBy("g", "d1", "d2").agg(F.min(F.struct("h", "doc_id")).alias("r")).select("g", "r.*")
    place = F.row_number().over(Window.partitionBy("g").orderBy("h", "doc_id"))
    chosen = one.withColumn("c", place - 1).where(F.col("c") < most).select("g", "doc_id", "c")
    first = full(rows.join(F.broadcast(staged(chosen, "first-centres")), ["g", "doc_id"]))
    share = lambda value: [F.when(F.col("c") == i, value).otherwise(0.0).alias(s[i]) for i in range(most)]
    entries = first.select("g", "c", F.explode(F.arrays_zip("terms", "w")).alias("e")).select("g", F.col("e.terms").alias("term"), *share(F.col("e.w")))
    path, was = written(entries.unionByName(first.select("g", F.lit(None).cast("long").alias("term"), *share(F.lit(1.0)))))

    def sums(batches):
        for own, g, centres, terms, number, w, row, c in _groups(batches, path, most, weigh):
            if centres.q is not None:
                # the last row, of no term, has the sizes
                by = np.bincount(number * most + c[row], w, len(terms) * most).reshape(-1, most)
                by = np.vstack([by, np.bincount(c, minlength=most)])
                names = pa.array(np.append(terms, 0), mask=np.arange(len(by)) == len(terms))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(by), g)), names, *(pa.array(by[:, i].astype(float)) for i in range(most))], ["g", "term", *s])

    for _ in range(rounds - 1):
        old = path
        path, now = written(rows.select("g", "terms", "w").mapInArrow(sums, ", ".join(["g long", "term long", *(f"{c} double" for c in s)])))
        unstaged(spark, old)
        if now == was:
            break
        was = now

    if reads is not None:
        reads.append(path)

    def labels(batches):
        for own, *_, c in _groups(batches, path, most, weigh):
            yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keep), pa.array(c)], [*keep, "cluster"])

    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep]
    return rows.select("g", *dict.fromkeys([*keep, "terms", "w"])).mapInArrow(labels, ", ".join([*kinds, "cluster int"]))


def _nearest(sums: np.ndarray, n: np.ndarray, number: np.ndarray, w: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The nearest of the centres with these sums by term and sizes, the lowest of equals."""
    mean = np.where(n > 0, np.floor((2 * sums + n) / np.maximum(2 * n, 1)), 0.0)
    q = np.where(n > 0, (mean * mean).sum(axis=0), np.inf)
    dots = np.column_stack([np.bincount(row, w * mean[number, i], rows) for i in range(len(n))])
    return (q - 2 * dots).argmin(axis=1)


def _clusters_of(grp: str, names: list[str | None], terms: np.ndarray, w: np.ndarray, sizes: np.ndarray, fan: int, rounds: int) -> np.ndarray:
    """The clusters that ``large_clusters`` gives one group by_group. names: ids as text; entries are by row."""
    row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    some = np.flatnonzero(sizes).tolist()
    told = {i: hashlib.md5((grp if names[i] is None else f"{grp}:{names[i]}").encode()).hexdigest() for i in some}
    first: dict[tuple[bytes, bytes], int] = {}
    for i in sorted(some, key=told.__getitem__):
        at = slice(ends[i] - sizes[i], ends[i])
        first.setdefault((terms[at].tobytes(), w[at].tobytes()), i)
        if len(first) == fan:
            break
    if not first:
        return np.zeros(len(sizes), int)
    known, number = np.unique(terms, return_inverse=True)
    chosen = np.full(len(sizes), -1)
    chosen[[*first.values()]] = np.arange(len(first))
    of = chosen[row]
    sums, n = np.bincount((number * fan + of)[of >= 0], w[of >= 0], len(known) * fan).reshape(-1, fan), np.bincount(chosen[chosen >= 0], minlength=fan)
    for _ in range(rounds - 1):
        c = _nearest(sums, n, number, w, row, len(sizes))
        again = np.bincount(number * fan + c[row], w, len(known) * fan).reshape(-1, fan), np.bincount(c, minlength=fan)
        if (again[0] == sums).all() and (again[1] == n).all():
            break
        sums, n = again
    return _nearest(sums, n, number, w, row, len(sizes))


def _whole_groups(batches):
    """A table of each group, from batches sorted by g."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("g").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if held and low < high and held[-1].column("g")[-1].as_py() != keys[low]:
                yield pa.Table.from_batches(held)
                held = []
            if low < high:
                held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _split_in_task(batches, most: int, fan: int, levels: int, rounds: int, weigh=None):
    """(doc_id, grp, large) of whole groups, from batches sorted by g: each is split up to ``levels`` times, its parts too; large: what doesn't fit then."""

    def parts(grp, at, terms, w, sizes, left):
        if len(at) <= most or not left:
            yield grp, at
            return
        c = _clusters_of(grp, [names[i] for i in at.tolist()], terms, w, sizes, fan, rounds)
        of = np.repeat(c, sizes)
        for i in np.unique(c).tolist():
            yield from parts(f"{grp}/{i}", at[c == i], terms[of == i], w[of == i], sizes[c == i], left - 1)

    for group in _whole_groups(map(weigh, batches) if weigh else batches):
        held = group.combine_chunks()
        names, lists = held.column("name").to_pylist(), held.column("terms").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        whole = (lists.flatten().to_numpy(), held.column("w").combine_chunks().flatten().to_numpy(), sizes)
        for grp, at in parts(held.column("grp")[0].as_py(), np.arange(len(sizes)), *whole, levels):
            ids = held.column("doc_id").combine_chunks().take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, pa.array([grp] * len(at), pa.string()), pa.array([len(at) > most] * len(at))], ["doc_id", "grp", "large"])


#: Entries of vectors up to which a group is split by one task: some 100 MB of arrays.
ENTRIES_IN_TASK = 3_000_000


def split_groups(weights: DataFrame, docs: DataFrame, most: int = 300, fan: int = 8, depth: int = 4, rounds: int = 5, in_task: int = ENTRIES_IN_TASK) -> DataFrame:
    """(doc_id, grp) for docs (grp, doc_id): groups of more than ``most`` documents are clustered again by weights (doc_id, term, w), all at once, until they fit.

    A document may be in several groups, which split apart from one another, each from first centres of its own.
    """
    one = vectors(weights, docs.select(F.col("grp").cast("string").alias("grp"), "doc_id"))
    return split_rows(one, most, fan, depth, rounds, in_task)


def split_rows(one: DataFrame, most: int, fan: int, depth: int, rounds: int, in_task: int = ENTRIES_IN_TASK, weigh=None) -> DataFrame:
    """(doc_id, grp) for rows (g, grp, doc_id, terms, w), as ``vectors`` makes them, which are left where they are. weigh: see ``large_clusters``.

    Groups of up to ``in_task`` entries of vectors go to one task each, which splits them and their parts down to the end; only larger ones are clustered in rounds over all tasks.

    A level splits each large group into up to ``fan`` clusters, named grp/cluster. Work grows with the documents that don't fit yet, not with the square of a group. What is too
    large after ``depth`` levels, such as a group of copies, is dealt by hash and sliced, as grp/part/slice. Names are the same however the data is dealt. A level's vectors are removed when the next one has its own.
    """
    spark, fits, over = one.sparkSession, [], []
    kind = one.schema["doc_id"].dataType.simpleString()
    for level in range(depth + 1):
        whole = (F.sum(F.size("terms")) <= in_task) if level < depth else F.lit(False)
        sizes, count = one.groupBy("g").agg((F.count("*") > most).alias("__large"), whole.alias("__whole")), Observation()
        sizes = F.broadcast(staged(sizes.observe(count, F.count_if(F.expr("__large and not __whole")).alias("n"), F.count_if(F.expr("__large and __whole")).alias("whole")), "split-sizes"))
        fits.append(staged(one.join(sizes.where("not __large"), "g", "left_semi").select("doc_id", "grp"), "split-fits"))
        left = one.join(sizes.where("__large and not __whole"), "g", "left_semi")
        if few := count.get.get("whole"):
            own = one.join(sizes.where("__large and __whole"), "g", "left_semi").select("g", "grp", "doc_id", F.col("doc_id").cast("string").alias("name"), "terms", "w")
            # more partitions than groups, so that two large ones seldom meet
            dealt = own.repartition(min(8 * few, 1024), "g").sortWithinPartitions("g")
            split = functools.partial(_split_in_task, most=most, fan=fan, levels=depth - level, rounds=rounds, weigh=weigh)
            ended = staged(dealt.mapInArrow(split, f"doc_id {kind}, grp string, large boolean"), "split-in-tasks")
            fits.append(ended.where("not large").select("doc_id", "grp"))
            over.append(ended.where("large").select("grp", "doc_id"))
        done = not count.get.get("n")
        if level == depth and not done:
            over.append(left.select("grp", "doc_id"))
        if level == depth or done:
            if over:
                fits.append(sliced(staged(functools.reduce(DataFrame.unionByName, over), "split-over"), most))
            if level:
                unstaged(spark, one)
            break
        # after the last level, nobody asks for vectors
        keep = ("grp", "doc_id", "terms", "w")[: 2 if level == depth - 1 else 4]
        reads: list = []
        again = large_clusters(left, fan, rounds, by_group=True, keep=keep, weigh=weigh, reads=reads).withColumn("grp", F.concat_ws("/", "grp", F.col("cluster").cast("string")))
        again = again.select(F.xxhash64("grp").alias("g"), *keep)
        if len(keep) > 2:
            # each group goes to a few tasks, so that a task meets few groups
            again = again.repartition("g", F.pmod(F.xxhash64("doc_id"), F.lit(max(64 // fan ** (level + 1), 4)))).sortWithinPartitions("g")
        was, one = one, staged(again, "vectors")
        # splits that come one after the other leave no centres either
        unstaged(spark, *([was] if level else []), *(reads if weigh else []))
    return functools.reduce(DataFrame.unionByName, fits)


def sliced(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, grp/part/slice) for docs (grp, doc_id)."""
    return bounded_groups(docs, "grp", "doc_id", most).select("doc_id", F.concat_ws("/", "grp", F.col("part").cast("string"), F.col("slice").cast("string")).alias("grp"))


def clusters_sql(w: str, docs: str, most: int, rounds: int, tag: str = "", by: str = "doc_id::VARCHAR") -> str:
    """The same as CTEs over the named w(grp, doc_id, term, w) and docs(grp, doc_id); the last one is ``member``. tag: ends all their names; by: what is hashed to choose first centres."""
    out = f"""dg{tag} AS MATERIALIZED (SELECT grp, doc_id, sum(('0x' || substr(h, 1, 8))::BIGINT) AS s1, sum(('0x' || substr(h, 9, 8))::BIGINT) AS s2, count(*) AS n FROM (SELECT *, md5(term || '=' || w::BIGINT) AS h FROM {w}) GROUP BY grp, doc_id),
one{tag} AS (SELECT * FROM dg{tag} QUALIFY row_number() OVER (PARTITION BY grp, s1, s2, n ORDER BY md5({by}), doc_id) = 1),
a{tag}0 AS MATERIALIZED (SELECT grp, doc_id, row_number() OVER (PARTITION BY grp ORDER BY md5({by}), doc_id) - 1 AS c FROM one{tag} QUALIFY c < {most})"""
    for i in range(rounds):
        out += f""", n{tag}{i} AS MATERIALIZED (SELECT grp, c, count(*) AS n FROM a{tag}{i} GROUP BY grp, c),
m{tag}{i} AS MATERIALIZED (SELECT grp, term, c, floor((2 * s + n) / (2 * n)) AS m FROM (SELECT grp, term, c, sum(w) AS s FROM {w} JOIN a{tag}{i} USING (grp, doc_id) GROUP BY grp, term, c) JOIN n{tag}{i} USING (grp, c)),
q{tag}{i} AS MATERIALIZED (SELECT grp, c, coalesce(q, 0) AS q FROM n{tag}{i} LEFT JOIN (SELECT grp, c, sum(m * m) AS q FROM m{tag}{i} GROUP BY grp, c) USING (grp, c)),
p{tag}{i} AS MATERIALIZED (SELECT grp, doc_id, c, sum(w * m) AS dot FROM {w} JOIN m{tag}{i} USING (grp, term) GROUP BY grp, doc_id, c),
a{tag}{i + 1} AS MATERIALIZED (SELECT grp, doc_id, c FROM {docs} JOIN q{tag}{i} USING (grp) LEFT JOIN p{tag}{i} USING (grp, doc_id, c) QUALIFY row_number() OVER (PARTITION BY grp, doc_id ORDER BY q - 2 * coalesce(dot, 0), c) = 1)"""
    return out + f", member{tag} AS (SELECT grp, doc_id, coalesce(c, 0)::INT AS cluster FROM {docs} LEFT JOIN a{tag}{rounds} USING (grp, doc_id))"


def split_sql(w: str, docs: str, most: int, fan: int, depth: int, rounds: int) -> str:
    """The same as CTEs over the named w(doc_id, term, w) and docs(grp, doc_id); the last one is ``split``."""
    out = f"g0 AS MATERIALIZED (SELECT grp, doc_id, count(*) OVER (PARTITION BY grp) > {most} AS large FROM {docs})"
    for i in range(depth):
        out += f""", l{i} AS MATERIALIZED (SELECT grp, doc_id FROM g{i} WHERE large), w{i} AS MATERIALIZED (SELECT grp, doc_id, term, w FROM {w} JOIN l{i} USING (doc_id)),
{clusters_sql(f"w{i}", f"l{i}", fan, rounds, f"_{i}_", "concat_ws(':', grp, doc_id)")}, g{i + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY grp) > {most} AS large FROM (SELECT grp || '/' || cluster AS grp, doc_id FROM member_{i}_))"""
    fits = " UNION ALL ".join(f"SELECT doc_id, grp FROM g{i} WHERE NOT large" for i in range(depth + 1))
    return out + f""", dealt AS (SELECT grp, doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % ((count(*) OVER (PARTITION BY grp) + {most - 1}) // {most}) AS part FROM g{depth} WHERE large),
split AS ({fits} UNION ALL SELECT doc_id, grp || '/' || part || '/' || ((row_number() OVER (PARTITION BY grp, part ORDER BY doc_id) - 1) // {most}) AS grp FROM dealt)"""
