"""Removal of long byte strings that occur twice or more, found by deep-shallow sorting of sampled suffixes.

Sampling. Every string of ``length`` bytes picks one of its 64-byte grams, the leftmost with the least hash. Equal strings
pick the same gram at the same offset, so a repeated string is found among the strings that picked an equal gram. The
strings of a text that pick the same occurrence of a gram start at neighbouring bytes and make a run.

Pruning. Grams that are picked once are done with. Where all runs of a gram have one content, they cover each other, and so
do runs with equal content in general; these are settled by counts alone, which are summed before they are shuffled.

Sorting. What is left, runs with the same gram and different content, is compared exactly. The suffixes that start at the gram
and the reversed prefixes that end there are sorted: multikey quicksort on 8-byte words down to ``SHALLOW`` bytes, then
a blind trie for each group that is still equal. Neighbours' common prefixes tell for every start which runs share the whole
string. Grams with more than ``CROWD`` different runs don't go to one task: their strings are counted one by one by hash.

Defined results: null text is empty. Texts shorter than ``length`` lose nothing. Rows are told apart by their text, so
doc_id may be null or repeat; two rows with the same text of at least ``length`` bytes lose it all. Empty tables give empty
results. Only doc_id and text are read; ``drop_repeats`` keeps all other columns whatever their names are. Bytes that are
no longer valid UTF-8 after a cut become U+FFFD in ``drop_repeats`` only; the digest is taken of the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, groups_of, mix, rows_of, staged

GRAM = 64
SHALLOW = 32
CROWD = 3000
SEGMENT = 1 << 23
AT_ONCE = 20_000


def picks(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the runs of a text: the gram's hash, its place, the first and the last start of the run."""
    found = []
    for base in range(0, len(data) - length + 1, SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        words = np.ndarray(len(part) - 7, "<u8", part.tobytes(), strides=(1,)).astype(np.uint64)
        h = mix(words)
        width = 8
        while width < GRAM:
            h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]
            h ^= h >> np.uint64(29)
            width *= 2
        h = mix(h)
        at = np.arange(len(h), dtype=np.uint64)
        least = (h & ~np.uint64((1 << 24) - 1)) | at
        span, wide = length - GRAM + 1, 1
        while wide * 2 <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < span:
            least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        found.append((h[place[first]], place[first] + base, first + base, last + base))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.encode(text, "UTF-8").alias("data"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


RUN = "k1 long, k2 long, gram long, ctx long, at int, first int, last int, sure boolean"


def _runs(keyed: DataFrame, length: int) -> DataFrame:
    """The runs of every text. sure: its own text, or the task's earlier rows, repeat it already."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for rows in rows_of(batches, "data", "k1", "k2"):
            out: list[list] = [[] for _ in range(8)]

            def put(*cols, out=out):
                for to, values in zip(out, cols, strict=True):
                    to.append(values)

            for data, k1, k2 in rows:
                if len(data) < length:
                    continue
                if (k1, k2) in seen:  # a copy: all of it goes
                    put(*(np.array([x]) for x in (k1, k2, 0, 0, 0, 0, len(data) - length, True)))
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add((k1, k2))
                gram, at, first, last = picks(np.frombuffer(data, np.uint8), length)
                ctx = np.array([xxhash.xxh3_64_intdigest(data[s : e + length], a - s) for a, s, e in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)], np.uint64)
                _, one, back, times = np.unique(ctx, return_index=True, return_inverse=True, return_counts=True)
                sure = times[back] > 1
                single = ~sure
                single[one] = True  # one of equal runs still speaks for its content to other texts
                n = int(single.sum())
                put(np.full(n, k1), np.full(n, k2), gram[single].view(np.int64), ctx[single].view(np.int64), at[single], first[single], last[single], np.zeros(n, bool))
                if m := int(sure.sum()):
                    put(np.full(m, k1), np.full(m, k2), np.zeros(m, np.int64), np.zeros(m, np.int64), at[sure], first[sure], last[sure], np.ones(m, bool))
            if out[0]:
                cols = [np.concatenate(x) for x in out]
                kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) if k == pa.bool_() else pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RUN.split(", ")])

    return keyed.select("data", "k1", "k2").mapInArrow(run, RUN)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """members sorted by their strings, and each one's common prefix with the one before (0 for the first).

    Inner nodes know only a depth and the byte there. A string goes down blindly, is compared once with the leaf it comes to,
    and hangs where they part.
    """
    root: list | int = members[0]
    twins: dict[int, list[int]] = {members[0]: []}
    for m in members[1:]:
        s = strings[m]
        node = root
        while not isinstance(node, int):
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1)
            if node is None:
                node = next(iter(kids.values()))
        t = strings[node]
        shared = common_prefix(s, t)
        if shared == len(s) == len(t):
            twins[node].append(m)
            continue
        twins[m] = []
        up, node = None, root
        while not isinstance(node, int) and node[0] < shared:
            up = (node, s[node[0]] if node[0] < len(s) else -1)
            node = node[1][up[1]]
        byte = s[shared] if shared < len(s) else -1
        if not isinstance(node, int) and node[0] == shared:
            node[1][byte] = m
            continue
        split = (shared, {t[shared] if shared < len(t) else -1: node, byte: m})
        if up is None:
            root = split
        else:
            up[0][1][up[1]] = split
    order, shared_with_last, stack = [], [], [(root, 0)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, int):
            order.append(node)
            shared_with_last.append(before)
            for twin in twins[node]:
                order.append(twin)
                shared_with_last.append(len(strings[node]))
        else:
            depth, kids = node
            keys = sorted(kids)
            stack += [(kids[k], depth if i else before) for i, k in reversed(list(enumerate(keys)))]
    return order, shared_with_last


def deep_shallow(group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings by (group, string), and each one's common prefix with the one before; -1 in another group."""
    n = len(strings)
    flat = b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings)
    words = np.frombuffer(flat, ">u8").reshape(n, -1)
    order = np.argsort(group, kind="stable")
    first = np.r_[True, group[order][1:] != group[order][:-1]]
    for w in range(words.shape[1]):
        part = np.cumsum(first)
        open_ = np.flatnonzero(np.bincount(part)[part] > 1)
        if not len(open_):
            break
        key = words[order[open_], w]
        into = np.lexsort((key, part[open_]))
        order[open_] = order[open_][into]
        p, k = part[open_][into], key[into]
        first[open_] = np.r_[True, (p[1:] != p[:-1]) | (k[1:] != k[:-1])]
    ends = np.r_[np.flatnonzero(first)[1:], n]
    shared = np.zeros(n, np.int64)
    for s, e in zip(np.flatnonzero(first).tolist(), ends.tolist(), strict=True):
        if e - s > 1:
            order[s:e], shared[s:e] = blind_trie(strings, order[s:e].tolist())
    heads = np.flatnonzero(first)
    for h in heads[heads > 0].tolist():
        a, b = order[h - 1], order[h]
        shared[h] = common_prefix(strings[a][:SHALLOW], strings[b][:SHALLOW]) if group[a] == group[b] else -1
    if n:
        shared[0] = -1
    return order, shared


def repeated_starts(group: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> np.ndarray:
    """found[i, t]: run i's string that starts t bytes before the gram is in another run of its group too.

    left: what stands before the gram, reversed; right: from the gram on.
    """
    n = len(left)
    far = np.array([len(x) for x in left])
    near = length - np.array([len(x) for x in right])
    by_right, lcp_right = deep_shallow(group, right)
    by_left, lcp_left = deep_shallow(group, left)
    found = np.zeros((n, int(far.max(initial=0)) + 1), bool)
    id_right, id_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(found.shape[1]):
        here = np.flatnonzero((near <= t) & (t <= far))
        if len(here) < 2:
            continue
        id_right[by_right] = np.cumsum(lcp_right < length - t)
        id_left[by_left] = np.cumsum(lcp_left < t)
        both = id_right[here] * (n + 1) + id_left[here]
        into = np.argsort(both, kind="stable")
        same = np.r_[False, both[into][1:] == both[into][:-1]]
        found[here[into[same | np.r_[same[1:], False]]], t] = True
    return found


def _contexts(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes around the grams of wanted, once a text and task."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "ctx", "at", "first", "last", "times", "crowd")).alias("runs"))
    joined = keyed.select("k1", "k2", "data").join(lists, ["k1", "k2"])

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for rows in rows_of(batches, "k1", "k2", "data", "runs"):
            out = []
            for k1, k2, data, runs in rows:
                if (k1, k2) not in seen:
                    seen.add((k1, k2))
                    out += [(k1, k2, r["gram"], r["ctx"], r["at"], r["times"], r["crowd"], data[r["first"] : r["at"]][::-1], data[r["at"] : r["last"] + length]) for r in runs]
            if out:
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["k1", "k2", "gram", "ctx", "at", "times", "crowd", "left", "right"])

    return joined.mapInArrow(run, "k1 long, k2 long, gram long, ctx long, at int, times long, crowd boolean, left binary, right binary")


SPAN = "k1 long, k2 long, first int, last int"


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated starts of runs in groups of bounded size."""

    def run(batches):
        for table in groups_of(batches, "gram", AT_ONCE):
            _, one = np.unique(np.c_[table["gram"].to_numpy(), table["ctx"].to_numpy()], axis=0, return_index=True)
            table = table.take(pa.array(np.sort(one)))  # a text may have come from two tasks
            found = repeated_starts(table["gram"].to_numpy(), table["left"].to_pylist(), table["right"].to_pylist(), length)
            found[table["times"].to_numpy() > 1] = False  # settled already
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            who, low = np.nonzero(edge == 1)
            high = np.nonzero(edge == -1)[1] - 1
            if len(who):
                at = table["at"].to_numpy()[who]
                yield pa.RecordBatch.from_arrays([pa.array(table["k1"].to_numpy()[who]), pa.array(table["k2"].to_numpy()[who]), pa.array((at - high).astype(np.int32)), pa.array((at - low).astype(np.int32))], ["k1", "k2", "first", "last"])

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, SPAN)


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same for crowded grams, by counting every string's hash."""

    def run(batches):
        for rows in rows_of(batches, "k1", "k2", "gram", "ctx", "at", "left", "right"):
            for k1, k2, gram, ctx, at, left, right in rows:
                data = left[::-1] + right
                n = len(data) - length + 1
                h = np.array([xxhash.xxh3_64_intdigest(data[i : i + length]) for i in range(n)], np.uint64).view(np.int64)
                start = np.arange(n, dtype=np.int32) + np.int32(at - len(left))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(np.full(n, gram)), pa.array(np.full(n, ctx)), pa.array(h), pa.array(start)], ["k1", "k2", "gram", "ctx", "h", "start"])

    strings = contexts.dropDuplicates(["gram", "ctx"]).mapInArrow(run, "k1 long, k2 long, gram long, ctx long, h long, start int")
    often = strings.groupBy("gram", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return strings.join(often, ["gram", "h"]).select("k1", "k2", F.col("start").alias("first"), F.col("start").alias("last"))


def repeated_spans(keyed: DataFrame, length: int = 400) -> DataFrame:
    """(k1, k2, spans): for each text key the ranges of starts, both inclusive, of strings that start elsewhere too."""
    runs = staged(_runs(keyed, length), "suffix-runs")
    picked = runs.where("not sure").drop("sure")
    grams = picked.groupBy("gram").agg(F.count("*").alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("n > 1").select("gram", (F.col("lo") == F.col("hi")).alias("uniform"))
    shared = staged(picked.join(grams, "gram"), "suffix-shared")
    mixed = shared.where("not uniform")
    kinds = mixed.groupBy("gram", "ctx").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "at", "first", "last")).alias("one"))
    kinds = staged(kinds.select("gram", "ctx", "times", "one.*"), "suffix-kinds")
    crowds = kinds.groupBy("gram").agg((F.count("*") > CROWD).alias("crowd"))
    contexts = staged(_contexts(keyed, kinds.join(crowds, "gram"), length), "suffix-contexts")
    same = mixed.join(kinds.where("times > 1").select("gram", "ctx"), ["gram", "ctx"])
    span = ["k1", "k2", "first", "last"]
    spans = runs.where("sure").select(span).unionByName(shared.where("uniform").select(span)).unionByName(same.select(span))
    spans = spans.unionByName(_compared(contexts.where("not crowd"), length)).unionByName(_counted(contexts.where("crowd"), length))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _keep(data: bytes, spans, length: int) -> tuple[bytes, int]:
    """What is left of data, and the number of maximal removed runs."""
    if not spans:
        return data, 0
    kept, n, done = [], 0, 0
    end = -1
    for first, last in sorted((s["first"], s["last"] + length) for s in spans):
        if first > end:
            n += 1
            kept.append(data[done:first])
        done = end = max(end, last)
    kept.append(data[done:])
    return b"".join(kept), n


def suffix_digest(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    keyed = _keyed(docs)
    joined = keyed.join(repeated_spans(keyed, length), ["k1", "k2"], "left")

    def run(batches):
        for rows in rows_of(batches, "doc_id", "data", "spans"):
            out = []
            for doc_id, data, spans in rows:
                kept, n = _keep(data, spans, length)
                out.append((doc_id, len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("doc_id", "data", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs with ``text`` less every string of length bytes that starts elsewhere too; null text stays null."""
    text = F.coalesce("text", F.lit(""))
    spans = repeated_spans(_keyed(docs), length)
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    joined = whole.join(spans, ["k1", "k2"], "left").select("row", "spans")
    names = docs.columns

    def run(batches):
        for batch in batches:
            row = pa.array(batch.column("row"))
            cols = row.flatten()
            at = names.index("text")
            texts = [t if t is None or not s else _keep(t.encode(), s, length)[0].decode(errors="replace") for t, s in zip(cols[at].to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, ddl(docs.schema))
