"""SentencePiece encoding that keeps offsets, and decoding, of BPE models with byte fallback.

A text is normalised by the longest prefix that the model's compiled character map knows, else a character at a time, and each
normalised character keeps the place in the text that it came from. Normalised text falls into units that no merge can cross; each
distinct unit is merged once, as long as a task remembers it. The pieces' lengths then run over the kept places, which gives every
piece its span of original bytes.

Defined results: null and empty texts have no tokens; each row is encoded by itself; a control piece's text inside a document is
ordinary text; texts are never cut; units of any length are merged in n log n. Other columns are kept by ``encode`` and ``decode``
and may have any name but those of the result columns. Models of other kinds, with pieces of users or unused ones, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _pieces as slices
from .common import ddl

# Fixed values of the file format.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
NEVER = 1 << 60
NONE = (1 << 31) - 1


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message: whole numbers, or bytes of all else."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, message[at : at + size]
            at += size


class CharacterMap:
    """The compiled map of a normaliser: a double array over UTF-8 bytes, whose leaves point to replacement texts. Empty: every character stays."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        self.plain: set[str] = set()  # characters that stay as they are, whatever follows

    def _step(self, node: int, byte: int) -> int:
        """The unit that a byte leads to from where a unit points, or -1."""
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else -1

    def _target(self, at: int) -> int:
        unit = self.units[at]
        return at ^ (unit >> 10 << ((unit & 512) >> 6))

    def longest(self, data: bytes, start: int) -> tuple[int, bytes | None]:
        """Length and replacement of the longest known prefix of data from start on; 0 and None if there is none."""
        found = 0, None
        if not self.units:
            return found
        node = self._target(0)
        for i in range(start, len(data)):
            at = self._step(node, data[i])
            if at < 0:
                break
            node = self._target(at)
            if self.units[at] >> 8 & 1:
                text = self.units[node] & 0x7FFFFFFF
                found = i - start + 1, self.texts[text : self.texts.index(b"\0", text)]
        return found

    def _stays(self, char: str) -> bool:
        """Whether no known prefix begins with the whole character."""
        if not self.units:
            return True
        node = self._target(0)
        for byte in char.encode():
            at = self._step(node, byte)
            if at < 0:
                return True
            node = self._target(at)
        return False

    def knows_none_of(self, text: str) -> bool:
        new = set(text) - self.plain
        odd = {c for c in new if not self._stays(c)}
        self.plain |= new - odd
        return not odd

    def parts(self, text: str) -> list[tuple[int, str]]:
        """Consecutive (bytes of the text, what they become)."""
        if self.knows_none_of(text):
            return [(len(c.encode()), c) for c in text]
        data, at, out = text.encode(), 0, []
        while at < len(data):
            n, new = self.longest(data, at)
            if not n:
                lead = data[at]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + n]
            out.append((n, new.decode()))
            at += n
        return out


class PieceModel:
    """A model file."""

    #: Units of a generation; as many of the one before are remembered too.
    REMEMBERED = 120_000
    #: Characters up to which units are merged together, by classes of length; longer ones go one by one through a heap.
    WIDTHS = (6, 10, 16, 48)

    def __init__(self, content: bytes):
        self.text: list[str] = []
        self.kind: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in fields(content):
            if number == 1:
                own = dict(fields(value))
                self.text.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kind.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        # fields by number: 3 model type, 24 white space as suffix, 35 byte fallback, 44 text of unknown; 2 map, 3 dummy prefix, 4 extra spaces, 5 escapes
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or not trainer.get(35, 0) or set(self.kind) - {NORMAL, UNKNOWN, CONTROL, BYTE} or not normalizer.get(5, 1):
            raise ValueError("only BPE models with byte fallback, and without user-defined or unused pieces, are read")
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.map = CharacterMap(normalizer.get(2, b""))
        self.prefix, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.ids = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {t: order[scores[i]] for t, i in self.ids.items()}
        self.symbols: int | None = None  # pairs are numbered when the first unit is merged; decoding needs none
        self.units_of = self._splitter().findall
        self.decimal = [str(i) for i in range(len(self.text))]
        self.length = np.array([len(t) if k == NORMAL else 0 for t, k in zip(self.text, self.kind, strict=True)])
        self.byte_value = np.array([self.byte_of.get(i, -1) for i in range(len(self.text))])
        # what a token stands for wherever it is: all but control and unknown pieces, and bytes of longer characters
        self.shown = ["" if k in (UNKNOWN, CONTROL) else t.replace(SPACE, " ") if k == NORMAL else chr(self.byte_of[i]) if self.byte_of[i] < 128 else "" for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True))]
        self.odd = np.isin(self.kind, [UNKNOWN, CONTROL])
        self.now: dict[str, tuple[str, str]] = {}  # ids, as decimals, and text by unit
        self.before: dict[str, tuple[str, str]] = {}

    def _splitter(self) -> re.Pattern:
        """Units end before a run of spaces, if no piece has one inside, and around ASCII characters that are in no piece of two characters or more."""
        long = [t for t in self.ids if len(t) > 1]
        used = set("".join(long))
        alone = re.escape("".join(c for c in map(chr, range(128)) if c not in used))
        inside = f"[^{alone}]+" if any(SPACE in t.lstrip(SPACE) for t in long) else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"
        return re.compile(f"{inside}|[{alone}]" if alone else inside)

    # normalisation

    def normalized(self, text: str) -> str:
        """What is cut into pieces."""
        if self.squeeze or not self.map.knows_none_of(text):
            return self.aligned(text)[0]
        return (SPACE * self.prefix + text.replace(" ", SPACE)) if text else ""

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and where in the text's bytes each of its characters begins, and the last one ends."""
        if not self.squeeze and self.map.knows_none_of(text):
            if not text:
                return "", np.zeros(1, np.int64)
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.zeros(len(code) + 1 + self.prefix, np.int64)
            np.cumsum(1 + (code > 0x7F) + (code > 0x7FF).astype(np.int64) + (code > 0xFFFF), out=at[1 + self.prefix :])
            return SPACE * self.prefix + text.replace(" ", SPACE), at
        parts = self.map.parts(text)
        sizes = np.fromiter((n for n, _ in parts), np.int64, len(parts))
        at = np.concatenate([[0], np.cumsum(sizes)])
        out: list[str] = []
        begins: list[int] = []
        low, high = 0, len(parts)
        if self.squeeze:
            while low < high and parts[low][1] == " ":
                low += 1
        if low == high:
            return "", np.zeros(1, np.int64)
        if self.prefix:
            out.append(SPACE)
            begins.append(int(at[low]))
        spaced = self.squeeze
        for i in range(low, high):
            new = parts[i][1]
            if spaced:
                new = new.lstrip(" ")
            if new:
                out.extend(SPACE if c == " " else c for c in new)
                begins.extend([int(at[i])] * len(new))
                spaced = self.squeeze and new[-1] == " "
        end = int(at[high])
        if self.squeeze:
            while out and out[-1] == SPACE:
                out.pop()
                end = begins.pop()
        return "".join(out), np.array([*begins, end], np.int64)

    # merging

    def _number_pairs(self) -> None:
        """Numbers for pieces and for characters of pieces, and of each pair of them that makes a piece its rank and that piece. The last number stands for all other characters."""
        size = len(self.text)
        others = sorted(set("".join(self.ids)) - set(self.ids))
        self.symbol = self.ids | {c: size + i for i, c in enumerate(others)}
        self.symbols = size + len(others) + 1
        own = [(self.symbol[t[:i]] * self.symbols + self.symbol[t[i:]], self.rank[t], n) for t, n in self.ids.items() for i in range(1, len(t)) if t[:i] in self.symbol and t[i:] in self.symbol]
        table = np.array(sorted(own) or [(-1, 0, 0)], np.int64)
        # 32 bits hold the pairs of all but very large models
        self.whole = np.int32 if self.symbols**2 < NONE else np.int64
        self.pair_keys, self.pair_ranks, self.pair_made = np.ascontiguousarray(table.T.astype(self.whole))

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; rank NONE where it makes none."""
        key = a * self.whole(self.symbols) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.whole(NONE)), self.pair_made[at]

    def _merged_together(self, units: list[str]) -> list[list[int]]:
        """The symbols of units by merging: the pair of the best score is joined, the leftmost of equal ones, until no pair makes a piece; a merge of each unit at a time."""
        if self.symbols is None:
            self._number_pairs()
        other = self.symbols - 1
        sizes = np.array([*map(len, units)])
        wide = int(sizes.max()) + 1
        rows = np.arange(len(units))
        inside = np.arange(wide) < sizes[:, None]
        find = self.symbol.get
        piece = np.full(inside.shape, -1, self.whole)
        piece[inside] = [find(c, other) for c in "".join(units)]
        rank, made = np.full(inside.shape, NONE, self.whole), np.zeros(inside.shape, self.whole)
        pair = inside[:, 1:]
        rank[:, :-1][pair], made[:, :-1][pair] = self._pairs(piece[:, :-1][pair], piece[:, 1:][pair])
        after = np.tile(np.arange(1, wide + 1), (len(units), 1))
        before = np.tile(np.arange(-1, wide - 1), (len(units), 1))
        todo = rows
        while len(todo):
            at = rank[todo].argmin(axis=1)
            on = rank[todo, at] < NONE
            todo, at = todo[on], at[on]
            gone = after[todo, at]
            beyond = after[todo, gone]
            piece[todo, at], piece[todo, gone], rank[todo, gone] = made[todo, at], -1, NONE
            after[todo, at], before[todo, np.minimum(beyond, wide - 1)] = beyond, at
            for left, right in ((before[todo, at], at), (at, beyond)):
                ok = (left >= 0) & (right < wide)
                ok[ok] = piece[todo[ok], right[ok]] >= 0
                ended = todo[~ok & (left >= 0)]
                rank[ended, left[~ok & (left >= 0)]] = NONE
                own = todo[ok]
                rank[own, left[ok]], made[own, left[ok]] = self._pairs(piece[own, left[ok]], piece[own, right[ok]])
        kept = piece >= 0
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        flat = piece[kept].tolist()
        return [flat[low:high] for low, high in zip([0, *ends], ends, strict=False)]

    def _merged_long(self, unit: str) -> list[str]:
        """The pieces of a unit of any length, as strings."""
        parts, rank = list(unit), self.rank.get
        n = len(parts)
        after, before = [*range(1, n), n], [*range(-1, n - 1)]
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1], NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != joined:
                continue  # merged otherwise since
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (r := rank(parts[x] + parts[y], NEVER)) < NEVER:
                    heapq.heappush(heap, (r, x, parts[x] + parts[y]))
        return [p for p in parts if p]

    def _decimals(self, parts: list[str]) -> str:
        """The ids of pieces; the bytes of a character that is no piece."""
        return ",".join([self.decimal[i] for p in parts for i in ([self.ids[p]] if p in self.ids else [self.byte[b] for b in p.encode()])])

    def _encoded(self, units: list[str]) -> Iterator[tuple[str, str]]:
        """(unit, its ids as decimals), in any order."""
        decimal, known = self.decimal, len(self.text)
        low = 0
        for high in self.WIDTHS:
            own = [u for u in units if low < len(u) <= high]
            for unit, symbols in zip(own, self._merged_together(own) if own else [], strict=True):
                if max(symbols) < known:
                    yield unit, ",".join([decimal[i] for i in symbols])
                else:  # characters that are no pieces stay single
                    parts, at = [], 0
                    for i in symbols:
                        parts.append(unit[at : at + (len(self.text[i]) if i < known else 1)])
                        at += len(parts[-1])
                    yield unit, self._decimals(parts)
            low = high
        for unit in units:
            if len(unit) > low:
                yield unit, self._decimals(self._merged_long(unit))

    def learn(self, units: set[str]) -> None:
        if len(self.now) > self.REMEMBERED:
            self.now, self.before = {}, self.now
        new = units.difference(self.now)
        again = {u for u in new if u in self.before}
        self.now.update((u, self.before[u]) for u in again)
        self.now.update((u, (ids, u.replace(SPACE, " "))) for u, ids in self._encoded([*(new - again)]))

    def forget(self) -> None:
        """Lets go of all units: a worker goes on to other tasks and keeps the model only."""
        self.now, self.before = {}, {}

    def encoded(self, normalized: list[str]) -> list[list[tuple]]:
        """The units' results of texts that are normalised."""
        units = [self.units_of(t) for t in normalized]
        self.learn(set().union(*units))
        return [[*map(self.now.__getitem__, u)] for u in units]

    def spans(self, found: list[tuple], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each piece begins and ends in the text's bytes; bytes before a character's last one have empty spans."""
        ids = np.fromstring(",".join([f[0] for f in found]), np.int32, sep=",") if found else np.zeros(0, np.int32)
        byte = np.append(self.byte_value[ids], -1)
        last = (byte[:-1] >= 0) & ((byte[1:] < 128) | (byte[1:] > 191))  # no other byte of its character follows
        size = self.length[ids] + last
        end = np.cumsum(size)
        return ids, at[end - size], at[end]

    # decoding

    @staticmethod
    def _text_of(data: bytes) -> str:
        out = []
        while data:
            try:
                out.append(data.decode())
                break
            except UnicodeDecodeError as e:
                out.append(data[: e.start].decode() + "\ufffd")
                data = data[e.start + 1 :]
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each, control pieces nothing."""
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids[ends[i] : ends[i + 1]]."""
        bounds = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        if self.squeeze or self.odd[ids].any():
            return [self._decoded_in_turn(ids[low:high].tolist()) for low, high in bounds]
        shown = [*map(self.shown.__getitem__, ids.tolist())]
        byte = self.byte_value[ids]
        long = np.flatnonzero(byte > 127)
        if len(long):
            # a run of bytes ends with its text
            apart = (np.diff(long) > 1) | (np.diff(np.searchsorted(ends, long, "right")) > 0)
            for run in np.split(long, np.flatnonzero(apart) + 1):
                shown[run[0]] = self._text_of(byte[run].astype(np.uint8).tobytes())
        if self.prefix:
            first = ends[:-1][ends[:-1] < ends[1:]]
            for i in first[byte[first] < 0].tolist():
                shown[i] = shown[i].removeprefix(" ")
        return ["".join(shown[low:high]) for low, high in bounds]

    def _decoded_in_turn(self, ids: list[int]) -> str:
        """The same, token by token: what is a space at the start depends on all tokens before."""
        out: list[str] = []
        held = bytearray()
        start = True  # the first space is the dummy prefix

        def flush() -> None:
            out.append(self._text_of(bytes(held)))
            held.clear()

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                flush()
                start = False
            if self.kind[i] == CONTROL:
                continue
            if self.kind[i] == UNKNOWN:
                out.append(self.unknown_text)
                start = False
                continue
            piece = self.text[i]
            if start and (self.prefix or self.squeeze):
                stripped = piece.removeprefix(SPACE)
                start = self.squeeze and not stripped
                piece = stripped
            out.append(piece.replace(SPACE, " "))
        flush()
        return "".join(out)

    def decoded(self, found: list[tuple]) -> str:
        """What ``decode`` gives for the ids of a text's units, from the units' own texts."""
        text = "".join([f[1] for f in found])
        return text[1:] if (self.prefix or self.squeeze) and text.startswith(" ") else text


_MODELS: dict[str, PieceModel] = {}


def _model(shipped) -> PieceModel:
    """The worker's model of a broadcast file; kept while the worker lives."""
    if shipped.value[0] not in _MODELS:
        _MODELS.clear()
        _MODELS[shipped.value[0]] = PieceModel(shipped.value[1])
    return _MODELS[shipped.value[0]]


def _ship(df: DataFrame, path: str):
    """The model file, of a size that does not grow with the data, to all executors."""
    with open(path, "rb") as f:
        content = f.read()
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(content).hexdigest(), content))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays), kind))


def encode(docs: DataFrame, path: str, ids: str = "ids", begins: str = "begins", ends: str = "ends") -> DataFrame:
    """docs with the ids of ``text``, and of each the span of the text's UTF-8 bytes that it stands for."""
    shipped = _ship(docs, path)

    def run(batches):
        model = _model(shipped)
        for part in slices(batches):
            texts = [model.aligned(t or "") for t in part.column("text").to_pylist()]
            found = [model.spans(f, at) for f, (_, at) in zip(model.encoded([t for t, _ in texts]), texts, strict=True)]
            new = [_lists([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, ids, begins, ends])
        model.forget()

    return docs.mapInArrow(run, f"{ddl(docs.schema)}, `{ids}` array<int>, `{begins}` array<long>, `{ends}` array<long>")


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of the token ids as ``out``; null ids give an empty text."""
    shipped = _ship(df, path)

    def run(batches):
        model = _model(shipped)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(ids)
                ends = np.concatenate([[0], np.cumsum(lists.fill_null([]).value_lengths().to_numpy(zero_copy_only=False))])
                text = model.decode_all(lists.flatten().to_numpy(zero_copy_only=False), ends)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*part.schema.names, out])

    return df.mapInArrow(run, f"{ddl(df.schema)}, `{out}` string")


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_covered of every row of docs: what ``encode`` and ``decode`` give, in digests. n_covered: bytes of the text in its tokens' spans."""
    covered = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda s, n: s + n)
    coded = encode(docs.select("doc_id", "text"), path).select("doc_id", "ids", covered.alias("n_covered"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return decode(coded, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_covered")
