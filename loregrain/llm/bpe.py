"""BPE with word ends: encode by speculating and verifying, decode by table.

A new word first gets the longest vocabulary entry at every position, a guess that costs a few look-ups. The guess is
right exactly if no merge of the real algorithm would ever join pieces across one of its borders, and that depends on the
two tokens at the border alone. All borders of all new words of a batch are checked at once, as numpy arrays; only words
with a failing border are encoded by merging, a merge of each of them at a time. Every distinct word is encoded once, as
long as a task remembers it.

Why a border check needs only two tokens: the pieces that touch the border from the left are the right spine of the left
token's merge tree, from the right the left spine of the right token's. Ranks grow up the spines. So two such pieces meet
from the moment when the later one is made until the first of them is merged further, and a merge between them happens
exactly if its rank is lower than that of the next merge on the left and not higher than that of the next on the right
(of equal merges the leftmost goes first).

The encoding is that of a tokenizer file with NFC, lower-casing, dropped white space, the fixed split pattern and byte-level
letters. Defined results: null and empty texts have no tokens; an added token's text inside a document is that token;
every row is encoded by itself; other columns are kept by ``encode`` and ``decode`` and may have any name but that of the
result column. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from .common import ddl

# Fixed values of the file format: the split pattern and the mark at the end of a word.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
WORD_END = "</w>"
END = "\0"  # stands for WORD_END as one character
NEVER = 1 << 40
#: The same split for ASCII, and for texts without numbers that are no decimal digits.
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
SPLIT_PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|\\d|(?:_|[^\\w\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])+")
ODD_NUMBERS = frozenset(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
#: Characters of texts that are encoded together.
AT_ONCE = 1_000_000


def byte_letters() -> list[str]:
    """The printable letter of every byte: itself where Latin-1 prints it, else the next free code point from 256 on."""
    free = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else chr(next(free)) for b in range(256)]


class WordBpe:
    """A tokenizer file's model."""

    #: Words of a generation; as many of the one before are remembered too.
    REMEMBERED = 120_000
    WIDE = 64

    def __init__(self, content: str):
        data = json.loads(content)
        vocab, merges = data["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.find_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.ids = {t.removesuffix(WORD_END) + END * t.endswith(WORD_END): i for t, i in vocab.items()}
        lengths: dict[str, set[int]] = {}  # of the tokens of three characters or more, by their first three
        for t in self.ids:
            if len(t) > 2:
                lengths.setdefault(t[:3], set()).add(len(t))
        self.lengths = {start: (*sorted(own, reverse=True), 2, 1) for start, own in lengths.items()}
        self.letters = str.maketrans(dict(zip(map(chr, range(256)), byte_letters(), strict=True)))
        self.pair_rank: dict[int, int] = {}
        self.made: list[int] = []
        size = max(vocab.values()) + 1
        self.size = size
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; -1: none does
        self.left, self.right = np.arange(size), np.arange(size)
        for r, (a, b) in enumerate(merges):
            i, j, made = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank.setdefault(i * size + j, r)
            self.made.append(made)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, i, j
        keys = np.fromiter(self.pair_rank, np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(self.pair_rank.values(), np.int64)[order]
        self.decimal = [str(i) for i in range(size)]
        self.now: dict[str, tuple[str, str]] = {}  # ids and text by word
        self.before: dict[str, tuple[str, str]] = {}
        self.merged_words = self.guessed_words = 0

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a and b stay apart when their joint text is encoded."""
        ok = np.ones(len(a), bool)
        a, b = a.copy(), b.copy()
        next_a, next_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            r = self._merge_rank(x, y)
            bad = (r < next_a[todo]) & (r <= next_b[todo]) & (r < NEVER)
            ok[todo[bad]] = False
            made_x, made_y = self.rank[x], self.rank[y]
            on = ~bad & ((made_x >= 0) | (made_y >= 0))
            todo, x, y, made_x, made_y = todo[on], x[on], y[on], made_x[on], made_y[on]
            undo_x = made_x > made_y  # the later of the two merges is undone; of equal ones that on the right
            at, back = todo[undo_x], todo[~undo_x]
            next_a[at], a[at] = made_x[undo_x], self.right[x[undo_x]]
            next_b[back], b[back] = made_y[~undo_x], self.left[y[~undo_x]]
        return ok

    def _guess(self, word: str) -> list[int]:
        out, at, last = [], 0, len(word) - 1
        find, lengths = self.ids.get, self.lengths
        while at < last:
            for n in lengths.get(word[at : at + 3], (2, 1)):
                # no token ends just before END
                if at + n != last and (t := find(word[at : at + n])) is not None:
                    out.append(t)
                    at += n
                    break
        return out

    def _letters(self, word: str) -> list[int]:
        return [self.ids[c] for c in word[:-2]] + [self.ids[word[-2:]]]

    def merged(self, word: str) -> list[int]:
        """The tokens of a word by merging: always the lowest rank, the leftmost of equal ones. For words of any length."""
        pieces = self._letters(word)
        n = len(pieces)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank_of, size = self.pair_rank.get, self.size
        heap = [(r, i, pieces[i], pieces[i + 1]) for i in range(n - 1) if (r := rank_of(pieces[i] * size + pieces[i + 1], NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if pieces[i] != a or j < 0 or pieces[j] != b:
                continue  # merged otherwise since
            pieces[i], pieces[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := rank_of(pieces[x] * size + pieces[y], NEVER)) < NEVER:
                    heapq.heappush(heap, (r, x, pieces[x], pieces[y]))
        return [t for t in pieces if t >= 0]

    def merged_together(self, words: list[str]) -> list[list[int]]:
        """The same for many words, a merge of each at a time. Words of more than ``WIDE`` letters go one by one."""
        out: list[list[int]] = [[]] * len(words)
        for low, high in ((2, 12), (12, 24), (24, self.WIDE)):
            own = [i for i, w in enumerate(words) if low < len(w) <= high]
            if own:
                for i, tokens in zip(own, self._merged_matrix([self._letters(words[i]) for i in own]), strict=True):
                    out[i] = tokens
        for i, w in enumerate(words):
            if not 2 < len(w) <= self.WIDE:
                out[i] = self.merged(w)
        return out

    def _merged_matrix(self, letters: list[list[int]]) -> list[list[int]]:
        sizes = np.array([len(x) for x in letters])
        wide = int(sizes.max()) + 1
        inside = np.arange(wide) < sizes[:, None]
        piece = np.full(inside.shape, -1, np.int64)
        piece[inside] = np.concatenate(letters)
        rank = np.full(inside.shape, NEVER, np.int64)
        pair = inside[:, 1:]
        rank[:, :-1][pair] = self._merge_rank(piece[:, :-1][pair], piece[:, 1:][pair])
        after, before = np.tile(np.arange(1, wide + 1), (len(letters), 1)), np.tile(np.arange(-1, wide - 1), (len(letters), 1))
        made = np.array(self.made)
        todo = np.arange(len(letters))
        while len(todo):
            at = rank[todo].argmin(axis=1)
            least = rank[todo, at]
            on = least < NEVER
            todo, at, least = todo[on], at[on], least[on]
            gone = after[todo, at]
            beyond = after[todo, gone]
            piece[todo, at], piece[todo, gone] = made[least], -1
            rank[todo, gone] = NEVER
            after[todo, at], before[todo, np.minimum(beyond, wide - 1)] = beyond, at
            for x, y in ((at, beyond), (before[todo, at], at)):
                ok = (x >= 0) & (y < wide)
                ok[ok] = piece[todo[ok], y[ok]] >= 0
                rank[todo[~ok & (x >= 0)], x[~ok & (x >= 0)]] = NEVER
                rank[todo[ok], x[ok]] = self._merge_rank(piece[todo[ok], x[ok]], piece[todo[ok], y[ok]])
        kept = piece >= 0
        ends = np.cumsum(kept.sum(axis=1))
        flat = piece[kept].tolist()
        return [flat[low:high] for low, high in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def words(self, words: list[str]) -> list[list[int]]:
        """The tokens of words that are written in byte letters and end with END."""
        guesses = [self._guess(w) for w in words]
        flat = np.fromiter((t for g in guesses for t in g), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(g) for g in guesses])
        inner = owner[1:] == owner[:-1]
        pair, back = np.unique(flat[:-1][inner] * self.size + flat[1:][inner], return_inverse=True)
        fits = self.fit(pair // self.size, pair % self.size)[back]
        wrong = set(owner[1:][inner][~fits].tolist())
        self.merged_words += len(wrong)
        self.guessed_words += len(words) - len(wrong)
        anew = dict(zip(sorted(wrong), self.merged_together([words[i] for i in sorted(wrong)]), strict=True))
        return [anew.get(i, g) for i, g in enumerate(guesses)]

    def split(self, text: str) -> list[str]:
        """The words of a text; an added token is END and its text."""
        if self.find_added and any(t in text for t in self.added):
            return [w for piece in self.find_added.split(text) for w in ([END + piece] if piece in self.added else self._words_of(piece))]
        return self._words_of(text)

    def _words_of(self, text: str) -> list[str]:
        if text.isascii():
            return SPLIT_ASCII.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (SPLIT_PLAIN if ODD_NUMBERS.isdisjoint(text) else SPLIT).findall(text)

    def _spelt(self, word: str) -> str:
        return (word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)) + END

    def learn(self, words: set[str]) -> None:
        """Encodes words that were not seen before. A full generation takes the place of the one before it; words of that are kept if they come again."""
        if len(self.now) > self.REMEMBERED:
            self.now, self.before = {}, self.now
        new = words.difference(self.now)
        again = new.intersection(self.before)
        self.now.update((w, self.before[w]) for w in again)
        new -= again
        plain = []
        for w in new:
            if w[0] == END and w[1:] in self.added:
                self.now[w] = (str(self.added[w[1:]]), w[1:])
            else:
                plain.append(w)
        decimal, text = self.decimal, self.text
        if plain:
            for word, tokens in zip(plain, self.words([self._spelt(w) for w in plain]), strict=True):
                self.now[word] = (" ".join([decimal[t] for t in tokens]), " ".join([text[t] for t in tokens]))

    def forget(self) -> None:
        """Lets go of all words: a worker goes on to other tasks and keeps the model only."""
        self.now, self.before = {}, {}

    def encode(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text its ids, as decimals, and its decoded text, both joined by spaces."""
        words = [self.split(t or "") for t in texts]
        self.learn(set().union(*words))
        both = [[*map(self.now.__getitem__, w)] for w in words]
        return [(" ".join([x[0] for x in b]), " ".join([x[1] for x in b])) for b in both]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text[i] for i in ids if i in self.text)


_MODELS: dict[int, WordBpe] = {}


def _model(shipped) -> WordBpe:
    """The worker's model of a broadcast tokenizer file; kept while the worker lives."""
    if shipped.value[0] not in _MODELS:
        _MODELS.clear()
        _MODELS[shipped.value[0]] = WordBpe(shipped.value[1])
    return _MODELS[shipped.value[0]]


def _ship(df: DataFrame, path: str):
    """The tokenizer file, a few MB whatever the data, to all executors."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(content.encode()).hexdigest(), content))


def _pieces(batches):
    """The batches in slices of about AT_ONCE characters of text."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // AT_ONCE
        cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for low, high in zip(cut, cut[1:], strict=False):
            if high > low:
                yield batch.slice(low, high - low)


def encode(docs: DataFrame, path: str, out: str = "ids") -> DataFrame:
    """docs with the token ids of ``text`` as ``out``, array<int>."""
    shipped = _ship(docs, path)

    def run(batches):
        model = _model(shipped)
        for part in _pieces(batches):
            ids = [np.fromstring(x, np.int32, sep=" ") if x else np.empty(0, np.int32) for x, _ in model.encode(part.column("text").to_pylist())]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, out])
        model.forget()

    return docs.mapInArrow(run, f"{ddl(docs.schema)}, `{out}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of the token ids as ``out``; null ids give an empty text, unknown ids give nothing."""
    shipped = _ship(df, path)

    def run(batches):
        model = _model(shipped)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                text = [model.decode(x or []) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*part.schema.names, out])

    return df.mapInArrow(run, f"{ddl(df.schema)}, `{out}` string")


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs."""
    shipped = _ship(docs, path)

    def run(batches):
        model = _model(shipped)
        for part in _pieces(batches):
            both = model.encode(part.column("text").to_pylist())
            sha = [[hashlib.sha256(x.encode()).hexdigest() for x in col] for col in zip(*both, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([ids.count(" ") + bool(ids) for ids, _ in both], pa.int64()), pa.array(sha[0]), pa.array(sha[1])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        model.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
