"""Byte-level BPE: encoding by batched merge rounds over flat arrays, and decoding.

Files are those of the ``tokenizers`` library. Words that a batch of texts brings for the first time are laid end to end
in one array of symbols; each round looks up all adjacent pairs by binary search in the sorted merge pairs, finds the
lowest rank of every word and merges that pair wherever the word holds it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols above which a word is merged with a queue: it would need about as many rounds.
LONG = 2048
#: Words whose ids a task keeps; beyond that it starts anew.
KEPT = 1 << 17
#: Code points taken apart at once, of one text or several, and ids turned into bytes at once.
STRETCH = 1 << 20
_NONE = np.iinfo(np.int64).max
# No word reaches from a character into a space that follows it, so a text may be cut there.
_CUT = regex.compile(r"(?<=\S)(?= )")


def byte_signs() -> list[str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others as U+0100 and on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _stretched(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in order, as many at a time as have ``STRETCH`` code points between them, at least one."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > STRETCH:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


class Bpe:
    """Vocabulary, sorted merge pairs and special tokens of a file, and how to encode and decode with them.

    The file must be byte-level BPE without normalizer, prefix space, dropout or options of added tokens. Its truncation
    and padding are not used. Strings of added tokens are recognised in texts, as the library does by default.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = spec.get("added_tokens") or []
        flags = any(t[x] for t in added for x in ("single_word", "lstrip", "rstrip", "normalized"))
        kinds = model["type"], before["type"], (spec["decoder"] or {}).get("type")
        if kinds != ("BPE", "ByteLevel", "ByteLevel") or not plain or flags or spec["normalizer"] or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("not a plain byte-level BPE file")
        self.word = regex.compile(pattern)
        vocab = model["vocab"]
        signs = byte_signs()
        self.first = np.array([vocab[s] for s in signs], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.pairs, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None

        of_sign = {s: b for b, s in enumerate(signs)}
        known = {i: bytes(map(of_sign.__getitem__, t)) for t, i in vocab.items() if t not in self.special}
        known |= {i: t.encode() for t, i in self.special.items()}
        tokens = [known.get(i, b"") for i in range(max(known) + 1)]
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        """Words seen, and where the ids of each begin in the table of ids."""
        self.place = {t: i for i, t in enumerate(self.special)}
        self.ids = np.array(list(self.special.values()), dtype=np.int32)
        self.ends = np.arange(len(self.special) + 1, dtype=np.int64)

    def _stretches(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some of them at a time; special tokens are words of their own."""
        for i, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if i % 2:
                yield [part]
                continue
            at = 0
            while at < len(part):
                cut = _CUT.search(part, at + STRETCH) if len(part) - at > STRETCH else None
                end = cut.start() if cut else len(part)
                yield self.word.findall(part, at, end) if cut is None and at == 0 else self.word.findall(part[at:end])
                at = end

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and where each text's begin (one more at the end)."""
        parts, sizes = [np.zeros(0, dtype=np.int32)], []
        for some in _stretched(texts):
            ids, begin = self._encode(some)
            parts.append(ids)
            sizes += np.diff(begin).tolist()
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > KEPT:
            self._forget()
        spelled, new, sizes = [], [], []
        for text in texts:
            size = 0
            for words in self._stretches(text):
                place = self.place
                for w in set(words).difference(place):
                    place[w] = len(place)
                    new.append(w)
                spelled.append(np.fromiter(map(place.__getitem__, words), dtype=np.int32, count=len(words)))
                size += len(words)
            sizes.append(size)
        if new:
            ids, ends = self.merge([w.encode() for w in new])
            self.ends = np.concatenate([self.ends, self.ends[-1] + ends[1:]])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        word = np.concatenate([*spelled, np.zeros(0, dtype=np.int32)])
        begin, count = self.ends[word], self.ends[word + 1] - self.ends[word]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, by binary search over the sorted pairs; ``_NONE`` for those that never merge."""
        if not len(self.pairs):
            return np.full(len(left), _NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, end to end, and where each word's begin (one more at the end)."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        long = {i: self._merge_long(words[i]) for i in np.flatnonzero(size > LONG).tolist()}
        symbol = self.first[np.frombuffer(b"".join(w for i, w in enumerate(words) if i not in long), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), np.where(size > LONG, 0, size))
        done_symbol, done_owner = [np.array(x, dtype=np.int64) for x in long.values()], [np.full(len(x), i) for i, x in long.items()]
        # The rank of the pair that begins at each symbol.
        rank = np.full(len(symbol), _NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, begin)
            count = np.diff(np.concatenate([begin, [len(symbol)]]))
            if (lowest == _NONE).any():
                ready = np.repeat(lowest == _NONE, count)
                done_symbol.append(symbol[ready])
                done_owner.append(owner[ready])
                symbol, owner, rank = symbol[~ready], owner[~ready], rank[~ready]
                count, lowest = count[lowest != _NONE], lowest[lowest != _NONE]
            if not len(symbol):
                break
            hit = rank == np.repeat(lowest, count)
            # Of overlapping pairs (a a a) the first, third, ... merge: neighbours in a run of hits alternate.
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit, -1, place))
            hit &= (place - run) % 2 == 1
            at = np.flatnonzero(hit)
            symbol[at] = self.merged[rank[at]]
            kept = np.ones(len(symbol), dtype=bool)
            kept[at + 1] = False
            moved = (np.cumsum(kept) - 1)[at]
            symbol, owner, rank = symbol[kept], owner[kept], rank[kept]
            # Only pairs that hold a new symbol have a new rank.
            changed = np.concatenate([moved, moved[moved > 0] - 1])
            rank[changed] = _NONE
            changed = changed[changed + 1 < len(symbol)]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self._rank(symbol[changed], symbol[changed + 1])
        owner = np.concatenate([*done_owner, np.zeros(0, dtype=np.int64)])
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate([*done_symbol, np.zeros(0, dtype=np.int64)])[order]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for one word of any length: its pairs wait in a queue by rank, then place."""
        symbol = self.first[np.frombuffer(word, dtype=np.uint8)]
        ranks = self._rank(symbol[:-1], symbol[1:])
        queue = [(r, i) for i, r in enumerate(ranks.tolist()) if r != _NONE]
        heapq.heapify(queue)
        rank = [*ranks.tolist(), _NONE]
        symbols = symbol.tolist()
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        ranked = self._ranked()
        while queue:
            r, i = heapq.heappop(queue)
            if rank[i] != r:
                continue  # merged away, or another pair by now
            gone = after[i]
            symbols[i], symbols[gone] = int(self.merged[r]), -1
            rank[gone] = _NONE
            after[i] = after[gone]
            if after[i] < len(symbols):
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0:
                    b = after[a]
                    rank[a] = ranked.get(symbols[a] << 32 | symbols[b], _NONE) if b < len(symbols) else _NONE
                    if rank[a] != _NONE:
                        heapq.heappush(queue, (rank[a], a))
        return [s for s in symbols if s >= 0]

    def _ranked(self) -> dict[int, int]:
        if not hasattr(self, "_rank_of"):
            self._rank_of = dict(zip(self.pairs.tolist(), self.ranks.tolist()))
        return self._rank_of

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, special tokens included; ids that the file does not have give nothing."""
        ids = ids[(ids >= 0) & (ids < len(self.length))]
        parts = []
        for at in range(0, len(ids), STRETCH):
            some = ids[at : at + STRETCH]
            size = self.length[some]
            upto = np.cumsum(size)
            parts.append(self.bytes[np.repeat(self.start[some] - upto + size, size) + np.arange(upto[-1])].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


_LOADED: dict[tuple[str, str], Bpe] = {}


def _loaded(path: str, pattern: str) -> Bpe:
    """One per worker and file; workers outlive tasks."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(path, pattern)
    return _LOADED[path, pattern]


def encode(text: Column | str, path: str, pattern: str) -> Column:
    """Token ids (array<int>) of whole texts, as the ``tokenizers`` library gives for the file at ``path`` without added
    special tokens, truncation or padding. ``pattern`` is the word pattern that byte-level files of this kind share.

    Null texts are empty and have no ids; a text of any length is encoded whole, in stretches that end where no word can
    reach across. The ids depend on the text alone.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        found, begin = _loaded(path, pattern).encode(t.as_py() for t in texts)
        return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(found))

    c = F.col(text) if isinstance(text, str) else text
    return ids(F.coalesce(c.cast("string"), F.lit("")))


def decode(ids: Column | str, path: str, pattern: str) -> Column:
    """The text of token ids (array<int>), special tokens included. Bytes that are not UTF-8, as ids that were cut within
    a character leave them, become U+FFFD. Null is null; null and unknown ids give nothing."""

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        bpe = _loaded(path, pattern)
        return pa.array([None if x.values is None else bpe.decode(_numbers(x.values)) for x in lists], pa.string())

    return text(_made(ids))


def ids_digest(ids: Column | str) -> Column:
    """Lower-case hex SHA-256 of ids as little-endian unsigned 32-bit integers; null is null."""
    import hashlib

    @F.arrow_udf("string")
    def digest(lists: pa.Array) -> pa.Array:
        return pa.array([None if x.values is None else hashlib.sha256(_numbers(x.values).astype("<u4").tobytes()).hexdigest() for x in lists], pa.string())

    return digest(_made(ids))


def _made(ids: Column | str) -> Column:
    """The same ids, as an expression that Spark evaluates between Python functions: without it, each function of
    encoded ids would be chained to an encoding of its own."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.when(F.size(c) >= 0, c)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
