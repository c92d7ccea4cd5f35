"""Spelling variants: words one edit apart, found by an index of grams of variable length.

A word, with a mark at either end, is decomposed into one gram per position: two characters, made longer as long as what
has been read so far is frequent among all words, up to ``LONGEST``. Which grams one edit can affect is therefore known:
those that hold the edited place. From the most that any one place affects follows how many grams two near words share,
so that a word needs to be listed under few of its rarest grams only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within
from passageway.llm.common import written

#: The shortest and the longest gram.
SHORTEST, LONGEST = 2, 5
#: A gram is frequent if it begins at more than one in so many positions; so there are at most as many of each length.
POSITIONS = 1 << 14
#: Slots in which words are counted by their grams, to put grams in order of rarity.
SLOTS = 1 << 18
#: Words listed under one gram, above which they are listed under it and a second gram they must share.
LIST = 256
#: Words decomposed by one task.
TASK_WORDS = 20_000
_HELD = 1 << 18
_PAIRS = 1 << 19
_WIDTH = 48
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_BEGIN, _END = b"\x01", b"\x02"


def damaged(run: str, key: int, every: int) -> str:
    """``run`` without the code point h % length if ``every`` divides h, the crc32 of ``<doc_id>:<run>``; ``key`` is that
    of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), key)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the words of at least ``shortest`` code points and ``least`` occurrences in all whole texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased, one in ``every`` damaged as ``damaged`` says.
    Null texts have none; a null key is the empty text; repeated rows count again. Tasks add up before the shuffle, so a
    word found everywhere is a row per task.
    """

    def counted(batches):
        held: Counter = Counter()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, k in enumerate(batch.column(0).to_pylist()):
                start = zlib.crc32(f"{k}:".encode())
                for run, n in Counter(_RUN.findall(texts[i].as_py().translate(_LOWER).decode())).items():
                    word = damaged(run, start, every)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= _HELD:
                    yield _counts(held, "word")
                    held.clear()
        if held:
            yield _counts(held, "word")

    rows = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string"))
    return rows.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _counts(held: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=[name, "n"])


def decompose(word: bytes, frequent: set[bytes]) -> list[bytes]:
    """The gram at every position of a marked word: as short as may be, but longer while it is frequent."""
    end = len(word)
    grams = []
    for p in range(end - SHORTEST + 1):
        q = p + SHORTEST
        while q < end and q - p < LONGEST and word[p:q] in frequent:
            q += 1
        grams.append(word[p:q])
    return grams


def most_affected(grams: list[bytes]) -> int:
    """The most grams that one edit can affect: those that hold the deleted or replaced character. An insertion affects
    the grams that hold the characters on both sides of it, which are fewer."""
    change = np.zeros(len(grams) + SHORTEST, dtype=np.int64)
    start = np.arange(len(grams))
    np.add.at(change, start, 1)
    np.add.at(change, start + [len(g) for g in grams], -1)
    return int(np.cumsum(change)[1 : len(grams)].max())  # the marks at both ends are never edited


def numbered(grams: list[bytes]) -> list[int]:
    """Grams as numbers; a gram that is repeated in a word differs from its earlier occurrences."""
    seen: Counter = Counter()
    out = []
    for g in grams:
        out.append(int.from_bytes(g, "big") << 23 | seen[g])
        seen[g] += 1
    return out


def _slot(gram: int) -> int:
    return (gram * 0x9E3779B97F4A7C15 >> 40) & (SLOTS - 1)


def _words_of(batch: pa.RecordBatch) -> list[bytes]:
    return [w.encode("latin-1") for w in batch.column(0).to_pylist()]


def frequent_grams(words: DataFrame, positions: int) -> set[bytes]:
    """The grams shorter than ``LONGEST`` that begin at more than 1 / ``POSITIONS`` of all positions of ``words``: the
    inner nodes of the gram dictionary. There are at most ``POSITIONS`` of each length, whatever the number of words."""

    def counted(batches):
        held: Counter = Counter()
        for batch in batches:
            for w in _words_of(batch):
                word = _BEGIN + w + _END
                for size in range(SHORTEST, LONGEST):
                    held.update(word[p : p + size] for p in range(len(word) - size + 1))
                if len(held) >= _HELD:
                    yield _counts(held, "gram")
                    held.clear()
        if held:
            yield _counts(held, "gram")

    counts = words.select("word").mapInArrow(counted, "gram binary, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {bytes(r.gram) for r in counts.filter(F.col("n") * POSITIONS > positions).collect()}


def gram_counts(words: DataFrame, frequent) -> np.ndarray:
    """Number of words with a gram of each slot; a table of fixed size."""

    def counted(batches):
        held = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            found = [_slot(g) for w in _words_of(batch) for g in numbered(decompose(_BEGIN + w + _END, frequent.value))]
            held += np.bincount(np.array(found, dtype=np.int64), minlength=SLOTS)
        slots = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(held[slots])], names=["slot", "n"])

    rows = words.select("word").mapInArrow(counted, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, dtype=np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def lists_of(word: bytes, frequent: set[bytes], counts: np.ndarray) -> tuple[list[int], int, int]:
    """(keys, sketch, affected): the lists of a word, the bits of its grams, and the most grams an edit affects.

    A near word lacks at most ``affected`` of the grams. So among the ``affected`` + 1 rarest of either word there is one
    that both have (grams are in one order for all words). If that is in more than ``LIST`` words, a second one is asked
    for: among the ``affected`` + 2 rarest both words have two. A word of six characters has seven grams, of which an edit
    affects five at most.
    """
    grams = decompose(_BEGIN + word + _END, frequent)
    affected = most_affected(grams)
    numbers = numbered(grams)
    sketch = 0
    for g in numbers:
        sketch |= 1 << (g * 0xD6E8FEB86659FD93 >> 32 & 63)
    rarest = sorted((int(counts[_slot(g)]), g) for g in numbers)[: affected + 2]
    keys = set()
    for i, (n, g) in enumerate(rarest[: affected + 1]):
        if n <= LIST:
            keys.add(_mixed(g, 0))
        else:
            keys.update(_mixed(*sorted((g, h))) for j, (_, h) in enumerate(rarest) if j != i)
    return sorted(keys), sketch, affected


def _mixed(a: int, b: int) -> int:
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & ((1 << 64) - 1)
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & ((1 << 64) - 1)
    return (x ^ x >> 32) - (1 << 63)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced character makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class _Lists:
    """Complete lists of some keys: rows sorted by key and length of the word."""

    def __init__(self, rows: pa.Table):
        key = rows.column("key").to_numpy()
        word = rows.column("word").combine_chunks()
        length = np.diff(np.frombuffer(word.buffers()[1], dtype=np.int32)[word.offset : word.offset + len(word) + 1])
        order = np.lexsort((length, key))
        self.word = word.take(pa.array(order))
        self.key, self.length = key[order], length[order].astype(np.int64)
        self.sketch = rows.column("sketch").to_numpy()[order].astype(np.uint64)
        self.affected = rows.column("affected").to_numpy()[order]
        self.n = rows.column("n").to_numpy()[order]
        # Characters from the left and from the right; what is longer is compared one by one.
        start = np.frombuffer(self.word.buffers()[1], dtype=np.int32)[:-1].astype(np.int64)
        data = np.frombuffer(self.word.buffers()[2] or b"", dtype=np.uint8)
        place = np.arange(_WIDTH)
        inside = place < self.length[:, None]
        last = max(len(data) - 1, 0)
        self.left = np.where(inside, data[np.minimum(start[:, None] + place, last)], 0)
        self.right = np.where(inside, data[np.clip((start + self.length - 1)[:, None] - place, 0, last)], 0)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (a, b) of one list whose words are near, in stretches of bounded size."""
        n = len(self.key)
        _, group = np.unique(self.key, return_inverse=True)
        scale = int(self.length.max(initial=0)) + 3
        place = group * scale + self.length
        count = np.searchsorted(place, place + 1, side="right") - np.arange(n) - 1
        for a in np.flatnonzero(count > _PAIRS):  # more rows of a list than one stretch takes
            end = a + 1 + count[a]
            for b in range(a + 1, end, _PAIRS):
                others = np.arange(b, min(b + _PAIRS, end))
                yield self._near(np.full(len(others), a), others)
        count[count > _PAIRS] = 0
        upto = np.cumsum(count)
        at = 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, side="right")))
            repeat = count[at:stop]
            a = np.repeat(np.arange(at, stop), repeat)
            yield self._near(a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(repeat) - repeat, repeat))
            at = stop

    def _near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.sketch[a], self.sketch[b]
        shared = (np.bitwise_count(x & ~y) <= self.affected[a]) & (np.bitwise_count(y & ~x) <= self.affected[b])
        a, b = a[shared], b[shared]
        short = self.length[b] <= _WIDTH
        fits = np.zeros(len(a), dtype=bool)
        p, q = a[short], b[short]
        same = self.length[p] == self.length[q]
        ahead = _equal(self.left[p], self.left[q])
        behind = _equal(self.right[p], self.right[q])
        # Equal words share all; others may overlap by at most what repeats around the edit.
        fits[short] = np.where(same, ahead + behind == self.length[p] - 1, np.minimum(ahead, self.length[p]) + np.minimum(behind, self.length[p]) >= self.length[p])
        for i in np.flatnonzero(~short):
            fits[i] = one_edit(self.word[int(a[i])].as_py(), self.word[int(b[i])].as_py())
        return a[fits], b[fits]


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal leading columns."""
    differ = x != y
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all words one edit apart, both ways round, from (word, n) with different words of at least
    six characters of U+0001 above 2 and up to U+00FF. Pairs found in several lists come once."""
    positions, n_words = words.agg(F.sum(F.length("word") + 1), F.count("*")).first()
    parts = max(1, -(-n_words // TASK_WORDS))
    dealt = words.repartition(parts, "word") if parts > 1 else words
    context = words.sparkSession.sparkContext
    frequent = context.broadcast(frequent_grams(dealt, positions or 0))  # at most POSITIONS grams of each length
    counts = context.broadcast(gram_counts(dealt, frequent))  # one number per slot

    def listed(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for word, n in zip(_words_of(batch), batch.column(1).to_pylist()):
                keys, sketch, affected = lists_of(word, frequent.value, counts.value)
                for k in keys:
                    for column, value in zip(columns, (k, word, n, sketch - (1 << 64) if sketch >> 63 else sketch, affected)):
                        column.append(value)
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "word", "n", "sketch", "affected"])

    def compared(batches):
        carried = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            carried = rows if carried is None else pa.concat_tables([carried, rows])
            key = carried.column("key").to_numpy()
            done = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if done:  # the last list may go on in the next batch
                yield from near(carried.slice(0, done))
                carried = carried.slice(done).combine_chunks()
        if carried is not None and carried.num_rows:
            yield from near(carried)

    def near(rows):
        lists = _Lists(rows)
        for a, b in lists.pairs():
            if len(a):
                text = [w.decode("latin-1") for w in lists.word.take(pa.array(np.concatenate([a, b]))).to_pylist()]
                n = lists.n
                other = text[len(a) :] + text[: len(a)]
                yield pa.RecordBatch.from_arrays([pa.array(text), pa.array(other), pa.array(np.concatenate([n[b], n[a]]))], names=["word", "near", "near_n"])

    lists = dealt.select("word", "n").mapInArrow(listed, "key bigint, word binary, n bigint, sketch bigint, affected int")
    found = lists.repartition("key").sortWithinPartitions("key").mapInArrow(compared, "word string, near string, near_n bigint")
    return found.repartition("word").distinct()


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form reached. Each round doubles the steps taken, so chains as long as the
    number of times that a count can grow fivefold take a handful of rounds."""
    paths = written(forms.select("word", F.col("form").alias("root")), "paths")
    while True:
        ahead = broadcast_within(paths.select(F.col("word").alias("root"), F.col("root").alias("_next")))
        moved = written(paths.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "paths")
        paths = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return paths


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all ``words`` (word, n).

    Near words differ by one inserted, deleted or replaced code point; the form is the near word of largest n (ties:
    the smallest) if that is at least ``times`` the word's; the root is reached by following forms. A word has at most
    some hundred near words a character, so no group of links is large. No words give no rows.
    """
    # Smallest first: by falling n, then by code points, which is the order of UTF-8 bytes.
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("near")))
    links = near_words(words).groupBy("word").agg(best.alias("best"), F.count("*").alias("n_near"))
    fits = -F.col("best.minus_n") >= times * F.col("n")
    grouped = words.join(links, "word", "left").select(
        "word",
        F.when(fits, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, -F.col("best.minus_n")).alias("form_n"),
    )
    grouped = written(grouped, "forms")
    roots = follow_forms(grouped.filter("form IS NOT NULL"))
    return grouped.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all whole texts with the form and root of their spelling: ``count_words``, then ``group_variants``."""
    return group_variants(written(count_words(docs, key, text), "words"))
