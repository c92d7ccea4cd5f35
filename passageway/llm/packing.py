"""Packing documents into sequences of tokens by patterns fitted to the histogram of lengths."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageway.llm.common import written
from passageway.llm.order import hash_part, running_sum

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Texts of Latin letters, digits and ASCII signs: both libraries split these alike, whatever their Unicode version.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ɏ]*\Z")
_CUT = re.compile(r"(?<=\S)(?= )")


class Encoder:
    """Token ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    Such a tokenizer never joins a character with a space that follows it, so a text may be cut there. Stretches in
    Latin script are encoded by ``tiktoken`` with the vocabulary of the same file (the ids are the same, in a third of
    the time), forms with other characters by ``tokenizers``.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], {t["content"] for t in spec.get("added_tokens", [])}
        signs = _byte_signs()
        ranks = {bytes(map(signs.__getitem__, k)): v for k, v in model["vocab"].items() if k not in added}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # Strings of added tokens in a text are those tokens, as the library has it unless told otherwise.
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(longest_first) + ")") if self.added else None

    def _stretch(self, text: str, plain: bool) -> np.ndarray:
        if plain:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids of the text and id 0 at the end."""
        parts = []
        for i, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if i % 2:
                parts.append([self.added[part]])
            elif _PLAIN.match(part):
                parts.append(self._stretch(part, True))
            else:
                runs = groupby(_CUT.split(part), lambda form: bool(_PLAIN.match(form)))
                parts += [self._stretch("".join(forms), plain) for plain, forms in runs]
        return np.concatenate([*parts, [0]]).astype("<u4", copy=False)


def _byte_signs() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or 256 and on for the others."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 2048, text: str = "text") -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32. A document is its ids and id 0 at the end; only
    longer ones than ``capacity`` are cut, into full pieces with the shorter one in front. Null texts are empty."""

    def cut(batches):
        encoder = Encoder(tokenizer, pattern)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(content.as_py() or "")
                at = 0
                for k in range(-(-len(ids) // capacity)):
                    size = (len(ids) - 1) % capacity + 1 if k == 0 else capacity
                    for column, value in zip(out, (key, k, at, size, zlib.crc32(ids[at : at + size].tobytes()))):
                        column.append(value)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string")).mapInArrow(cut, PIECES)


def patterns_of(total: int, most: int = 3) -> np.ndarray:
    """All ways to write ``total`` as a sum of at most ``most`` (2 or 3) whole numbers, one a row, 0 where there are fewer."""
    a = np.arange(1, total // 2 + 1)
    rows = [np.array([[total, 0, 0]]), np.stack([total - a, a, 0 * a], 1)]
    if most > 2:
        for small in range(1, total // 3 + 1):
            mid = np.arange(small, (total - small) // 2 + 1)
            rows.append(np.stack([total - small - mid, mid, np.full_like(mid, small)], 1))
    return np.concatenate(rows)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, enter: int = 128, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares by an active set: repeat counts x of patterns that bring A x close to the histogram.

    A has one row per length and holds the number of a pattern's parts of that length; it is formed for the active
    patterns only. In each round up to ``enter`` patterns of steepest descent that share no length enter together, and
    those that least squares makes negative leave, until none is negative.
    """
    size = len(histogram)
    scale = max(1.0, float(histogram.max(initial=0)))
    target = histogram / scale
    active, x, columns, rest = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((size, 0)), target.copy()
    for _ in range(rounds):
        gain = rest.copy()
        gain[0] = 0.0
        steep = gain[patterns].sum(1)
        steep[active] = 0.0
        best = _apart(patterns, steep, enter)
        if not len(best):
            break
        new = np.zeros((size, len(best)))
        for j, parts in enumerate(patterns[best]):
            np.add.at(new[:, j], parts[parts > 0], 1)
        active, columns = np.concatenate([active, best]), np.hstack([columns, new])
        while True:
            x = np.linalg.solve(columns.T @ columns + 1e-8 * np.eye(len(active)), columns.T @ target)
            if (x >= 0).all():
                break
            active, columns = active[x >= 0], columns[:, x >= 0]
        rest = target - columns @ x
    return active, x * scale


def _apart(patterns: np.ndarray, steep: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the steepest patterns, no two with a length in common."""
    pool = np.argpartition(-steep, min(64 * most, len(steep) - 1))[: 64 * most]
    pool = pool[steep[pool] > 1e-6]
    used: set[int] = set()
    chosen = []
    for i in pool[np.argsort(-steep[pool], kind="stable")]:
        parts = {int(p) for p in patterns[i] if p}
        if used.isdisjoint(parts):
            used |= parts
            chosen.append(i)
            if len(chosen) == most:
                break
    return np.array(chosen, dtype=np.int64)


class Packing:
    """Groups of equal sequences: the lengths they hold, in order, and how many there are."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.count = capacity, [], []
        self.open: dict[int, list[int]] = defaultdict(list)
        self.free = np.zeros(capacity + 1, dtype=bool)

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        space = self.capacity - sum(lengths)
        self.held.append(lengths)
        self.count.append(count)
        self.open[space].append(len(self.count) - 1)
        self.free[space] = True

    def place(self, length: int, left: int) -> None:
        """Best fit: ``left`` pieces go where least space stays, then into new sequences."""
        while left:
            fits = np.flatnonzero(self.free[length:])
            if not len(fits):
                break
            space = length + int(fits[0])
            group = self.open[space].pop()
            if not self.open[space]:
                self.free[space] = False
            n = min(left, self.count[group])
            if n < self.count[group]:
                self.count[group] -= n
                self.open[space].append(group)
                self.free[space] = True
            else:
                self.count[group] = 0
            self.add((*self.held[group], length), n)
            left -= n
        if left:
            each = self.capacity // length
            if left // each:
                self.add((length,) * each, left // each)
            if left % each:
                self.add((length,) * (left % each), 1)


def pack_histogram(counts: dict[int, int], capacity: int = 2048, bins: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for the pieces counted by length: (lengths in order, how many such sequences).

    Repeats of patterns of at most three lengths that fill a sequence (above ``bins`` lengths: classes of lengths,
    rounded up) are fitted by non-negative least squares, rounded down and kept within what there is. The pieces left
    are packed by best fit, longest first, also into the space that patterns leave. Everything here works on the histogram, so its
    cost depends on ``capacity`` alone.
    """
    left = {n: c for n, c in counts.items() if c}
    packing = Packing(capacity)
    if left.get(capacity):
        packing.add((capacity,), left.pop(capacity))
    width = -(-capacity // bins)
    bins = capacity // width
    stock: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        stock[-(-n // width)].append(n)  # the longest is taken first, from the end
    histogram = np.zeros(bins + 1)
    for b, lengths in stock.items():
        if b <= bins:
            histogram[b] = sum(left[n] for n in lengths)
    if bins >= 3 and histogram.any():
        patterns = patterns_of(bins)
        present = histogram > 0
        present[0] = True
        patterns = patterns[present[patterns].all(1)]
        if len(patterns):
            chosen, repeats = fit_repeats(patterns, histogram)
            for i in np.argsort(-repeats, kind="stable"):
                parts = [int(p) for p in patterns[chosen[i]] if p]
                has = min(int(histogram[p]) // parts.count(p) for p in set(parts))
                n = min(int(repeats[i] + 1e-6), has)
                for p in parts:
                    histogram[p] -= n
                while n:
                    lengths, taken = [], n
                    trial = dict.fromkeys(parts, 0)
                    for p in parts:
                        lengths.append(stock[p][-1])
                        trial[p] += 1
                    taken = min(n, *(max(1, left[stock[p][-1]] // trial[p]) for p in parts))
                    if any(left[stock[p][-1]] < trial[p] for p in parts):  # two parts, one piece of the longest left
                        taken, lengths = 1, []
                        for p in parts:
                            lengths.append(stock[p][-1])
                            left[lengths[-1]] -= 1
                            if not left[lengths[-1]]:
                                stock[p].pop()
                    else:
                        for p in parts:
                            left[stock[p][-1]] -= taken
                        for p in set(parts):
                            if not left[stock[p][-1]]:
                                stock[p].pop()
                    packing.add(tuple(lengths), taken)
                    n -= taken
    for length in sorted((n for n, c in left.items() if c), reverse=True):
        packing.place(length, left[length])
    return [(h, c) for h, c in zip(packing.held, packing.count) if c]


def slots(packed: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of a length go, by their rank: (length, first rank, end rank, sequence of the first, offset)."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, count in packed:
        offset = 0
        for n in lengths:
            out.append((n, used[n], used[n] + count, sequence, offset))
            used[n] += count
            offset += n
        sequence += count
    return out


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    Only the histogram of lengths (at most ``capacity`` numbers) reaches the driver, and the plan that goes back is
    bounded by ``capacity`` too: it has the runs of equal sequences. Pieces of a length are ranked by hashed parts, so a
    length that a third of all pieces have is no burden for one task. Repeated rows are packed as pieces of their own.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = slots(pack_histogram(counts, capacity))
    where = spark.createDataFrame(plan, "length bigint, _from bigint, _to bigint, _sequence bigint, offset bigint")
    ranked = pieces.withColumns({"_one": F.lit(1).cast("bigint"), "_class": F.lit(0).cast("bigint"), "_part": hash_part(F.col("doc_id"), F.col("piece"))})
    ranked = running_sum(ranked, ["length"], "_one", "_class", "_part", ["doc_id", "piece", "start", "ids_crc32"], "_rank")
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1)
    placed = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (ranked["_rank"] >= where["_from"]) & (ranked["_rank"] < where["_to"]))
    sequence = F.col("_sequence") + F.col("_rank") - F.col("_from")
    return placed.select(*(pieces[c] for c in pieces.columns), sequence.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with id 0; null doc_ids stay null; repeated rows are separate documents; an
    empty table gives no rows; other columns of ``docs`` are not read.
    """
    return pack_pieces(written(token_pieces(docs, tokenizer, pattern, capacity), "pieces"), capacity)
