"""Scoring texts by a hierarchical Pitman-Yor model of word pairs.

Every word is a context, a restaurant whose dishes are the words that follow it; all contexts share one parent, whose
dishes come from the smoothed word counts. A context's predictive probability of a word is

    (c - d * t) / (s + n)  +  (s + d * T) / (s + n) * parent(word)

with c customers and t tables of the dish, n customers and T tables of the restaurant, discount d and strength s. The
tables are sampled by Gibbs sweeps. Every table of a context is a customer of the parent, whose tables are sampled in
turn given these; contexts and parent take turns for several rounds. The tables of the last round's samples are averaged:
given the other level, a probability is linear in them, so that averages the probabilities.

The work is dealt by a hash of (context, word), so no context or word, however frequent, belongs to one task: a
restaurant is spread over all buckets, and what its parts must know of one another (customers and dishes in all) comes
back from an exchange by word, and so do the sums of tables after every round, from which the next one goes on: one total
per restaurant, whatever the number of buckets. Rows hold packed arrays, and a bucket's share of the text is bounded.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text for one bucket, and for one block of documents in a map task.
BUCKET_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
#: Bytes of text that are hashed at once (a longer text alone).
HASHED_BYTES = 1 << 18
#: Pairs that are dealt to buckets at once.
STRETCH = 1 << 18
#: Bytes of cells that leave a map task at once.
SENT_BYTES = 1 << 21
#: Words are told apart by 48 bits of a hash.
_WORD = np.uint64((1 << 48) - 1)
END = np.uint64(1)
#: Entries of a block are sorted as one number if they fit into so many bits.
KEY_BITS = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEP = np.zeros(256, dtype=bool)
_SEP[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
#: Documents whose sums over the buckets of a task are held at once (25 bytes each).
HELD_DOCS = 1 << 20
#: Up to so many customers of a dish the number of tables is drawn from its exact conditional.
EXACT = 512


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by ``END``, and the number of tokens of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sep = _SEP[data]
    inside = ~sep
    starts = np.flatnonzero(inside[1:] & sep[:-1]) + 1
    if len(inside) and inside[0]:
        starts = np.concatenate(([0], starts))
    ends = np.flatnonzero(sep[1:] & inside[:-1]) + 1
    lengths = ends - starts
    if len(starts):
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        power = np.full(int(lengths.max()), _STEP, dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        sums = np.add.reduceat(_BYTE[data[inside]] * power[place], first)
        words = _mix(sums + lengths.astype(np.uint64)) & _WORD
        words[words <= END] += np.uint64(2)
    else:
        words = np.zeros(0, dtype=np.uint64)
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return np.insert(words, upto, END), np.diff(upto, prepend=0) + 1


def _hashed(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` in bounded memory."""
    done, group, size = [], [], 0
    for text in texts:
        if group and size + len(text) > HASHED_BYTES:
            done.append(word_hashes(group))
            group, size = [], 0
        group.append(text)
        size += len(text)
    words, numbers = zip(*done, word_hashes(group))
    return np.concatenate(words), np.concatenate(numbers)


def _coded(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words of all texts in order, the place of every token among them, and the number of tokens of each text."""
    hashed, n = _hashed(texts)
    order = np.argsort(hashed)
    hashed = hashed[order]
    new = np.concatenate(([True], hashed[1:] != hashed[:-1]))
    words = hashed[new]
    del hashed
    code = np.empty(len(order), dtype=np.int32)
    code[order] = np.cumsum(new, dtype=np.int32) - 1
    return words, code, n


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _planes(x: np.ndarray, kind: str) -> bytes:
    """All first bytes of the numbers, then all second ones, and so on: high bytes are mostly 0 and compress away."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, width).T).tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _counts(x: np.ndarray) -> bytes:
    """Counts, most of them small: a byte or less each."""
    return zlib.compress(_planes(x, "<i8"), 1)


def _from_counts(raw: bytes) -> np.ndarray:
    return _from_planes(zlib.decompress(raw), "<i8")


def _gaps(words: np.ndarray) -> bytes:
    """Hashes in order, each by its distance from the one before; of most distances the high bytes say little."""
    raw = _planes(np.diff(words, prepend=np.uint64(0)), "<u8")
    return raw[: len(raw) // 2] + zlib.compress(raw[len(raw) // 2 :], 1) + len(words).to_bytes(4, "little")


def _from_gaps(raw: bytes) -> np.ndarray:
    low = 4 * int.from_bytes(raw[-4:], "little")
    return np.cumsum(_from_planes(raw[:low] + zlib.decompress(raw[low:-4]), "<u8"), dtype=np.uint64)


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _from_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool)


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(u * _STEP + w)


PACKED = "bucket int, block bigint, kind int, a binary, b binary, c binary, d binary, e binary"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(_KINDS)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def _ordered(u: np.ndarray, w: np.ndarray, doc: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """The distinct pairs in order, where the documents of each begin, the documents, and how often each has the pair; each
    number is below that of ``sizes``."""
    bits = [max(1, int(x - 1).bit_length()) for x in sizes]
    if sum(bits) <= KEY_BITS:  # as one number, which is sorted by value
        key = u.astype(np.uint64)
        for column, width in zip((w, doc), bits[1:]):
            key <<= np.uint64(width)
            np.bitwise_or(key, column, out=key, dtype=np.uint64, casting="unsafe")
        key.sort()
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        number = np.diff(at, append=len(key)).astype(np.uint32)
        key = key[at]
        doc = (key & np.uint64((1 << bits[2]) - 1)).astype(np.uint16)
        key >>= np.uint64(bits[2])
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key = key[at]
        return [(key >> np.uint64(bits[1])).astype(np.int32), (key & np.uint64((1 << bits[1]) - 1)).astype(np.int32), at, doc, number]
    order = np.lexsort((doc, w, u))
    u, w, doc = u[order], w[order], doc[order]
    new = np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
    at = np.flatnonzero(new | np.concatenate(([True], doc[1:] != doc[:-1])))
    number = np.diff(at, append=len(order)).astype(np.uint32)
    starts = np.flatnonzero(new[at])
    return [*(c[at[starts]].astype(np.int32) for c in (u, w)), starts, doc[at].astype(np.uint16), number]


def _cells(blocks: int):
    """Map side: per block and bucket the distinct (context, word, document) with their numbers (kind 0), and per
    block its documents (kind 1).

    A cell names each of its words once, in order, and then by its place. Documents to learn from come first in a block,
    so a cell holds how many they are and no flag for each."""

    def block_rows(ids: pa.Array, texts: Iterable[bytes], held: np.ndarray, block: int) -> Iterable[tuple]:
        words, w, n = _coded(texts)
        turn = np.argsort(held, kind="stable")
        place = np.empty(len(n), dtype=np.int32)
        place[turn] = np.arange(len(n))
        u = np.concatenate((np.zeros(1, dtype=np.int32), w[:-1]))  # the end of a text, the smallest word, is the context of the next one's first word
        u, w, starts, doc, number = _ordered(u, w, np.repeat(place, n), [len(words), len(words), len(n)])
        documents = np.diff(starts, append=len(doc))
        bucket = np.empty(len(u), dtype=np.min_scalar_type(blocks))
        for i in range(0, len(u), STRETCH):
            part = slice(i, i + STRETCH)
            bucket[part] = (_pair(words[u[part]], words[w[part]]) >> np.uint64(20)) % np.uint64(blocks)
        cuts = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=blocks))))
        bucket = np.argsort(bucket, kind="stable").astype(np.int32)
        trained = len(n) - int(held.sum())
        at = np.empty(len(words), dtype=np.int32)
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            pairs = bucket[cuts[i] : cuts[i + 1]]
            of_pairs, word, shared = u[pairs], w[pairs], documents[pairs]
            entries = np.repeat(starts[pairs] - (np.cumsum(shared) - shared), shared) + np.arange(int(shared.sum()))
            runs = np.flatnonzero(np.concatenate(([True], of_pairs[1:] != of_pairs[:-1])))
            named = np.sort(np.concatenate((of_pairs[runs], word)))
            named = named[np.flatnonzero(np.diff(named, prepend=-1))]
            at[named] = np.arange(len(named))
            context = np.zeros(len(named), dtype=bool)
            context[at[of_pairs[runs]]] = True
            heads = _bits(context) + zlib.compress(_planes(np.diff(runs, append=len(pairs)), "<u4"), 1)
            places = _planes(at[word], "<u4")
            followers = places[: len(word)] + zlib.compress(places[len(word) :] + _planes(shared, "<u4"), 1)
            sums = zlib.compress(_planes(doc[entries], "<u2") + _planes(number[entries], "<u4"), 1)
            sizes = np.array([len(entries), len(n), trained], dtype="<i8").tobytes()
            yield i, block, 0, _gaps(words[named]), heads, followers, sums, sizes
        keys = ids.take(pa.array(turn))
        present = np.array(keys.is_valid(), dtype=np.uint8).tobytes()
        flags = held[turn].astype(np.uint8).tobytes()
        yield block % blocks, block, 1, keys.fill_null(0).to_numpy().astype("<i8").tobytes(), n[turn].astype("<i8").tobytes(), present, b"", flags

    def cells(batches):
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, texts, held = batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.binary()), batch.column(2).to_numpy(zero_copy_only=False)
            upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
            first = 0
            while first < len(texts):
                last = int(np.searchsorted(upto, upto[first] + BLOCK_BYTES, side="right")) - 1
                part = slice(first, min(max(last, first + 1), first + (1 << 16)))
                first = part.stop
                rows, size = [], 0
                for row in block_rows(ids[part], (x.as_py() or b"" for x in texts[part]), held[part].astype(bool), block):
                    rows.append(row)
                    size += sum(map(len, row[3:]))
                    if size > SENT_BYTES:
                        yield from _table(rows).to_batches()
                        rows, size = [], 0
                yield from _table(rows).to_batches()
                block += 1

    return cells


class Bucket:
    """All cells of a bucket: entries (row, document, number) in order of their (context, word) pair; not ``whole``: only the
    pairs and how often those to learn from have them."""

    def __init__(self, rows: pa.Table, whole: bool = True):
        cells = sorted(rows.filter(pc.equal(rows.column("kind"), 0)).to_pylist(), key=lambda r: r["block"])
        sizes = np.array([np.frombuffer(r["e"], dtype="<i8") for r in cells], dtype=np.int64).reshape(-1, 3)
        self.cells, self.docs = [(r["bucket"], r["block"]) for r in cells], sizes[:, 1]
        entries = int(sizes[:, 0].sum())
        self.words = np.unique(np.concatenate([_from_gaps(r["a"]) for r in cells] or [np.zeros(0, dtype=np.uint64)]))
        key = np.empty(entries, dtype=np.uint64)
        doc, number, row = np.empty(entries, dtype=np.uint16), np.empty(entries, dtype=np.uint32), np.empty(entries, dtype=np.int32)
        at = 0
        for k, size in enumerate(sizes[:, 0].tolist()):
            r, cells[k] = cells[k], None
            part = slice(at, at := at + size)
            code = np.searchsorted(self.words, _from_gaps(r["a"])).astype(np.uint64)
            bits = -(-len(code) // 8)
            context = np.flatnonzero(_from_bits(r["b"][:bits], len(code)))
            of_pairs = np.repeat(context, _from_planes(zlib.decompress(r["b"][bits:]), "<u4"))
            n = len(of_pairs)
            rest = zlib.decompress(r["c"][n:])
            word = _from_planes(r["c"][:n] + rest[: 3 * n], "<u4")
            key[part] = np.repeat(code[of_pairs] << np.uint64(32) | code[word], _from_planes(rest[3 * n :], "<u4"))
            raw = zlib.decompress(r["d"])
            doc[part], number[part], row[part] = _from_planes(raw[: 2 * size], "<u2"), _from_planes(raw[2 * size :], "<u4"), k
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        # Places of the contexts and words among ``words``.
        self.iu, self.iw = (key[starts] >> np.uint64(32)).astype(np.int32), (key[starts] & np.uint64((1 << 32) - 1)).astype(np.int32)
        del key
        trained = np.where(doc < sizes[row, 2], number, 0)[order]
        self.count = np.add.reduceat(trained, starts, dtype=np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
        if whole:
            self.doc, self.number, self.row = doc[order], number[order], row[order]
            self.pair = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(starts, append=entries))

        self.is_context, self.is_dish = np.zeros((2, len(self.words)), dtype=bool)
        self.is_context[self.iu] = True
        self.is_dish[self.iw] = True

    def cuts(self, parts: int) -> np.ndarray:
        """Where each part of the words begins: a part is a range of hashes."""
        return np.searchsorted(self.words, np.array([(i << 48) // parts for i in range(parts + 1)], dtype=np.uint64))


class Asked:
    """What buckets ask of a part of the words: which words, and which of them they have as contexts and as dishes."""

    def __init__(self, rows: list[dict]):
        lists = [_from_gaps(r["a"]) for r in rows]
        marks = [(r["e"][16:], len(x)) for r, x in zip(rows, lists)]
        self.is_context = [_from_bits(raw[: -(-n // 8)], n) for raw, n in marks]
        self.is_dish = [_from_bits(raw[-(-n // 8) :], n) for raw, n in marks]
        self.words, self.where = np.unique(np.concatenate(lists), return_inverse=True)
        ends = np.cumsum([len(x) for x in lists])
        self.own = [self.where[end - len(x) : end] for end, x in zip(ends, lists)]
        self._of_contexts, self._of_dishes = (self.where[np.concatenate(m)] for m in (self.is_context, self.is_dish))

    def _sums(self, where: np.ndarray, raws: list[bytes]) -> np.ndarray:
        return np.bincount(where, np.concatenate([_from_counts(x) for x in raws]), minlength=len(self.words))

    def by_context(self, raws: list[bytes]) -> np.ndarray:
        return self._sums(self._of_contexts, raws)

    def by_dish(self, raws: list[bytes]) -> np.ndarray:
        return self._sums(self._of_dishes, raws)


def _statistics(parts: int):
    """Per bucket and part of the words: the words with their customers, contexts (of dishes) and followers (of contexts)
    in this bucket."""

    def statistics(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        x = Bucket(rows, whole=False)
        iu, iw = x.iu, x.iw
        seen = (x.count > 0).astype(float)
        n = len(x.words)
        numbers = [np.bincount(i, v, minlength=n) for i, v in ((iw, x.count), (iw, seen), (iu, seen))]
        cuts = x.cuts(parts)
        ones = np.array([(x.count == 1).sum(), (x.count == 2).sum()], dtype="<i8").tobytes()
        out = []
        for p in sorted({*np.flatnonzero(np.diff(cuts)).tolist(), bucket % parts}):
            part = slice(cuts[p], cuts[p + 1])
            context, dish = x.is_context[part], x.is_dish[part]
            counts = (_counts(v[part][m]) for v, m in zip(numbers, (dish, dish, context)))
            out.append((p, bucket, 0, _gaps(x.words[part]), *counts, (ones if p == bucket % parts else bytes(16)) + _bits(context) + _bits(dish)))
        return _table(out)

    return statistics


def _answers(rows: pa.Table) -> pa.Table:
    """Per part of the words: sums over all buckets, sent back to each bucket in its order (kind 2), and the part's
    totals (kind 3)."""
    part = rows.column("bucket")[0].as_py()
    asked = rows.to_pylist()
    x = Asked(asked)
    customers, contexts = (x.by_dish([r[c] for r in asked]).astype("<i8") for c in "bc")
    followers = x.by_context([r["d"] for r in asked]).astype("<i8")
    out = []
    for r, own, context, dish in zip(asked, x.own, x.is_context, x.is_dish):
        out.append((r["block"], part, 2, _counts(customers[own]), _counts(contexts[own[dish]]), _counts(followers[own[context]]), b"", b""))
    ones = sum((np.frombuffer(r["e"][:16], dtype="<i8") for r in asked), np.zeros(2, dtype=np.int64))
    totals = [customers.sum(), (customers > 0).sum(), contexts.sum(), (contexts == 1).sum(), (contexts == 2).sum(), *ones]
    out.append((-1, part, 3, ",".join(str(int(v)) for v in totals).encode(), b"", b"", b"", b""))
    return _table(out)


def log_stirling(most: int, discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t): weights of all seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = np.log(np.maximum(c - discount * t, 0)) + out[c, 1:]
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(np.isnan(stay), -np.inf, stay))
    return out


def sample_tables(
    count: np.ndarray, restaurant: np.ndarray, tables: np.ndarray, parent: np.ndarray, discount: float, strength: float, sweeps: int, kept: int, rng,
    start: np.ndarray | None = None,
) -> np.ndarray:
    """Mean number of tables of each dish over the last ``kept`` of ``sweeps`` Gibbs sweeps.

    ``count``: customers of a dish (one row), ``restaurant``: number of its restaurant, ``tables``: for each restaurant its
    tables if every dish has one, ``parent``: the parent's probability of the dish. A sweep seats all customers of a
    dish anew, given the other dishes: t tables have weight S(count, t) * parent^t * prod_k (strength + discount *
    (others + k)). Dishes of a restaurant are drawn in two halves in turn. Beyond ``EXACT`` customers the rest are seated
    in batches of a 16th, at the chance that the state before the batch gives. ``start`` are the tables to go on from (else
    one a dish), which ``tables`` counts.
    """
    t = np.ones(len(count), dtype=np.int64) if start is None else start.astype(np.int64)
    total = np.zeros(len(count))
    several = np.flatnonzero(count >= 2)
    if not len(several):
        return t.astype(float)
    stirling = log_stirling(int(min(EXACT, count.max())), discount)
    several = several[np.argsort(count[several], kind="stable")]
    extra = np.zeros(len(tables))
    for sweep in range(sweeps):
        half = rng.random(len(several)) < 0.5
        for rows in (several[half], several[~half]):
            # Runs of rows with similar counts share one table of weights.
            a = 0
            while a < len(rows):
                small = int(min(count[rows[a]], EXACT))
                b = a + int(np.searchsorted(count[rows[a:]], small + small // 8, side="right")) if small < EXACT else len(rows)
                b = min(b, a + max(1, 500_000 // (small + small // 8 + 1)))
                i = rows[a:b]
                c = np.minimum(count[i], EXACT)
                most = int(c.max())
                k = np.arange(most)
                others = tables[restaurant[i]] + extra[restaurant[i]] - t[i]
                weight = np.log(parent[i])[:, None] + np.log(strength + discount * (others[:, None] + k))
                weight = np.cumsum(weight, axis=1) + stirling[c, 1 : most + 1]
                weight = np.exp(weight - weight.max(axis=1, keepdims=True))
                upto = np.cumsum(weight, axis=1)
                drawn = 1 + (upto < (rng.random(len(i)) * upto[:, -1])[:, None]).sum(1)
                new = np.minimum(drawn, c)
                big = np.flatnonzero(count[i] > EXACT)
                if len(big):
                    seated, now = c[big].astype(float), new[big].astype(float)
                    while (left := count[i[big]] - seated).max() > 0:
                        batch = np.minimum(left, np.ceil(seated / 16))
                        fresh = (strength + discount * (others[big] + now)) * parent[i[big]]
                        now += rng.binomial(batch.astype(np.int64), fresh / (fresh + seated - discount * now))
                        seated += batch
                    new[big] = now.astype(np.int64)
                np.add.at(extra, restaurant[i], new - t[i])
                t[i] = new
                a = b
        if sweep >= sweeps - kept:
            total += t
    return total / kept


def _discounts(totals: list[int]) -> tuple[float, float]:
    """Of the parent and of the contexts, from the numbers of dishes seen once and twice."""
    once_twice = (totals[3:5], totals[5:7])
    return tuple(min(0.95, max(0.05, one / max(1, one + 2 * two))) for one, two in once_twice)


#: Bytes before the tables of a part: scale, its customers and tables in the parent, and the totals of the whole.
_HEADER = 80


class Restaurants:
    """The contexts' dishes in a bucket, with what the exchanges say of the whole restaurants."""

    def __init__(self, left: pa.Table, right: pa.Table, parts: int, strength: float, whole: bool = False):
        self.bucket = left.column("bucket")[0].as_py()
        self.x = x = Bucket(left, whole)
        self.cuts = x.cuts(parts)
        returned = right.to_pylist()
        answers, told = ({r["block"]: r for r in returned if r["kind"] == kind} for kind in (2, 6))

        def whole(values: list[np.ndarray], among: np.ndarray) -> np.ndarray:
            """What the parts say, of the words ``among``; 0 for the others, of which it is not asked."""
            out = np.zeros(len(x.words))
            out[among] = np.concatenate(values or [np.zeros(0)])
            return out

        every = np.ones(len(x.words), dtype=bool)
        said = lambda rows, column: [_from_counts(rows[p][column]) for p in sorted(rows)]

        self.start = None
        if told:  # the sums after a round
            held = [zlib.decompress(told[p]["a"]) for p in sorted(told)]
            parts_of = [np.frombuffer(h[:_HEADER], dtype="<i8") for h in held]
            self.totals = next(h[3:] for h in parts_of if h[0]).tolist()
            scale = max(int(h[0]) for h in parts_of)
            pairs, seated = (sum(int(h[k]) for h in parts_of) / scale for k in (1, 2))
            self.tables = whole([_from_planes(h[_HEADER:], "<i8") for h in held], x.is_context) / scale
            contexts, tables = (whole(said(told, c), x.is_dish) / scale for c in "bc")
            self.customers = whole(said(told, "d"), every)
            self.start = _from_counts(next(r["a"] for r in returned if r["kind"] == 5)) / scale
        else:  # at first one table a dish on both levels
            self.totals = [int(v) for v in next(r["a"] for r in returned if r["kind"] == 3).split(b",")]
            self.customers, contexts, self.tables = (whole(said(answers, c), m) for c, m in zip("abc", (every, x.is_dish, x.is_context)))
            tables = (contexts > 0).astype(float)
            pairs, seated = self.totals[2], self.totals[1]
        self.tokens, types = self.totals[:2]
        self.norm = math.log10(self.tokens + 0.5 * (types + 1))
        d0, self.d = _discounts(self.totals)
        smoothed = (self.customers + 0.5) / (self.tokens + 0.5 * (types + 1))
        self.iu, self.iw = x.iu, x.iw
        self.used = np.flatnonzero(x.count > 0)
        self.parent = (np.maximum(contexts - d0 * tables, 0) + (strength + d0 * seated) * smoothed) / (strength + pairs)


def _seated(parts: int, strength: float, sweeps: int, kept: int, turn: int):
    """Cells of a bucket with the answers to it: the tables of its dishes (kind 5, ``kept`` times their means) and, per part
    of the words, their sums by context and by dish (kind 4)."""

    def seated(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        r = Restaurants(left, right, parts, strength)
        x, iu, iw, used = r.x, r.iu[r.used], r.iw[r.used], r.used
        rng = np.random.default_rng([7, turn, r.bucket])
        mean = sample_tables(
            x.count[used], iu, r.tables, r.parent[iw], r.d, strength, sweeps, kept, rng, r.start
        )
        times = np.rint(mean * kept).astype(np.int64)
        out = [(r.bucket, r.bucket, 5, _counts(times), b"", b"", b"", b"")]
        line = np.array(r.totals, dtype="<i8").tobytes()
        sums = [(np.bincount(i, times, minlength=len(x.words)), m) for i, m in ((iu, x.is_context), (iw, x.is_dish))]
        for p in np.flatnonzero(np.diff(r.cuts)).tolist():
            part = slice(r.cuts[p], r.cuts[p + 1])
            out.append((p, r.bucket, 4, *(_counts(v[part][m[part]]) for v, m in sums), line, b"", b""))
        return _table(out)

    return seated


def _parents(parts: int, strength: float, sweeps: int, kept: int, scale: int, turn: int):
    """Per part of the words: tables by context over all buckets, and the parent's customers (the contexts' tables of a
    dish) and tables, sampled, ``scale`` times each, sent to each bucket in its order with the part's totals
    (kind 6). The buckets' own tables (kind 5) pass through, so that a bucket's work is done once."""

    def parents(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        part = left.column("bucket")[0].as_py()
        asked, returned = left.to_pylist(), right.to_pylist()
        x = Asked(asked)
        sums = {r["block"]: r for r in returned if r["kind"] == 4}
        customers = x.by_dish([r["b"] for r in asked])
        none = _counts(np.zeros(0))
        seen = [[sums[r["block"]][c] if r["block"] in sums else none for r in asked] for c in "ab"]
        tables, dishes = x.by_context(seen[0]), x.by_dish(seen[1])
        totals = np.frombuffer(next((r["c"] for r in sums.values()), bytes(_HEADER - 24)), dtype="<i8")
        tokens, types = totals[:2].tolist()
        count = np.rint(dishes / scale).astype(np.int64)
        used = np.flatnonzero(count > 0)
        seated = np.zeros(len(x.words))
        if len(used):
            base = (customers[used] + 0.5) / (tokens + 0.5 * (types + 1))
            rng = np.random.default_rng([11, turn, part])
            whole = np.array([float(types)])
            seated[used] = sample_tables(count[used], np.zeros(len(used), np.int64), whole, base, _discounts(totals)[0], strength, sweeps, kept, rng)
        seated = np.minimum(np.rint(seated * scale), dishes)
        header = np.array([scale if sums else 0, dishes.sum(), seated.sum(), *totals], dtype="<i8").tobytes()
        mine = {r["block"]: (own, own[context], own[dish]) for r, own, context, dish in zip(asked, x.own, x.is_context, x.is_dish)}
        # Every bucket is told the part's totals.
        out = [tuple(r[c] for c in _NAMES) for r in returned if r["kind"] == 5]
        for bucket in range(parts):
            own, context, dish = mine.get(bucket, [x.where[:0]] * 3)
            held = zlib.compress(header + _planes(tables[context], "<i8"), 1)
            out.append((bucket, part, 6, held, _counts(dishes[dish]), _counts(seated[dish]), _counts(customers[own]), b""))
        return _table(out)

    return parents


def _scores(parts: int, strength: float):
    """Cells of a bucket with all tables: sums for each document of each block; documents pass through."""

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a bucket without text
            return _table([])
        out = [tuple(r[c] for c in _NAMES) for r in left.filter(pc.equal(left.column("kind"), 1)).to_pylist()]
        r = Restaurants(left, right, parts, strength, whole=True)
        x, iu, iw, customers = r.x, r.iu, r.iw, r.customers
        tables = np.zeros(len(x.count))
        tables[r.used] = r.start
        n = customers[iu]
        back = np.where(n > 0, (strength + r.d * r.tables[iu]) / (strength + n), 1.0)
        p = np.maximum(x.count - r.d * tables, 0) / (strength + n) + back * r.parent[iw]
        # The documents of a cell one after the other; only those that the bucket has.
        place = (x.row.astype(np.uint64) << np.uint64(16)) | x.doc
        order = np.argsort(place, kind="stable").astype(np.int32)
        place = place[order]
        starts = np.flatnonzero(np.diff(place, prepend=~place[:1]))
        place = place[starts]
        pair, number = x.pair[order], x.number[order]
        sums = [np.add.reduceat(v[pair] * number, starts) for v in (np.log10(p), np.log10(customers[iw] + 0.5), (customers[iw] > 0).astype(float))]
        cuts = np.searchsorted(place, np.arange(len(x.cells) + 1, dtype=np.uint64) << np.uint64(16))
        for k, ((bucket, block), size) in enumerate(zip(x.cells, x.docs.tolist())):
            part = slice(cuts[k], cuts[k + 1])
            some = np.zeros(size, dtype=bool)
            some[place[part] & np.uint64(0xFFFF)] = True
            score, base, known = (v[part] for v in sums)
            own = _bits(some), _planes(score, "<f8"), _planes(base, "<f8"), _planes(known, "<u4")
            out.append((bucket, block, 0, *own, np.array([r.norm, r.tokens, size], dtype="<f8").tobytes()))
        return _table(out)

    return scores


class Sums:
    """Sums of a block's documents over buckets: score, base and known words."""

    def __init__(self, docs: int):
        self.values, self.present = np.zeros((3, docs)), np.zeros(docs, dtype=bool)

    def add(self, row: dict) -> None:
        some = _from_bits(row["a"], len(self.present))
        self.present |= some
        for v, column, kind in zip(self.values, "bcd", ("<f8", "<f8", "<u4")):
            v[some] += _from_planes(row[column], kind)


def _together(batches):
    """One row per block for the buckets of a task, as far as ``HELD_DOCS`` documents at once allow."""

    def rows() -> pa.Table:
        out = []
        for block, (first, x) in held.items():
            score, base, known = x.values[:, x.present]
            out.append((first["bucket"], block, 0, _bits(x.present), _planes(score, "<f8"), _planes(base, "<f8"), _planes(known, "<u4"), first["e"]))
        return _table(out)

    held, size = {}, 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 1:
                yield from _table([tuple(row[c] for c in _NAMES)]).to_batches()
                continue
            if row["block"] not in held:
                docs = int(np.frombuffer(row["e"], dtype="<f8")[2])
                if held and size + docs > HELD_DOCS:
                    yield from rows().to_batches()
                    held, size = {}, 0
                held[row["block"]] = {k: row[k] for k in ("bucket", "e")}, Sums(docs)
                size += docs
            held[row["block"]][1].add(row)
    yield from rows().to_batches()


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _documents(rows: pa.Table) -> pa.Table:
    """The sums of a block's documents over all buckets."""
    head, *rest = sorted(rows.to_pylist(), key=lambda r: (-r["kind"], r["bucket"]))
    n = np.frombuffer(head["b"], dtype="<i8")
    sums = Sums(len(n))
    for r in rest:
        sums.add(r)
    score, base, known = sums.values
    norm, tokens, _ = np.frombuffer(rest[0]["e"], dtype="<f8")
    keys = pa.array(np.frombuffer(head["a"], dtype="<i8"), mask=np.frombuffer(head["c"], dtype=np.uint8) == 0)
    columns = [keys, np.frombuffer(head["e"], dtype=np.uint8) > 0, n, known.astype(np.int64), np.full(len(n), int(tokens)), base - n * norm, score]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in RESULT.split(", ")])


def score_texts(
    docs: DataFrame, held_out: str = "held_out", key: str = "doc_id", text: str = "text", strength: float = 1.0, sweeps: int = 8, kept: int = 4, rounds: int = 2
) -> DataFrame:
    """``RESULT`` for every document: the model is learnt from those with ``held_out`` false and scores all.

    Tokens are the words of the text (A-Z lower-cased) and one end. base_score is the log10 probability by smoothed
    word counts, score by the model. In each of ``rounds`` the contexts' tables are sampled by an equal share of the ``sweeps``
    and the parent's by ``sweeps`` of its own; the last ``kept`` sweeps are averaged (no more than a round has). Discounts come from the numbers of pairs (and of words' contexts) seen once and
    twice. Null texts are empty: one token. A null ``held_out`` counts as false, null keys stay null, repeated rows are
    documents of their own. Without training documents both scores are 0 for every text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    cells = docs.mapInArrow(_cells(buckets), PACKED)
    asked = cells.groupBy("bucket").applyInArrow(_statistics(buckets), PACKED)
    answers = asked.groupBy("bucket").applyInArrow(_answers, PACKED)
    sums = [F.coalesce(F.sum(F.split(F.col("a").cast("string"), ",")[i].cast("bigint")), F.lit(0)) for i in range(7)]
    empty = F.lit(b"")
    totals = answers.filter("kind = 3").agg(F.concat_ws(",", *sums).cast("binary").alias("a"))
    totals = totals.select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(-1).cast("bigint").alias("block"), F.lit(3).alias("kind"), "a", *(empty.alias(c) for c in "bcde")
    )
    known = answers.filter("kind = 2").unionByName(totals)
    for turn in range(rounds):
        # Only the last round averages; the others hand on their last state.
        share = max(1, sweeps // rounds)
        scale = min(kept, share) if turn == rounds - 1 else 1
        seated = cells.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_seated(buckets, strength, share, scale, turn), PACKED)
        known = asked.groupBy("bucket").cogroup(seated.groupBy("bucket")).applyInArrow(_parents(buckets, strength, sweeps, kept, scale, turn), PACKED)
    scored = cells.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_scores(buckets, strength), PACKED)
    scored = scored.mapInArrow(_together, PACKED)
    return scored.groupBy("block").applyInArrow(_documents, RESULT)
