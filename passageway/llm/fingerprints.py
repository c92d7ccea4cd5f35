"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The modulus, a Mersenne prime, and two bases; a span's hash is the pair of its two polynomials.
MODULUS = (1 << 31) - 1
BASES = (1_000_003_919, 1_741_210_727)
_M, _S = np.uint64(MODULUS), np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainders of numbers below 2^62."""
    x = (x & _M) + (x >> _S)
    x = (x & _M) + (x >> _S)
    return np.where(x >= _M, x - _M, x)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = _mod(out[:more] * np.uint64(pow(base, done, MODULUS)))
        done += more
    return out


class Powers:
    """Powers of the bases and of their inverses, grown as texts need them."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> Powers:
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            self.up = [_powers(b, self.n) for b in BASES]
            self.down = [_powers(pow(b, -1, MODULUS), self.n) for b in BASES]
        return self


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class PrefixHashes:
    """Prefix arrays of a text: prefix[i] is the sum of c_j * base^j over the code points before i, modulo ``MODULUS``.

    The hash of a span is the difference of two entries, brought to a common power; so any two spans, of one text or
    of two, are compared in constant time, and the longest common extension of two places is found by binary search.
    Equal spans have equal hashes; different ones coincide with a chance of about 2^-62 times their length squared.
    """

    def __init__(self, points: np.ndarray, powers: Powers):
        self.n = len(points)
        self.powers = powers.upto(self.n + 1)
        c = points.astype(np.uint64) + np.uint64(1)
        self.prefix = [
            _mod(np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mod(c * up[: self.n]))))) for up in self.powers.up
        ]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans, alike wherever they stand."""
        parts = []
        for prefix, down in zip(self.prefix, self.powers.down):
            parts.append(_mod(_mod(prefix[ends] + (_M - prefix[starts])) * down[starts]))
        return (parts[0] << _S) | parts[1]

    def span(self, start: int, end: int) -> int:
        one, two = (
            (int(prefix[end]) - int(prefix[start])) % MODULUS * int(down[start]) % MODULUS for prefix, down in zip(self.prefix, self.powers.down)
        )
        return one << 31 | two

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """How many code points from the two places on are alike."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start, start + mid) == other.span(other_start, other_start + mid):
                low = mid
            else:
                high = mid - 1
        return low


def _scrambled(x: np.ndarray) -> np.ndarray:
    """Spread the bits of span hashes over 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: An empty slot of a sketch.
EMPTY = 0xFFFF


def sketch(hashes: PrefixHashes, width: int, slots: int) -> np.ndarray:
    """Of all spans of ``width`` code points (a shorter text is one span): per slot 16 bits of the smallest hash, or ``EMPTY``.

    A span's slot and its place within it are bits of its hash, so the share of equal slots of two texts estimates
    the share of spans they have in common.
    """
    least = np.full(slots, 0xFFFFFFFF, dtype=np.uint64)
    if hashes.n:
        width = min(width, hashes.n)
        step = 1 << 18
        for first in range(0, hashes.n - width + 1, step):
            starts = np.arange(first, min(first + step, hashes.n - width + 1))
            x = _scrambled(hashes.spans(starts, starts + width))
            np.minimum.at(least, ((x >> np.uint64(32)) % np.uint64(slots)).astype(np.int64), x & np.uint64(0xFFFFFFFE))
    mixed = (least * np.uint64(0x9E3779B1) >> np.uint64(16)) % np.uint64(EMPTY)
    return np.where(least == 0xFFFFFFFF, EMPTY, mixed).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the spans of two texts of equal size that they have in common (0 to 1), as their sketches tell it.

    From the share s of equal slots among those not empty in both, the shared part of the mean text is 2s / (1 + s).
    Two empty texts are alike.
    """
    used = (a != EMPTY) | (b != EMPTY)
    n = int(used.sum())
    if not n:
        return 1.0
    s = int(((a == b) & used).sum()) / n
    return 2 * s / (1 + s)


def fingerprint(hashes: PrefixHashes, values: np.ndarray) -> str:
    """Length and hash of the whole text, then the sketch, in hex digits. Equal texts have equal fingerprints."""
    return f"{hashes.n:08x}{hashes.span(0, hashes.n):016x}" + values.astype(">u2").tobytes().hex()


def sketch_of(print_: str) -> np.ndarray:
    """The sketch that a fingerprint holds."""
    return np.frombuffer(bytes.fromhex(print_[24:]), dtype=">u2").astype(np.uint16)


def in_order_with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, text, block, ahead): the rows of a block follow one another in order of the key, and at its end stands the
    row that follows its last one (``ahead``): the first of the next block, after the last block the first of all.

    Block bounds are quantiles of the key, 16 blocks a shuffle partition and 65,536 at most, so what the driver learns
    of them (a key each) is bounded. Each text moves once, the first of a block twice. Null keys come before all
    others and rows with equal keys in order of a hash of the text.
    """
    spark = docs.sparkSession
    lowest = F.lit(-(1 << 63))
    docs = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("_k", F.coalesce("k", lowest)).withColumn("_d", F.col("_k").cast("double"))
    blocks = min(65_536, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(docs.approxQuantile("_d", [i / blocks for i in range(1, blocks)], 0.25 / blocks)))
    inf = float("inf")
    if bounds:
        docs = Bucketizer(splits=[-inf, *bounds, inf], inputCol="_d", outputCol="_b").transform(docs)
    else:
        docs = docs.withColumn("_b", F.lit(0.0))
    docs = docs.withColumn("_b", F.col("_b").cast("int"))
    heads = sorted((r["_b"], r["_k"]) for r in docs.groupBy("_b").agg(F.min("_k").alias("_k")).collect())
    before = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]
    before = F.broadcast(spark.createDataFrame(before, "_k bigint, _before int"))
    place = F.struct(F.col("_b").alias("block"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.col("_before").alias("block"), F.lit(True).alias("ahead"))
    docs = docs.join(before, "_k", "left").withColumn("_at", F.explode(F.when(F.col("_before").isNull(), F.array(place)).otherwise(F.array(place, ahead))))
    docs = docs.select("k", "text", "_at.*", "_k", F.xxhash64("text").alias("_h"))
    return docs.repartition("block").sortWithinPartitions("block", "ahead", "_k", "_h").select("k", "text", "block", "ahead")


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, same_start bigint, next_start bigint"
)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 12, slots: int = 128) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (see ``RESULT``).

    The edited text has the last floor(n / 2) code points replaced by the first as many, or all, of the next document
    in order of the key (after the last: the first). near_edited and near_next are the ``likeness`` of the fingerprint
    to that of the edited text and of the next document. same_start is how many code points the text and the edited
    text begin with in common, next_start how far the replaced part agrees with the next document's start; both are
    longest common extensions by binary search over the prefix arrays. Null texts are empty; empty texts have a
    fingerprint and are alike; null keys come first; repeated rows are documents that follow one another; a table of
    one row is its own next document; an empty table gives no rows; other columns are ignored.
    """
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def rows(batches):
        powers = Powers()
        last = None  # (key, text, hashes, sketch, block) of the row before
        for batch in batches:
            out: list[tuple] = []
            for k, content, block, ahead in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3))):
                own = content.as_py()
                hashes = PrefixHashes(code_points(own), powers)
                values = sketch(hashes, width, slots)
                if last is not None and last[4] == block:
                    key_, before, its, its_values, _ = last
                    half = len(before) // 2
                    edited_text = before[: len(before) - half] + own[:half]
                    edited = PrefixHashes(code_points(edited_text), powers)
                    edited_values = sketch(edited, width, slots)
                    out.append(
                        (
                            key_,
                            len(before),
                            hashlib.sha256(edited_text.encode("utf-8")).hexdigest(),
                            fingerprint(its, its_values),
                            fingerprint(edited, edited_values),
                            likeness(its_values, edited_values),
                            likeness(its_values, values),
                            its.common_extension(0, edited, 0),
                            edited.common_extension(len(before) - half, hashes, 0),
                        )
                    )
                # What is ahead closes its block; rows that repeat its key are not needed.
                last = None if ahead else (k, own, hashes, values, block)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(names), kinds)], names=names)

    return in_order_with_next(docs, key, text).mapInArrow(rows, RESULT)
