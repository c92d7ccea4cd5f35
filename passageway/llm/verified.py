"""Near duplicates whose links are verified: covering buckets of fingerprints find candidates, shingles decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within
from passageway.llm.common import written
from passageway.llm.components import connected_components
from passageway.llm.simhash import _LOWER, covering_masks

#: Bits of a sketch; each is a bit of the smallest value of the shingles under one of as many hash functions.
BITS = 512
#: An estimate further than this from the threshold decides alone: three standard errors at a similarity of 0.8.
MARGIN = 0.08
#: Texts of a group that are compared in one task; larger groups are compared block against block.
BLOCK = 1024
_ODD = np.random.default_rng(11).integers(0, 1 << 64, BITS, dtype=np.uint64) | np.uint64(1)


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_LOWER).split()


def shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each shingle, the whole sequence if it is shorter than ``words``; nothing for no words."""
    import xxhash

    if not tokens:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(tokens) - words + 1)]
    last = ends[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), last.tolist())], dtype=np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """BITS bits in 64-bit words: two sets with similarity J agree in a share of (1 + J) / 2 of them, on average."""
    least = np.full(BITS, np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[a : a + 1024, None] * _ODD).min(0))
    return np.packbits((least >> np.uint64(7)).astype(np.uint8) & 1).view(np.uint64)


def word_set_fingerprint(tokens: list[bytes]) -> int:
    """64 bits, each set if it is set in over half of the hashes of the different words."""
    hashes = shingle_hashes(sorted(set(tokens)), 1)
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def describe(rows: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, node, fp, sketch) of each whole text; node is a hash of its sequence of words."""

    def described(batches):
        import xxhash

        for batch in batches:
            nodes, fps, bits = [], [], []
            for value in batch.column(1):
                tokens = _tokens(value.as_py())
                nodes.append(xxhash.xxh64_intdigest(b" ".join(tokens)))
                fps.append(word_set_fingerprint(tokens))
                bits.append(sketch(shingle_hashes(tokens, words)).tobytes())
            ids = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ids, pa.array(bits, pa.binary())], names=[key, "node", "fp", "sketch"])

    kind = rows.schema[key].dataType.simpleString()
    chosen = rows.select(key, F.col(text).cast("string").alias("_text"))
    return chosen.mapInArrow(described, f"`{key}` {kind}, node bigint, fp bigint, sketch binary")


def _groups(batches, keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal values in the first ``keys`` columns, one group at a time; single rows are left out."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        bounds = np.concatenate(([0], cuts, [batch.num_rows]))
        sizes = np.diff(bounds)
        edge = np.zeros(len(sizes), dtype=bool)
        edge[[0, -1]] = True  # may go on in another batch
        for g in np.flatnonzero((sizes > 1) | edge).tolist():
            here = tuple(int(c[bounds[g]]) for c in columns)
            if here != current:
                if sum(x.num_rows for x in held) > 1:
                    yield current, pa.Table.from_batches(held).combine_chunks()
                held, current = [], here
            held.append(batch.slice(bounds[g], sizes[g]))
    if sum(x.num_rows for x in held) > 1:
        yield current, pa.Table.from_batches(held).combine_chunks()


def with_neighbour(fps: np.ndarray, within: int) -> np.ndarray:
    """Which of the different ``fps`` differ from another in at most ``within`` bits.

    Neighbours in sorted order are looked at first, under several rotations; only those without one there are compared
    with all, so a tight run costs little more than its length.
    """
    found = np.zeros(len(fps), dtype=bool)
    for turn in (0, 16, 32, 48):
        order = np.argsort((fps << np.uint64(turn)) | (fps >> np.uint64((64 - turn) % 64)))
        for step in range(1, min(9, len(fps))):
            a, b = order[:-step], order[step:]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= within
            found[a[near]] = found[b[near]] = True
    rest = np.flatnonzero(~found)
    for a in range(0, len(rest), 256):
        for b in range(0, len(fps), 8192):
            near = np.bitwise_count(fps[rest[a : a + 256], None] ^ fps[None, b : b + 8192]) <= within
            found[rest[a : a + 256]] |= near.sum(1) > (near & (rest[a : a + 256, None] == np.arange(b, b + near.shape[1]))).sum(1)
    return found


def candidate_buckets(fps: DataFrame, radius: int, within: int) -> DataFrame:
    """(t, k, fp): the buckets of the covering masks in which a fingerprint (distinct) has one within ``within`` bits.

    Every pair within ``radius`` bits shares a bucket; of wider pairs many do. Most texts have no such neighbour and go
    no further.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("t", "k"))

    def marked(batches):
        for (t, k), group in _groups(batches, 2):
            found = group.column("fp").to_numpy()
            found = found[with_neighbour(found.view(np.uint64), within)]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x)) for x in (t, k)] + [pa.array(found)], names=["t", "k", "fp"])

    dealt = keyed.repartition("t", "k").sortWithinPartitions("t", "k").select(F.col("t").cast("bigint"), "k", "fp")
    return dealt.mapInArrow(marked, "t bigint, k bigint, fp bigint")


def _near(fps: np.ndarray, bits: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j within ``within`` bits and the similarity that their sketches estimate, some thousand at a time."""
    for a in range(0, len(fps), 256):
        for b in range(a, len(fps), 4096):
            i, j = np.nonzero(np.bitwise_count(fps[a : a + 256, None] ^ fps[None, b : b + 4096]) <= within)
            i, j = i + a, j + b
            i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 1 << 16):
                x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                yield x, y, 1 - 2 * np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) / BITS


def _flat_roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent[:] = up


def _join(parent: np.ndarray, x: int, y: int) -> bool:
    """Whether x and y were apart; they are together afterwards."""
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    while parent[y] != y:
        parent[y] = y = parent[parent[y]]
    parent[max(x, y)] = min(x, y)
    return x != y


def bucket_links(buckets: DataFrame, similarity: float, within: int) -> DataFrame:
    """(a, b, sure): of each bucket a forest of the links that estimates settle, and one of the pairs they leave open.

    A pair is left open if its estimate is within MARGIN of ``similarity``. Rows grow with a bucket's length, not with its
    pairs.
    """

    def links(batches):
        for _, group in _groups(batches, 2):
            node, fps = group.column("node").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
            bits = _bits(group)
            parent = np.arange(len(node))
            for least, sure in ((similarity + MARGIN, True), (similarity - MARGIN, False)):
                forest = []
                for i, j, like in _near(fps, bits, within):
                    i, j = i[like >= least], j[like >= least]
                    roots = _flat_roots(parent)
                    apart = roots[i] != roots[j]
                    forest += [(x, y) for x, y in zip(i[apart].tolist(), j[apart].tolist()) if _join(parent, x, y)]
                ends = np.array(forest, dtype=np.int64).reshape(-1, 2)
                yield _pairs(node, ends[:, 0], ends[:, 1], sure)

    dealt = buckets.repartition("t", "k").sortWithinPartitions("t", "k").select("t", "k", "node", "fp", "sketch")
    return dealt.mapInArrow(links, "a bigint, b bigint, sure boolean")


def _bits(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint64).reshape(group.num_rows, -1)


def _pairs(node: np.ndarray, i: np.ndarray, j: np.ndarray, sure: bool) -> pa.RecordBatch:
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), sure))], names=["a", "b", "sure"])


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the different shingle hashes of each whole text."""

    def sets(batches):
        for batch in batches:
            values = [np.unique(shingle_hashes(_tokens(x.as_py()), words)).view(np.int64) for x in batch.column(1)]
            offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
            flat = np.concatenate(values) if values else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(sets, "node bigint, shingles array<bigint>")


def exact_links(described: DataFrame, similarity: float, within: int, block: int = BLOCK) -> DataFrame:
    """(a, b): of each group a forest of the links between its texts, decided by the shingles where estimates do not.

    ``described`` is (group, node, fp, sketch, shingles). Groups of more than ``block`` texts are dealt into blocks by a
    hash, each pair of blocks being compared by itself, so that no task holds more than two blocks.
    """
    sizes = described.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).filter("_blocks > 1")
    dealt = described.join(broadcast_within(written(sizes, "sizes")), "group", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("_b", "_o"), "hi": F.greatest("_b", "_o")})
    keys = ["group", "lo", "hi"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "node", "fp", "sketch", "shingles")

    def links(batches):
        for _, group in _groups(batches, 3):
            node, fps = group.column("node").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
            sets = group.column("shingles").chunk(0)
            ends, values = np.asarray(sets.offsets), np.asarray(sets.values)
            parent, forest = np.arange(len(node)), []
            for i, j, like in _near(fps, _bits(group), within):
                open_ = like >= similarity - MARGIN
                for x, y, sure in zip(i[open_].tolist(), j[open_].tolist(), (like[open_] >= similarity + MARGIN).tolist()):
                    if _joined(parent, x, y):
                        continue
                    if not sure:
                        left, right = values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]]
                        common = len(np.intersect1d(left, right, assume_unique=True))
                        sure = common >= similarity * (len(left) + len(right) - common) - 1e-9
                    if sure and _join(parent, x, y):
                        forest.append((x, y))
            found = np.array(forest, dtype=np.int64).reshape(-1, 2)
            yield _pairs(node, found[:, 0], found[:, 1], True).select(["a", "b"])

    return dealt.mapInArrow(links, "a bigint, b bigint")


def _joined(parent: np.ndarray, x: int, y: int) -> bool:
    while parent[x] != x:
        x = parent[x]
    while parent[y] != y:
        y = parent[y]
    return x == y


def verified_links(nodes: DataFrame, rows: DataFrame, text: str, words: int, similarity: float, radius: int, within: int) -> DataFrame:
    """(a, b): links that connect all nodes whose texts are found to be similar."""
    fps = written(nodes.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    marks = candidate_buckets(fps.select("fp"), radius, within)
    same = fps.filter("n > 1").select(F.lit(-1).cast("bigint").alias("t"), F.col("fp").alias("k"), "fp")
    buckets = written(marks.unionByName(same), "buckets").join(nodes.select("fp", "node", "sketch"), "fp")
    found = written(bucket_links(buckets, similarity, within), "links")
    # Only groups with an open pair are looked at again; each of their texts travels once.
    groups = connected_components(found.select("a", "b"))
    unsettled = groups.join(found.filter("NOT sure").select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("component").distinct()
    wanted = groups.join(unsettled, "component", "left_semi").join(nodes.select("node", "fp", "sketch", "least._h1", "least._h2"), "node")
    wanted = written(wanted.withColumnRenamed("component", "group"), "wanted")
    texts = rows.select("_h1", "_h2", F.col(text).cast("string").alias("text")).join(broadcast_within(wanted.select("_h1", "_h2", "node")), ["_h1", "_h2"])
    sets = shingle_sets(texts.dropDuplicates(["node"]), words)
    exact = exact_links(wanted.drop("_h1", "_h2").join(sets, "node"), similarity, within)
    return written(found.filter("sure").select("a", "b").unionByName(exact), "verified")


def one_of_each_verified(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 6, within: int = 10
) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: the one with the smallest key, a null key being the largest.

    Texts are linked if the Jaccard similarity of their sets of shingles is at least ``similarity``; a group is what
    links connect. Candidates are texts whose fingerprints of different words differ in at most ``within`` bits and meet
    in a bucket of the covering masks of ``radius``: all pairs within ``radius`` do. Estimates from sketches settle what
    is more than MARGIN from the threshold, the shingles themselves the rest.

    Texts that are the same words in the same order are one node, so copies cost a row each. A text shorter than a
    shingle is one shingle; null texts and texts without a word are copies of one another. Rows with the smallest key
    are told apart by two hashes of the whole row, so keys need be neither there nor unique; equal rows leave one. An
    empty table gives no rows. Whole texts are read, however long.
    """
    whole = [F.col(f"`{c}`") for c in docs.columns]
    whole += [c.isNull() for c in whole]  # hashes skip nulls
    rows = docs.withColumns({"_h1": F.xxhash64(F.lit(1), *whole), "_h2": F.xxhash64(F.lit(2), *whole)})
    named = rows.withColumn("_row", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "_h1", "_h2"))
    described = written(describe(named, "_row", text, words), "described")
    nodes = described.groupBy("node").agg(F.min("_row").alias("least"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")
    labels = connected_components(verified_links(nodes, rows, text, words, similarity, radius, within))
    grouped = nodes.join(labels, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("least").alias("least"))
    kept = written(grouped.select("least._h1", "least._h2").distinct(), "kept")
    return rows.join(kept, ["_h1", "_h2"], "left_semi").select(*docs.columns).distinct()
