"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageway.llm.common import written
from passageway.llm.components import connected_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Runs of equal keys up to this length are compared outright, longer ones are first split by further masks.
RUN = 8192


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, each set if it is set in over half of the XXH64 hashes (seed 42) of the shingles of a whole text."""
    import xxhash

    tokens = (text or "").encode("utf-8").translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(words, len(tokens)) - 1 :].tolist()
    counts, done = np.zeros(64, dtype=np.int64), 0
    step = 1 << 16
    starts = starts.tolist()
    while done < n:
        upto = min(n, done + step)
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[done:upto], last[done:upto])], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        done = upto
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of each whole text as a signed BIGINT. Null and empty texts have fingerprint 0."""

    def hashed(batches):
        for batch in batches:
            bits = np.array([text_fingerprint(x.as_py(), words) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(hashed, f"`{key}` {kind}, fp bigint")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits: two fingerprints that differ in at most ``radius`` bits agree under one of them.

    Each bit position i gets a non-zero vector m(i) of radius + 1 bits; mask v (non-zero) has bit i set if m(i) and v
    have an odd number of ones in common. Any ``radius`` vectors m(i) leave some v that is orthogonal to them all, and
    under that mask none of the differing bits is looked at. Positions are dealt to vectors in random order, as evenly
    as they go, so that each mask looks at about half of the bits.
    """
    width = radius + 1
    rng = np.random.default_rng(seed)
    order = rng.permutation(64)
    vectors = np.empty(64, dtype=np.int64)
    vectors[order] = 1 + np.resize(rng.permutation((1 << width) - 1), 64)
    return [sum(1 << i for i in range(64) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, 1 << width)]


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def run_links(fps: np.ndarray, radius: int, level: int = 0, run: int = RUN) -> list[tuple[int, int]]:
    """Links that connect all of ``fps`` (distinct) which are connected by pairs within ``radius`` bits: a forest.

    Short runs are compared outright; long ones are split by the covering masks of another seed, under which every
    close pair meets again; if all masks leave a run whole, it is compared outright, block by block.
    """
    n = len(fps)
    parent = np.arange(n)
    links = []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            p, q = _root(parent, i), _root(parent, j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((int(fps[i]), int(fps[j])))

    if n <= run or level == 3:
        for start in range(0, n, 512):
            block = fps[start : start + 512]
            for other in range(start, n, 4096):
                near = np.bitwise_count(block[:, None] ^ fps[None, other : other + 4096]) <= radius
                a, b = np.nonzero(near)
                a, b = a + start, b + other
                new = a < b
                a, b = a[new], b[new]
                if len(a):
                    # Most pairs of a tight run are joined already: the first few of each row suffice to see it.
                    roots = np.array([_root(parent, i) for i in range(n)]) if len(a) > n else None
                    if roots is not None:
                        open_ = roots[a] != roots[b]
                        pairs = np.unique(np.stack([roots[a[open_]], roots[b[open_]]], 1), axis=0, return_index=True)[1]
                        a, b = a[open_][pairs], b[open_][pairs]
                    join(a, b)
        return links
    for mask in covering_masks(radius, seed=1000 + level):
        keys = fps & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                for x, y in run_links(np.sort(fps[part]), radius, level + 1, run):
                    i, j = np.searchsorted(fps, np.array([x, y], dtype=np.uint64))
                    join(np.array([i]), np.array([j]))
    return links


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct) within ``radius`` bits of one another.

    Every fingerprint goes to one bucket per covering mask, keyed by the bits under the mask; close pairs share a
    bucket in some table. Buckets are shuffled by (table, key), sorted, and read in a stream, so a task holds one
    bucket at a time. Each bucket returns a forest, not its pairs.
    """
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("t", "k"))

    def links(batches):
        held: list[np.ndarray] = []
        key = None

        def closed():
            if not held:
                return None
            fps = np.unique(np.concatenate(held))
            found = run_links(fps, radius) if len(fps) > 1 else []
            if not found:
                return None
            ends = np.array(found, dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            bounds = np.concatenate(([0], cuts, [len(t)]))
            sizes = np.diff(bounds)
            for i in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
                a, b = bounds[i], bounds[i + 1]
                if key != (t[a], k[a]):
                    if (out := closed()) is not None:
                        yield out
                    held, key = [], (t[a], k[a])
                held.append(fp[a:b].astype(np.int64).view(np.uint64))
        if (out := closed()) is not None:
            yield out

    dealt = keyed.repartition("t", "k").sortWithinPartitions("t", "k").select(F.col("t").cast("bigint"), "k", "fp")
    return dealt.mapInArrow(links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(key, fp, component_id): documents linked by fingerprints within ``radius`` bits, directly or through others.

    component_id is the smallest key that can be reached. Equal fingerprints are one node, so copies cost nothing
    beyond their own row. Null and empty texts have fingerprint 0 and link like any other; a null key is never the
    smallest unless a component has no other, then component_id is null; repeated rows each get a row; an empty table
    gives no rows; other columns are ignored.
    """
    hashed = written(simhash(docs, key, text, words), "fingerprints")
    nodes = written(hashed.groupBy("fp").agg(F.min(key).alias("_least")), "nodes")
    labels = connected_components(fingerprint_links(nodes, radius))
    labelled = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "_least", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("_least").alias("component_id"))
    named = written(labelled.join(least, "component").select("fp", "component_id"), "components")
    return hashed.join(named, "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", **parameters) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest key, a null key being the largest.

    Among rows with that key the smallest of two hashes of the whole row decides, so keys need be neither there nor
    unique: components without a key keep a row each, and so do components with the same one.
    """
    whole = [F.col(f"`{c}`") for c in docs.columns]
    whole += [c.isNull() for c in whole]  # hashes skip nulls
    rows = docs.withColumns({"_h1": F.xxhash64(F.lit(1), *whole), "_h2": F.xxhash64(F.lit(2), *whole)})
    named = rows.withColumn("_row", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "_h1", "_h2"))
    found = near_duplicates(named, "_row", **parameters)
    kept = found.select("component_id._h1", "component_id._h2").distinct()
    # Equal rows are told apart by nothing; they are brought down to one by an aggregate that starts before the shuffle.
    return rows.join(kept, ["_h1", "_h2"], "left_semi").select(*docs.columns).distinct()
