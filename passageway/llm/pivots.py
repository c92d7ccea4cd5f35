"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within
from passageway.llm.common import written
from passageway.llm.components import connected_components

#: Vectors of one list that are compared in one group; longer lists are compared block against block.
BLOCK = 2048


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column without nulls."""
    offsets = np.asarray(column.offsets)
    return offsets - offsets[0], np.asarray(column.flatten())


def spread_pivots(unit: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """Up to ``most`` rows of ``unit``, each the farthest from those before it; none is within ``cosine`` of another.

    A dense region of any number of rows owns one or a few, so its members agree about the others that are near.
    """
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(most, len(unit)):
        far = int(near.argmin())
        if near[far] >= cosine:
            break
        chosen.append(far)
        near = np.maximum(near, unit @ unit[far])
    return unit[chosen]


def choose_pivots(nodes: DataFrame, most: int, cosine: float) -> dict[int, np.ndarray]:
    """Unit reference points by dimension, ``most`` in all or fewer, spread over a bounded sample of four times as many.

    The sample is the first vectors in order of a hash. Pivots keep twice the squared distance that ``cosine`` stands for.
    """
    rows = nodes.orderBy(F.xxhash64("node"), "node").limit(4 * most).select("vec").collect()
    by_size: dict[int, list] = {}
    for (vec,) in rows:
        by_size.setdefault(len(vec), []).append(vec)
    out = {}
    for d, v in by_size.items():
        x = np.array(v, dtype=np.float64)
        share = -(-most * len(v) // len(rows))
        out[d] = spread_pivots(x / np.linalg.norm(x, axis=1, keepdims=True), share, 2 * cosine - 1)
    return out


def pivot_lists(nodes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """Each vector in the inverted lists of its nearest pivots, taken two at a time.

    A vector is described by its ``nearest`` pivots in order of nearness. The list (d, p, q) holds the vectors of
    dimension d that have both pivots p < q there, so two vectors meet in a list exactly if they share two pivots or
    more. Dimensions with fewer than two pivots have the single list (d, -1, -1).
    """
    shape = "node bigint, w bigint, vec array<double>, d int, p int, q int, near array<int>"

    def listed(batches):
        for batch in batches:
            offsets, values = _flat(batch.column(2))
            sizes = np.diff(offsets)
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                x = values[offsets[rows][:, None] + np.arange(d)]
                refs = pivots.get(d)
                if refs is None or len(refs) < 2:
                    near = np.empty((len(rows), 0), dtype=np.int32)
                    pairs = np.full((len(rows), 1, 2), -1)
                else:
                    m = min(nearest, len(refs))
                    closeness = x @ refs.T  # the order of pivots does not depend on the vector's length
                    near = np.argsort(-closeness, axis=1, kind="stable")[:, :m].astype(np.int32)
                    i, j = np.triu_indices(m, 1)
                    pairs = np.sort(near, axis=1)
                    pairs = np.stack([pairs[:, i], pairs[:, j]], 2)
                k = pairs.shape[1]
                at = pa.array(np.repeat(rows, k))
                lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * near.shape[1], pa.array(near.ravel(), pa.int32()))
                for a in range(0, len(rows) * k, 4096):
                    part = slice(a, a + 4096)
                    take = at[part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c).take(take) for c in range(3)),
                            pa.array(np.full(len(take), d, dtype=np.int32)),
                            pa.array(pairs.reshape(-1, 2)[part, 0].astype(np.int32)),
                            pa.array(pairs.reshape(-1, 2)[part, 1].astype(np.int32)),
                            lists.take(pa.array(np.repeat(np.arange(len(rows)), k)[part])),
                        ],
                        names=["node", "w", "vec", "d", "p", "q", "near"],
                    )

    return nodes.select("node", "w", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(listed, shape)


def _compare(vec: np.ndarray, near: np.ndarray, block: np.ndarray, key: tuple[int, int], cross: bool, cosine: float):
    """Pairs (i, j) of a list, i < j, with at least ``cosine``, that have no earlier list in common."""
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    for start in range(0, len(unit), 512):
        close = unit[start : start + 512] @ unit[start:].T >= cosine
        i, j = np.nonzero(close)
        i, j = i + start, j + start
        new = (i < j) & ((block[i] != block[j]) if cross else True)
        i, j = i[new], j[new]
        if near.shape[1] and len(i):
            shared = (near[i][:, :, None] == near[j][:, None, :]).any(2)
            first = np.sort(np.where(shared, near[i], np.iinfo(np.int32).max), axis=1)[:, :2]
            mine = (first[:, 0] == key[0]) & (first[:, 1] == key[1])
            i, j = i[mine], j[mine]
        yield i, j


def list_links(lists: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """(node, n, other): for each list and vector the weight n of the vectors it links with there, and one of them.

    The others form a forest on each list's links, so nothing grows with the square of a list. A pair that meets in
    several lists counts in the first. Lists of more than ``block`` vectors are dealt into blocks by a hash, each pair
    of blocks being a group, so that no group holds more than two blocks.
    """
    key = ["d", "p", "q"]
    sizes = lists.groupBy(*key).agg(F.count("*").alias("_size")).filter(F.col("_size") > block)
    sizes = sizes.select(*key, F.ceil(F.col("_size") / block).cast("int").alias("_blocks"))
    dealt = lists.join(broadcast_within(written(sizes, "sizes")), key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("b", "_o"), "hi": F.greatest("b", "_o")})
    group = [*key, "lo", "hi"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group).select(*group, "b", "node", "w", "near", "vec")

    def links(batches):
        held: list[pa.RecordBatch] = []
        current = None

        def closed() -> pa.RecordBatch | None:
            if not held or sum(x.num_rows for x in held) < 2:
                return None
            table = pa.Table.from_batches(held).combine_chunks()
            node, w, b = (table.column(c).to_numpy() for c in ("node", "w", "b"))
            d, p, q, lo, hi = current
            vec = _flat(table.column("vec").chunk(0))[1].reshape(-1, d)
            near = _flat(table.column("near").chunk(0))[1].reshape(len(node), -1)
            weight, parent = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
            edges = []
            for i, j in _compare(vec, near, b, (p, q), lo != hi, cosine):
                np.add.at(weight, i, w[j])
                np.add.at(weight, j, w[i])
                for x, y in zip(i.tolist(), j.tolist()):
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    while parent[y] != y:
                        parent[y] = y = parent[parent[y]]
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        edges.append((x, y))
            rows = np.flatnonzero(weight)
            if not len(rows):
                return None
            a = np.array([x for x, _ in edges], dtype=np.int64)
            c = np.array([y for _, y in edges], dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([node[rows], node[a]])),
                    pa.array(np.concatenate([weight[rows], np.zeros(len(a), dtype=np.int64)])),
                    pa.array(np.concatenate([node[rows], node[c]])),
                ],
                names=["node", "n", "other"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(i)) for i in range(5)]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for a, z in zip(bounds, bounds[1:]):
                here = tuple(int(c[a]) for c in columns)
                if here != current:
                    if (out := closed()) is not None:
                        yield out
                    held, current = [], here
                held.append(batch.slice(a, z - a))
        if (out := closed()) is not None:
            yield out

    return dealt.mapInArrow(links, "node bigint, n bigint, other bigint")


def near_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, nearest: int = 5, pivots: int | None = None
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: vectors linked by a cosine of at least ``cosine``.

    Equal vectors are one node (named by a 64-bit hash of the whole vector) and count as links of one another. Pivots
    are spread over a bounded sample: half the square root of the number of nodes, 64 to 4,096, unless given, and fewer
    if the sample has no more that are far enough from one another. All vectors are indexed, and two are compared if they share two of their ``nearest`` pivots; no link below ``cosine`` is made,
    and the share found of those there are is measured in the tests. Vectors that are null, empty, zero, or hold null
    or non-finite components link with nothing, nor do vectors of different dimension. A null key stays null; repeated
    rows count as links of one another; an empty table gives no rows; other columns are ignored.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    valid = F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = written(table.select(F.col(key).alias("key"), F.when(valid, F.xxhash64(x)).alias("node"), F.when(valid, x).alias("vec")), "vectors")
    nodes = rows.filter("vec IS NOT NULL").groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("w"), F.first("vec").alias("vec"))
    nodes = written(nodes, "nodes")
    number = nodes.count()
    refs = choose_pivots(nodes, pivots or int(min(4096, max(64, number**0.5 / 2))), cosine)
    links = written(list_links(written(pivot_lists(nodes, refs, nearest), "lists"), cosine), "links")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    labels = connected_components(links.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.select("node", "least", "w").join(counts, "node", "left").join(labels, "node", "left")
    named = named.select("node", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "component").select("node", "n_links", "component_id"), "components")
    found = rows.select("key", "node").join(named, "node", "left")
    found = found.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))
    return found.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
