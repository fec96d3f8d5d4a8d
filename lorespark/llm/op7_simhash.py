"""Near duplicates by SimHash, linked through BK-trees.

Fingerprints that differ in at most ``radius`` bits agree on at least two of
``radius + 2`` bit blocks, so each pair of blocks is a shard key and linked
fingerprints meet in some shard. A shard's BK-tree (children keyed by the
Hamming distance to their parent) is searched along edges within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import blocks, byte_texts, named, stage, text_of
from lorespark.llm.components import components
from lorespark.session import prepare

SEED = 42


def fingerprints(texts: list[bytes], width: int) -> np.ndarray:
    """SimHash of each text over its ``width``-word shingles."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            hashes.append(digest(joined, SEED))
            counts[i] = 1
            continue
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        hashes += [digest(joined[s:e], SEED) for s, e in zip(start.tolist(), end[width - 1 :].tolist())]
        counts[i] = len(words) - width + 1
    prints = np.zeros(len(texts), np.uint64)
    used = np.flatnonzero(counts)
    if len(used):
        number = np.array(hashes, np.uint64)
        first = np.cumsum(counts[used]) - counts[used]
        ones = np.empty((len(used), 64), np.int64)
        for bit in range(64):
            ones[:, bit] = np.add.reduceat((number >> np.uint64(bit)) & np.uint64(1), first)
        over = (2 * ones > counts[used][:, None]).astype(np.uint8)
        prints[used] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return prints


def _print_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("_t"))
            found = [fingerprints(texts[lo:hi], width) for lo, hi in blocks(texts)]
            prints = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "print"])

    return run


class Forest:
    """BK-trees of many shards, built and searched level by level."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray, radius: int):
        """``shard`` counts from 0; ``near`` gets the (point, ancestor) links."""
        self.prints, self.radius = prints, radius
        self.root = np.full(int(shard.max(initial=-1)) + 1, -1, np.int64)
        codes, nodes, near = [], [], []
        left = np.argsort(shard, kind="stable")
        group = shard[left].astype(np.int64)
        level = 0
        while len(left):
            new = np.ones(len(left), bool)
            new[1:] = group[1:] != group[:-1]
            top = left[np.flatnonzero(new)]
            if level == 0:
                self.root[group[new]] = top
            else:
                codes.append(group[new])
                nodes.append(top)
            parent = top[np.cumsum(new) - 1][~new]
            left = left[~new]
            apart = np.bitwise_count(prints[left] ^ prints[parent]).astype(np.int64)
            close = apart <= radius
            near.append(np.stack([left[close], parent[close]]))
            group = parent * 65 + apart
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
            level += 1
        order = np.argsort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        self.codes = np.concatenate(codes)[order] if codes else np.zeros(0, np.int64)
        self.nodes = np.concatenate(nodes)[order] if nodes else np.zeros(0, np.int64)
        self.near = np.concatenate(near, axis=1) if near else np.zeros((2, 0), np.int64)

    def links(self, prints: np.ndarray, shard: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """(query, point) pairs that connect all that lies within the radius.

        Where a query hits a point, the point's subtrees at distances within
        the radius hang on that point already (``near``), so they are left
        out: connections stay whole, and dense groups cost no square.
        """
        found = [np.zeros((2, 0), np.int64)]
        root = self.root[shard]
        ask = np.flatnonzero(root >= 0)
        waiting = [(ask[i : i + most], root[ask[i : i + most]]) for i in range(0, len(ask), most)]
        while waiting:
            query, node = waiting.pop()
            apart = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            hit = apart <= self.radius
            found.append(np.stack([query[hit], node[hit]]))
            low = np.where(hit, self.radius + 1, np.maximum(apart - self.radius, 0))
            first = np.searchsorted(self.codes, node * 65 + low)
            last = np.searchsorted(self.codes, node * 65 + np.minimum(apart + self.radius, 64), "right")
            count = np.maximum(last - first, 0)
            if not count.any():
                continue
            edge = np.cumsum(count)
            for lo in range(0, int(edge[-1]), most):
                take = np.arange(lo, min(lo + most, int(edge[-1])))
                of = np.searchsorted(edge, take, "right")
                child = self.nodes[first[of] + take - (edge[of] - count[of])]
                waiting.append((query[of], child))
        return np.concatenate(found, axis=1)


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label of ``n`` points under links ``a[i]``–``b[i]``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        if (label == before).all():
            break
    return label


def _link_batches(radius: int, chunk: int = 1 << 18):
    """Star links inside each shard: at most one row for each row read."""

    def settle(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        shard_of, prints, asks = (np.concatenate([x[i] for x in held]) for i in range(3))
        shard = np.unique(shard_of, axis=0, return_inverse=True)[1].ravel()
        value = prints.view(np.uint64)
        points = np.flatnonzero(~asks)
        forest = Forest(value[points], shard[points], radius)
        all_shards = np.full(int(shard.max(initial=-1)) + 1, -1, np.int64)
        all_shards[: len(forest.root)] = forest.root
        forest.root = all_shards
        hits = forest.links(value, shard)
        near = points[forest.near]
        label = smallest_labels(len(value), np.concatenate([hits[0], near[0]]), np.concatenate([points[hits[1]], near[1]]))
        tied = np.flatnonzero(prints != prints[label])
        return pa.RecordBatch.from_arrays([pa.array(prints[tied]), pa.array(prints[label[tied]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = (
                np.stack([batch.column(c).to_numpy() for c in ("pair", "key", "salt")], axis=1),
                batch.column("print").to_numpy(),
                batch.column("asks").to_numpy(zero_copy_only=False),
            )
            if size >= chunk:  # cut where a shard begins
                edge = np.flatnonzero((part[0] != held[-1][0][-1]).any(axis=1))
                cut = int(edge[0]) if len(edge) else len(part[1])
                held.append(tuple(x[:cut] for x in part))
                if len(edge):
                    yield settle(held)
                    held, size = [], 0
                part = tuple(x[cut:] for x in part)
            if len(part[1]):
                held.append(part)
                size += len(part[1])
        if held:
            yield settle(held)

    return run


def _shard_keys(radius: int) -> F.Column:
    """All pairs of bit blocks, as (pair, key)."""
    count = radius + 2
    edges = [64 * i // count for i in range(count + 1)]

    def block(i: int):
        width = edges[i + 1] - edges[i]
        return F.shiftrightunsigned("print", edges[i]).bitwiseAND(F.lit((1 << width) - 1))

    keys = [
        F.struct(F.lit(n).cast("long").alias("pair"), (F.shiftleft(block(i), 32) + block(j)).alias("key"))
        for n, (i, j) in enumerate(combinations(range(count), 2))
    ]
    return F.explode(F.array(*keys))


def linked_prints(prints: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """``(node, component)`` of distinct fingerprints within ``radius`` bits.

    A key with more than ``shard_rows`` points is salted into several trees.
    Those first find components among themselves; then every point outside the
    key's largest component asks all trees of its key. Two points of the
    largest one are connected already, so no link is lost.
    """
    keyed = prints.select("print", _shard_keys(radius).alias("x")).select("print", "x.pair", "x.key")
    often = keyed.groupBy("pair", "key").count().filter("count > 1")
    shards = stage(
        keyed.join(often, ["pair", "key"]).select(
            "pair", "key", "print",
            F.ceil(F.col("count") / shard_rows).cast("long").alias("salts"),
        ).withColumn("salt", F.pmod(F.xxhash64("print"), F.col("salts"))),
        "shards",
    )
    place = ["pair", "key", "salt"]

    def search(rows: DataFrame) -> DataFrame:
        dealt = rows.select(*place, "print", "asks").repartition(*place).sortWithinPartitions(*place)
        return dealt.mapInArrow(_link_batches(radius), "a long, b long").distinct()

    links = stage(search(shards.withColumn("asks", F.lit(False))), "near_links")
    split = shards.filter("salts > 1")
    if split.isEmpty():
        return components(links)
    first = stage(components(links), "first_components")
    part = split.join(first.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "part", F.coalesce("component", "print")
    )
    main = part.groupBy("pair", "key", "part").count().groupBy("pair", "key").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    askers = part.join(main, ["pair", "key"]).filter("part <> main").select(
        "pair", "key", "print", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("asks")
    )
    more = search(split.select(*place, "print", F.lit(False).alias("asks")).unionByName(askers))
    return components(links.unionByName(more))


def simhash_groups(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, shard_rows: int = 1 << 16
) -> DataFrame:
    """``(id, fingerprint, component)`` for each row of ``docs``.

    Words are lower-cased in A–Z; a text of fewer words is one shingle; null
    and empty texts have fingerprint zero and are linked like any other. The
    component is the smallest id reachable (null only if all its ids are
    null). Equal fingerprints are one node, so repeated rows and groups of
    copies cost one point. An empty table gives an empty table. Runs jobs.
    """
    prepare(docs.sparkSession)
    plain = docs.select(named(docs, ident).alias("id"), text_of(docs, text).alias("_t"))
    kind = plain.schema["id"].dataType.simpleString()
    prints = stage(plain.mapInArrow(_print_batches(width), f"id {kind}, print long"), "fingerprints")
    nodes = prints.groupBy("print").agg(F.min("id").alias("least"))
    linked = stage(linked_prints(nodes.select("print"), radius, shard_rows), "components")
    placed = nodes.join(linked.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("component", "print").alias("part")
    )
    lowest = placed.groupBy("part").agg(F.min("least").alias("component"))
    named_parts = placed.join(lowest, "part").select("print", "component")
    return prints.join(named_parts, "print").select(
        "id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component"
    )


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")
    found = simhash_groups(docs)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))
