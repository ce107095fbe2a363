"""Consistent hashing of document ids to shards, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

VIRTUAL_NODES = 100


def ring(shards: list[str], virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[str, str]]:
    """(point, shard) in ascending order of points; hex digests compare as the numbers they write."""
    if not shards:
        raise ValueError("a ring needs at least one shard")
    if len(set(shards)) != len(shards) or not all(shards):
        raise ValueError("shard ids are to be distinct and not empty")
    if virtual_nodes <= 0:
        raise ValueError("a shard needs at least one virtual node")
    return sorted((hashlib.sha256(f"{s}:{k}".encode()).hexdigest(), s) for s in shards for k in range(virtual_nodes))


def shard_of(doc_id: Column, shards: list[str], virtual_nodes: int = VIRTUAL_NODES) -> Column:
    """The shard of the first point strictly after the id's digest, around the ring."""
    points = ring(shards, virtual_nodes)
    digest = F.sha2(doc_id.cast("string"), 256)
    if len(shards) == 1:
        return F.when(doc_id.isNotNull(), F.lit(shards[0]))
    passed = lambda d: F.size(F.filter(F.array(*(F.lit(p) for p, _ in points)), lambda p: p <= d))
    at = F.transform(F.array(digest), passed)[0]  # the digest is computed once, not for each point
    return F.when(doc_id.isNotNull(), F.element_at(F.array(*(F.lit(s) for _, s in points), F.lit(points[0][1])), at + 1))
