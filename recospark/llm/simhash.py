"""SimHash near-duplicates: fingerprints, exact search of close pairs by pigeonhole blocks, and connected groups.

A fingerprint has 64 bits, cut in BLOCKS blocks. Of two fingerprints that differ in `distance` bits at most, BLOCKS -
distance blocks at least agree, so the pair meets in one of the tables that key a fingerprint by such a choice of blocks.
Copies are one fingerprint from the start. In a bucket of a table the Hamming distances are verified, and only links that
connect what is close are given out, not all pairs. A bucket of over CROWDED fingerprints is dealt anew by pigeonhole on
its remaining bits, until it can hold no more than CROWDED or so many bits are fixed that few fingerprints remain.

Defined results: words are what stands between ASCII white space, A-Z folded to lower case; a text of fewer words than a
shingle is one shingle; one without words, or null, has fingerprint zero, linked like any other. Repeated rows are rows
of one document each. A null id gets a fingerprint, and as component the least id of its group, or null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recospark.llm.common import checkpoint, chunks, join_skewed, release, texts, tidy
from recospark.llm.components import stars

#: Blocks of a fingerprint; fingerprints in a bucket that are compared at once; times a crowded bucket is dealt anew.
BLOCKS, CROWDED, DEEPER = 6, 4096, 2


def fingerprint(text: bytes, shingle: int, seed: int = 42, distinct: bool = False) -> int:
    """A text's fingerprint as a signed 64-bit integer: a bit is 1 if set in over half of the shingles' hashes.

    distinct: each word counts once (for shingles of one word).
    """
    words = text.lower().split()
    if distinct:
        words = list(dict.fromkeys(words))
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, n)
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], seed) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        part = hashes[a : a + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, views: int = 1, distinct: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id (as doc_id) and the fingerprints (fps, longs under the seeds 42, 43, ...) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                fps = [[fingerprint(x, shingle, 42 + v, distinct) for v in range(views)] for x in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "fps"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, fps array<long>")


@lru_cache(maxsize=4096)
def masks(fixed: int, distance: int) -> tuple[int, ...]:
    """The next tables' masks, given the bits that a bucket's fingerprints share; all as signed integers."""
    free = [b for b in range(64) if not fixed >> b & 1]
    blocks = [part for part in np.array_split(free, max(BLOCKS, distance + 1)) if len(part)]
    if len(blocks) <= distance:
        return (fixed,)
    out = []
    for chosen in combinations(blocks, len(blocks) - distance):
        mask = fixed & ((1 << 64) - 1)
        for b in np.concatenate(chosen):
            mask |= 1 << int(b)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return tuple(out)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits signed 64-bit integers differ."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def connected(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least of its group) that connect a bucket's fingerprints within the distance of each other."""
    left, us, vs = fps, [], []
    while len(left) > 1:
        group, frontier, left = [left[0]], [left[0]], left[1:]
        while frontier and len(left):
            near = differing(left, frontier.pop()) <= distance
            if near.any():
                found = left[near]
                group += found.tolist()
                frontier += list(found)
                left = left[~near]
        if len(group) > 1:
            least = min(group)
            us += [x for x in group if x != least]
            vs += [least] * (len(group) - 1)
    return np.array(us, np.int64), np.array(vs, np.int64)


def _buckets(distance: int):
    """Streams rows (view, mask, key, fp) sorted by all but fp, and gives out the links of each bucket with its view."""

    def links(view: np.ndarray, fps: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, len(fps)))
        # Buckets of two at once.
        two = starts[sizes == 2]
        a, b = fps[two], fps[two + 1]
        near = differing(a, b) <= distance
        views, us, vs = [view[two][near]], [np.maximum(a, b)[near]], [np.minimum(a, b)[near]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            u, v = connected(np.unique(fps[s : s + n]), distance)
            views.append(np.full(len(u), view[s]))
            us.append(u)
            vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (views, us, vs)], ["view", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            own = [np.concatenate([h, np.asarray(c, dtype=np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            new = np.flatnonzero((np.diff(own[0]) != 0) | (np.diff(own[1]) != 0) | (np.diff(own[2]) != 0)) + 1
            starts = np.append(0, new)
            last = starts[-1]
            held = [x[last:] for x in own]
            if last:
                yield from links(own[0][:last], own[3][:last], starts[:-1])
        if len(held[0]):
            yield from links(held[0], held[3], np.zeros(1, np.int64))

    return run


def _dealt_anew(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view, fixed, fps = (np.asarray(c, dtype=np.int64) for c in batch.columns)
            for mask in np.unique(fixed):
                own = fixed == mask
                for deeper in masks(int(mask), distance):
                    yield pa.RecordBatch.from_arrays([pa.array(view[own]), pa.array(np.full(own.sum(), deeper)), pa.array(fps[own])], ["view", "mask", "fp"])

    return run


def close_links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (view, u, v) that connect each view's distinct fingerprints just as all pairs within the distance do.

    fps: view and fp; where they have no views, neither have the links.
    """
    if "view" not in fps.columns:
        return close_links(fps.select(F.lit(0).alias("view"), "fp"), distance).select("u", "v")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fps.select(F.col("view").cast("long").alias("view"), "fp").repartition(tasks, "fp")
    rows = dealt.select("view", F.explode(F.array(*[F.lit(m).cast("long") for m in masks(0, distance)])).alias("mask"), "fp")
    bucket, parts = ["view", "mask", "key"], []
    for depth in range(DEEPER + 1):
        rows = rows.select("view", "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        if depth < DEEPER:
            crowded = checkpoint(rows.groupBy(*bucket).count().filter(F.col("count") > CROWDED).select(*bucket))
            crowds = crowded.count()
        else:
            crowds = 0
        calm = rows.join(crowded, bucket, "left_anti") if crowds else rows
        dealt = calm.repartition(*bucket).sortWithinPartitions(*bucket)
        parts.append(dealt.select(*bucket, "fp").mapInArrow(tidy(_buckets(distance)), "view long, u long, v long"))
        if not crowds:
            break
        rows = rows.join(crowded, bucket, "left_semi").select("view", "mask", "fp").mapInArrow(tidy(_dealt_anew(distance)), "view long, mask long, fp long").distinct()
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, views: int = 1, distinct: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (under seed 42) and component_id (the least id in its group) of each document.

    views: so many fingerprints under other seeds; documents are linked if any of them are close.
    """
    own = checkpoint(fingerprints(docs, shingle, views, distinct, id_col, text))
    copies = checkpoint(own.groupBy(F.col("fps")[0].alias("fp")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    if views == 1:
        links = close_links(copies.select("fp"), distance)
    else:
        # Documents stand for each other by their first fingerprint, which those with another one in common share too.
        seen = own.select(F.col("fps")[0].alias("fp"), F.posexplode("fps").alias("view", "other")).distinct()
        nodes = checkpoint(seen.groupBy("view", "other").agg(F.min("fp").alias("node")))
        ties = seen.join(nodes, ["view", "other"]).filter(F.col("fp") != F.col("node")).select("fp", "node")
        close = checkpoint(close_links(nodes.select("view", F.col("other").alias("fp")), distance).distinct())
        release(docs.sparkSession)
        for end in ("u", "v"):
            close = close.join(nodes.select("view", F.col("other").alias(end), F.col("node").alias(f"{end}_node")), ["view", end])
        links = ties.union(close.select("u_node", "v_node"))
    roots = stars(links.toDF("u", "v")).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    grouped = copies.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    leasts = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpoint(grouped.join(leasts, "root").select("fp", "component_id", "n"))
    return join_skewed(own.select("doc_id", F.col("fps")[0].alias("fp")), named, "fp", "n").select("doc_id", "fp", "component_id")
