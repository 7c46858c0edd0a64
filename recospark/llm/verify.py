"""Candidate groups of near-duplicates split by the exact similarity of their word shingles.

Within a candidate group two texts are linked if the Jaccard similarity of their sets of word shingles (as 64-bit hashes)
is `threshold` or more; what is left are the connected groups of these links. Copies of one text are one text from the
start. A group of up to PART_BYTES of distinct text is compared as a whole in one task. A larger one is dealt over parts of
half as much, and each two of its parts are compared in one task, so every pair of texts meets whatever the group's size;
such a group's work grows with its square. Pairs are never written out: a task gives a link for each text that belongs to
another.

Words are what stands between ASCII white space, A-Z folded to lower case; a text of fewer words than a shingle is one
shingle, and texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recospark.llm.common import checkpoint, chunks, release, texts, tidy
from recospark.llm.components import stars
from recospark.llm.shingles import Rolling, word_hashes

#: Bytes of text that a task compares at once, a text counting as LEAST_BYTES at least.
PART_BYTES, LEAST_BYTES = 8 << 20, 2048


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    return np.unique(Rolling(word_hashes(words)).at(np.arange(len(words) - k + 1), k))


def connected(ids: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links (id, least of its group) of the groups that similarities of `threshold` or more connect."""
    lengths = np.array([len(s) for s in sets], np.int64)
    known, terms = np.unique(np.concatenate(sets), return_inverse=True)
    terms = terms.astype(np.int32)
    ends = np.cumsum(lengths)
    marked, left, links = np.zeros(len(known), bool), np.arange(len(sets)), []
    flat, owner = terms, np.repeat(np.arange(len(sets), dtype=np.int32), lengths)  # of those that are left
    while len(left):
        group, frontier, left = [int(left[0])], [int(left[0])], left[1:]
        while frontier and len(left):
            i = frontier.pop()
            own = terms[ends[i] - lengths[i] : ends[i]]
            marked[own] = True
            shared = np.bincount(owner, marked[flat], len(sets))[left]
            marked[own] = False
            near = shared >= threshold * (lengths[i] + lengths[left] - shared)
            if near.any():
                group += left[near].tolist()
                frontier += left[near].tolist()
                left = left[~near]
                remains = np.zeros(len(sets), bool)
                remains[left] = True
                flat, owner = flat[remains[owner]], owner[remains[owner]]
        least = min(ids[i] for i in group)
        links += [(ids[i], least) for i in group if ids[i] != least]
    return links


def _links(shingle: int, threshold: float):
    """Streams rows (key, doc_id, text) sorted by key, and gives out the links of each key's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, found = None, [], [], []

        def close() -> None:
            if len(ids) > 1:
                found.extend(connected(ids, sets, threshold))
            ids.clear()
            sets.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])
            found.clear()
            return batch

        for batch in batches:
            for part in chunks(batch, "text"):
                for key, doc, text in zip(part.column("key").to_pylist(), part.column("doc_id").to_pylist(), texts(part), strict=True):
                    if key != at:
                        close()
                        at = key
                    ids.append(doc)
                    sets.append(shingles(text, shingle))
            if found:
                yield out()
        close()
        if found:
            yield out()

    return run


def duplicates(docs: DataFrame, candidates: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id of each document (doc_id, text; no null id) that isn't the least of its verified group.

    candidates: doc_id and component_id, the candidate group, of each document.
    """
    groups = candidates.groupBy("component_id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter(F.col("a") != F.col("b")).select("component_id")
    members = candidates.select("doc_id", "component_id").distinct().join(groups, "component_id")
    marked = docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.greatest(F.octet_length("text"), F.lit(LEAST_BYTES)).cast("long").alias("size")).join(members.hint("shuffle_hash"), "doc_id")
    marked = checkpoint(marked.select("component_id", "digest", "doc_id", "size").distinct())
    leaders = marked.groupBy("component_id", "digest").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))
    copies = marked.join(leaders.select("component_id", "digest", F.col("doc_id").alias("leader")), ["component_id", "digest"]).filter(F.col("doc_id") != F.col("leader"))
    sizes = leaders.groupBy("component_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter(F.col("n") > 1)
    parts = F.when(F.col("bytes") > PART_BYTES, F.ceil(2 * F.col("bytes") / PART_BYTES)).otherwise(1).cast("long")
    leaders = checkpoint(leaders.join(sizes.select("component_id", parts.alias("parts")), "component_id").select("component_id", "doc_id", "parts"))
    release(docs.sparkSession)
    named = docs.select("doc_id", "text")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = leaders.select("component_id", "doc_id", "parts", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), others)
    # Each two parts meet; a part's own pairs do so wherever it meets another.
    dealt = dealt.filter((F.col("parts") == 1) | (F.col("part") != F.col("other")))
    keyed = dealt.select(F.xxhash64("component_id", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "doc_id")
    # Equal keys of different groups only mean more comparisons, as every link is verified.
    rows = named.join(keyed.hint("shuffle_hash"), "doc_id").select("key", "doc_id", "text").repartition("key").sortWithinPartitions("key")
    links = stars(rows.mapInArrow(tidy(_links(shingle, threshold)), "u long, v long"))
    return copies.select("doc_id").union(links.select(F.col("u").alias("doc_id"))).distinct()
