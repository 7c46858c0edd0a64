"""Benchmark decontamination: test items found in documents by size-partitioned MinHash containment search.

Documents are partitioned by their number of distinct shingles, to the next power of two, and items by theirs. For each
pair of partitions the containment threshold, the item's least and the document's largest number of shingles give the
size of a one-permutation MinHash (see signature_bits): as few bins as let a document that holds an item to the threshold
share the least hash of a bin with it with probability RECALL. Every bin is a band of one row, as a short item in a long
document leaves a Jaccard similarity far too small for more rows. Items of so few shingles that no signature below the
whole set reaches RECALL are searched by all of their hashes. What meets is verified by exact shingle containment on the
words themselves.

Words are what stands between ASCII white space, A-Z folded to lower case. Shingles are runs of `shingle` words; an item
of fewer words is one shingle of all its words, looked for among the documents' runs of that length.

Items of ITEM_BYTES of text at most are broadcast, and documents are read once, without a shuffle. More items are not: they
and the documents are joined by the values of their signatures, and the texts of those that meet are brought together.

Defined results: a null or empty text has no words and neither finds nor is found; items or documents repeated in their
tables give their rows repeated; null ids are kept as null; a document that holds several items gives a row for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recospark.llm.common import chunks, texts, tidy
from recospark.llm.shingles import Rolling, word_hashes

#: The probability that an item which a document holds to the threshold is met; bytes of items that are broadcast;
#: partitions by size (powers of two); parts that documents with one signature value are dealt over where all are joined.
RECALL, ITEM_BYTES, PARTITIONS, SALTS = 0.999, 16 << 20, 40, 16
#: Bits of a signature that keeps every hash.
ALL = 64


@lru_cache(maxsize=4096)
def signature_bits(item_class: int, partition: int, threshold: float) -> int:
    """Bits of the number of bins for items of 2**item_class shingles or more and documents of 2**partition at most.

    A shared shingle is the least of its bin with probability (1 - e**-load) / load, load being the shingles of a bin, and
    a document that holds the item shares threshold * 2**item_class of them at least.
    """
    shared = max(1, math.ceil(threshold * 2**item_class))
    wanted = 1 - (1 - RECALL) ** (1 / shared)
    if wanted > 0.8:
        return ALL
    low, high = 0.0, 1e6
    for _ in range(60):
        load = (low + high) / 2
        low, high = (load, high) if (1 - math.exp(-load)) / max(load, 1e-12) >= wanted else (low, load)
    return max(0, math.ceil(partition - math.log2(low)))


def signature(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The least of the sorted distinct hashes in each of 2**bits bins."""
    if bits >= ALL or not len(hashes):
        return hashes
    bins = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
    first = np.ones(len(hashes), bool)
    first[1:] = bins[1:] != bins[:-1]
    return hashes[first]


def partition_of(n: int) -> int:
    """The size partition of a document with n distinct shingles."""
    return min(PARTITIONS - 1, max(0, (n - 1).bit_length()))


def class_of(n: int) -> int:
    """The size class of an item with n distinct shingles."""
    return n.bit_length() - 1


def item_shingles(words: list[bytes], shingle: int) -> tuple[int, set[bytes], np.ndarray]:
    """The length of an item's shingles, the shingles, and their sorted distinct hashes."""
    k = min(shingle, len(words))
    return k, {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}, np.unique(Rolling(word_hashes(words)).at(np.arange(len(words) - k + 1), k))


class Sought:
    """What documents are searched for: for each shingle length the size classes of items."""

    def __init__(self, kinds: set[tuple[int, int]], threshold: float) -> None:
        self.classes, self.threshold = {}, threshold
        for k, size in sorted(kinds):
            self.classes.setdefault(k, []).append(size)

    def signatures(self, words: list[bytes]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(shingle length, size class, partition, values) of a document."""
        rolling = Rolling(word_hashes(words))
        for k, classes in self.classes.items():
            if len(words) < k:
                continue
            hashes = np.unique(rolling.at(np.arange(len(words) - k + 1), k))
            p = partition_of(len(hashes))
            by_bits: dict[int, np.ndarray] = {}
            for size in classes:
                bits = min(ALL, signature_bits(size, p, self.threshold))
                if bits not in by_bits:
                    by_bits[bits] = signature(hashes, bits)
                yield k, size, p, by_bits[bits]


class Items:
    """Items held in memory: their exact shingles, and for each kind and size partition their MinHash values."""

    def __init__(self, rows: list[tuple[int, bytes]], shingle: int, threshold: float) -> None:
        self.ids, self.shingles, self.lengths, self.threshold = [], [], [], threshold
        self.hashes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item, text in rows:
            words = text.lower().split()
            if words:
                k, own, hashes = item_shingles(words, shingle)
                self.hashes.setdefault((k, class_of(len(hashes))), []).append((len(self.ids), hashes))
                self.ids.append(item)
                self.lengths.append(k)
                self.shingles.append(own)
        self.sought = Sought(set(self.hashes), threshold)
        self.values: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def of(self, k: int, size: int, partition: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted values of the items of a kind for a partition, and whose they are."""
        at = k, size, partition
        if at not in self.values:
            parts = [signature(h, signature_bits(size, partition, self.threshold)) for _, h in self.hashes[k, size]]
            values = np.concatenate(parts)
            order = np.argsort(values, kind="stable")
            self.values[at] = values[order], np.repeat([i for i, _ in self.hashes[k, size]], [len(x) for x in parts])[order]
        return self.values[at]

    def met(self, words: list[bytes]) -> list[int]:
        """The items whose signature a document's meets."""
        found = set()
        for k, size, p, own in self.sought.signatures(words) if words else ():
            values, owner = self.of(k, size, p)
            at = np.minimum(np.searchsorted(own, values), len(own) - 1)
            found.update(owner[own[at] == values].tolist())
        return sorted(found)

    def verified(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(item, shared shingles, item's shingles) of the items that a document contains to the threshold."""
        runs: dict[int, set] = {}
        for i in self.met(words):
            k = self.lengths[i]
            if k not in runs:
                runs[k] = {b" ".join(words[a : a + k]) for a in range(len(words) - k + 1)}
            shared, of = len(self.shingles[i] & runs[k]), len(self.shingles[i])
            if shared >= self.threshold * of:
                yield self.ids[i], shared, of


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())


def _shared(docs: DataFrame, items: DataFrame):
    """The items (item_id, text) as a broadcast, or None if they are too large for one."""
    items = _items(items)
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > ITEM_BYTES:
        return None
    return docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in items.collect()])


_KEYS = "key long, k int, size int, partition int, value long"


def _keyed(found: Iterator[tuple[int, int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (key, k, size, partition, value) of (key, k, size, partition, values)."""
    parts = list(found)
    if parts:
        sizes = [len(x[4]) for x in parts]
        heads = [np.repeat(np.array([x[i] for x in parts], np.int64 if i == 0 else np.int32), sizes) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, heads), pa.array(np.concatenate([x[4] for x in parts]).view(np.int64))], ["key", "k", "size", "partition", "value"])


def _joined(docs: DataFrame, items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """doc_id, key (a hash of the document's id and text), item_id, text and item: the texts of each pair that meets."""
    docs = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).withColumn("key", F.xxhash64("doc_id", "text"))
    items = _items(items).withColumn("item_key", F.xxhash64("item_id", "text"))

    def kinds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for text in texts(batch):
                if words := text.lower().split():
                    k, _, hashes = item_shingles(words, shingle)
                    seen.add((k, class_of(len(hashes))))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in sorted(seen)], pa.int32()) for i in (0, 1)], ["k", "size"])

    # A shingle length and a power of two each: a few dozen kinds at most.
    kinds = {(r.k, r.size) for r in items.select("text").mapInArrow(tidy(kinds_of), "k int, size int").distinct().collect()}

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("item_key").to_pylist(), texts(batch), strict=True):
                if words := text.lower().split():
                    k, _, hashes = item_shingles(words, shingle)
                    size = class_of(len(hashes))
                    yield from _keyed((key, k, size, p, signature(hashes, signature_bits(size, p, threshold))) for p in range(PARTITIONS))

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = Sought(kinds, threshold)
        for batch in batches:
            for part in chunks(batch, "text"):
                for key, text in zip(part.column("key").to_pylist(), texts(part), strict=True):
                    if words := text.lower().split():
                        yield from _keyed((key, *x) for x in sought.signatures(words))

    on = ["k", "size", "partition", "value"]
    # Documents with one value, which a third of all may share, are dealt over salts; items go to each of them.
    left = docs.select("key", "text").mapInArrow(tidy(doc_rows), _KEYS).withColumn("salt", F.pmod("key", F.lit(SALTS)))
    right = items.select("item_key", "text").mapInArrow(tidy(item_rows), _KEYS).withColumnRenamed("key", "item_key")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = left.join(right, [*on, "salt"]).select("key", "item_key").distinct()
    found = docs.join(met, "key").join(items.select("item_key", "item_id", F.col("text").alias("item")), "item_key")
    return found.select("doc_id", "key", "item_id", "text", "item")


def _verified(pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs of documents and items that the exact containment of shingles confirms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, key, item, text, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "item_id")), texts(batch), texts(batch, "item"), strict=True):
                k, wanted, _ = item_shingles(other.lower().split(), shingle)
                words = text.lower().split()
                shared = len(wanted & {b" ".join(words[a : a + k]) for a in range(len(words) - k + 1)})
                if shared >= threshold * len(wanted):
                    found.append((doc, key, item, shared, len(wanted), shared / len(wanted)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)

    kinds = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64()), ("containment", pa.float64())])
    return pairs.mapInArrow(tidy(run), "doc_id long, key long, item_id long, n_shared long, n_shingles long, containment double")


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: the items (item_id, text) that documents (doc_id, text) contain."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = _shared(docs, items)
    if shared is None:
        return _verified(_joined(rows, items, shingle, threshold), shingle, threshold).drop("key")
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(shared.value, shingle, threshold)
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [
                    (doc, item, n, of, n / of)
                    for doc, text in zip(part.column(0).to_pylist(), texts(part), strict=True)
                    for item, n, of in index.verified(text.lower().split())
                ]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(tidy(run), "doc_id long, item_id long, n_shared long, n_shingles long, containment double")


def without_items(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs whose text contains no item to the threshold; all columns stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = _shared(docs, items)
    if shared is None:
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        keys = _verified(_joined(own, items, shingle, threshold), shingle, threshold).select("key").distinct()
        return docs.join(keys, F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == keys["key"], "left_anti")
    arrow = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(shared.value, shingle, threshold)
        for batch in batches:
            for part in chunks(batch, "text"):
                kept = [next(index.verified(t.lower().split()), None) is None for t in texts(part)]
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(kept, pa.bool_())).columns, schema=arrow)

    return docs.mapInArrow(tidy(run), docs.schema)
