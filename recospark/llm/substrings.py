"""Substring deduplication with difference-cover anchors.

A word is removed if it lies in a window of WINDOW words whose sequence also starts in a document with a smaller id.
COVER is a difference cover modulo PERIOD: for any two places there is a shift of less than PERIOD that brings both to
cover places. Anchors are the runs of ANCHOR = WINDOW - PERIOD + 1 words at cover places, so two equal windows share an
anchor at the same shift. Anchors are hashed, and those that two documents share are kept; around them alone all windows
are hashed (the extension), and the least document of each window is found.

What a run of documents shows by itself is settled where it is read: there an anchor or window that several documents
share is sent on once, so a passage in a third of all documents makes no large group. The texts are shuffled once, and
that exchange serves both joins.

Defined results: words are what stands between ASCII white space, unchanged; a null or empty text has none; a text of
fewer words than a window loses none, though its words were repeated elsewhere. Rows repeated under an id never make each
other lose words, as neither id is smaller; where their texts differ, each is told from the others by a hash of its text
(`version`, else 0). A null id takes no part and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recospark.llm.common import checkpoint, chunks, texts, tidy
from recospark.llm.shingles import BASES, Rolling, word_hashes

#: The window, and a perfect difference set: each residue but 0 is the difference of one pair.
WINDOW, PERIOD, COVER = 50, 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Anchors or windows of a run of documents, within which repeats are settled at once.
SETTLED = 1_000_000


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and the number of each place's group in that order."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _range_of_docs(docs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest document of each place's group; group: ascending numbers."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    return np.minimum.reduceat(docs, starts)[group], np.maximum.reduceat(docs, starts)[group]


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a document's anchors, from the hashes of its words."""
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    places = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    places = places[places + ANCHOR <= n]
    return Rolling(hashes).at(places, ANCHOR).view(np.int64), places.astype(np.int32)


def _stacked(parts: list[tuple], kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc_id, version, place) of the first anchor of each hash in each document; place is -1 - place if this run of
    documents shows that others share it."""
    found, size = [], 0
    for batch in batches:
        for doc, version, text in zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(), texts(batch), strict=True):
            if doc is None:
                continue
            h, places = anchors(word_hashes(text.split()))
            found.append((h, np.full(len(h), doc, np.int64), np.full(len(h), version, np.int64), places))
            size += len(h)
            if size >= SETTLED:
                yield from _sent(found)
                found, size = [], 0
    yield from _sent(found)


def _sent(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """What a run of documents sends of its anchors (h, doc_id, version, place)."""
    h, docs, versions, places = _stacked(found, (np.int64, np.int64, np.int64, np.int32))
    if not len(h):
        return
    order, group = _groups(h, docs, versions)
    order = order[np.diff(group, prepend=-1) != 0]
    h, docs, versions, places = h[order], docs[order], versions[order], places[order]
    _, group = np.unique(h, return_inverse=True)
    least, most = _range_of_docs(docs, group)
    known = least != most
    sent = ~known | (np.diff(group, prepend=-1) != 0)  # one of a known group tells other runs of documents
    # What is known needs no group any more and is spread evenly.
    spread = (docs[known] * np.int64(1000003) + places[known]) * np.int64(0x5851F42D4C957F2D)
    both = [np.concatenate([x[sent], x[known]]) for x in (docs, versions)]
    columns = np.concatenate([h[sent], spread]), *both, np.concatenate([places[sent], -1 - places[known]]).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "doc_id", "version", "place"])


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, version, place) of the anchors that several documents have; all rows of a hash are in one partition."""
    parts = [[np.asarray(c) for c in b.columns] for b in batches]
    h, docs, versions, places = _stacked(parts, (np.int64, np.int64, np.int64, np.int32))
    known = places < 0
    yield pa.RecordBatch.from_arrays([pa.array(docs[known]), pa.array(versions[known]), pa.array(-1 - places[known])], ["doc_id", "version", "place"])
    h, docs, versions, places = (x[~known] for x in (h, docs, versions, places))
    if len(h):
        order, group = _groups(h)
        least, most = _range_of_docs(docs[order], group)
        kept = order[least != most]
        yield pa.RecordBatch.from_arrays([pa.array(docs[kept]), pa.array(versions[kept]), pa.array(places[kept])], ["doc_id", "version", "place"])


def candidates(places: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at the places, in a document of n words."""
    change = np.zeros(n + 2, np.int32)
    np.add.at(change, np.maximum(places - (WINDOW - ANCHOR), 0), 1)
    np.add.at(change, places + 1, -1)
    return np.flatnonzero(np.cumsum(change)[: max(0, n - WINDOW + 1)] > 0)


#: Columns of the windows that are sent, and their types.
_SENT = {"h": np.int64, "tag": np.int32, "doc_id": np.int64, "version": np.int64, "start": np.int32, "number": np.int32}


def _starts_of_runs(starts: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where runs of consecutive starts with equal keys begin."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _settled(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (h, tag, doc_id, version, start, number) of a run of documents: runs of windows that are known to start in a
    smaller document (number > 0), and runs of equal ones to compare (-number of them)."""
    columns = _stacked(found, tuple(_SENT.values())[:-1])
    if not len(columns[0]):
        return
    order, group = _groups(*columns[:2])
    h, tag, docs, versions, starts = (x[order] for x in columns)
    least, _ = _range_of_docs(docs, group)
    known = docs > least
    own = [x[~known] for x in (h, tag, docs, versions, starts)]
    first = _starts_of_runs(own[4], *own[:4])
    out = [(*(x[first] for x in own), -np.diff(np.append(first, len(own[0]))).astype(np.int32))]
    if known.any():
        d, v, s = docs[known], versions[known], starts[known]
        order = np.lexsort((s, v, d))
        d, v, s = d[order], v[order], s[order]
        keep = np.ones(len(d), bool)
        keep[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])
        d, v, s = d[keep], v[keep], s[keep]
        first = _starts_of_runs(s, d, v)
        number = np.diff(np.append(first, len(d))).astype(np.int32)
        d, v, s = d[first], v[first], s[first]
        out.append(((d * np.int64(1000003) + s) * np.int64(0x5851F42D4C957F2D), np.zeros(len(d), np.int32), d, v, s.astype(np.int32), number))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _stacked(out, tuple(_SENT.values()))], [*_SENT])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows around shared anchors."""
    found, size = [], 0
    for batch in batches:
        for doc, version, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version")), texts(batch), batch.column("places").to_pylist(), strict=True):
            if doc is None or not places:
                continue
            hashes = word_hashes(text.split())
            # Anchors of one hash are shared together.
            h, at = anchors(hashes)
            starts = candidates(at[np.isin(h, h[np.isin(at, places)])].astype(np.int64), len(hashes))
            if n := len(starts):
                h, other = (Rolling(hashes, b).at(starts, WINDOW) for b in BASES)
                tag = (other >> np.uint64(32)).astype(np.uint32).view(np.int32)
                found.append((h.view(np.int64), tag, np.full(n, doc, np.int64), np.full(n, version, np.int64), starts.astype(np.int32)))
                size += n
            if size >= SETTLED:
                yield from _settled(found)
                found, size = [], 0
    yield from _settled(found)


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, version, start, number): runs of windows that start in a smaller document too."""
    names = ["doc_id", "version", "start", "number"]
    parts = [[np.asarray(c) for c in b.columns] for b in batches]
    columns = _stacked(parts, tuple(_SENT.values()))
    known = columns[5] > 0
    yield pa.RecordBatch.from_arrays([pa.array(x[known]) for x in columns[2:]], names)
    h, tag, docs, versions, starts, number = (x[~known] for x in columns)
    if len(h):
        order, group = _groups(h, tag)
        least, _ = _range_of_docs(docs[order], group)
        kept = order[docs[order] > least]
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (docs, versions, starts, -number)], names)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            kept, counts, removed = [], [], []
            for text, starts, numbers in zip(texts(part), part.column("starts").to_pylist(), part.column("numbers").to_pylist(), strict=True):
                words = text.split()
                counts.append(len(words))
                if starts:
                    change = np.zeros(len(words) + WINDOW + 1, np.int32)
                    s, n = np.array(starts), np.array(numbers)
                    np.add.at(change, s, 1)
                    np.add.at(change, s + n + WINDOW - 1, -1)
                    left = np.flatnonzero(np.cumsum(change)[: len(words)] == 0).tolist()
                    removed.append(len(words) - len(left))
                    words = [words[i] for i in left]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kept (the words that stay, joined by a space), n_words and n_removed of each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    key, said = ["doc_id", "version"], F.xxhash64(F.col("text"), F.col("text").isNull())
    # Ids under which different texts stand: none, as a rule.
    several = checkpoint(rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(said).alias("a"), F.max(said).alias("b")).filter(F.col("a") != F.col("b")).select("doc_id"))
    if several.limit(1).count():
        marked = rows.join(several.withColumn("several", F.lit(True)).hint("shuffle_hash"), "doc_id", "left")
        rows = marked.select("doc_id", F.when(F.col("several"), said).otherwise(F.lit(0)).cast("long").alias("version"), "text")
    else:
        rows = rows.select("doc_id", F.lit(0).cast("long").alias("version"), "text")
    anchored = rows.mapInArrow(tidy(_anchor_rows), "h long, doc_id long, version long, place int").repartition("h")
    shared = anchored.mapInArrow(tidy(_shared_anchors), "doc_id long, version long, place int")
    places = shared.groupBy(*key).agg(F.collect_list("place").alias("places"))
    # Both joins are left joins of the same rows, so that the texts are exchanged once.
    windows = rows.join(places.hint("shuffle_hash"), key, "left").select(*key, "text", "places")
    compared = windows.mapInArrow(tidy(_window_rows), "h long, tag int, doc_id long, version long, start int, number int").repartition("h")
    repeated = compared.mapInArrow(tidy(_repeated_windows), "doc_id long, version long, start int, number int")
    removed = repeated.groupBy(*key).agg(F.collect_list("start").alias("starts"), F.collect_list("number").alias("numbers"))
    marked = rows.join(removed.hint("shuffle_hash"), key, "left").select("doc_id", "text", "starts", "numbers")
    return marked.mapInArrow(tidy(_kept), "doc_id long, kept string, n_words long, n_removed long")
