"""Hierarchical multi-length packing of documents into token sequences.

Each task routes its documents to tiers of context size (TIERS). A document longer than the longest window gives full
windows and a tail; a tail goes to the smallest tier that holds it. Tiers are packed from the longest down: each window
takes one tail of its tier, its gap is filled by the longest fitting tails of shorter tiers, and what then is left by a
piece cut off a shorter tail, whose rest goes back to its tier. What remains of the last windows is cut at powers of two,
which are not padded. The sequences of each size are dealt over step groups, whose numbers of tokens differ by one
longest window at most.

Nothing is shuffled: every task packs its own documents, RUN tokens at a time, so memory is bounded by a run and the
longest document. A sequence's id holds the task's number, so a task that runs again gives the same ids.

Defined results: a null text counts as empty and gives the end id alone; ids and their order are kept, and each lies in
exactly one piece; repeated rows are packed as often as they occur, also under a null id; an empty table gives no piece.
"""

from __future__ import annotations

import heapq
import os
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recospark.llm.common import chunks, tidy

#: Sizes of windows; tokens of a step group, in longest windows; tokens packed together; words whose ids are kept.
TIERS, STEP_WINDOWS, RUN, REMEMBERED = (256, 512, 1024, 2048), 8, 2_000_000, 400_000
#: Words that the tokenizer gets as one text.
JOINED = 64
#: The id that ends every document.
END = 1

SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_id long"

#: A letter before a punctuation mark: the tokenizer parts them anyway.
_PARTED = r"([a-z])([!-&(-/:-@\[-`{-~])"
#: What the tokenizer takes as one piece.
_PLAIN = r"^(\pL+|[!-&(-/:-@\[-`{-~]+)$"


def _words(docs: pa.Array) -> pa.Array:
    """Each document's white-space separated words, "" among them, which the tokenizer treats as it does the text.

    It folds to lower case itself; where a special token's spelling may begin, nothing is folded or parted.
    """
    parted = pc.replace_substring_regex(pc.ascii_lower(docs), _PARTED, r"\1 \2")
    special = pc.match_substring(docs, "<|")
    return pc.ascii_split_whitespace(pc.if_else(special, docs, parted) if pc.any(special).as_py() else parted)


class Words:
    """Ids of white-space separated words. The tokenizer drops white space and never joins what it parts.

    The ids of REMEMBERED words at most are kept; when they are full, those not used since the last time go.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # Each piece of a text ends with one id whose token says so.
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # A known word has counts[i] ids, which begin at starts[i].
        self.known, self.used = pa.array([], pa.string()), np.zeros(0, bool)
        self.flat, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the words, where each word's begin there, and how many it has."""
        plain = np.asarray(pc.match_substring_regex(words, _PLAIN))
        alone = [np.flatnonzero(~plain)]
        flat, starts, counts, base = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        joined = np.flatnonzero(plain)
        text = words.take(pa.array(joined)).to_pylist()
        for a in range(0, len(joined), JOINED * 64):
            groups = range(a, min(a + JOINED * 64, len(joined)), JOINED)
            for g, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(text[g : g + JOINED]) for g in groups], add_special_tokens=False), strict=True):
                own, found = joined[g : g + JOINED], np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.ends[found]) + 1
                if len(ends) != len(own) or ends[-1] != len(found):
                    alone.append(own)
                    continue
                counts[own] = np.diff(ends, prepend=0)
                starts[own] = base + ends - counts[own]
                flat.append(found)
                base += len(found)
        rest = np.concatenate(alone)
        text = words.take(pa.array(rest)).to_pylist()
        for a in range(0, len(rest), 4096):
            for i, e in zip(rest[a : a + 4096].tolist(), self.tokenizer.encode_batch_fast(text[a : a + 4096], add_special_tokens=False), strict=True):
                flat.append(np.array(e.ids, np.uint32))
                starts[i], counts[i] = base, len(flat[-1])
                base += len(flat[-1])
        return np.concatenate(flat), starts, counts

    def keep(self, words: pa.Array, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Remember words that weren't known."""
        if len(self.known) + len(words) > REMEMBERED:
            sizes = self.counts[self.used]
            ends = np.cumsum(sizes)
            self.flat = self.flat[np.repeat(self.starts[self.used] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
            self.starts, self.counts, self.known = ends - sizes, sizes, self.known.filter(pa.array(self.used))
            self.used = np.zeros(len(self.known), bool)
        if len(self.known) + len(words) <= REMEMBERED:
            self.known = pa.concat_arrays([self.known, words])
            self.starts = np.append(self.starts, len(self.flat) + starts)
            self.counts = np.append(self.counts, counts)
            self.flat = np.concatenate([self.flat, flat])
            self.used = np.append(self.used, np.zeros(len(words), bool))

    def ids(self, docs: pa.Array) -> list[np.ndarray]:
        """Each document's ids, the end id included."""
        if not len(docs):
            return []
        split = _words(docs)
        # Offsets of a slice start where it lies.
        offsets = np.asarray(split.offsets, dtype=np.int64)
        coded = split.flatten().dictionary_encode()
        word, distinct = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
        at = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.known), -1), dtype=np.int64)
        new = at < 0
        self.used[at[~new]] = True
        fresh = distinct.filter(pa.array(new))
        flat, begin, counts = self.encoded(fresh)
        # The distinct words' ids in one array: the known ones' and, behind them, the new ones'.
        starts, sizes = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        starts[~new], sizes[~new] = self.starts[at[~new]], self.counts[at[~new]]
        starts[new], sizes[new] = len(self.flat) + begin, counts
        source = np.concatenate([self.flat, flat])
        sizes = sizes[word]
        ends = np.cumsum(sizes)
        out = source[np.repeat(starts[word] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[offsets - offsets[0]]
        self.keep(fresh, flat, begin, counts)
        end = np.array([END], np.uint32)
        return [np.concatenate([out[a:b], end]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def _words_of(path: str) -> Words:
    """A worker's words, kept from task to task."""
    return Words(path)


def _tier(length: int) -> int:
    return next(t for t in TIERS if length <= t)


def pack(lengths: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (tier, [(document, start, length), ...]) that hold each token of each document once."""
    longest, out = TIERS[-1], []
    # For each tier, its tails as (length, document, start), in ascending order.
    tails: dict[int, list[tuple[int, int, int]]] = {t: [] for t in TIERS}
    for doc, n in enumerate(lengths):
        full = n // longest * longest
        out += [(longest, [(doc, a, longest)]) for a in range(0, full, longest)]
        if n > full:
            tails[_tier(n - full)].append((n - full, doc, full))
    for own in tails.values():
        own.sort()
    for k in range(len(TIERS) - 1, -1, -1):
        tier, shorter = TIERS[k], TIERS[k::-1]
        while tails[tier]:
            n, doc, start = tails[tier].pop()
            window, gap = [(doc, start, n)], tier - n
            while gap:
                for t in shorter:
                    if i := bisect_right(tails[t], (gap, len(lengths), 0)):
                        n, doc, start = tails[t].pop(i - 1)
                        break
                else:
                    # Nothing fits: cut the gap off the longest shorter tail.
                    source = next((tails[t] for t in shorter if tails[t]), None)
                    if source is None:
                        break
                    most, doc, start = source.pop()
                    n = gap
                    insort(tails[_tier(most - n)], (most - n, doc, start + n))
                window.append((doc, start, n))
                gap -= n
            out += [(tier, window)] if not gap else _halved(window)
    return out


def _halved(window: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """A window that nothing fills any more, cut into sequences whose lengths are powers of two."""
    out, rest = [], sum(n for *_, n in window)
    pieces = list(reversed(window))
    while rest:
        room = size = 1 << (rest.bit_length() - 1)
        own = []
        while room:
            doc, start, n = pieces.pop()
            own.append((doc, start, min(n, room)))
            if n > room:
                pieces.append((doc, start + room, n - room))
            room -= min(n, room)
        out.append((size, own))
        rest -= size
    return out


def step_groups(sizes: list[int]) -> list[int]:
    """Each sequence's step group, given their sizes, largest first: each goes to the group that holds the fewest tokens.

    There are as many groups as full ones of STEP_WINDOWS longest windows, one at least, and as sizes are powers of two
    groups differ by one longest window at most; every group gets its share of each size.
    """
    groups = [(0, g) for g in range(max(1, sum(sizes) // (STEP_WINDOWS * TIERS[-1])))]
    out = []
    for size in sizes:
        load, g = groups[0]
        heapq.heapreplace(groups, (load + size, g))
        out.append(g)
    return out


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document: its id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset in the sequence, tier (the sequence's length) and step_id (its step group).

    tokenizer: path of a tokenizers file that parts words at white space; END ends each document.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([df.schema[id_col], *StructType.fromDDL(SCHEMA)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, sequence, step, held = _words_of(tokenizer), TaskContext.get().partitionId() << 40, 0, 0, 0
        owners: list = []
        ids: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            nonlocal sequence, step, held
            rows = []
            sequences = sorted(pack([len(x) for x in ids]), key=lambda x: -x[0])
            groups = step_groups([tier for tier, _ in sequences])
            for (tier, pieces), group in zip(sequences, groups, strict=True):
                offset = 0
                for doc, start, n in pieces:
                    rows.append((owners[doc], start, n, ids[doc][start : start + n].tobytes(), len(ids[doc]), base + sequence, offset, tier, base + step + group))
                    offset += n
                sequence += 1
            step += max(groups) + 1
            held = 0
            owners.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for part in chunks(batch, text):
                owners += part.column(id_col).to_pylist()
                found = words.ids(pc.fill_null(part.column(text).cast(pa.string()), ""))
                ids += found
                held += sum(map(len, found))
                if held >= RUN:
                    yield packed()
        if ids:
            yield packed()

    return df.select(id_col, text).mapInArrow(tidy(run), schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")
