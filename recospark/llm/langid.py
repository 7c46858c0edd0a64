"""Language identification by cross-parsing entropy.

From a bounded sample of labelled texts of each language a suffix automaton is built. A text is parsed against each
automaton: a phrase runs as long as some training text holds it and ends at the symbol that breaks the match, where the
next one starts. The language with the smallest cost, phrases * log2(training length) / symbols, wins. Texts are parsed
in runs of RUN symbols, so that the runs of many texts step through the automata together; every run begins a new phrase.

Symbols: letters folded to lower case that a language's own sample holds often enough; its other letters are one symbol,
every other character is one space, and stretches of spaces are one symbol. Each language has an alphabet of its own, so
that no script takes another's letters. Every language that is labelled is learned; of long texts an excerpt is.

Defined results: a text that is null, or without a letter, is "und" with score 0, as is every text if nothing was
learned; repeated rows get the same answer each; equal costs go to the language first in alphabetical order; an empty
table stays empty. A null id is never learned from. Other columns are neither read nor returned unless asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recospark.llm.common import chunks, tidy

UNDETERMINED = "und"
#: Training bounds: symbols in all and in a language, documents drawn for a language, characters of a drawn document.
MOST_SYMBOLS, LANGUAGE_SYMBOLS, DRAWN, DRAWN_CHARS = 160_000, 40_000, 96, 8_000
#: Symbols that a language is learned from however many languages there are, symbols in a run.
LEAST_SYMBOLS, RUN = 2_000, 1024
#: A language's letters with a column of their own in its table, by frequency; transitions by others are searched.
COLUMNS = 62


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """A text's letters, lower case, with one 0 for each stretch of other characters."""
    x = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    return x[keep]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a string: each state's next states by symbol. State 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


@dataclass
class Model:
    """Stacked automata: next offsets (0: none), each language's root, log2 of its training length, and all letters.

    columns: each language's column of a symbol in its table; 1, always empty, for letters that it has no column for.
    start: where a symbol leads from each language's root (the root: nowhere). keys and nexts: the transitions without a
    column, as sorted offset * symbols + symbol and next offset.
    """

    languages: list[str]
    alphabet: np.ndarray
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray
    columns: np.ndarray
    start: np.ndarray
    keys: np.ndarray
    nexts: np.ndarray

    @property
    def width(self) -> int:
        return len(self.alphabet) + 2

    @property
    def kind(self) -> type:
        return np.uint8 if self.width <= 1 << 8 else np.uint16 if self.width <= 1 << 16 else np.uint32

    def symbols(self, text: str) -> np.ndarray:
        """0: a space, 1: a letter that no language was learned with, else a letter."""
        x = letters(text)
        if not len(self.alphabet):
            return (x != 0).astype(self.kind)
        at = np.minimum(np.searchsorted(self.alphabet, x), len(self.alphabet) - 1)
        return np.where(x == 0, 0, np.where(self.alphabet[at] == x, at + 2, 1)).astype(self.kind)


def fit(samples: dict[str, list[str]]) -> Model:
    """A model from each language's sample of texts."""
    languages = sorted(samples)
    seen = [np.unique(letters(text)) for language in languages for text in samples[language]]
    alphabet = np.unique(np.concatenate([np.zeros(1, np.uint32), *seen]))[1:]
    width = len(alphabet) + 2
    columns, start = np.ones((len(languages), width), np.int64), np.zeros((len(languages), width), np.int64)
    none = np.zeros(0, np.int64)
    model = Model(languages, alphabet, none, none, np.zeros(0), columns, start, none, none)
    most = min(LANGUAGE_SYMBOLS, max(LEAST_SYMBOLS, MOST_SYMBOLS // max(1, len(languages))))
    tables, roots, bits, base, far = [np.zeros(COLUMNS + 2, np.int32)], [], [], COLUMNS + 2, []
    for number, language in enumerate(languages):
        learned: list[int] = []
        for text in samples[language]:
            if len(learned) < most:
                learned += [*model.symbols(text).tolist(), 0]
        learned = learned[:most]
        counted = Counter(c for c in learned if c)
        near = [c for c, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:COLUMNS]]
        own = {0: 0, **{c: i + 2 for i, c in enumerate(near)}}
        size = len(near) + 2
        states = automaton(learned)
        table = np.zeros((len(states), size), np.int32)
        for state, out in enumerate(states):
            for c, to in out.items():
                if c in own:
                    table[state, own[c]] = base + to * size
                else:
                    far.append(((base + state * size) * width + c, base + to * size))
        columns[number, list(own)] = list(own.values())
        start[number] = base
        for c, to in states[0].items():
            start[number, c] = base + to * size
        roots.append(base)
        bits.append(np.log2(len(learned) + 2))
        tables.append(table.ravel())
        base += table.size
    model.table, model.roots, model.bits = np.concatenate(tables), np.array(roots, np.int64), np.array(bits)
    if far:
        model.keys, model.nexts = np.array(sorted(far), np.int64).T.copy()
    return model


def phrases(model: Model, runs: list[np.ndarray]) -> np.ndarray:
    """For each language (rows) and run of symbols (columns), how many phrases the run parses into."""
    order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
    lengths = np.array([len(runs[i]) for i in order])
    steps = int(lengths[0]) if len(lengths) else 0
    grid = np.zeros((len(runs), steps), model.kind)
    for k, i in enumerate(order):
        grid[k, : len(runs[i])] = runs[i]
    grid = np.ascontiguousarray(grid.T)
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    count = np.zeros((len(model.languages), len(runs)), np.int32)
    state = np.repeat(model.roots[:, None], len(runs), 1)
    start, columns = model.start, model.columns
    searched = np.zeros(model.width, bool)
    searched[model.keys % model.width] = True
    for t in range(steps):
        n = active[t]
        symbol = grid[t, :n].astype(np.int64)
        to = model.table.take(state[:, :n] + columns.take(symbol, 1))
        if len(model.keys) and len(rare := np.flatnonzero(searched[symbol])):
            wanted = state[:, rare] * model.width + symbol[rare]
            at = np.minimum(np.searchsorted(model.keys, wanted), len(model.keys) - 1)
            to[:, rare] = np.where(model.keys[at] == wanted, model.nexts[at], to[:, rare])
        broken = to == 0
        count[:, :n] += broken
        state[:, :n] = np.where(broken, start.take(symbol, 1), to)
    out = np.empty_like(count)
    out[:, order] = count + 1
    return out


def identify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text's language, the margin by which it wins (0 to 1), and its cost in bits a symbol."""
    runs, owner, sizes = [], [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        x = model.symbols(text) if text and model.languages else np.zeros(0, model.kind)
        if x.any():
            sizes[i] = len(x)
            parts = [x[a : a + RUN] for a in range(0, len(x), RUN)]
            runs += parts
            owner += [i] * len(parts)
    names, margin, least = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if runs:
        found = phrases(model, runs)
        total = np.stack([np.bincount(owner, x, len(texts)) for x in found])
        cost = total * model.bits[:, None] / np.maximum(sizes, 1)
        best = cost.argmin(0)
        first = cost.min(0)
        second = np.partition(cost, 1, 0)[1] if len(cost) > 1 else np.full(len(texts), np.inf)
        for i in np.flatnonzero(sizes):
            names[i] = model.languages[best[i]]
            margin[i] = 1.0 if np.isinf(second[i]) else (second[i] - first[i]) / max(second[i], 1e-12)
            least[i] = first[i]
    return names, margin, least


def sample(df: DataFrame, learn: Column) -> dict[str, list[str]]:
    """A bounded sample of labelled texts: for each language, those of the smallest id hashes, of long ones an excerpt."""
    known = df.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * DRAWN / n))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.filter(place < shares[F.col("lang")])
    excerpt = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, DRAWN_CHARS)
    rows = drawn.select("lang", excerpt.alias("text"), place.alias("place")).orderBy("place", "text").limit(3 * DRAWN * len(counts)).collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        own = out.setdefault(r.lang, [])
        if len(own) < DRAWN:
            own.append(r.text)
    return out


def predict(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred, score (0 to 1) and bits (cost in bits a symbol) of each row; keep has none of these."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([df.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double").add("bits", "double")
    arrow = to_arrow_schema(schema)
    columns = keep if text in keep else [*keep, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                names, margin, bits = identify(shared.value, part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(margin), pa.array(bits)], schema=arrow)

    return df.select(*columns).mapInArrow(tidy(run), schema)
