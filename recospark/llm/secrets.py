"""Secret scans: a trigram inverted index picks the texts that a rule's regex has to be run on.

Each regex is parsed and a Boolean query of trigrams is derived from it: what every match must contain. Each run of
texts gets an inverted index of the trigrams that the rules ask for (ASCII letters folded to lower case); postings are
intersected and united as a query says, and the regex is run on the candidates alone. A rule without a mandatory
trigram is run on all texts.

Defined results: a null text counts as empty and has no spans; whole texts of any length are scanned; offsets are code
points, the end is exclusive; spans are ordered by start, then by the order of the rules. Repeated rows each get their
own result, and an empty table stays empty. Columns besides the text pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recospark.llm.common import chunks, tidy

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and the least length of a group (0: the match) for a match to stay."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed patterns of the three base kinds.
BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: A PEM key's edges, and its body after the first: headers, then base64 up to the END line, or where that is missing up to
#: the last base64 line (a short last one only if padded or alone on its line). Line breaks may be spaces or escaped.
_PEM = r"-----{edge} (?:[A-Z]{{1,16}} ){{0,3}}PRIVATE KEY-----"
_BREAK, _BASE64 = r"(?:\s|\\[nr])", "[A-Za-z0-9+/]"
_PEM_BODY = (
    rf"(?:{_BREAK}*+(?:[A-Za-z][A-Za-z0-9-]{{0,63}}:\x20[^\s\\]++{_BREAK}++)*+"
    rf"(?:(?:[A-Za-z0-9+/=]|{_BREAK})*+{_PEM.format(edge='END')}"
    rf"|{_BASE64}{{16,}}+={{0,2}}(?:{_BREAK}++{_BASE64}{{16,}}+={{0,2}})*+"
    rf"(?:{_BREAK}++{_BASE64}++={{1,2}}|(?:\r?\n|\\n){_BASE64}++(?=[\x20\t\r]*(?:\n|\Z)|[\\\"']))?))?"
)
#: Fixed public formats of credentials that the base kinds do not cover.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}+"),
    Rule("private_key", _PEM.format(edge="BEGIN") + _PEM_BODY),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    Rule("url_login", r"[a-z]{2,10}://[^\s:/@]++:[^\s:/@]++@"),
)
RULES = BASE + MORE

#: Sets of literal strings larger than this are not carried on.
MOST_LITERALS = 64

# A query is True (says nothing), a trigram (bytes), or ("and" | "or", frozenset of queries).


def _all(*queries):
    parts = set()
    for q in queries:
        if q is True:
            continue
        parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _any(*queries):
    if any(q is True for q in queries):
        return True
    parts = set(queries)
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _contains(strings: frozenset[bytes]):
    """What holds if a text contains one of the strings."""
    return _any(*(_all(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings)) if strings else True


@dataclass(frozen=True)
class _Seen:
    """What is known of a part's matches: all of them (exact), or what they begin and end with; and what they contain."""

    exact: frozenset[bytes] | None
    begin: frozenset[bytes]
    end: frozenset[bytes]
    needs: object = True


_NOTHING = frozenset({b""})
_OPEN = _Seen(None, _NOTHING, _NOTHING)


def _literal(strings) -> _Seen:
    s = frozenset(strings)
    return _Seen(s, s, s) if len(s) <= MOST_LITERALS else _OPEN


def _then(a: _Seen, b: _Seen) -> _Seen:
    """a followed by b."""
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_LITERALS:
        return _literal(x + y for x, y in product(a.exact, b.exact))

    def joined(x, y):
        return frozenset(p + q for p, q in product(x, y)) if len(x) * len(y) <= MOST_LITERALS else None

    across = joined(a.end, b.begin)
    needs = _all(a.needs, b.needs, _contains(across) if across else True, *(_contains(x.exact) for x in (a, b) if x.exact is not None))
    begin = (joined(a.exact, b.begin) or a.begin) if a.exact is not None else a.begin
    end = (joined(a.end, b.exact) or b.end) if b.exact is not None else b.end
    return _Seen(None, begin, end, needs)


def _either(parts: list[_Seen]) -> _Seen:
    if all(p.exact is not None for p in parts):
        return _literal(x for p in parts for x in p.exact)
    needs = _any(*(_all(p.needs, _contains(p.exact) if p.exact is not None else _all(_contains(p.begin), _contains(p.end))) for p in parts))
    return _Seen(None, _NOTHING, _NOTHING, needs)


def _of(tree) -> _Seen:
    """What is known of the matches of a parsed regex."""
    seen = _literal({b""})
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            part = _literal({chr(arg).encode().lower()})
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            part = _literal({chr(c).encode().lower() for _, c in arg})
        elif name == "BRANCH":
            part = _either([_of(x) for x in arg[1]])
        elif name == "SUBPATTERN":
            part = _of(arg[-1])
        elif name == "ATOMIC_GROUP":
            part = _of(arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg[0], arg[1], _of(arg[2])
            if low == 0:
                part = _literal({b""} | inner.exact) if high == 1 and inner.exact is not None else _OPEN
            elif low == high == 1:
                part = inner
            else:
                part = _then(_then(inner, _OPEN), inner) if low > 1 else _Seen(None, inner.begin, inner.end, _all(inner.needs, _contains(inner.exact or _NOTHING)))
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        else:
            part = _OPEN
        seen = _then(seen, part)
    return seen


def trigram_query(pattern: str):
    """The Boolean query of lower-case trigrams that any text with a match of the pattern fulfils; True if there is none."""
    seen = _of(re._parser.parse(pattern))
    return _all(seen.needs, _contains(seen.exact) if seen.exact is not None else _all(_contains(seen.begin), _contains(seen.end)))


def _trigrams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class Index:
    """An inverted index of chosen trigrams over runs of texts."""

    def __init__(self, queries: list) -> None:
        grams = sorted(set().union(*map(_trigrams, queries)))
        self.row = {g: i for i, g in enumerate(grams)}
        self.codes = np.array([int.from_bytes(g, "big") for g in grams], np.uint32)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def postings(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each trigram, which texts hold it; data: the texts' bytes one after the other, ends: where each ends."""
        found = np.zeros((len(self.codes), len(ends)), bool)
        if len(data) > 2 and len(self.codes):
            b = self.fold[data]
            codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            at = np.flatnonzero(self.wanted[codes])
            text = np.searchsorted(ends, at, "right")
            inside = at + 3 <= ends[text]
            found[np.searchsorted(self.codes, codes[at[inside]]), text[inside]] = True
        return found

    def candidates(self, query, postings: np.ndarray) -> np.ndarray:
        """Which texts fulfil the query."""
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.row[query]]
        merge = np.logical_and if query[0] == "and" else np.logical_or
        return merge.reduce([self.candidates(q, postings) for q in query[1]])


def _matches(rule: Rule, regex: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for m in regex.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def _compiled(rule: Rule) -> re.Pattern:
    """The rule's regex; a lone greedy class needs no shorter matches than the rule keeps."""
    lone = rule.group == 0 and re.fullmatch(r"\[[^\]\\]+\]\+", rule.pattern)
    return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}" if lone and rule.least else rule.pattern)


def find(batch: pa.RecordBatch, column: str, rules: tuple[Rule, ...], index: Index, queries: list, compiled: list) -> list[list[tuple[int, int, int]]]:
    """Each text's spans as (start, number of the rule, end), sorted."""
    found: list[list[tuple[int, int, int]]] = []
    for part in chunks(batch, column, 2 << 20):
        values = part.column(column).to_pylist()
        raw = [x.encode() if x else b"" for x in values]
        ends = np.cumsum([len(x) for x in raw])
        postings = index.postings(np.frombuffer(b"".join(raw), np.uint8), ends)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in values]
        for n, (rule, query, regex) in enumerate(zip(rules, queries, compiled, strict=True)):
            for i in np.flatnonzero(index.candidates(query, postings)):
                if values[i]:
                    spans[i] += [(s, n, e) for s, e in _matches(rule, regex, values[i])]
        for x in spans:
            x.sort()
        found += spans
    return found


def scan(df: DataFrame, column: str = "text", rules: tuple[Rule, ...] = RULES, redact: str | None = None, into: str = "spans") -> DataFrame:
    """df with the column `into`: the secrets of each text, as an array of (kind, start, end).

    redact: also replace each stretch of the text that spans cover by this string.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if into in df.columns:
        raise ValueError(f"there is a column {into} already")
    queries = [trigram_query(r.pattern) for r in rules]
    schema = StructType.fromJson(df.schema.jsonValue()).add(into, StructType.fromDDL(f"s {SPANS}")["s"].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, compiled = Index(queries), [_compiled(r) for r in rules]
        at = arrow.get_field_index(column)
        for batch in batches:
            found = find(batch, column, rules, index, queries, compiled)
            columns = list(batch.columns)
            if redact is not None:
                columns[at] = pa.array([x and _redacted(x, s, redact) for x, s in zip(batch.column(at).to_pylist(), found, strict=True)], arrow.field(at).type)
            spans = [[{"kind": rules[n].kind, "start": s, "end": e} for s, n, e in x] for x in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, arrow.field(into).type)], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def _redacted(text: str, spans: list[tuple[int, int, int]], by: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(df: DataFrame, spans: str = "spans") -> DataFrame:
    """doc_id, the numbers of base spans by kind, their sha256, and all spans as a string."""

    def said(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in BASE]))
    return df.select(
        "doc_id", *(of(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col(spans)).alias("spans")
    )
