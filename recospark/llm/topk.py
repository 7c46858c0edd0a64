"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Rows are sparse: a zero component is no posting, and a missing one (a shorter vector) counts as zero. Queries and
candidates are packed in blocks of bounded size, and blocks are dealt to groups: every cell of the grid of query groups
and candidate groups is one key. A cell's query blocks come first and are held while its candidate blocks stream by: the
query rows of each term scatter their weighted postings into a dense score array, and a partition selection keeps each
query's best. So a cell gives k rows for each of its queries, and a merge over the candidate groups gives the exact answer.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, and neither does a null
id; an empty vector scores 0 against all. Rows that share an id are copies of one vector: none is a candidate of that
id, and of the copies the least vector is the query. An empty table gives no rows. Scores are exact as long as they
fit a signed 64-bit integer; a larger one is clamped to that range before it is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recospark.llm.common import tidy

#: Rows in a block of candidates or queries, and queries that are scored at once.
BLOCK, QUERY_BLOCK, TILE = 4096, 1024, 64
#: Terms that are present in over this share of a block are held as dense postings.
DENSE = 0.25
#: Queries and candidates in a group of the grid.
QUERY_GROUP, CANDIDATE_GROUP = 8192, 1 << 18
LEAST, MOST = -(2**63), 2**63 - 1


def _pack(batch: pa.RecordBatch, scale: float | None) -> dict | None:
    """A batch as one sparse block: ids, row ends, terms and integer weights; None if no row takes part."""
    ids, vectors = batch.column(0), batch.column(1)
    good = np.asarray(pc.and_(pc.is_valid(ids), pc.is_valid(vectors)))
    vectors = vectors.filter(pa.array(good))
    flat = vectors.flatten()
    x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)  # null becomes NaN
    lengths = np.asarray(pc.list_value_length(vectors), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    kept = np.ones(len(lengths), bool)
    kept[row[~np.isfinite(x)]] = False
    if not kept.any():
        return None
    inside = kept[row]
    term = (np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[inside]
    x, row = x[inside], (np.cumsum(kept) - 1)[row[inside]]
    x = np.floor(x * scale) if scale else np.floor(x)
    filled = x != 0
    x, row, term = x[filled], row[filled], term[filled]
    order = np.lexsort((row, term))
    big = bool(len(x)) and float(np.abs(x).max()) >= 2.0**31
    return {
        "ids": np.asarray(ids.filter(pa.array(good)), dtype=np.int64)[kept].tobytes(),
        "terms": term[order].astype(np.int32).tobytes(),
        "rows": row[order].astype(np.int32).tobytes(),
        "weights": x[order].astype(np.float64 if big else np.int32).tobytes(),
        "big": big,
    }


def _postings(block: dict) -> tuple[np.ndarray, dict[int, tuple[np.ndarray | None, np.ndarray]], float]:
    """ids; term -> (rows, weights), with rows None for a dense posting; the largest sum of |weights| of a row's terms."""
    ids, terms, rows = (np.frombuffer(block[k], t) for k, t in (("ids", np.int64), ("terms", np.int32), ("rows", np.int32)))
    weights = np.frombuffer(block["weights"], np.float64 if block["big"] else np.int32)
    found = {}
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else []
    for s, e in zip(starts, np.r_[starts[1:], len(terms)] if len(terms) else [], strict=True):
        r, w = rows[s:e], weights[s:e]
        if e - s > DENSE * len(ids):
            full = np.zeros(len(ids), w.dtype)
            full[r] = w
            r, w = None, full
        found[int(terms[s])] = (r, w)
    return ids, found, float(np.abs(weights).max()) if len(weights) else 0.0


def _dense(w: np.ndarray, r: np.ndarray | None, n: int) -> np.ndarray:
    if r is None:
        return w
    out = np.zeros(n, w.dtype)
    out[r] = w
    return out


def _accumulate(queries: dict, n: int, postings: dict, m: int, kind) -> np.ndarray:
    """Scores of n queries against m candidates, term by term."""
    scores, part = np.zeros((n, m), kind), np.empty((n, m), kind)
    for term, (qr, qw) in queries.items():
        if term not in postings:
            continue
        dr, dw = postings[term]
        qw, dw = (np.array([int(v) for v in w], object) if kind is object else w.astype(kind, copy=False) for w in (qw, dw))
        if dr is None:
            np.multiply(_dense(qw, qr, n)[:, None], dw[None, :], out=part)
            scores += part
        else:
            rows = np.arange(n) if qr is None else qr
            scores[np.ix_(rows, dr)] += np.multiply.outer(qw, dw)
    return np.clip(scores, LEAST, MOST).astype(np.int64) if kind is object else scores


def _tiles(postings: dict, n: int) -> Iterator[tuple[int, int, dict]]:
    """Query postings cut into tiles of TILE rows."""
    for a in range(0, n, TILE):
        b, tile = min(n, a + TILE), {}
        for term, (r, w) in postings.items():
            if r is None:
                tile[term] = (None, w[a:b])
            else:
                i, j = np.searchsorted(r, (a, b))
                if i < j:
                    tile[term] = (r[i:j] - a, w[i:j])
        yield a, b, tile


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of one query, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = scores >= cut
        scores, ids = scores[kept], ids[kept]
    order = np.lexsort((ids, ~scores.astype(np.int64)))[:k]
    return scores[order], ids[order]


def search(df: DataFrame, id_col: str, vector_col: str, k: int, query_filter, scale: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates.

    df: all candidates. query_filter: a condition on df's rows that are queries too. scale: components become
    floor(scale * x), x as double; None takes floor(x).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    # Copies that take no part must not stand for their id: neither a null component nor a non-finite one is below infinity.
    valid = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    total, asking = df.agg(F.count("*"), F.count(F.when(query_filter, 1))).first()
    query_groups = max(1, -(-asking // QUERY_GROUP))
    # At least a cell for each core, as long as a group has a block.
    least = min(-(-total // BLOCK), -(-df.sparkSession.sparkContext.defaultParallelism // query_groups))
    candidate_groups = max(1, least, -(-total // CANDIDATE_GROUP))
    ids = df.filter(query_filter).filter(valid).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    asked = ids.repartition(max(1, -(-asking // QUERY_BLOCK)), "id").groupBy("id").agg(F.min("vector").alias("vector"))
    packed = "ids binary, terms binary, rows binary, weights binary, big boolean"

    def pack(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, size):
                    if block := _pack(batch.slice(a, size), scale):
                        yield pa.RecordBatch.from_pylist([block])

        return run

    def group(groups: int):
        return F.pmod(F.xxhash64("ids"), F.lit(groups))

    def each(groups: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))

    queries = asked.mapInArrow(tidy(pack(QUERY_BLOCK)), packed).select(group(query_groups).alias("q"), each(candidate_groups).alias("c"), F.lit(0).alias("side"), F.struct("*").alias("block"))
    candidates = rows.mapInArrow(tidy(pack(BLOCK)), packed).select(each(query_groups).alias("q"), group(candidate_groups).alias("c"), F.lit(1).alias("side"), F.struct("*").alias("block"))
    cells = queries.union(candidates).repartition("q", "c").sortWithinPartitions("q", "c", "side")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for ids, _, _, tops in held:
                lists = [(q, *top) for q, top in zip(ids, tops, strict=True) if top]
                if lists:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([q for q, _, _ in lists], [len(s) for _, s, _ in lists]).astype(np.int64)),
                            pa.array(np.concatenate([d for *_, d in lists]).astype(np.int64)),
                            pa.array(np.concatenate([s for _, s, _ in lists]).astype(np.int64)),
                        ],
                        ["query_id", "vec_id", "score"],
                    )
            held.clear()

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if (row["q"], row["c"]) != cell:
                    yield from out()
                    cell = row["q"], row["c"]
                ids, post, most = _postings(row["block"])
                if row["side"] == 0:
                    held.append((ids, post, most, [None] * len(ids)))
                    continue
                for q_ids, q_post, q_most, tops in held:
                    bound = q_most * most * max(1, min(len(q_post), len(post)))
                    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
                    for a, b, tile in _tiles(q_post, len(q_ids)):
                        scores = _accumulate(tile, b - a, post, len(ids), kind)
                        for i in range(a, b):
                            other = ids != q_ids[i]
                            s, d = _best(scores[i - a][other], ids[other], k)
                            if tops[i]:
                                s, d = _best(np.concatenate([tops[i][0], s]), np.concatenate([tops[i][1], d]), k)
                            tops[i] = (s, d) if len(s) else None
        yield from out()

    found = cells.mapInArrow(tidy(score), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
