"""DuckDB SQL that must give the rows of the registered queries, put together from named parts."""

from __future__ import annotations

import re

_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_SEARCH = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\w\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_TITLE = r"'^(.+?)\s+\((\d{4})\)$'"


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


PARTS = {
    "sales": "SELECT o_custkey + 1 AS u, l_suppkey + 1 AS si, l_partkey + 1 AS pi, CAST(ceil(l_quantity / 5) / 2.0 AS DOUBLE) AS rating, CAST(epoch(l_shipdate) AS BIGINT) AS ts, o_orderpriority, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "rs": "SELECT u, si AS i, rating, ts FROM sales",
    "rp": "SELECT u, pi AS i, rating, ts FROM sales",
    "mv": "SELECT p_partkey + 1 AS i, p_name || CASE WHEN p_partkey % 3 = 0 THEN ', The' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ' (' || (1980 + p_size) || ')' END AS title, "
    "CASE WHEN p_partkey % 11 = 0 THEN '(no genres listed)' ELSE p_type || '|' || p_brand END AS genres FROM part",
    "tg": "SELECT CAST(u AS VARCHAR) AS u, pi AS i, c_mktsegment AS tag FROM sales JOIN customer ON o_custkey = c_custkey UNION ALL SELECT CAST(u AS VARCHAR), pi, o_orderpriority FROM sales",
    "lk": "SELECT p_partkey + 1 AS i, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS imdb, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE '' END || p_partkey AS tmdb FROM part",
    "ev": f"SELECT i, {_NORM.format('tag')} AS tag, count(*) AS rows, count(DISTINCT nullif(trim(u), '')) AS users FROM tg WHERE i IN (SELECT i FROM mv) GROUP BY ALL",
    "dfq": "SELECT tag, count(*) AS df FROM ev WHERE users > 0 GROUP BY tag",
    "scored": "SELECT i, tag, users, (1 + ln(CAST(users AS DOUBLE))) * (ln((1.0 + (SELECT count(DISTINCT i) FROM ev)) / (1.0 + df)) + 1) AS w FROM ev JOIN dfq USING (tag)",
    "trank": "SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, users DESC, tag) AS n, max(w) OVER (PARTITION BY i) AS top FROM scored",
    "tt": "SELECT i, tag, w, top, CAST(row_number() OVER (PARTITION BY i ORDER BY n) AS INTEGER) AS rank FROM trank WHERE n <= 10 AND (n = 1 OR w >= 0.3 * top)",
    "titles": f"SELECT i, title AS raw, CASE WHEN regexp_matches(title, {_TITLE}) THEN regexp_extract(title, {_TITLE}, 1) ELSE title END AS t, TRY_CAST(nullif(regexp_extract(title, {_TITLE}, 2), '') AS INTEGER) AS year, genres FROM mv",
    "named": rf"SELECT i, raw, regexp_replace(t, '^(.+), (The|A|An)$', '\2 \1') AS title, year, CASE WHEN genres IN ('', '(no genres listed)') THEN '' ELSE genres END AS genres FROM titles",
    "tagtext": "SELECT i, string_agg(tag, ' ' ORDER BY rank) AS tag_text FROM tt GROUP BY i",
    "search": f"SELECT i, {_SEARCH.format('title')} AS title_norm, coalesce(tag_text, '') AS tag_text, "
    + _NORM.format(f"concat_ws(' ', nullif({_SEARCH.format('title')}, ''), nullif({_SEARCH.format(chr(39).join(['replace(genres, ', '|', ', ', ' ', ')']))}, ''), nullif(tag_text, ''))")
    + " AS all_text FROM named LEFT JOIN tagtext USING (i)",
    # Profiles.
    "rd": "SELECT u, i, rating, ts FROM (SELECT *, row_number() OVER (PARTITION BY u, i ORDER BY ts DESC, rating DESC) AS n FROM rs) WHERE n = 1",
    "band": "SELECT *, CASE WHEN rating >= 4 THEN 'positive' WHEN rating >= 3 THEN 'weak' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS band, max(ts) OVER (PARTITION BY u) AS latest FROM rd",
    "wt": f"SELECT u, i, rating, ts, band, (CASE band WHEN 'positive' THEN 0.75::DOUBLE + 0.25 * {_clamp('(rating - 4) / 1.0')} WHEN 'weak' THEN 0.25::DOUBLE + (0.65::DOUBLE - 0.25::DOUBLE) * {_clamp('(rating - 3) / 1.0')} "
    f"WHEN 'negative' THEN 0.4::DOUBLE + 0.6::DOUBLE * {_clamp('(2 - rating) / 1.5')} END) * (0.2::DOUBLE + 0.8::DOUBLE * pow(0.5::DOUBLE, (latest - ts) / 86400.0::DOUBLE / 365.0::DOUBLE)) AS w FROM band",
    "lists": "SELECT *, CAST(row_number() OVER (PARTITION BY u, list ORDER BY CASE WHEN list = 'recent' THEN ts ELSE 0 END DESC, rw DESC, ts DESC, i) AS INTEGER) AS position FROM ("
    "SELECT u, i, rating, ts, round(w, 6) AS rw, unnest(CASE band WHEN 'positive' THEN ['liked', 'recent'] WHEN 'weak' THEN ['interested'] WHEN 'negative' THEN ['negative'] ELSE [] END) AS list FROM wt)",
    "behavior": "SELECT * FROM lists WHERE position <= CASE list WHEN 'liked' THEN 100 WHEN 'recent' THEN 30 ELSE 50 END",
    "ratedlist": "SELECT u, CAST(row_number() OVER (PARTITION BY u ORDER BY ts DESC, rating DESC, i) AS INTEGER) AS position, i FROM rd",
    "gl": "SELECT i, string_split(genres, '|') AS gs FROM named WHERE genres <> ''",
    "gscore": "SELECT u, band, g AS name, sum(w / len(gs)) AS score, count(*) AS support, max(ts) AS t FROM (SELECT u, band, w, ts, gs, unnest(gs) AS g FROM wt JOIN gl USING (i)) GROUP BY ALL",
    "tscore": "SELECT u, band, tag AS name, sum(wt.w * tt.w / tt.top) AS score, count(*) AS support, max(ts) AS t FROM wt JOIN tt USING (i) GROUP BY ALL",
    "scores": "SELECT 'genre' AS kind, * FROM gscore UNION ALL SELECT 'tag', * FROM tscore",
    "interest": "SELECT *, CAST(row_number() OVER (PARTITION BY u, kind, band ORDER BY weight DESC, confidence DESC, name) AS INTEGER) AS position FROM ("
    "SELECT u, kind, band, name, round(score / max(score) OVER (PARTITION BY u, kind, band), 6) AS weight, round(least(support / 5.0, 1.0), 6) AS confidence, t FROM scores WHERE band IN ('positive', 'negative'))",
    "kept": "SELECT * FROM interest WHERE position <= CASE WHEN kind = 'genre' THEN 10 WHEN band = 'positive' THEN 30 ELSE 20 END",
    # Similarity.
    "pos": "SELECT u, i, 1.0::DOUBLE AS w, ts FROM rs WHERE rating >= 4",
    "posw": "SELECT u, i, rating - 3 AS w, ts FROM rs WHERE rating >= 3.5",
    "rank32": "SELECT *, xor(x4, x4 >> 16) & 4294967295 AS sample_rank FROM (SELECT *, CAST((CAST(x3 AS HUGEINT) * 2221713035) % 281474976710656 AS BIGINT) AS x4 FROM (SELECT *, xor(x2, x2 >> 15) & 281474976710655 AS x3 FROM ("
    "SELECT *, CAST((CAST(xor(x0, x0 >> 16) AS HUGEINT) * 2146121005) % CAST('9223372036854775808' AS HUGEINT) AS BIGINT) AS x2 FROM (SELECT *, xor(i * 1000003, u * 9176) AS x0 FROM (SELECT DISTINCT u, i FROM rs)))))",
}


def _similarity(prefix: str, pos: str, key: str, shared: str, least: int, together: int, top: int, participants: str, extra: str = "") -> dict[str, str]:
    """Parts for neighbours of `key`: norms, pairs, directed scores and ranked edges."""
    return {
        f"{prefix}norm": f"SELECT {key} AS k, sum(w * w) AS norm, count(*) AS n FROM {pos} GROUP BY {key} HAVING count(*) >= {least} AND sum(w * w) > 0",
        **{f"{prefix}{name}": sql for name, sql in [x.split(":=", 1) for x in participants.split(";;")]},
        f"{prefix}met": f"SELECT a.{key} AS l, b.{key} AS r, a.w * b.w AS w FROM {prefix}in a JOIN {prefix}in b ON a.{shared} = b.{shared} AND a.{key} < b.{key}{extra}",
        f"{prefix}pair": f"SELECT l, r, sum(w) AS weight, count(*) AS cooccurrence FROM {prefix}met GROUP BY l, r",
        f"{prefix}dir": f"SELECT unnest([l, r]) AS src, unnest([r, l]) AS dst, round(weight / sqrt(x.norm * y.norm), 8) AS score, cooccurrence FROM {prefix}pair JOIN {prefix}norm x ON l = x.k JOIN {prefix}norm y ON r = y.k WHERE cooccurrence >= {together} AND weight / sqrt(x.norm * y.norm) >= 0",
        f"{prefix}sim": f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, cooccurrence DESC, dst) AS INTEGER) AS position FROM {prefix}dir) WHERE position <= {top}",
    }


def _best(prefix: str, pos: str, valid: str) -> str:
    return f"best:=SELECT u, i, w, ts FROM (SELECT *, row_number() OVER (PARTITION BY u, i ORDER BY w DESC, ts DESC) AS n FROM {pos} WHERE {valid} IN (SELECT k FROM {prefix}norm)) WHERE n = 1"


def _items(prefix: str, pos: str) -> dict[str, str]:
    capped = f"in:=SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, ts DESC, i) AS n FROM {prefix}best) WHERE n <= 300"
    return _similarity(prefix, pos, "i", "u", 5, 3, 100, ";;".join([_best(prefix, pos, "i"), capped]))


def _users(prefix: str, pos: str, cap: int, top: int, anchors: int = 0, coverage: int = 0) -> dict[str, str]:
    steps = [
        _best(prefix, pos, "u"),
        f"ranked:=SELECT b.*, sample_rank, count(*) OVER (PARTITION BY b.i) AS n FROM {prefix}best b JOIN rank32 USING (u, i)",
        f"turn:=SELECT *, row_number() OVER (PARTITION BY i ORDER BY k, w DESC) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY i, w ORDER BY sample_rank, ts DESC, u) AS k FROM {prefix}ranked WHERE n >= 2)",
        f"in:=SELECT * FROM {prefix}turn WHERE turn <= {cap}",
    ]
    extra = ""
    if anchors:
        steps += [
            f"anchor:=SELECT DISTINCT u, i FROM (SELECT p.u, p.i, row_number() OVER (PARTITION BY p.u ORDER BY c.rows, p.w DESC, p.ts DESC, sample_rank, p.i) AS n FROM {pos} p JOIN (SELECT i, count(*) AS rows FROM {pos} GROUP BY i) c USING (i) JOIN rank32 USING (u, i) WHERE p.u IN (SELECT k FROM {prefix}norm)) WHERE n <= {anchors}",
            f"extra:=SELECT * FROM {prefix}turn t WHERE turn > {cap} AND EXISTS (SELECT 1 FROM {prefix}anchor a WHERE a.u = t.u AND a.i = t.i)",
            f"base:=SELECT * FROM {prefix}turn WHERE turn <= {max(cap, coverage)}",
        ]
        extra = f" UNION ALL SELECT least(a.u, b.u), greatest(a.u, b.u), a.w * b.w FROM {prefix}extra a JOIN {prefix}base b ON a.i = b.i AND a.u <> b.u"
    return _similarity(prefix, pos, "u", "i", 5, 2, top, ";;".join(steps), extra)


PARTS |= _items("ib", "pos") | _items("iw", "posw") | _users("ub", "pos", 30, 10) | _users("uc", "posw", 100, 50, 3, 300)

# Serving: one request for ten items for each user, asked for twenty candidates.
PARTS |= {
    "beh": "SELECT u, CASE list WHEN 'recent' THEN 0 WHEN 'liked' THEN 1 ELSE 2 END AS channel, position, i, rw FROM behavior WHERE list <> 'negative'",
    "seen": "SELECT DISTINCT u, i FROM (SELECT u, i FROM behavior UNION ALL SELECT u, i FROM ratedlist WHERE position <= 300)",
    "iseed": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY CASE WHEN al > 24 THEN -score END, CASE WHEN al > 24 THEN i END, channel, position) AS INTEGER) AS seed_order FROM (SELECT *, count(*) OVER (PARTITION BY u) AS al FROM ("
    "SELECT u, i, channel, position, [1.0::DOUBLE, 0.5::DOUBLE, 0.3::DOUBLE][channel + 1] * CASE WHEN rw > 0 THEN rw ELSE 1 END / position AS score, row_number() OVER (PARTITION BY u, i ORDER BY channel, position) AS f FROM beh) WHERE f = 1)) WHERE seed_order <= 24",
    "icon": "SELECT s.u, e.dst AS i, s.score * e.score AS c, seed_order, s.i AS trig FROM iseed s JOIN ibsim e ON e.src = s.i AND e.position <= 20 AND e.score > 0 WHERE s.score * e.score > 0 AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.u = s.u AND seen.i = e.dst)",
    "icf": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS INTEGER) AS position FROM (SELECT u, i, list_sum(list(c ORDER BY seed_order)) AS score, first(trig ORDER BY c DESC, seed_order) AS trig, max(c) AS reason FROM icon GROUP BY u, i)) WHERE position <= 20",
    "ulike": "SELECT u, i, [1.0::DOUBLE, 0.7::DOUBLE, 0.3::DOUBLE][channel + 1] * CASE WHEN rw > 0 THEN rw ELSE 1 END / position AS score FROM (SELECT *, row_number() OVER (PARTITION BY u, i ORDER BY channel, position) AS f FROM beh) WHERE f = 1",
    "ucon": "SELECT e.src AS u, l.i, e.score * l.score AS c, e.position AS seed_order, e.dst AS trig FROM ubsim e JOIN ulike l ON l.u = e.dst WHERE e.position <= 10 AND e.score > 0 AND e.score * l.score > 0 AND EXISTS (SELECT 1 FROM rd WHERE rd.u = e.src) AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.u = e.src AND seen.i = l.i)",
    "ucf": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS INTEGER) AS position FROM (SELECT u, i, list_sum(list(c ORDER BY seed_order)) AS score, first(trig ORDER BY c DESC, seed_order) AS trig, max(c) AS reason FROM ucon GROUP BY u, i)) WHERE position <= 20",
    "cand": "SELECT 'item_cf' AS retriever, 0 AS turn, * FROM icf UNION ALL SELECT 'user_cf', 1, * FROM ucf",
    "merged": "SELECT u, i, sum(score) AS score, string_agg(retriever, ',' ORDER BY position, turn) AS retriever, count(*) AS signals, min(position * 2 + turn) AS place FROM cand GROUP BY u, i",
    "orch": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY place) AS INTEGER) AS position FROM merged) WHERE position <= 10",
    "feat": "SELECT i, 'genre' AS kind, unnest(gs) AS name FROM gl UNION ALL SELECT i, 'tag', tag FROM tt WHERE round(w, 4) > 0",
    "match": "SELECT o.u, o.i, sum(CASE WHEN band = 'positive' THEN weight ELSE 0 END) AS liked, sum(CASE WHEN band = 'negative' THEN weight ELSE 0 END) AS disliked FROM orch o JOIN feat f ON f.i = o.i JOIN kept k ON k.u = o.u AND k.kind = f.kind AND k.name = f.name GROUP BY o.u, o.i",
    "qual": "SELECT named.i, avg, n FROM named LEFT JOIN (SELECT i, round(avg(rating), 4) AS avg, count(*) AS n FROM rs GROUP BY i) USING (i)",
    "fact": "SELECT o.u, o.i, q.i IS NOT NULL AS known, o.score AS retrieval, coalesce(liked, 0.0) AS interest, CASE WHEN avg > 0 AND q.n > 0 THEN avg / 5.0 * ln(1 + CAST(q.n AS DOUBLE)) ELSE 0.0 END AS quality, coalesce(b.rw, 0.0) + coalesce(disliked, 0.0) AS negative "
    "FROM orch o LEFT JOIN match m ON m.u = o.u AND m.i = o.i LEFT JOIN qual q ON q.i = o.i LEFT JOIN behavior b ON b.list = 'negative' AND b.u = o.u AND b.i = o.i",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY s DESC, i) AS INTEGER) AS rank_position FROM (SELECT *, retrieval + interest + quality * 0.1 - negative AS s FROM fact)",
}


# The fixture: pools as large as the 0.01 scale hold every user with neighbours, so the pool's limits need no SQL.
PARTS |= {
    "unear": "SELECT src AS u, count(*) AS nb, count_if(rd2.u IS NULL)::BIGINT AS miss FROM ubsim LEFT JOIN (SELECT DISTINCT u FROM rd) rd2 ON rd2.u = dst WHERE position <= 10 AND score > 0 GROUP BY src",
    "umet": "SELECT e.src AS u, count(*) AS fetched, count(x.i) AS filtered FROM ubsim e JOIN ulike l ON l.u = e.dst LEFT JOIN seen x ON x.u = e.src AND x.i = l.i WHERE e.position <= 10 AND e.score > 0 GROUP BY e.src",
    "imet": "SELECT s.u, count(DISTINCT s.i) AS seeds, count(x.i) AS filtered FROM iseed s LEFT JOIN ibsim e ON e.src = s.i AND e.position <= 20 AND e.score > 0 LEFT JOIN seen x ON x.u = s.u AND x.i = e.dst GROUP BY s.u",
    "acted": "SELECT DISTINCT u, i FROM (SELECT u, i FROM beh UNION ALL SELECT u, i FROM ratedlist WHERE position <= 300)",
    "ilist": "SELECT u, count(*) AS n FROM icf GROUP BY u",
    "ulist": "SELECT u, count(*) AS n FROM ucf GROUP BY u",
    "olist": "SELECT a.u, count(*) AS n FROM icf a JOIN ucf b ON a.u = b.u AND a.i = b.i GROUP BY a.u",
    "replay": "SELECT m.u AS user_id, (SELECT count(*) FROM acted a WHERE a.u = m.u) AS behaviors, m.seeds, (SELECT count(*) FROM seen s WHERE s.u = m.u) AS seen, n.nb AS neighbors, n.nb - n.miss AS hits, n.miss AS misses, "
    "coalesce(a.n, 0) AS n_item_cf, coalesce(b.n, 0) AS n_user_cf, coalesce(o.n, 0) AS overlap, coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(o.n, 0) AS union_, m.filtered AS item_filtered, coalesce(k.filtered, 0) AS user_filtered "
    "FROM imet m JOIN unear n ON n.u = m.u LEFT JOIN umet k ON k.u = m.u LEFT JOIN ilist a ON a.u = m.u LEFT JOIN ulist b ON b.u = m.u LEFT JOIN olist o ON o.u = m.u",
    "kinds": "SELECT user_id, unnest([least(n_item_cf, n_user_cf) * 10.0::DOUBLE + union_ + hits, n_item_cf * 10.0::DOUBLE - n_user_cf * 2 + item_filtered + user_filtered, n_user_cf * 10.0::DOUBLE - n_item_cf * 2 + hits * 2, "
    "100.0::DOUBLE / greatest(behaviors, 1) + union_, overlap * 8.0::DOUBLE + (item_filtered + user_filtered) * 3 + union_, union_ * 5.0::DOUBLE + seeds + hits, union_ * 1000.0::DOUBLE + hits]) AS score, unnest([0, 1, 2, 3, 4, 5, 6]) AS turn FROM replay WHERE union_ > 0",
}
_before: list[str] = []
for _turn, _quota in enumerate((3, 2, 2, 1, 1, 1)):
    _old = "".join(f" AND user_id NOT IN (SELECT user_id FROM pick{x})" for x in _before)
    PARTS[f"pick{'abcdef'[_turn]}"] = f"SELECT user_id FROM kinds WHERE turn = {_turn}{_old} ORDER BY score DESC, user_id LIMIT {_quota}"
    _before.append("abcdef"[_turn])
_PICKED = " UNION ALL ".join(f"SELECT user_id, '{kind}' AS kind FROM pick{x}" for x, kind in zip("abcdef", ("dual", "item_strong", "user_strong", "sparse", "overlap_filter", "content"), strict=True))


def sql(final: str) -> str:
    """The final select with the parts that it needs, in order."""
    needed, todo = set(), [final]
    while todo:
        text = todo.pop()
        for word in set(re.findall(r"[a-z][a-z0-9]*", text)) & PARTS.keys() - needed:
            if re.search(rf"(?:FROM|JOIN|,|IN)\s+\(?{word}\b|FROM {word}\b", text):
                needed.add(word)
                todo.append(PARTS[word])
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in PARTS if name in needed)
    return f"WITH {parts}\n{final}"


def _list(name: str) -> str:
    return f"SELECT u AS user_id, position, i AS item_id, rw AS weight, ts AS event_time, 1 AS source, round(least(greatest(rw, 0.0), 1.0), 6) AS confidence, rating AS raw_score FROM behavior WHERE list = '{name}'"


def _interest(kind: str, band: str) -> str:
    return f"SELECT u AS user_id, position, name, weight, confidence, t AS update_time FROM kept WHERE kind = '{kind}' AND band = '{band}'"


def _edges(prefix: str) -> str:
    return f"SELECT src, dst, score, cooccurrence FROM {prefix}sim"


_CANDIDATE = "SELECT u AS user_id, i AS item_id, position, round(score, 13) AS retrieve_score, trig AS trigger_id, round(reason, 13) AS reason_score FROM "

ORACLES = {
    "rating_stats": "SELECT i AS item_id, round(avg(rating), 4) AS avg, count(*) AS count FROM rp GROUP BY i",
    "tag_evidence": "SELECT i AS item_id, tag, rows, users FROM ev",
    "tag_df": "SELECT tag, df FROM dfq",
    "top_tags": "SELECT i AS item_id, tag, round(w, 4) AS weight, rank FROM tt",
    "item_titles": "SELECT i AS item_id, title, raw AS title_raw, year FROM named",
    "item_genres": "SELECT i AS item_id, string_split(genres, '|')[k] AS genre, CAST(k AS INTEGER) AS position FROM named, unnest([1, 2, 3, 4]) AS t(k) WHERE genres <> '' AND k <= len(string_split(genres, '|'))",
    "item_links": r"SELECT i AS item_id, CASE WHEN imdb = '' THEN NULL WHEN imdb LIKE 'tt%' THEN imdb WHEN regexp_full_match(imdb, '\d+') THEN 'tt' || CASE WHEN length(imdb) < 7 THEN lpad(imdb, 7, '0') ELSE imdb END ELSE 'tt' || imdb END AS imdb_id, TRY_CAST(tmdb AS BIGINT) AS tmdb_id FROM lk",
    "item_search": "SELECT i AS item_id, title_norm, tag_text, all_text FROM search",
    "item_index_flat": "SELECT n.i AS item_id, n.title, n.year, n.genres, CAST(coalesce((SELECT sum(rows) FROM ev WHERE ev.i = n.i), 0) AS BIGINT) AS tag_count, (SELECT count(*) FROM ev WHERE ev.i = n.i AND users > 0) AS unique_tag_count, avg, coalesce(c, 0) AS rating_count, tag_text FROM named n JOIN search s ON s.i = n.i LEFT JOIN (SELECT i, round(avg(rating), 4) AS avg, count(*) AS c FROM rp GROUP BY i) r ON r.i = n.i",
    "rating_dedupe": "SELECT u AS user_id, i AS item_id, rating, ts AS event_time FROM rd",
    "rating_bands": "SELECT u AS user_id, i AS item_id, band, round(w, 6) AS weight FROM wt",
    "user_stats": "SELECT u AS user_id, count(*) AS rating_count, count_if(band = 'positive')::BIGINT AS positive_rating_count, count_if(band = 'weak')::BIGINT AS weak_positive_rating_count, count_if(band = 'negative')::BIGINT AS negative_rating_count, round(avg(rating), 6) AS avg_rating, round(stddev_pop(rating), 6) AS rating_stddev, min(ts) AS first_event_time, max(ts) AS last_event_time, max(ts) - min(ts) AS active_timeframe, round(least(ln(1 + CAST(count(*) AS DOUBLE)) / ln(51.0::DOUBLE), 1.0), 6) AS profile_confidence FROM band GROUP BY u",
    "liked_items": _list("liked"),
    "recent_liked_items": _list("recent"),
    "interested_items": _list("interested"),
    "negative_items": _list("negative"),
    "rated_items": "SELECT u AS user_id, position, i AS item_id FROM ratedlist WHERE position <= 300",
    "genre_interests": _interest("genre", "positive"),
    "tag_interests": _interest("tag", "positive"),
    "negative_genre_interests": _interest("genre", "negative"),
    "negative_tag_interests": _interest("tag", "negative"),
    "interest_entropy": "SELECT u AS user_id, CASE WHEN count(*) > 1 THEN round(sum(-p * ln(p)) / ln(CAST(count(*) AS DOUBLE)), 6) ELSE 0.0 END AS interest_entropy FROM (SELECT u, score / sum(score) OVER (PARTITION BY u) AS p FROM gscore WHERE band = 'positive' AND score > 0) GROUP BY u",
    "item_norms": "SELECT i AS item_id, sum(w * w) AS norm, count(*) AS n FROM posw GROUP BY i",
    "user_norms": "SELECT u AS user_id, sum(w * w) AS norm, count(*) AS n FROM posw GROUP BY u",
    "item_pairs": "SELECT l, r, weight, cooccurrence FROM iwpair",
    "item_similarity": _edges("ib"),
    "item_similarity_weighted": _edges("iw"),
    "stable_rank": "SELECT u AS user_id, i AS item_id, sample_rank FROM rank32",
    "stratified_sample": "SELECT i AS item_id, u AS user_id, w AS weight FROM ubin",
    "coverage_anchors": "SELECT u AS user_id, i AS item_id FROM ucanchor",
    "user_similarity": _edges("ub"),
    "user_similarity_coverage": _edges("uc"),
    "seen_items": "SELECT u AS user_id, i AS item_id FROM seen",
    "item_cf_seeds": "SELECT u AS user_id, i AS item_id, round(score, 12) AS score, seed_order FROM iseed",
    "item_cf_candidates": _CANDIDATE + "icf",
    "user_cf_candidates": _CANDIDATE + "ucf",
    "retrieval_diagnostics": "SELECT u AS user_id, count(DISTINCT s.i) AS seeds, count(e.dst) AS fetched, count(x.i) AS filtered FROM iseed s LEFT JOIN ibsim e ON e.src = s.i AND e.position <= 10 LEFT JOIN seen x USING (u, i) GROUP BY u".replace("LEFT JOIN seen x USING (u, i)", "LEFT JOIN seen x ON x.u = s.u AND x.i = e.dst").replace("SELECT u AS", "SELECT s.u AS").replace("GROUP BY u", "GROUP BY s.u"),
    "user_diagnostics": "SELECT n.u AS user_id, nb AS neighbors, miss AS missing, coalesce(fetched, 0) AS user_fetched, coalesce(filtered, 0) AS user_filtered FROM unear n LEFT JOIN umet k ON k.u = n.u WHERE n.u IN (SELECT u FROM rd)",
    "fixture_replay": "SELECT * EXCLUDE (union_), union_ AS \"union\" FROM replay",
    "fixture_users": _PICKED,
    "orchestrated": "SELECT u AS user_id, i AS item_id, position, retriever, round(score, 13) AS retrieve_score FROM orch",
    "retrieval_reasons": "SELECT c.u AS user_id, c.i AS item_id, c.retriever, CASE WHEN c.turn = 0 THEN 'Retrieved from item_cf using trigger item ' ELSE 'Retrieved from user_cf using similar user ' END || trig || '.' AS description FROM cand c JOIN orch o ON o.u = c.u AND o.i = c.i",
    "ranked": "SELECT u AS user_id, i AS item_id, rank_position, round(s, 6) AS rank_score, round(retrieval, 6) AS retrieval, round(interest, 6) AS interest, round(quality, 6) AS quality, round(negative, 6) AS negative FROM ranked",
    "score_factors": "SELECT u AS user_id, i AS item_id, place, CAST([1, 2, 4, 3][place + 1] AS INTEGER) AS factor_type, ['retrieval', 'interest_match', 'quality', 'negative_feedback'][place + 1] AS name, round([retrieval, interest, quality, negative][place + 1], 6) AS raw_value, round([retrieval, interest, quality * 0.1, -negative][place + 1], 6) AS contribution FROM ranked, (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS place) WHERE known OR place IN (0, 3)",
    "recommend": "SELECT u AS user_id, i AS item_id, rank_position, round(s, 6) AS rank_score FROM ranked",
    "recommend_status": "SELECT q.u AS user_id, CAST(CASE WHEN d.u IS NULL THEN 1 WHEN q.m <= 0 THEN 2 WHEN coalesce(n, 0) = 0 THEN 3 ELSE 0 END AS INTEGER) AS status, coalesce(n, 0) AS n_items FROM (SELECT c_custkey + 1 AS u, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 10 END AS m FROM customer) q LEFT JOIN (SELECT DISTINCT u FROM rd) d ON d.u = q.u LEFT JOIN (SELECT u, count(*) AS n FROM ranked GROUP BY u) k ON k.u = q.u AND q.m > 0",
    "redis_zset": "SELECT 'rec:item_cf:v1:neighbors:' || src AS key, 'zset' AS data_type, CAST(dst AS VARCHAR) AS member, score FROM ibsim",
    "redis_top": "SELECT key, member, score, position FROM (SELECT 'rec:item_cf:v1:neighbors:' || src AS key, CAST(dst AS VARCHAR) AS member, score, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, CAST(dst AS VARCHAR) DESC) AS INTEGER) AS position FROM ibsim) WHERE position <= 10",
    "dry_run_counts": "SELECT count(DISTINCT src) AS records, count(*) AS value_count FROM ibsim",
    "batch_profiles": "SELECT q.u AS user_id, CASE WHEN q.u > 2147483647 OR q.u <= 0 THEN 'INVALID' WHEN d.u IS NULL THEN 'NOT_FOUND' ELSE 'SUCCESS' END AS status, (SELECT count(*) FROM behavior b WHERE b.u = q.u AND b.list <> 'negative') AS n_items FROM (SELECT c_custkey + CASE WHEN c_custkey % 100 = 0 THEN 2147483648 ELSE 1 END AS u FROM customer) q LEFT JOIN (SELECT DISTINCT u FROM rd) d ON d.u = q.u",
}
ORACLES = {name: sql(final) for name, final in ORACLES.items()}
