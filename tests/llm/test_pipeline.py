"""The pipeline's stages against a brute-force version over a small fixture."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
from recospark.llm import langid, secrets, simhash  # noqa: E402

PARTS = {"aa": ["ta", "ko", "mi", "ru", "le"], "bb": ["sch", "eit", "ung", "ver", "ab"]}


def prose(language, n, rng):
    return " ".join("".join(rng.choices(PARTS[language], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng = random.Random(21)
    rows = [(i, prose(lang := rng.choice(["aa", "bb"]), rng.randint(60, 200), rng), lang) for i in range(80)]
    items = [(i, prose("aa", 20, rng)) for i in range(5)]
    for i in range(80, 90):  # near and exact copies
        w = rows[i - 80][1].split()
        if i % 2:
            w[len(w) // 2] = "edited"
        rows.append((i, " ".join(w), rows[i - 80][2]))
    for i in range(90, 95):  # leaks
        rows.append((i, prose("aa", 100, rng) + " " + items[i - 90][1] + " " + prose("aa", 50, rng), "aa"))
    for i in range(95, 99):
        rows.append((i, prose("bb", 80, rng) + f" password=secret{i}x " + prose("bb", 30, rng), "bb"))
    rows += [(99, None, "aa"), (100, "123 456 !!", "aa"), (101, "", None), (None, prose("aa", 60, rng), "aa"), (20, rows[20][1], "aa")]
    top = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), rows, items


def brute(rows, items, model, path):
    """Stage after stage in plain Python; the rows that are kept, as (doc_id, text)."""
    names, _, bits = langid.identify(model, [t for _, t, _ in rows])
    kept = [(d, t) for (d, t, _), n, b in zip(rows, names, bits, strict=True) if n != "und" and not (len(t) >= cp.LONG_ENOUGH and b > cp.GIBBERISH_BITS)]
    named = sorted({(d, t) for d, t in kept if d is not None})
    group = {d: d for d, _ in named}
    fps = {d: [simhash.fingerprint(t.encode(), 1, 42 + v, True) & 2**64 - 1 for v in range(cp.VIEWS)] for d, t in named}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if group[a] < group[b] and any((x ^ y).bit_count() <= cp.DISTANCE for x, y in zip(fps[a], fps[b], strict=True)):
                    group[b], changed = group[a], True
    kept = [(d, t) for d, t in named if group[d] == d] + [(d, t) for d, t in kept if d is None]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    kept = [(d, t) for d, t in kept if not any(len(shingles(t) & shingles(x)) >= 0.8 * len(shingles(x)) for _, x in items)]
    index = secrets.Index(queries := [secrets.trigram_query(r.pattern) for r in secrets.RULES])
    import pyarrow as pa

    found = secrets.find(pa.RecordBatch.from_pydict({"text": [t for _, t in kept]}), "text", secrets.RULES, index, queries, [secrets._compiled(r) for r in secrets.RULES])
    return [(d, secrets._redacted(t, s, cp.REDACTED)) for (d, t), s in zip(kept, found, strict=True)]


def test_against_brute_force(spark, fixture):
    top, rows, items = fixture
    docs = spark.read.parquet(f"{top}/documents.parquet")
    model = langid.fit(langid.sample(docs, F.lit(True)))
    want = brute(rows, items, model, top)
    stages = docs
    for _, stage in cp.STAGES[:-1]:
        stages = stage(spark, stages, top)
        assert stages.columns == docs.columns
    assert sorted(map(repr, [(r.doc_id, r.text) for r in stages.collect()])) == sorted(map(repr, want))
    assert all(r.n_chars == len(r.text) for r in stages.collect())
    ids = {d for d, _ in want}
    assert not ids & {*range(80, 95), 99, 100, 101} and {*range(80), *range(95, 99), None} <= ids
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(cp.tokenizer_path())
    texts = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in want}
    pieces = cp.run(spark, top).collect()
    assert sum(p.length for p in pieces) == sum(map(len, texts.values()))
    for p in pieces:
        own = texts[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))


def test_clashing_columns(spark, fixture):
    top, _, _ = fixture
    docs = spark.read.parquet(f"{top}/documents.parquet")
    more = docs
    for name in ("score", "bits", "lang_pred", "spans", "row", "fp", "fps", "component_id", "key", "u", "n"):
        more = more.withColumn(name, F.col("doc_id"))
    for _, stage in cp.STAGES[:-1]:
        more, docs = stage(spark, more, top), stage(spark, docs, top)
        assert sorted(map(repr, [(r.doc_id, r.text) for r in more.collect()])) == sorted(map(repr, [(r.doc_id, r.text) for r in docs.collect()]))
    assert more.select("score", "spans").filter("score != spans").count() == 0
    assert sum(r.length for r in cp.pack(spark, more, top).collect()) == sum(r.length for r in cp.pack(spark, docs, top).collect())


def test_empty(spark, fixture, tmp_path):
    top, _, _ = fixture
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{top}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
