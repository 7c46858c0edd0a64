"""Language identification: the parse against brute force, and held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from recospark.llm import langid

PARTS = {"aa": ["ta", "ko", "mi", "ru"], "bb": ["sch", "eit", "ung", "ver"], "cc": ["eau", "oi", "que", "ç"]}


def words(language, n, rng):
    return " ".join("".join(rng.choices(PARTS[language], k=rng.randint(1, 4))) for _ in range(n))


def test_parse_is_greedy_longest_match():
    rng = random.Random(1)
    samples = {k: [words(k, 60, rng)] for k in PARTS}
    model = langid.fit(samples)
    for text in [words("aa", 30, rng), words("bb", 30, rng) + " ünseen ç", "x"]:
        x = model.symbols(text).tolist()
        got = langid.phrases(model, [np.array(x, np.uint8)])[:, 0]
        for row, language in enumerate(model.languages):
            learned = "".join(map(chr, [*model.symbols(samples[language][0]).tolist(), 0]))
            count, current = 0, ""
            for c in map(chr, x):
                if current + c in learned:
                    current += c
                else:
                    count += 1
                    current = c if c in learned else ""
            assert got[row] == count + 1


def test_predict(spark):
    rng = random.Random(2)
    rows = [(i, words(k := rng.choice(list(PARTS)), 40, rng), k) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, words("cc", 20000, rng), None)], "doc_id long, text string, lang string")
    model = langid.fit(langid.sample(docs, F.col("doc_id") % 3 != 0))
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "cc"
    held = [(i, k) for i, _, k in rows if i % 3 == 0]
    assert sum(got[i].lang_pred == k for i, k in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(langid.sample(docs, F.lit(True)))
    assert [tuple(r)[:3] for r in langid.predict(docs, model, ["doc_id"]).collect()] == [(1, "und", 0.0)]
    assert langid.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_all_languages_scripts_and_long_texts(spark):
    """More languages than 64, scripts of over 62 letters in all, and a language of long texts alone."""
    rng = random.Random(4)
    starts = [0x61, 0x3B1, 0x430, 0x561, 0x5D0, 0x10D0]
    alike = {"zh1": range(0x4E00, 0x4E80), "zh2": range(0x5000, 0x5080)}
    letters = {f"l{i:02}": [chr(starts[i % 6] + rng.randrange(22)) for _ in range(5)] for i in range(72)} | {k: [chr(c) for c in v] for k, v in alike.items()}
    said = lambda k, n: " ".join("".join(rng.choices(letters[k], k=4)) for _ in range(n))
    rows = [(k, said(k, 2500 if k == "l07" else 60)) for k in letters for _ in range(6)] + [("l07", "12 " + said("l07", 2500))]
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(langid.sample(docs, F.lit(True)))
    assert model.languages == sorted(letters) and len(model.keys)
    held = [(k, said(k, 60)) for k in letters]
    names, _, _ = langid.identify(model, [t for _, t in held])
    assert sum(a == k for a, (k, _) in zip(names, held, strict=True)) >= 0.95 * len(held)
    assert {a for a, (k, _) in zip(names, held, strict=True) if k in ("l07", "zh1", "zh2")} == {"l07", "zh1", "zh2"}
    assert langid.fit({}).languages == []
