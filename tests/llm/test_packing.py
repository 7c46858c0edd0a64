"""Packing: every token once, no gap, hardly any padding, ids as the tokenizer gives them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recospark.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 300), st.integers(1, 9000)), max_size=60))
def test_pack_holds_each_token_once(lengths):
    got = defaultdict(list)
    for tier, pieces in packing.pack(lengths):
        total = sum(n for *_, n in pieces)
        assert total == tier and total & (total - 1) == 0 and total <= packing.TIERS[-1]
        for doc, start, n in pieces:
            got[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(got[doc]):
            assert start == at and size > 0
            at += size
        assert at == n


def test_ids_and_places(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(5)
    odd = [None, "", "   ", "Don't <|endoftext|> x<|startoftext|>y", "ÄÖÜ ß é ́a İstanbul \x1c\x85 日本語 12345 ΑΣ", "word " * 9000, "Stop. stop, A.B. x.. (end). Ü. é. don't. it's, 3. \u00a0y.\u00a0z. b.\x0c c.\x1c <|ENDOFTEXT|> End."]
    rows = [(i, t) for i, t in enumerate(odd + [" ".join("".join(rng.choices("abcdeé'1.", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 400))) for _ in range(60)])]
    docs = spark.createDataFrame([*rows, (None, "a b"), (3, "again")], "doc_id long, text string").repartition(3)
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack_documents(docs, path).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length
    for i, t in rows:
        if i == 3:
            continue
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by[i], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in own), np.uint32).tolist() == want
        assert all(p.doc_tokens == len(want) for p in own)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    first = packing.digest(packing.pack_documents(docs.limit(1), path)).first()
    assert first.ids_crc32 in {zlib.crc32(p.ids) for p in pieces} or first.length
    assert packing.pack_documents(docs.limit(0), path).count() == 0
