import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retrievo.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
OWN = bpe.Vocabulary(bpe.read_definition(PATH))

TEXTS = ["", " \n", "Hello <|startoftext|> it's WE'LL", "ΑΣ ΟΔΟΣ İstanbul ﬁ é é \x1c a\x85b\xa0c 1234 ½ ²", "a<|endoftext|>b<|END",
         "aaaaaaaaaaaaaaaaaaa 日本語テキスト 🎉🎊👩‍👩‍👧 \x00 ﻿ '' 's 'S DON'T", "Ǆ ẞ ß ŉ K Å Ω", "x" * 3000, "\U00010d50"]


def _agrees(texts):
    for text, ids in zip(texts, OWN.encode(texts)):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:80]
        assert OWN.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_library():
    rng = random.Random(1)
    many = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(3000))
            for letters in ("ab", "aeiorstn", "abcdefghijklmnopqrstuvwxyz'.!0é")]
    _agrees(TEXTS + many)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF)))
def test_any_text(text):
    _agrees([text])


def test_forgetting(monkeypatch):
    own = bpe.Vocabulary(bpe.read_definition(PATH))
    for name in ("MEMORY_SPANS", "MEMORY_NODES", "MEMORY_PAIRS"):
        monkeypatch.setattr(bpe, name, 2)
    for text in ["one two three four", "two five", "one"]:
        assert own.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, t, "k") for t in TEXTS] + [(None, None, None), (1, TEXTS[2], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.tokenize(docs, bpe.read_definition(PATH), digests=True)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == len(rows)
    got = {r.text: r.n_tokens for r in out.collect()}
    assert all(n == len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t, n in got.items())
    full = {r.text: r for r in bpe.tokenize(docs, bpe.read_definition(PATH)).collect()}
    assert full[None].token_ids == [] and full[None].decoded == ""
    assert full[TEXTS[2]].token_ids == LIBRARY.encode(TEXTS[2], add_special_tokens=False).ids
    assert bpe.tokenize(docs.where("false"), bpe.read_definition(PATH)).count() == 0
