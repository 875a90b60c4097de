import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retrievo.llm import sentence_pieces as sp
from retrievo.llm.piece_model import fields, read_model
from retrievo.llm.queries import op12

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sp.read_file(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = sp.Encoder(MODEL)

TEXTS = ["", " ", "  ", "a", " a\nb  c▁d</s> <s> <unk> <0x0A>", "\n", "\n a", "x" * 3000, " " * 100, "aaa" * 50 + " " * 37 + "b",
         "日本語 テキスト 🎉🎊👩‍👩‍👧 \x00 x", "é é \r\n\t", "▁▁▁a", "a ▁ b", "1234,56.7", "� ﻿"]


def _wanted(text):
    return LIBRARY.encode(text or "", add_bos=True, add_eos=True)


def _agrees(texts, own=OWN):
    ids, heads = own.encode(pa.array(texts, pa.string()))
    assert len(heads) == len(texts) + 1
    for text, a, b in zip(texts, heads[:-1], heads[1:]):
        want = _wanted(text)
        assert ids[a:b].tolist() == want, (text or "")[:80]
        assert own.decode(ids[a:b]).decode() == LIBRARY.decode(want)


@pytest.mark.parametrize("letters", ["ab", " a", "aeiorstn ", "abcdefghijklmnopqrstuvwxyz'.!0é ▁\n", "日本語のあいう ab", "==--##//  \n"])
def test_library(letters):
    rng = random.Random(1)
    _agrees(["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(150)])


def test_special_texts():
    _agrees([*TEXTS, None])
    _agrees([])
    _agrees(["word " * 200_000 + "x" * 100_000])  # one very long text with a very long word


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_any_text(text):
    _agrees([text])


def test_forgetting(monkeypatch):
    monkeypatch.setattr(sp, "KEPT", 2)
    monkeypatch.setattr(sp, "KEPT_PAIRS", 2)
    own = sp.Encoder(MODEL)
    for text in ["one two three four", "two five", "one", "hello world"]:
        _agrees([text], own)
    assert len(own.young) <= 2 and len(own.old) <= 2 and len(own.pairs) <= 2


def test_compatible_pairs_are_what_the_library_keeps():
    rng = random.Random(3)
    plain = [i for t, i in OWN.model.ids.items() if "▁" not in t]
    for _ in range(2000):
        left, right = rng.choice(plain), rng.choice(plain)
        text = OWN.text[left] + OWN.text[right]
        assert OWN.compatible(left, right) == (OWN.joined(text) == [OWN.text[left], OWN.text[right]])


def test_models_of_other_kinds_are_refused():
    def message(number, value):
        def size(n):
            out = b""
            while n > 127:
                out, n = out + bytes([n & 127 | 128]), n >> 7
            return out + bytes([n])
        return size(number << 3 | 2) + size(len(value)) + value

    with pytest.raises(ValueError):
        read_model(MODEL + message(2, b"\x18\x01"))  # another model type
    with pytest.raises(ValueError):
        read_model(MODEL + message(3, b"\x12\x01x"))  # a character map
    assert {n for n, _ in fields(MODEL)} == {1, 2, 3}


def test_rows(spark):
    rows = [(1, t, "k") for t in TEXTS] + [(None, None, None), (1, TEXTS[4], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sp.encode_pieces(docs, MODEL, digests=True)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == len(rows)
    for r in out.collect():
        want = _wanted(r.text)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want).encode()).hexdigest()
    full = {r.text: r for r in sp.encode_pieces(docs, MODEL).collect()}
    assert full[None].token_ids == [1, 2] and full[None].decoded == ""
    assert full[TEXTS[4]].token_ids == _wanted(TEXTS[4])
    assert sp.encode_pieces(docs.where("false"), MODEL).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = op12(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        want = _wanted(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want).encode()).hexdigest()
