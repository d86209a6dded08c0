import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from landmarq.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return bpe.Tokenizer(open(PATH, encoding="utf-8").read()), library


def same(both, text):
    mine, library = both
    want = library.encode(text, add_special_tokens=False).ids
    got = mine.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want, text[:80]
    assert mine.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_matches_the_library(both, spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        same(both, r.text)


def test_pieces_of_the_vocabulary(both):
    random.seed(5)
    names = [n.replace("</w>", "") for n in both[0].names.values()]
    for _ in range(3000):
        same(both, "".join(random.choice(names) for _ in range(random.randint(1, 6))))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=60) | st.text(alphabet="abcDÉéΣσßİı </w>'sre1234<|startoftext|>\x1c\x85́", max_size=60))
def test_any_text(both, text):
    same(both, text)


def test_long_words_and_marks(both):
    for text in ("a" * 20000, "!" * 5000, "x</w>y</w>", "<|startoftext|><|endoftext|>a<|endoftext|>", "ab" * 5000 + "é", ":\U0003d000!", "a\U000107bbb", ":\U00013460", "\u0558x"):
        same(both, text)


def test_cache_generations(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    for text in ("a b c d e f g a b c", "a a a b b b z y x w"):
        same(both, text)


def test_documents(odd_docs, no_docs, both):
    rows = bpe.encode_documents(odd_docs, PATH, with_ids=True)
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    got = rows.collect()
    assert len(got) == odd_docs.count()
    for r in got:
        want = both[1].encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(want, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode_ids(rows.select("doc_id", "ids"), PATH).collect()
    assert all(r.decoded == both[1].decode(r.ids, skip_special_tokens=False) for r in back)
    assert bpe.encode_documents(no_docs, PATH).count() == 0
