import hashlib

import public_tokenizers as P
import pytest
from .helpers import ROWS, awkward
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from estatelens.llm import bpe

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return library, bpe.Bpe(PATH)


def same(both, text):
    library, own = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "don't WE'LL they've", "<|endoftext|>a<|startoftext|> <|", "x" * 900 + "y" * 900, "ΑΣ ΣΑΣ İstanbul", "a\x1cb\x85c\xa0d", "é é ﬁ ½²٣", "日本語 한국어 🙂🙃", "ſſ ẞ ß", "abc" * 400, "\r\n\t"])
def test_cases(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    same(both, text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdeinorst'.,! 12éüñ", max_size=400))
def test_words(both, text):
    same(both, text)


def test_long_words_take_the_heap_and_agree(both):
    own = both[1]
    word = ("inthean" * 200).encode()
    assert own._encode_long([*(own.inner[b] for b in word[:-1]), own.last[word[-1]]]) == own.encode_word(word)
    short = b"international"
    assert own._encode_long([*(own.inner[b] for b in short[:-1]), own.last[short[-1]]]) == own.encode_word(short)


def test_query(spark, both):
    got = bpe.token_digests(awkward(spark, ROWS), PATH).collect()
    expected = []
    for i, text in ROWS:
        ids = both[0].encode(text or "", add_special_tokens=False).ids
        decoded = both[0].decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert bpe.token_digests(awkward(spark, []), PATH).count() == 0
    whole = bpe.encode_documents(awkward(spark, ROWS), PATH)
    assert whole.filter("doc_id = 9").first().token_ids == both[0].encode("x").ids
