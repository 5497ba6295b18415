import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattledger.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 '\n\t é中!_²ǅ́s", max_size=80), st.integers(1, 9))
def test_segments_do_not_change_ids(text, size):
    enc = bpe.encoding(PATH)
    assert bpe.encode_text(enc, text, size=size, longest=size).tolist() == enc.encode_ordinary(text)
    assert "".join(bpe.segments(text, size)) == text


@pytest.mark.parametrize("text", ["a" * 3000, " " * 3000, "ab 12\n" * 800, "!" * 2000 + "x", "é中" * 900 + " \n" * 300])
def test_long_runs(text):
    enc = bpe.encoding(PATH)
    ids = bpe.encode_text(enc, text, size=100, longest=200)
    assert ids.tolist() == enc.encode_ordinary(text)
    assert enc.decode_bytes(ids.tolist()) == text.encode()


def test_tables(odd, make):
    got = bpe.decode(bpe.encode(odd, PATH), PATH).select("doc_id", "ids", "decoded", "lang").collect()
    texts = odd.select("doc_id", "text").collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((r["text"] or "").encode() for r in texts)
    enc = bpe.encoding(PATH)
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(bytes(r["decoded"]).decode())
    assert bpe.encode(make([]), PATH).count() == 0
