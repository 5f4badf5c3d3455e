import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm.bpe import bpe_encode, codec

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("aehnrst ", max_size=200), st.text(" \n\t.,!*$'", max_size=80)))
def test_equals_library(library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = codec(PATH).encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert codec(PATH).decode(ids) == text.encode()


def test_long_pieces(library):
    rng = random.Random(5)
    for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "éèaß", "中文字符"):
        text = "".join(rng.choice(letters) for _ in range(3000))
        assert np.frombuffer(codec(PATH).encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_rows(docs, odd_rows, library):
    got = bpe_encode(docs(odd_rows), PATH, keep=("doc_id", "row")).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, library.encode_ordinary(t or ""), sha((t or "").encode())) for i, t in odd_rows]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, r.input_ids, r.decoded_sha256) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.row == "x" and r.n_tokens == len(r.input_ids) and r.ids_sha256 == sha(np.array(r.input_ids, "<u4").tobytes())
    assert bpe_encode(docs([]), PATH).count() == 0
