import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from keyorder.llm import bpe, queries

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")
PATH = queries.tokenizer_path("byte_bpe_50k.tiktoken")
ALPHABET = ["'", "s", "re", "ve", "ll", "t", "d", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "!", "…", " ", "漢", "🙂", "'s", "'ll", " '", "\r\n", " ", "x'", "A", "́", "\x1c", "\x85", "𝟘", "'RE", "_"]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_pieces(PATH), bpe.class_ranges())


def ids_of(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(pa.array(texts, pa.string()))[0]]


def test_equals_library_on_random_texts(encoder, encoding):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(5000)]
    assert ids_of(encoder, texts) == [encoding.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=40), max_size=6))
def test_equals_library_on_any_text(encoder, encoding, texts):
    assert ids_of(encoder, texts) == [encoding.encode_ordinary(t) for t in texts]


def test_long_piece(encoder, encoding):
    text = "ab" * 30_000 + " " * 5000 + "z"
    assert ids_of(encoder, [text]) == [encoding.encode_ordinary(text)]


def test_scan_is_the_fold():
    of, product, action, _, identity = bpe.monoid()
    elements = np.random.default_rng(0).choice(of, 5000)
    acc, expected = identity, []
    for x in elements.tolist():
        acc = product[acc, x]
        expected.append(acc)
    assert bpe.scan(elements).tolist() == expected
    k = len(product)
    assert all(product[product[a, b], c] == product[a, product[b, c]] for a in range(k) for b in range(k) for c in range(k))


def test_round_trip_and_null_texts(spark):
    rows = [(1, "It's  é\n"), (2, None), (3, ""), (3, "x"), (None, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded", "3 AS n_tokens")
    coded = bpe.decode(bpe.encode(df, "doc_id", "text", PATH), "doc_id", PATH).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in coded) == sorted((i or 0, t or "") for i, t in rows)
    first = next(r for r in coded if r.doc_id == 1)
    assert np.frombuffer(first.piece_starts, "<u4").tolist() == [0, 2, 4, 5, 8]


def test_query_equals_the_library(spark, data, encoding):
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, data).collect()}
    rows = queries.op2_byte_bpe(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = encoding.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
        assert r.n_pieces == len(regex.findall(tokenizers.PATTERN, docs[r.doc_id]))


def test_offsets_lead_to_pieces(spark):
    texts = ["It's  é\n and more, 12 words…", "", None, "x", "漢字 and 🙂 and so on"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = bpe.encode(df, "doc_id", "text", PATH)
    for span in ((0, 2), (1, 4), (3, 100), (2, 2)):
        found = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(coded, "doc_id", PATH, span).collect()}
        assert found == {i: "".join(regex.findall(tokenizers.PATTERN, t or "")[slice(*span)]) for i, t in enumerate(texts)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, "doc_id", "text", PATH), "doc_id", PATH).collect() == []
