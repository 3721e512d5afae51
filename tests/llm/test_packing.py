import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from keyorder.llm import packing, queries

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return packing.load_tokenizer(PATH)


def check(rows, expected, limits):
    """Every id once, gapless sequences within the limits; returns the padding's share."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r[0], []).append((r[1], r[2], r[3]))
        sequences.setdefault(r[5], []).append((r[6], r[2], r[7]))
    for key, pieces in docs.items():
        pieces.sort()
        ids, at = b"", 0
        for start, length, part in pieces:
            assert start == at and length > 0 and len(part) == 4 * length
            at, ids = at + length, ids + part
        assert ids == expected[key]
    assert set(docs) == set(expected)
    padding = 0
    for pieces in sequences.values():
        pieces.sort()
        at = 0
        for offset, length, _ in pieces:
            assert offset == at
            at += length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(x[2] for x in pieces) <= limits.loss
        padding += limits.tokens - at if at & (at - 1) else 0
    return padding / max(1, sum(len(x) // 4 for x in expected.values()))


PARTS = [
    "'", "s", "re", "ll", " ", "  ", "\n", "\t", "a", "é", "1", "!", "…", " ", "漢", "🙂", "'s", "\r\n", " ", "A", "H", "\u0331", "\u0301", "\u0338", "=", ",", "(", ").",
    "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "İ", "Σ", "ﬁ", "\u0958", "K", "<|endoftext|>", "w" * 70, "\0",
]


@pytest.mark.parametrize("control_ids", [False, True])
@pytest.mark.parametrize("parts", [PARTS, [x for x in PARTS if x not in ("\u0331", "\u0301", "\u0338")]])
def test_word_cache_equals_whole_texts(control_ids, parts):
    rng = random.Random(4)
    texts = ["", None, *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)), "", None]
    coder = packing.WordCoder(PATH, 1, control_ids)
    found = [x.tolist() for at in range(0, len(texts), 1000) for x in coder.encode(pa.array(texts[at : at + 1000]))]
    plain = tokenizers.Tokenizer.from_file(PATH)
    plain.encode_special_tokens = not control_ids
    assert found == [e.ids + [1] for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_of_real_texts(tokenizer):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    found = packing.WordCoder(PATH, None).encode(texts)
    assert [x.tolist() for x in found] == [e.ids for e in tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]


def plain_packing(examples, limits):
    """The rule word for word: one open bin, the largest dot product of a whole example, else of a head."""
    left = [[i, 0, len(ids), loss_from] for i, ids, loss_from in examples]
    loss = lambda e, n: max(0, e[1] + n - max(e[1], e[3]))
    bins = []
    while left:
        room, placed = [limits.tokens, limits.segments, limits.loss], []
        value = lambda e, n: n * room[0] / limits.tokens**2 + loss(e, n) * room[2] / limits.loss**2  # noqa: E731, B023
        while left and room[0] and room[1]:
            fits = [(e, e[2]) for e in left if e[2] <= room[0] and loss(e, e[2]) <= room[2]]
            if not fits and (room[0] > limits.max_padding or not placed):
                heads = [(e, min(e[2], room[0], max(e[3], e[1]) + room[2] - e[1])) for e in left]
                fits = [max(heads, key=lambda x: value(*x))]
                if fits[0][1] <= 0:
                    break
            if not fits:
                break
            e, n = max(fits, key=lambda x: value(*x))
            placed.append((e[0], e[1], n, loss(e, n)))
            room = [room[0] - n, room[1] - 1, room[2] - loss(e, n)]
            e[1], e[2] = e[1] + n, e[2] - n
            left = [e for e in left if e[2]]
        bins.append(placed)
    return bins


@pytest.mark.parametrize("limits", [packing.Limits(tokens=64, segments=3, loss=40), packing.Limits(tokens=100, segments=5, loss=30, max_padding=0)])
def test_bins_equal_the_plain_rule(limits):
    rng = random.Random(11)
    examples = []
    for i in range(150):
        n = rng.randrange(1, 60)
        examples.append((i, np.arange(n, dtype="<u4"), rng.randrange(n + 1)))
    packer = packing.Packer(limits, 0)
    rows = list(packer.add(examples)) + list(packer.drain())
    found = {}
    for r in rows:
        found.setdefault(r[5], []).append((r[0], r[1], r[2], r[7]))
    plain = plain_packing(examples, limits)
    assert [found[k] for k in sorted(found)][: len(plain) - 1] == plain[:-1]  # the last one is cut into powers of two
    full = lambda part, limit, of: sum(sum(x[part] for x in b) == limit if part else len(b) == limit for b in of)
    assert full(3, limits.loss, plain) > 5 and full(0, limits.segments, plain) > 5  # both limits bind


def test_instruction_query_is_held_by_all_limits(spark, tokenizer):
    rows = queries.packing_instructions(spark, "/root/testdata/sf0.01").collect()
    limits, bins = queries.INSTRUCTIONS, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    tokens = [sum(r.length for r in b) for b in bins.values()]
    loss = [sum(r.loss_tokens for r in b) for b in bins.values()]
    assert max(tokens) <= limits.tokens and max(loss) <= limits.loss and max(map(len, bins.values())) <= limits.segments
    assert sum(x == limits.loss for x in loss) > 1 or sum(len(b) == limits.segments for b in bins.values()) > 1
    talk = pq.read_table("/root/testdata/sf0.01/conversations.parquet").to_pylist()
    talk.sort(key=lambda r: (r["conv_id"], r["turn"], r["role"] or "", r["text"] or ""))
    expected = {}
    for i, r in enumerate(talk):
        if r["role"] == "assistant":
            before = talk[i - 1]["text"] if i and talk[i - 1]["conv_id"] == r["conv_id"] else ""
            a, b = (tokenizer.encode(t or "", add_special_tokens=False).ids for t in (before, r["text"]))
            key = r["conv_id"]
            expected[key] = [x + y for x, y in zip(expected.get(key, [0, 0]), [len(a) + len(b) + 1, len(b) + 1])]
    found = {}
    for r in rows:
        found[r.conv_id] = [x + y for x, y in zip(found.get(r.conv_id, [0, 0]), [r.length, r.loss_tokens])]
    assert found == expected


@pytest.mark.parametrize("wrong", [{"loss": 0}, {"tokens": 0}, {"segments": 0}, {"window": 0}, {"max_padding": -1}])
def test_impossible_limits(wrong):
    with pytest.raises(ValueError):
        packing.Limits(**wrong)


@pytest.mark.parametrize(
    "limits", [packing.Limits(), packing.Limits(tokens=64, segments=3, loss=40, window=16), packing.Limits(tokens=64, segments=64, loss=64, max_padding=0, window=8)]
)
def test_limits_hold(limits):
    rng = random.Random(1)
    examples = []
    for i in range(500):
        n = rng.choice([1, 2, 5, 30, 64, 65, 200])
        examples.append((i, np.arange(n, dtype="<u4") + i, rng.randrange(n + 1)))
    packer = packing.Packer(limits, 0)
    rows = [r for at in range(0, 500, 100) for r in packer.add(examples[at : at + 100])] + list(packer.drain())
    padding = check(rows, {i: ids.tobytes() for i, ids, _ in examples}, limits)
    if limits.segments == 64:
        assert padding == 0


def test_query(spark, data, tokenizer):
    docs = {r.doc_id: r.text for r in queries.documents(spark, data).collect()}
    rows = queries.op6_vector_packing(spark, data).collect()
    encoded = dict(zip(docs, tokenizer.encode_batch([t or "" for t in docs.values()], add_special_tokens=False), strict=True))
    ids = {k: np.array(e.ids + [1], "<u4").tobytes() for k, e in encoded.items()}
    expanded = []
    for r in rows:
        part = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.ids_crc32 == zlib.crc32(part) and 4 * r.doc_tokens == len(ids[r.doc_id])
        expanded.append((r.doc_id, r.start, r.length, part, r.doc_tokens, r.sequence_id, r.offset, r.loss_tokens))
    assert check(expanded, ids, packing.Limits()) < 0.02


def test_nulls_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (2, "again"), (None, "x"), (3, "many words " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'a' AS ids", "2 AS offset").coalesce(1)
    found = packing.pack(df, "doc_id", "text", PATH).collect()
    assert sum(r.length for r in found) == 1 + 1 + 2 + 2 + 6001
    assert packing.pack(df.limit(0), "doc_id", "text", PATH).collect() == []
