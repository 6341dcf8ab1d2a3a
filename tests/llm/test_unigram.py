import math
import random

import public_tokenizers
import pytest

from gridloom.llm.unigram import BYTE, NORMAL, UNKNOWN, DoubleArray, Encoder, _table, build, decode, decode_ids, encode, load, viterbi

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return load(PATH)


def ids(raw):
    return [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]


def brute(model, unit):
    """Best path by plain dynamic programming over characters, float32 sums."""
    import numpy as np

    text = unit.decode()
    of = {p: k for k, p in enumerate(model.pieces) if model.kinds[k] in (1, 4)}
    best = [np.float32(0)] + [np.float32(-math.inf)] * len(text)
    back = [None] * (len(text) + 1)
    for s in range(len(text)):
        if best[s] == -math.inf:
            continue
        for e in range(s + 1, min(len(text), s + 40) + 1):
            k = of.get(text[s:e])
            if k is not None and best[s] + model.scores[k] > best[e]:
                best[e], back[e] = best[s] + model.scores[k], (s, [k])
        if text[s] not in of and best[s] + model.floor > best[s + 1]:
            best[s + 1], back[s + 1] = best[s] + model.floor, (s, [int(model.byte_ids[b]) for b in text[s].encode()])
    out, at = [], len(text)
    while at:
        at, k = back[at]
        out = k + out
    return out


def test_trie():
    keys = sorted({bytes(random.Random(k).choices(b"abc\xff", k=k % 6 + 1)) for k in range(300)})
    t = DoubleArray(keys)
    for k, key in enumerate(keys):
        node = 0
        for c in key:
            to = t.base[node] + c + 1
            assert t.check[to] == node
            node = to
        assert t.value[node] == k


def test_against_brute_force(model):
    rng = random.Random(1)
    units = ["".join(rng.choices("▁etaoinsh.éß\n日🙂Zz9", k=rng.randint(1, 24))).replace("▁", "") for _ in range(400)]
    units = [("▁" * rng.randint(0, 5) + u).encode() for u in units if u]
    assert [ids(r) for r in viterbi(model, units)] == [brute(model, u) for u in units]


def test_against_the_library(tmp_path, model):
    """The same pieces and scores written as a unigram file."""
    import struct

    import sentencepiece

    def field(n, kind, body):
        def varint(v):
            out = b""
            while v > 127:
                out, v = out + bytes([v & 127 | 128]), v >> 7
            return out + bytes([v])

        return varint(n << 3 | kind) + (varint(len(body)) + body if kind == 2 else varint(body) if kind == 0 else body)

    raw = b""
    for p, s, k in zip(model.pieces, model.scores.tolist(), model.kinds):
        raw += field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s if k == NORMAL else 0.0)) + field(3, 0, k))
    raw += field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0))
    path = tmp_path / "unigram.model"
    path.write_bytes(raw)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), Encoder(load(str(path)))
    texts = ["Hello world", "  two  spaces   ", "a\nb\n\n c", "naïve ▁ mark 日本🙂", "Thntblere of then, edtioner in inea"]
    for t in texts:
        assert ids(own.batch([t])[0]) == lib.encode(t), t


def test_round_trip(model):
    own, table = Encoder(model), _table(model)
    for t in ["", " ", "a", "  a  b ", "x\n\ny \n z\n", "日本\u0000é🙂\r\t", "a" * 5000, " \n", "\n", "q\nw e"]:
        assert decode_ids(model, table, ids(own.batch([t])[0])) == t


def test_units_agree_with_whole_text(model):
    t = "Hello the world, it is\nnew line  and two"
    assert Encoder(model).batch([t])[0] == viterbi(model, [("▁" + t.replace(" ", "▁")).encode()])[0]


def test_small_unigram():
    m = build(["<unk>", "▁a", "b", "ab", "▁", "a", *[f"<0x{b:02X}>" for b in range(256)]], [0, -1.0, -2.0, -1.5, -1.0, -3.0, *[0] * 256], [UNKNOWN, *[NORMAL] * 5, *[BYTE] * 256])
    assert ids(viterbi(m, ["▁ab".encode()])[0]) == [4, 3]


def test_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    back = decode(encode(docs, PATH, keep=["doc_id", "text"]), PATH, keep=["doc_id", "text"]).collect()
    assert len(back) == 200 and all(r.text == r.decoded for r in back)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", None)], "doc_id long, text string, ids int")
    assert len(encode(rows, PATH).collect()) == 3
    got = sorted([(r[0], r.n_pieces) for r in encode(rows, PATH, keep=["doc_id"]).collect()], key=str)
    assert got[:2] == [(1, 0), (1, 0)] and got[2][0] is None and got[2][1] > 0
    assert encode(rows.limit(0), PATH, keep=["doc_id"]).count() == 0
