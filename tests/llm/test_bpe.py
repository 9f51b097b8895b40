import hashlib
import random
import time

import numpy as np
import public_tokenizers
from _texts import SCHEMA, corpus
from test_packing import PARTS
from tokenizers import Tokenizer

from quillsieve.llm.bpe import Merges, TreeEncoder, decode_ids, encode_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MORE = [*PARTS, " ", "　", "͸", "😀", "ﷺ", "𝟘", "<|endoftext|", "word", "tokenization", "‍", "'", "�"]


def exact(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def plainly(merges, word):
    """The definition: again and again the leftmost adjacent pair of lowest rank."""
    ids = [int(merges.start[b]) for b in word]
    while True:
        best = min(((merges.rank[a << 32 | b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in merges.rank), default=None)
        if best is None:
            return ids
        ids[best[1] : best[1] + 2] = [int(merges.made[best[0]])]


def test_trees_merge_as_defined():
    rng, merges = random.Random(5), Merges(PATH)
    words = [bytes(rng.choice(b"aabbnest ing\xc3\xa9\xff0") for _ in range(rng.randint(1, 90))) for _ in range(700)]
    got = merges.merge(words)
    assert got == [plainly(merges, w) for w in words]
    assert [merges._long(w) for w in words] == got
    assert merges.merge([]) == []


def test_encoder_equals_the_library():
    rng = random.Random(2)
    texts = ["".join(rng.choice(MORE) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for keep in (400_000, 50):
        encoder = TreeEncoder(PATH, keep)
        assert [x.tolist() for a in range(0, 4000, 100) for x in encoder.encode(texts[a : a + 100])] == [exact(t) for t in texts]


def test_classes_of_code_points():
    encoder = TreeEncoder(PATH)
    some = [c for c in [*range(0x3000), *range(0x3000, 0x110000, 61), *range(0x10D40, 0x10D66), 0x558, 0x1C89, 0x88F, 0x3FC3C] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in some[k : k + 50]) for k in range(0, len(some), 50)]
    assert [x.tolist() for x in encoder.encode(texts)] == [exact(t) for t in texts]


def test_long_texts():
    rng = random.Random(1)
    words = "".join(rng.choice(["the ", "a  ", "\n", "don't ", "x" * 70 + " "]) for _ in range(150_000))
    began = time.time()
    for t in (words, "ab" * 200_000, "a" * 600_001, words[:1000] + "<|endoftext|>" + words[:600_000], "é" * 100_000 + " b"):
        assert TreeEncoder(PATH).encode([t])[0].tolist() == exact(t)
    assert time.time() - began < 120


def test_tables_round_trip(spark):
    rows = [*corpus(seed=9), (None, "no id <|endoftext|> x", "en", "", 5), (7, "twice", None, None, None), (7, "twice", None, None, None)]
    docs = spark.createDataFrame([(*r, "clash", b"x") for r in rows], SCHEMA + ", decoded string, ids binary").repartition(3)
    out = decode_ids(encode_texts(docs, PATH), PATH).collect()
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), r.text or "", bytes(r.ids), r.decoded) for r in out) == sorted((str(r[0]), r[1] or "", np.array(exact(r[1]), "<u4").tobytes(), LIBRARY.decode(exact(r[1]), skip_special_tokens=False)) for r in rows)
    assert decode_ids(encode_texts(docs.limit(0), PATH), PATH).count() == 0


def test_ids_within_characters_and_unknown(spark):
    ids = exact("日本 ok")
    rows = [ids[1:], ids[:1], [], [70_000, ids[-1]], [*ids[:2], 50256]]
    df = spark.createDataFrame([(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in enumerate(rows)] + [(9, None)], "k int, ids binary")
    got = {r.k: r.decoded for r in decode_ids(df, PATH).collect()}
    assert got == {k: LIBRARY.decode(x, skip_special_tokens=False) for k, x in enumerate(rows)} | {9: None}


def test_query_over_whole_tables(spark):
    from quillsieve.llm.queries import op11_bpe_codec

    dir_ = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{dir_}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = op11_bpe_codec(spark, dir_).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = exact(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(LIBRARY.decode(ids, skip_special_tokens=False).encode())
