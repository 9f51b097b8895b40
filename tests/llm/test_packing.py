import random
import zlib

import numpy as np
import public_tokenizers
from _texts import SCHEMA, corpus
from tokenizers import Tokenizer

from quillsieve.llm._tokens import Encoder
from quillsieve.llm.packing import hilbert, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "S", "s", "t", "re", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "1", "23", "²", "½", "é", "Ω", "Ж", "!", "?.", "…", "\x1c", "\x85", "\xa0", "ʼ", "_", "\x00", "<|endoftext|>", "日", "’", "٣"]


def test_encoder_equals_tokenizer():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    exact = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for keep in (400_000, 50):
        encoder = Encoder(PATH, keep)
        got = [x.tolist() for a in range(0, 4000, 100) for x in encoder.encode(texts[a : a + 100])]
        assert got == exact


def test_hilbert_is_a_path():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_every_id_once_and_no_padding(spark):
    rows = corpus(seed=6, n=80, longest=400)
    docs = spark.createDataFrame([*rows, (None, "no id", "en", "", 5)], SCHEMA).repartition(3)
    out = pack(docs, length=256).collect()
    token = Tokenizer.from_file(PATH)
    ids = {r[0]: [*token.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in [*rows, (None, "no id")]}
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(ids)
    for d, p in pieces.items():
        at = 0
        for r in sorted(p, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    for p in sequences.values():
        at = 0
        for r in sorted(p, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and at & (at - 1) == 0
    assert pack(docs.limit(0)).count() == 0
