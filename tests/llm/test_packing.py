import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from larkspan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "größer", "naïve", "ﬁ", "Word,", "über.", " ", " ", "\n", "\t", "　", "'s", "12", "<|endoftext|>", "İ", "Σ", "\x1e", "É", "..."]


def test_word_ids_equal_the_tokenizer():
    rng, plain = random.Random(6), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    words = packing.WordIds(PATH)
    for text, ids in zip(texts, map(words.of, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_and_places(documents):
    rng, plain = random.Random(7), Tokenizer.from_file(PATH)
    texts = [" ".join(rng.choice(["tree", "stone", "water"]) for _ in range(rng.randint(0, 150))) for _ in range(300)] + [None, "", "word " * 900]
    data = [*enumerate(texts), (None, "no id"), (3, texts[3])]
    found = packing.pieces(documents(data), PATH, capacity=128)
    rows = packing.pack(found, capacity=128, block=64).collect()
    assert len(rows) == found.count()
    by_id = dict(data)
    for r in rows:
        ids = np.array(plain.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        part = ids[r.start : r.start + 128]
        assert (r.start, r.length, r.ids_crc32) == (128 * r.piece, len(part), zlib.crc32(part.tobytes()))
    bins = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 128
    assert len(bins) <= 1.03 * sum(bins.values()) / 128 + 1
    assert packing.pack(packing.pieces(documents([]), PATH)).count() == 0


def test_crossover_keeps_every_piece():
    rng, sizes = random.Random(8), np.array([random.Random(k).randint(1, 90) for k in range(200)])
    a, b = packing.fresh(sizes, 100, rng, 0.0), packing.fresh(sizes, 100, rng, 0.5)
    for _ in range(20):
        child = packing.crossover(a, b, sizes, 100, rng)
        loads = np.bincount(child, sizes)
        assert (child >= 0).all() and loads.max() <= 100 and (loads > 0).all()
    best = packing.evolve(sizes, [a, b], 100, 1)
    assert packing.fitness(best, sizes, 100) >= packing.fitness(a, sizes, 100)
