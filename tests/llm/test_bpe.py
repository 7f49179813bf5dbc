import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from larkspan.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "Word,", "über", " ", " ", "\n", "\t", "　", "'s", "12", "<|endoftext|>", "\x1e", "\x1c", "\xa0", "😀"]


def texts():
    rng = random.Random(9)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    return [*made, None, "", " ", "\n\n\n", "word " * 5000, "x" * 20_000]


def test_cuts_keep_the_ids():
    plain, split = Tokenizer.from_file(PATH), bpe.Splitter(["<|endoftext|>"])
    for t in filter(None, texts()):
        assert sum((plain.encode(w, add_special_tokens=False).ids for w in split(t)), []) == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip(documents, spark):
    plain, data = Tokenizer.from_file(PATH), [*enumerate(texts()), (None, "no id"), (2, texts()[2])]
    rows = bpe.encode(documents(data).repartition(3), PATH).collect()
    assert len(rows) == len(data)
    by_id = dict(data)
    for r in rows:
        text = by_id[r.doc_id] or ""
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(documents([]), PATH).count() == 0


def test_decode_by_join(spark):
    plain = Tokenizer.from_file(PATH)
    pieces = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(bpe.piece_table(plain))], "id int, piece binary")
    rows = [(1, k, i) for k, i in enumerate(plain.encode("Grüße <|endoftext|> 😀\n", add_special_tokens=False).ids)] + [(2, 0, 99_999_999)]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, pos int, id int"), pieces).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "Grüße <|endoftext|> 😀\n")]


def test_packed_numbers():
    for numbers in ([], [0], [1 << 31, 5, 70_000]):
        assert bpe.unsqueeze(bpe.squeeze(np.array(numbers, np.uint32))).tolist() == numbers
    assert bpe.unpack_words(bpe.pack_words([b"", b"ab", b"\x00"])) == [b"", b"ab", b"\x00"]
