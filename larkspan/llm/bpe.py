"""BPE encoding and decoding through a table of distinct words.

1. Split: documents are cut into words at white space, batch by batch. A batch (some thousand documents) keeps its
   distinct words once, numbered by first appearance; its documents become word numbers.
2. Encode: the distinct words of all batches meet by word, in buckets, and every distinct word is encoded once.
   A frequent word comes once per batch, however often it occurs, so no word is a hot key.
3. Join back: the ids return to the batch, where word numbers (the positions) pick them up.
4. Decode: ids meet the vocabulary, an id-to-piece table whose size is fixed by the tokenizer.

A batch's key is a digest of its word list. Step 1 runs once for the words and once for the documents; if a lost task
came back with its rows dealt otherwise, the digests would differ and the job would stop instead of giving wrong ids.

What moves: each distinct word of a batch and its ids once, and about two bytes per word of text. Columns of words and
numbers travel as packed bytes, since a row of Spark's costs far more than a word.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import read, shuffle_width, slices, whole

BATCH_CHARS = 24_000_000
SLICE_CHARS = 2_000_000
BLOCK_ROWS = 512
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def fixed_tokenizer(path: str):
    """A tokenizer for use in a task: no truncation, no padding, and no threads beside the task's own."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Splitter:
    """Cuts a text before each blank or line feed that stands directly before a word.

    A byte-level tokenizer gives the last white space of a run to the word after it, and everything before it to a
    token of its own, so the ids of a text are those of its cuts, one after the other. A special token is matched in
    the raw text first; there the white space before it is not cut off.
    """

    def __init__(self, special: Iterable[str]):
        self.special = sorted(special)
        ahead = "".join(f"(?!{re.escape(s)})" for s in self.special)
        self.cut = re.compile(f"(?=[ \\n]{ahead}[^{SPACE}])")

    def __call__(self, text: str) -> list[str]:
        pieces = text.replace(" ", "\x1e ").replace("\n", "\x1e\n").split("\x1e")
        words = text.split()
        # one blank or line feed between two words, no other white space anywhere: the fast cut is the same
        single = len(pieces) == len(words) and sum(map(len, words)) == len(text) - len(words) + 1
        if single and "\x1e" not in text and not any(s in text for s in self.special):
            return pieces
        return [p for p in self.cut.split(text) if p]


def pack_words(words: list[bytes]) -> bytes:
    """A list of byte strings as one, compressed."""
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    body = lengths.tobytes() + b"".join(words)
    return np.array([len(words), len(body)], "<u4").tobytes() + pa.compress(body, "zstd", asbytes=True)


def unpack_words(packed: bytes) -> list[bytes]:
    n, size = np.frombuffer(packed, "<u4", 2).tolist()
    body = pa.decompress(packed[8:], size, "zstd", asbytes=True)
    at, out = 4 * n, []
    for end in (np.cumsum(np.frombuffer(body, "<u4", n), dtype=np.int64) + at).tolist():
        out.append(body[at:end])
        at = end
    return out


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as four byte planes, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.array([len(numbers)], "<u4").tobytes() + pa.compress(planes, "zstd", asbytes=True)


def unsqueeze(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, "<u4", 1)[0])
    planes = pa.decompress(packed[4:], 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()


def _numbered(batches: Iterator[pa.RecordBatch], special: list[str], with_codes: bool) -> Iterator[tuple]:
    """(ids, word list, codes and lengths of the documents) of each batch."""
    split = Splitter(special)
    for arrow in batches:
        sizes = pc.utf8_length(arrow.column("_text")).to_pylist()
        for start, end in slices(sizes, BATCH_CHARS):
            words: dict[str, int] = {}
            codes, lengths, key = [], [], hashlib.blake2b(digest_size=16)
            for at, upto in slices(sizes[start:end], SLICE_CHARS):
                for text in arrow.column("_text").slice(start + at, upto - at).to_pylist():
                    pieces = split(text) if text else []
                    for w in dict.fromkeys(pieces):
                        if w not in words:
                            words[w] = len(words)
                    if with_codes:
                        codes.append(np.fromiter(map(words.__getitem__, pieces), np.uint32, len(pieces)))
                        lengths.append(len(pieces))
            listed = [w.encode("utf-8", "surrogatepass") for w in words]
            del words
            for w in listed:
                key.update(b"%d:" % len(w) + w)
            yield arrow.column("doc_id").slice(start, end - start), key.digest(), listed, codes, lengths


def word_buckets(texts: DataFrame, special: list[str], buckets: int) -> DataFrame:
    """batch, bucket, the batch's distinct words in that bucket and their numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, listed, _, _ in _numbered(batches, special, False):
            home = np.fromiter(map(zlib.crc32, listed), np.uint32, len(listed)) % buckets
            order = np.argsort(home, kind="stable")
            edges = np.flatnonzero(np.diff(home[order], prepend=-1))
            rows = []
            for at, upto in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                numbers = order[at:upto]
                rows.append(
                    {"batch": key, "bucket": int(home[numbers[0]]), "words": pack_words([listed[i] for i in numbers.tolist()]), "numbers": squeeze(numbers)}
                )
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return texts.mapInArrow(work, "batch binary, bucket long, words binary, numbers binary")


def encode_buckets(found: DataFrame, tokenizer_path: str) -> DataFrame:
    """batch, numbers and ids: each distinct word of a bucket is encoded once, whatever batches it comes from."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = fixed_tokenizer(tokenizer_path)
        bucket, known = None, {}
        for arrow in batches:
            for i in range(len(arrow)):
                row = arrow.slice(i, 1).to_pylist()[0]
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                words = unpack_words(row["words"])
                new = [w for w in words if w not in known]
                for w, e in zip(new, tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4").tobytes()
                yield pa.RecordBatch.from_pylist([{"batch": row["batch"], "numbers": row["numbers"], "ids": pack_words([known[w] for w in words])}])

    near = found.repartition("bucket").sortWithinPartitions("bucket")
    return near.mapInArrow(work, "batch binary, numbers binary, ids binary")


def word_numbers(texts: DataFrame, special: list[str]) -> DataFrame:
    """batch, number of its words, and blocks of documents as word numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, key, listed, codes, lengths in _numbered(batches, special, True):
            for at in range(0, len(codes), BLOCK_ROWS):
                part = codes[at : at + BLOCK_ROWS]
                yield pa.RecordBatch.from_pylist(
                    [{
                        "batch": key, "n_words": len(listed), "doc_ids": ids.slice(at, BLOCK_ROWS).to_pylist(),
                        "lengths": squeeze(np.array(lengths[at : at + BLOCK_ROWS], np.uint32)), "codes": squeeze(np.concatenate(part)),
                    }]
                )

    return texts.mapInArrow(work, "batch binary, n_words long, doc_ids array<bigint>, lengths binary, codes binary")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, then from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def piece_table(tokenizer) -> list[bytes]:
    """Bytes of each id: the id-to-piece table of a byte-level vocabulary."""
    letters = {letter: b for b, letter in enumerate(byte_letters())}
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    pieces = [b""] * (max(tokenizer.get_vocab(True).values()) + 1)
    for piece, i in tokenizer.get_vocab(True).items():
        pieces[i] = special[i].encode() if i in special else bytes(letters[c] for c in piece)
    return pieces


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.string())])


def _assembled(words: pa.Table, documents: pa.Table, pieces: list[bytes], width: str, full: bool) -> Iterator[pa.RecordBatch]:
    """Documents of one batch from the ids of its words."""
    total = max(documents.column("n_words").to_pylist())
    table: list[bytes | None] = [None] * total
    for numbers, ids in zip(words.column("numbers"), words.column("ids"), strict=True):
        for number, found in zip(unsqueeze(numbers.as_py()).tolist(), unpack_words(ids.as_py()), strict=True):
            table[number] = found
    if None in table:
        raise ValueError("a batch of documents came back with other words: its ids are not complete")
    counts = np.fromiter(map(len, table), np.int64, total) // np.dtype(width).itemsize
    flat = np.frombuffer(b"".join(table), width).astype("<u4")
    starts = np.cumsum(counts) - counts
    shown = [b"".join(map(pieces.__getitem__, flat[s : s + n].tolist())) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
    for row in documents.to_pylist():
        codes, lengths = unsqueeze(row["codes"]), unsqueeze(row["lengths"])
        out, at = [], 0
        for doc_id, n in zip(row["doc_ids"], lengths.tolist(), strict=True):
            own = codes[at : at + n]
            at += n
            many = counts[own]
            size = int(many.sum())
            ids = flat[np.repeat(starts[own] - (np.cumsum(many) - many), many) + np.arange(size)].tobytes()
            decoded = b"".join(map(shown.__getitem__, own.tolist())).decode("utf-8", "replace")
            out.append(
                {"doc_id": doc_id, "n_tokens": size, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(),
                 "ids": ids if full else None, "decoded": decoded if full else None}
            )
        yield pa.RecordBatch.from_pylist(out, RESULT)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with `full` ids (little-endian 32-bit) and decoded text.

    Null and empty texts have no ids. Repeated rows and null ids are rows like any other; an empty table gives none.
    """
    tokenizer = fixed_tokenizer(tokenizer_path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    pieces, width = piece_table(tokenizer), "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_text"))
    words = encode_buckets(word_buckets(texts, special, 4 * shuffle_width(docs.sparkSession)), tokenizer_path)
    documents = word_numbers(texts, special)
    held = docs.sparkSession.sparkContext.broadcast(pieces)  # fixed by the vocabulary: 50 thousand pieces

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(_assembled(left, right, held.value, width, full)) if right.num_rows else []
        return pa.Table.from_batches(parts, RESULT)

    return words.groupBy("batch").cogroup(documents.groupBy("batch")).applyInArrow(
        assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"
    )


def decode(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Texts of `ids` (doc_id, pos, id) through a join with `vocabulary` (id, piece as bytes).

    Ids without a piece are skipped; bytes that are no UTF-8 become replacement marks.
    """
    joined = ids.join(vocabulary, "id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    as_text: Column = F.aggregate("p", F.lit(b""), lambda all_, p: F.concat(all_, p["piece"]))
    return joined.select("doc_id", F.decode(as_text, "UTF-8").alias("text"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), full=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
