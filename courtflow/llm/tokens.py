"""Token ids with fixed-width bit packing.

A file row is a block: documents in order, their lengths, and all ids packed with the fewest bits that
hold the vocabulary, least significant bit first. Blocks end at document ends, so an id is found from
its block and place alone, and numpy unpacks a block at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import arrow_rows, scratch, shuffle_parts

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16
#: Pieces that a worker remembers (some 300 MB).
REMEMBER = 1_500_000
BLOCKS = "part int, block int, part_start long, bits int, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"

#: Bytes of texts that are cut and encoded at once; a longer text is alone.
GROUP = 1 << 22

#: Texts in which cutting before single spaces might not be a cut of the tokenizer as well.
_ODD = r"  |\A | \z| \n|\n |[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"


def bits_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, ``bits`` bits each, least significant first, padded with zeros to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` ids from place ``start`` on, reading no byte outside them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    lo, hi = start * bits // 8, -(-(start + n) * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, hi - lo, lo), bitorder="little")
    each = flat[start * bits - lo * 8 :][: n * bits].reshape(n, bits)
    return each.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Encoder:
    """Encodes whole texts. Between a non-space and ``space + non-space`` byte-level BPE always cuts, so ordinary
    texts are cut there and each distinct piece is encoded once; texts with other white space, or with one of the tokenizer's
    added tokens (which keep their ids), are encoded as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *added])
        # a byte-level token's string has one sign for each byte
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        """``known`` gives a piece's number: ``x`` stands for a space and x, `` x`` for x at the start of a text."""
        self.known: dict[str, int] = {}
        self.ends = np.zeros(1, np.int64)  # piece k's ids are flat[ends[k]:ends[k + 1]]
        self.flat = np.empty(0, np.uint32)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, names: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.ends) - 1, len(self.ends) - 1 + len(names))))
        self.ends = np.concatenate((self.ends, self.ends[-1] + ends))
        self.flat = np.concatenate((self.flat, ids))

    def _numbers(self, words: pa.Array, heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of distinct ``words`` after a space, and of ``heads`` at the start of a text."""
        if len(self.known) + len(words) + len(heads) > REMEMBER:
            self._forget()
        names = words.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            some = [names[i] for i in new]
            ids = self._encode(" " + " ".join(some))
            sizes = pc.binary_length(words.cast(pa.binary())).to_numpy()[new] + 1
            first = len(self.ends) - 1
            self._learn(some, ids, np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(sizes), "right"))
            found[new] = np.arange(first, first + len(new))
        some = [x for x in dict.fromkeys(heads) if " " + x not in self.known]
        if some:
            each = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._learn([" " + x for x in some], np.concatenate(each), np.cumsum([len(x) for x in each]))
        return found, np.array([self.known[" " + x] for x in heads], np.int64)

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts that may be cut before spaces."""
        pieces = pc.split_pattern(texts, " ")
        at = np.concatenate(([0], np.cumsum(pc.list_value_length(pieces).to_numpy())))
        words = pieces.flatten().dictionary_encode()
        heads = words.take(pa.array(at[:-1])).to_pylist()
        found, starts = self._numbers(words.dictionary, heads)
        pick = found[words.indices.to_numpy()]
        pick[at[:-1]] = starts
        n = self.ends[pick + 1] - self.ends[pick]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.ends[pick] - (ends - n), n) + np.arange(ends[-1])]
        return np.split(ids, ends[at[1:-1] - 1])

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null texts have none."""
        texts = texts.fill_null("")
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts.cast(pa.binary())).to_numpy()
        for i in np.flatnonzero(odd):
            out[i] = self._encode(texts[i].as_py())
        plain = np.flatnonzero(~odd & (size > 0))
        group = np.cumsum(size[plain]) // GROUP
        for some in np.split(plain, np.flatnonzero(np.diff(group)) + 1):
            if len(some):
                for i, ids in zip(some, self._plain(texts.take(pa.array(some)))):
                    out[i] = ids
        return out


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker process, which so share what it remembers."""
    return Encoder(path)


def encoded_blocks(docs: DataFrame, tokenizer: str, end_id: int = 0, block_ids: int = BLOCK_IDS, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks of packed ids in ascending ``order`` (see ``BLOCKS``), ``end_id`` after each document.

    ``part`` numbers the range of that order, ``block`` the block in it, ``part_start`` the ids before the block in its
    part. Null texts are empty. Repeated and null doc_ids keep their rows (nulls first). No rows, no blocks.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    parts = shuffle_parts(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(tokenizer)
        bits = bits_of(encoder.tokenizer.get_vocab_size())
        part, block, before = TaskContext.get().partitionId(), 0, 0
        names, sizes, ids, held = [], [], [], 0
        last = np.array([end_id], np.uint32)

        def close():
            return pa.RecordBatch.from_pydict(
                {"part": [part], "block": [block], "part_start": [before], "bits": [bits], "n_ids": [held], "doc_ids": [names], "lengths": [sizes], "payload": [pack(np.concatenate(ids), bits)]},
                schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]),
            )

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1))):
                ids += [got, last]
                names.append(doc_id)
                sizes.append(len(got) + 1)
                held += len(got) + 1
                if held >= block_ids:
                    yield close()
                    block, before = block + 1, before + held
                    names, sizes, ids, held = [], [], [], 0
        if names:
            yield close()

    keys = [c for c in order if c != "doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys)
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write the blocks of ``docs`` under ``path``."""
    encoded_blocks(docs, tokenizer, **options).write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """Documents from the files: ``doc_id, start, n_tokens, ids_crc32, ids`` (array of int)."""
    blocks = spark.read.parquet(path)
    return _starts(blocks, blocks.mapInArrow(lambda b: _unpacked(b, True), "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long, ids array<int>"))


def token_digest(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files."""
    blocks = spark.read.parquet(path)
    return _starts(blocks, blocks.mapInArrow(lambda b: _unpacked(b, False), "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long"))


def _unpacked(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack(r["payload"], r["bits"], r["n_ids"]).astype("<u4")
            ends = np.cumsum(r["lengths"])
            starts = ends - np.array(r["lengths"])
            out = {
                "doc_id": pa.array(r["doc_ids"], pa.int64()),
                "part": pa.array([r["part"]] * len(ends), pa.int32()),
                "in_part": pa.array(starts + r["part_start"], pa.int64()),
                "n_tokens": pa.array(r["lengths"], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
            }
            if whole:
                out["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts, ends)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)


def _starts(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Turn places in a part into places in the corpus; one row a part meets in the sum (as many as range partitions)."""
    spark = blocks.sparkSession
    at, rows = 0, []
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        rows.append((r.part, at))
        at += r.n
    offsets = spark.createDataFrame(rows, "part int, _o long")
    joined = docs.join(F.broadcast(offsets), "part")
    return joined.select("doc_id", (F.col("_o") + F.col("in_part")).alias("start"), *(c for c in docs.columns if c not in ("doc_id", "part", "in_part")))


def random_access(payload: bytes, bits: int, place: int) -> int:
    """The id at ``place`` of a block, from its own bytes only."""
    return int(unpack(payload, bits, 1, place)[0])
