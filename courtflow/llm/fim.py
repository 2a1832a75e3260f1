"""Fill-in-middle over seekable compressed texts.

A text is stored as independent zstandard frames of bounded size with cumulative counts of bytes, code points and units (tokens of
white space and what follows it) at their ends. A cut after a given number of units is found from the counts and one decompressed
frame. Outputs are stored alike: frames that no cut meets are copied as they are, the pieces of cut frames are compressed anew.
Digests stream the frames in order, so that no text is ever whole in decompressed form once it is stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import arrow_rows, saved

#: Most bytes of text in a frame, and the level of compression.
FRAME = 1 << 16
LEVEL = 3
#: The marks, and the order of the pieces (0 prefix, 1 middle, 2 suffix) in each form.
MARKS = (b"<P>", b"<M>", b"<S>")
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}

STORE = "payload binary, offsets array<long>, starts array<long>, chars array<long>, units array<long>"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Frames:
    """A stored text. Frame i is ``payload[offsets[i]:offsets[i+1]]`` and holds bytes ``starts[i]`` to ``starts[i+1]`` of the text;
    ``chars`` and ``units`` count code points and ends of units up to each start. Outputs have no counts of units."""

    payload: bytes
    offsets: Sequence[int]
    starts: Sequence[int]
    chars: Sequence[int]
    units: Sequence[int] | None = None

    def __post_init__(self):
        self._zstd = zstandard.ZstdDecompressor()
        self._last: tuple[int, bytes] = (-1, b"")

    @property
    def size(self) -> int:
        return self.starts[-1]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def frame(self, i: int) -> bytes:
        """The bytes of a frame; the last one that was read is remembered."""
        if self._last[0] != i:
            self._last = i, self._zstd.decompress(memoryview(self.payload)[self.offsets[i] : self.offsets[i + 1]])
        return self._last[1]

    def stream(self, a: int = 0, b: int | None = None) -> Iterator[bytes]:
        """Bytes a to b, frame by frame."""
        b = self.size if b is None else b
        i = int(np.searchsorted(self.starts, a, "right")) - 1
        while a < b:
            end = min(b, self.starts[i + 1])
            data = self.frame(i)
            yield data if end - a == len(data) else data[a - self.starts[i] : end - self.starts[i]]
            a, i = end, i + 1

    def after_units(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units: one frame is decompressed."""
        if k <= 0 or not self.size:
            return 0, 0
        i = int(np.searchsorted(self.units, k, "left")) - 1  # the k-th unit ends in this frame
        data = np.frombuffer(self.frame(i), np.uint8)
        space = _SPACE[data]
        inside = np.flatnonzero(~space[:-1] & space[1:]) + 1
        before = self.units[i]
        if i and not space.size == 0 and space[0] and not _SPACE[self.frame_end(i - 1)]:
            before -= 1  # the unit that ends where this frame begins is counted by the frame before it
            inside = np.concatenate(([0], inside))
        place = k - before - 1
        at = int(inside[place]) if place < len(inside) else len(data)
        return self.starts[i] + at, self.chars[i] + code_points(data[:at])

    def frame_end(self, i: int) -> int:
        """The last byte of a frame (leaves the remembered frame as it is)."""
        return self._zstd.decompress(memoryview(self.payload)[self.offsets[i] : self.offsets[i + 1]])[-1]


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Writer:
    """Builds frames from bytes and from frames of other texts."""

    def __init__(self, level: int = LEVEL):
        self._zstd = zstandard.ZstdCompressor(level=level)
        self.clear()

    def clear(self) -> None:
        self._parts, self._offsets, self._starts, self._chars = [], [0], [0], [0]

    def _put(self, packed, size: int, chars: int) -> None:
        self._parts.append(packed)
        self._offsets.append(self._offsets[-1] + len(packed))
        self._starts.append(self._starts[-1] + size)
        self._chars.append(self._chars[-1] + chars)

    def add(self, data: bytes) -> None:
        """Bytes as frames of their own, none beyond ``FRAME``, cut between code points."""
        view, at = np.frombuffer(data, np.uint8), 0
        while at < len(data):
            end = min(at + FRAME, len(data))
            for _ in range(3):
                if end < len(data) and view[end] & 0xC0 == 0x80:
                    end -= 1
            self._put(self._zstd.compress(data[at:end]), end - at, code_points(view[at:end]))
            at = end

    def copy(self, text: Frames, a: int, b: int) -> None:
        """Bytes a to b of a stored text: whole frames as they are, parts of frames anew."""
        i = int(np.searchsorted(text.starts, a, "right")) - 1
        while a < b:
            end = min(b, text.starts[i + 1])
            if end - a == text.starts[i + 1] - text.starts[i]:
                packed = memoryview(text.payload)[text.offsets[i] : text.offsets[i + 1]]
                self._put(packed, end - a, text.chars[i + 1] - text.chars[i])
            else:
                self.add(text.frame(i)[a - text.starts[i] : end - text.starts[i]])
            a, i = end, i + 1

    def done(self) -> Frames:
        out = Frames(b"".join(self._parts), self._offsets, self._starts, self._chars)
        self.clear()
        return out


def stored(data: bytes, writer: Writer) -> Frames:
    """A text as frames with all counts. A unit ends where white space follows other signs, and at the text's end."""
    writer.add(data)
    out = writer.done()
    space = _SPACE[np.frombuffer(data, np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    out.units = np.searchsorted(ends, out.starts, "right").tolist()
    if len(data):
        out.units[-1] = len(ends) + 1
    return out


def arranged(text: Frames, form: str, cuts: tuple[int, int], writer: Writer) -> Frames:
    """The output: the pieces between the cuts, each after its mark, in the order of the form; the text itself if plain."""
    if form == "plain":
        writer.copy(text, 0, text.size)
        return writer.done()
    bounds = (0, *cuts, text.size)
    for piece in ORDERS[form]:
        writer.add(MARKS[piece])
        writer.copy(text, bounds[piece], bounds[piece + 1])
    return writer.done()


def pieces(output: Frames, form: str) -> list[tuple[int, int]]:
    """Where prefix, middle and suffix stand in an output, found from its marks while its frames stream by."""
    if form == "plain":
        return [(0, output.size)]
    order, found, tail, seen = ORDERS[form], [], b"", 0
    for chunk in output.stream():
        data = tail + chunk
        at = 0
        while len(found) < 3 and (hit := data.find(MARKS[order[len(found)]], at)) >= 0:
            found.append(seen - len(tail) + hit)
            at = hit + 3
        seen += len(chunk)
        tail = data[max(at, len(data) - 2) :]
    spans = dict(zip(order, ((a + 3, b) for a, b in zip(found, [*found[1:], output.size]))))
    return [spans[i] for i in range(3)]


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text that an output was made from, streamed."""
    for a, b in pieces(output, form):
        yield from output.stream(a, b)


def _frames(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[Frames]:
    for row in zip(*(batch.column(n).to_pylist() for n in names)):
        yield Frames(*row)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = Writer()
    lists = pa.list_(pa.int64())
    for b in batches:
        rows = [stored(t or b"", writer) for t in b.column(0).to_pylist()]
        new = [pa.array([r.payload for r in rows], pa.binary()), *(pa.array([getattr(r, c) for r in rows], lists) for c in ("offsets", "starts", "chars", "units"))]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], *new], [*b.schema.names[1:], "payload", "offsets", "starts", "chars", "units"])


def frame_store(docs: DataFrame) -> DataFrame:
    """``doc_id, marked, n`` and the frames (``STORE``) of every row of ``docs(doc_id, text)``; ``marked``: the text holds a mark; ``n``: its units."""
    arrow_rows(docs.sparkSession, 64)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(text, F.lit(m.decode()))
    rows = docs.select(text.cast("binary").alias("data"), F.col("doc_id").cast("long").alias("doc_id"), marked.alias("marked"))
    return rows.mapInArrow(_store, f"doc_id long, marked boolean, {STORE}").withColumn("n", F.element_at("units", -1))


def _draw(seed: int, i: int) -> Column:
    """The i-th (from 1) group of 8 hex digits of sha256 of ``seed:doc_id`` (a null id: nothing after the colon)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(h, 8 * i - 7, 8), 16, 10).cast("long")


def planned(store: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``store`` with ``form`` and the units before the two cuts, ``cut1`` and ``cut2``."""
    a, b = (F.pmod(_draw(seed, i), F.col("n") + 1) for i in (1, 2))
    plain = (F.col("n") == 0) | F.col("marked") | (F.pmod(_draw(seed, 3), F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(_draw(seed, 4), F.lit(100)) < spm, "spm").otherwise("psm")
    return store.select("*", form.alias("form"), F.least(a, b).alias("cut1"), F.greatest(a, b).alias("cut2"))


_OUT = ("payload", "offsets", "starts", "chars")


def _arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = Writer()
    lists = pa.list_(pa.int64())
    for b in batches:
        rows, first, second = [], [], []
        for text, form, c1, c2 in zip(_frames(b, [*_OUT, "units"]), *(b.column(c).to_pylist() for c in ("form", "cut1", "cut2"))):
            if form == "plain":
                cuts, sizes = (0, 0), (None, None)
            else:
                (p1, n1), (p2, n2) = text.after_units(c1), text.after_units(c2)
                cuts, sizes = (p1, p2), (n1, n2 - n1)
            rows.append(arranged(text, form, cuts, writer))
            first.append(sizes[0])
            second.append(sizes[1])
        new = [pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array([r.payload for r in rows], pa.binary()), *(pa.array([getattr(r, c) for r in rows], lists) for c in _OUT[1:])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), b.column("form"), *new], ["doc_id", "n", "form", "prefix_chars", "middle_chars", *_OUT])


def outputs(plans: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` and the frames of each output (without counts of units)."""
    rows = plans.select("doc_id", "n", "form", "cut1", "cut2", *_OUT, "units")
    frames = STORE.rsplit(",", 1)[0]
    return rows.mapInArrow(_arrange, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {frames}")


def _sha(chunks: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for c in chunks:
        h.update(c)
    return h.hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    for b in batches:
        out, back = [], []
        for o, form in zip(_frames(b, _OUT), b.column("form").to_pylist()):
            out.append(_sha(o.stream()))
            back.append(_sha(restored(o, form)))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out), pa.array(back)], [*keep, "output_sha256", "restored_sha256"])


def digests(made: DataFrame) -> DataFrame:
    """Digests of the outputs and of the texts that are rebuilt from them, frame by frame."""
    return made.mapInArrow(_digest, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = [(b"".join(o.stream()), b"".join(restored(o, form))) for o, form in zip(_frames(b, _OUT), b.column("form").to_pylist())]
        cols = [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("form"), *cols], ["doc_id", "form", "output", "restored"])


def texts(made: DataFrame) -> DataFrame:
    """``doc_id, form, output, restored``: outputs and rebuilt texts as strings."""
    rows = made.mapInArrow(_texts, "doc_id long, form string, output binary, restored binary")
    return rows.select("doc_id", "form", F.decode("output", "UTF-8").alias("output"), F.decode("restored", "UTF-8").alias("restored"))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """The outputs for every row of ``docs(doc_id, text)``, from a store of frames that is written first; see ``outputs``.

    ``rate`` percent of the documents are cut, ``spm`` percent of those begin with the suffix. A row depends on its own doc_id and text
    alone: repeated rows stay, repeated doc_ids have one draw, a null doc_id draws as an empty one. Null texts are empty and, like
    texts that hold a mark, stay plain. Other columns are ignored; no rows, no result. Texts of any length: Spark hands one over
    whole, after that a frame at a time is decompressed.
    """
    return outputs(planned(saved(frame_store(docs)), seed, rate, spm))
