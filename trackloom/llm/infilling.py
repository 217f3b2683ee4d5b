"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames with an index: how many units and characters lie
before each frame, and where its bytes end. Units are runs of ASCII letters and single other
characters. A cut after some unit is found from the index and one decompressed frame, whatever the
length of the text. Digests, outputs and texts rebuilt from outputs stream the frames in order, a
frame at a time, so only compressed frames of a text are ever held besides the row itself.

A frame covers a fixed number of code points and may end inside a run of letters: a unit counts in
the frame where it begins.

Null texts count as empty; an empty text has one empty frame and its form is plain. A null document
id counts as no digits in the hashed seed. Repeated rows come back as often as they come in. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import bounded_batches, stored

#: Code points of one frame.
FRAME_CHARS = 65_536
LEVEL = 3
# The marks of the three parts, and in per cent the texts left alone and those in suffix-first form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
KEPT_PERCENT, SPM_PERCENT = 10, 20
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}

Batches = Iterator[pa.RecordBatch]
CONTAINER = "frames binary, ends array<long>, units array<long>, chars array<long>, joined array<boolean>"


def unit_starts(codes: np.ndarray, inside: bool) -> np.ndarray:
    """Whether a unit begins at each code point; ``inside`` says that a letter stands right before."""
    letter = (codes | np.uint32(32)) - np.uint32(97) < np.uint32(26)
    before = np.empty_like(letter)
    before[:1] = inside
    before[1:] = letter[:-1]
    return ~(letter & before)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Container:
    """The frames of one text: their bytes on end, and cumulative ends, units and characters after each."""

    data: bytes
    ends: list[int]
    units: list[int]
    chars: list[int]
    joined: list[bool]

    @classmethod
    def of(cls, text: str, frame_chars: int = FRAME_CHARS) -> Container:
        """Compress a text frame by frame."""
        packer = zstandard.ZstdCompressor(level=LEVEL)
        out, ends, units, chars, joined = bytearray(), [], [], [], []
        inside, total = False, 0
        for at in range(0, max(len(text), 1), frame_chars):
            piece = text[at : at + frame_chars]
            total += int(unit_starts(code_points(piece), inside).sum())
            out += packer.compress(piece.encode("utf-8", "surrogatepass"))
            ends.append(len(out))
            units.append(total)
            chars.append(at + len(piece))
            joined.append(inside)
            inside = piece[-1:].isascii() and piece[-1:].isalpha()
        return cls(bytes(out), ends, units, chars, joined)

    def frame(self, number: int) -> str:
        """The text of one frame; no other frame is touched."""
        begin = self.ends[number - 1] if number else 0
        return zstandard.ZstdDecompressor().decompress(self.data[begin : self.ends[number]]).decode("utf-8", "surrogatepass")

    def place(self, count: int) -> int:
        """How many characters the first ``count`` units hold."""
        if count >= self.units[-1]:
            return self.chars[-1]
        number = int(np.searchsorted(self.units, count, side="right"))
        starts = np.flatnonzero(unit_starts(code_points(self.frame(number)), self.joined[number]))
        before = self.units[number - 1] if number else 0
        return (self.chars[number - 1] if number else 0) + int(starts[count - before])

    def stream(self, begin: int, end: int) -> Iterator[str]:
        """The characters from ``begin`` to ``end``, a frame at a time."""
        number = int(np.searchsorted(self.chars, begin, side="right"))
        while begin < end:
            first = self.chars[number - 1] if number else 0
            piece = self.frame(number)[begin - first : end - first]
            yield piece
            begin += len(piece)
            number += 1


def emit(container: Container, form: str, cuts: tuple[int, int]) -> Iterator[str]:
    """The output of a text in pieces; ``cuts`` are the ends of prefix and middle in characters."""
    if form == "plain":
        yield from container.stream(0, container.chars[-1])
        return
    parts = ((0, cuts[0]), (cuts[0], cuts[1]), (cuts[1], container.chars[-1]))
    for mark, part in ORDERS[form]:
        yield mark
        yield from container.stream(*parts[part])


def split_parts(pieces: Iterable[str], form: str) -> Iterator[tuple[int, str]]:
    """Pairs (part, text) of an output that comes in pieces; part 0 is the prefix, 1 the middle, 2 the suffix.

    Only the output and its form are used: the marks are looked for in the order of the form, also
    where one lies across two pieces.
    """
    marks, part, held = list(ORDERS[form]), None, ""
    for piece in pieces:
        held += piece
        while marks:
            mark, following = marks[0]
            at = held.find(mark)
            if at < 0:
                keep = len(mark) - 1
                if part is not None and len(held) > keep:
                    yield part, held[:-keep]
                    held = held[-keep:]
                break
            if part is not None and at:
                yield part, held[:at]
            held, part = held[at + len(mark) :], following
            marks.pop(0)
        if not marks and held:
            yield part, held
            held = ""
    if marks:
        raise ValueError(f"an output of form {form} lacks {marks[0][0]}")


def rebuild(pieces: Iterable[str], form: str) -> Iterator[str]:
    """The text of an output, in pieces. Parts that come too early wait as compressed frames."""
    if form == "plain":
        yield from pieces
        return
    waiting: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
    turn = 0
    packer, opener = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

    def release(part: int) -> Iterator[str]:
        for frame in waiting.pop(part):
            yield opener.decompress(frame).decode("utf-8", "surrogatepass")

    arrived = [part for _, part in ORDERS[form]]
    for part, text in split_parts(pieces, form):
        # every part whose own turn has come and that lies behind in the output is complete
        while turn != part and turn in arrived and arrived.index(turn) < arrived.index(part):
            yield from release(turn)
            turn += 1
        if part == turn:
            yield from release(part)
            waiting[part] = []
            yield text
        else:
            waiting[part].append(packer.compress(text.encode("utf-8", "surrogatepass")))
    for part in range(turn, 3):
        yield from release(part)


@dataclass
class Digest:
    """A digest of text that comes in pieces."""

    state: hashlib._Hash = field(default_factory=hashlib.sha256)

    def of(self, pieces: Iterable[str]) -> str:
        for piece in pieces:
            self.state.update(piece.encode("utf-8", "surrogatepass"))
        return self.state.hexdigest()


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def store_frames(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", frame_chars: int = FRAME_CHARS) -> DataFrame:
    """Write every text as a container ``(doc_id, n, marked, frames, ends, units, chars, joined)``.

    ``marked`` says that the text holds one of the three marks itself. The table lies in the shared
    folder; frames are compressed already, so the files are not compressed again.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            marked, made = [], []
            for text in _texts(batch.column(1)):
                marked.append(PREFIX in text or SUFFIX in text or MIDDLE in text)
                made.append(Container.of(text, frame_chars))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([c.units[-1] for c in made], pa.int64()), pa.array(marked, pa.bool_()),
                pa.array([c.data for c in made], pa.binary()), *(
                    pa.array([getattr(c, name) for c in made], pa.list_(pa.int64())) for name in ("ends", "units", "chars")
                ), pa.array([c.joined for c in made], pa.list_(pa.bool_())),
            ], ["doc_id", "n", "marked", "frames", "ends", "units", "chars", "joined"])

    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    with bounded_batches(docs.sparkSession):
        return stored(rows.mapInArrow(run, f"doc_id {kind}, n long, marked boolean, {CONTAINER}"))


def choose_forms(frames: DataFrame) -> DataFrame:
    """Add the form and the numbers of units before the two cuts, both from a hash of the document id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    cuts: list[Column] = [h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)]
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= 100 - KEPT_PERCENT)
    return frames.withColumns({
        "form": F.when(plain, "plain").when(h[3] % 100 < SPM_PERCENT, "spm").otherwise("psm"),
        "first_units": F.least(*cuts), "last_units": F.greatest(*cuts),
    })


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[Container, str, tuple[int, int]]]:
    """Container, form and cuts in characters of every row; only frames that hold a cut are opened."""
    column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        at = {name: column[name][i].as_py() for name in column if name != "doc_id"}
        container = Container(*(at[name] for name in ("frames", "ends", "units", "chars", "joined")))
        form = at["form"]
        cuts = (0, 0) if form == "plain" else (container.place(at["first_units"]), container.place(at["last_units"]))
        yield container, form, cuts


def _mapped(frames: DataFrame, run, schema: str) -> DataFrame:
    kind = dict(frames.dtypes)["doc_id"]
    columns = ["doc_id", "n", "form", "first_units", "last_units", "frames", "ends", "units", "chars", "joined"]
    with bounded_batches(frames.sparkSession):
        return stored(choose_forms(frames).select(*columns).mapInArrow(run, f"doc_id {kind}, {schema}"))


def outputs(frames: DataFrame) -> DataFrame:
    """The transformed texts: ``(doc_id, form, output)``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = ["".join(emit(*row)) for row in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], ["doc_id", "form", "output"])

    return _mapped(frames, run, "form string, output string")


def restore(transformed: DataFrame) -> DataFrame:
    """The texts of outputs: ``(doc_id, form, output)`` gives ``(doc_id, text)``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = ["".join(rebuild([output], form)) for form, output in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(transformed.dtypes)["doc_id"]
    with bounded_batches(transformed.sparkSession):
        return stored(transformed.select("doc_id", "form", "output").mapInArrow(run, f"doc_id {kind}, text string"))


def digests(frames: DataFrame) -> DataFrame:
    """Form, lengths, and digests of each output and of the text rebuilt from it, without holding either."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for container, form, cuts in _rows(batch):
                lengths = (None, None) if form == "plain" else (cuts[0], cuts[1] - cuts[0])
                rows.append((*lengths, Digest().of(emit(container, form, cuts)), Digest().of(rebuild(emit(container, form, cuts), form))))
            prefix, middle, output, restored = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array(output, pa.string()), pa.array(restored, pa.string()),
            ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return _mapped(frames, run, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
