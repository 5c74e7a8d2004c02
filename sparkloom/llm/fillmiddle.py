"""Fill-in-middle transformation over seekable compressed frames (operator 11).

A text is stored as independent zstandard frames of at most FRAME bytes, cut between characters, with the counts of units and
of characters that end before each frame (`archived`). A unit is a word with the white space before it; white space at
the end of a text is a unit of its own. To transform a text only the frames in which a cut lies are decompressed: the
cumulative counts tell which (`selected`); all others move to the output as they are, so the output, in its new order and
with its marks, is again a list of frames whose concatenation is one zstandard stream (`fill_in_middle`). Digests and
the rebuilt text come from streaming the ordered frames, so a task never holds more of a text than its compressed frames
and one open frame (`digests`).

Defined cases: null text counts as empty, and an empty text is plain; a null doc_id counts as an empty id when cuts are drawn and is
kept; repeated rows are rows of their own; an empty table gives an empty result; texts that hold a mark are plain; extra
columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, materialize, one_array, small_arrow_batches, texts_of

FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The order of parts in each form, each after its mark.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
ARCHIVE = "doc_id long, n long, n_chars long, marked boolean, units array<long>, chars array<long>, frames array<binary>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Places inside data where a unit ends: white space after something else."""
    space = white(data)
    return np.flatnonzero(space[1:] & ~space[:-1]) + 1


def n_chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def frame_starts(data: np.ndarray, most: int) -> list[int]:
    """Where frames of at most `most` bytes begin, never inside a character."""
    starts, at = [], 0
    while at < len(data):
        starts.append(at)
        at += most
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
    return starts


def archived(most: int, level: int):
    """An Arrow function: texts to rows of ARCHIVE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        for table in gathered(batches):
            texts = texts_of(table)
            marked = pc.match_substring(texts, PREFIX.decode())
            for mark in (SUFFIX, MIDDLE):
                marked = pc.or_(marked, pc.match_substring(texts, mark.decode()))
            bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
            bounds = bounds - bounds[0]
            ends = unit_ends(data)
            counts, letters, units, chars, frames = [], [], [], [], []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                body = data[low:high]
                starts = frame_starts(body, most)
                before, after = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left")
                counts.append(int(after - before) + (high > low))
                parts = [body[a:b] for a, b in zip(starts, [*starts[1:], len(body)])]
                sizes = np.cumsum([0, *map(n_chars, parts)])
                letters.append(int(sizes[-1]))
                chars.append(sizes[:-1])
                units.append(np.searchsorted(ends, np.array(starts, np.int64) + low, "right") - before if len(starts) > 1 else np.zeros(len(starts), np.int64))
                frames.append([packer.compress(memoryview(p)) for p in parts])
            yield pa.RecordBatch.from_arrays([
                one_array(table["doc_id"]), pa.array(counts, pa.int64()), pa.array(letters, pa.int64()), marked,
                pa.array(units, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int64())), pa.array(frames, pa.list_(pa.binary()))],
                ["doc_id", "n", "n_chars", "marked", "units", "chars", "frames"])

    return run


class Cut:
    """A place in a text's frames: frame, byte in it, characters before it, and the open frame's bytes (None at a frame's start)."""

    def __init__(self, frame: int, byte: int, chars: int, body: bytes | None):
        self.frame, self.byte, self.chars, self.body = frame, byte, chars, body


def selected(frames: list[bytes], units: np.ndarray, chars: np.ndarray, n: int, total: int, wanted: int, opener: zstandard.ZstdDecompressor) -> Cut:
    """The place after `wanted` units. Only the frame that holds it is decompressed."""
    if wanted <= 0:
        return Cut(0, 0, 0, None)
    if wanted >= n:
        return Cut(len(frames), 0, total, None)
    at = int(np.searchsorted(units, wanted, "left")) - 1
    body = opener.decompress(frames[at])
    data = np.frombuffer(body, np.uint8)
    ends, nth = unit_ends(data), wanted - int(units[at]) - 1
    if nth >= len(ends):  # the unit ends with its frame
        return Cut(at + 1, 0, int(chars[at + 1]), None)
    return Cut(at, int(ends[nth]), int(chars[at]) + n_chars(data[:ends[nth]]), body)


def between(frames: list[bytes], low: Cut, high: Cut, packer: zstandard.ZstdCompressor) -> list[bytes]:
    """The frames from one place to another; only what a cut opened is compressed anew."""
    if low.frame == high.frame:
        return [packer.compress(high.body[low.byte:high.byte])] if high.byte > low.byte else []
    head = [packer.compress(low.body[low.byte:])] if low.byte else frames[low.frame:low.frame + 1]
    return head + frames[low.frame + 1:high.frame] + ([packer.compress(high.body[:high.byte])] if high.byte else [])


def transformed(level: int):
    """An Arrow function: rows of ARCHIVE with form, low and high (units before the cuts) to rows of OUTPUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, opener = zstandard.ZstdCompressor(level=level, write_checksum=True), zstandard.ZstdDecompressor()
        marks = {m: packer.compress(m) for m in (PREFIX, SUFFIX, MIDDLE)}
        for table in gathered(batches):
            prefix, middle, out = [], [], []
            for r in table.select(["n", "n_chars", "form", "low", "high", "units", "chars", "frames"]).to_pylist():
                frames = r["frames"]
                if r["form"] == "plain":
                    prefix.append(None)
                    middle.append(None)
                    out.append(frames)
                    continue
                units, chars = np.array(r["units"]), np.array(r["chars"])
                first, second = (selected(frames, units, chars, r["n"], r["n_chars"], r[k], opener) for k in ("low", "high"))
                begin, end = Cut(0, 0, 0, None), Cut(len(frames), 0, r["n_chars"], None)
                parts = [between(frames, *pair, packer) for pair in ((begin, first), (first, second), (second, end))]
                prefix.append(first.chars)
                middle.append(second.chars - first.chars)
                out.append([f for mark, part in ORDERS[r["form"]] for f in (marks[mark], *parts[part])])
            yield pa.RecordBatch.from_arrays([
                one_array(table["doc_id"]), one_array(table["n"]), one_array(table["form"]).cast(pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array(out, pa.list_(pa.binary()))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"])

    return run


def text_order(frames: list[bytes], form: str, opener: zstandard.ZstdDecompressor) -> list[bytes]:
    """The frames of the text itself from the output's, by the output's marks and its form. No text frame can equal a mark, since texts that hold one are plain."""
    if form == "plain":
        return frames
    at = []
    for k, frame in enumerate(frames):
        if len(at) < 3 and zstandard.frame_content_size(frame) == 3 and opener.decompress(frame) == ORDERS[form][len(at)][0]:
            at.append(k)
    bounds = [*at, len(frames)]
    parts = {part: frames[bounds[k] + 1:bounds[k + 1]] for k, (_, part) in enumerate(ORDERS[form])}
    return [*parts[0], *parts[1], *parts[2]]


def streamed(frames: list[bytes], opener: zstandard.ZstdDecompressor) -> str:
    digest = hashlib.sha256()
    for frame in frames:
        digest.update(opener.decompress(frame))
    return digest.hexdigest()


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An Arrow function: rows of OUTPUT to rows of DIGESTS."""
    opener = zstandard.ZstdDecompressor()
    for table in gathered(batches):
        frames, forms = one_array(table["frames"]).to_pylist(), one_array(table["form"]).to_pylist()
        said = [streamed(f, opener) for f in frames]
        restored = [streamed(text_order(f, form, opener), opener) if f else s for f, form, s in zip(frames, forms, said)]
        yield pa.RecordBatch.from_arrays([
            *[one_array(table[c]) for c in ("doc_id", "n")], one_array(table["form"]).cast(pa.string()), *[one_array(table[c]) for c in ("prefix_chars", "middle_chars")],
            pa.array(said, pa.string()), pa.array(restored, pa.string())], DIGESTS.replace(" long", "").replace(" string", "").split(", "))


def drawn(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th number (from 1) drawn for a document: eight hexadecimal digits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def archive(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", frame_bytes: int = FRAME, level: int = 3) -> DataFrame:
    """Rows of ARCHIVE, one for each document, to be written and read by any number of transformations."""
    small_arrow_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(archived(frame_bytes, level), ARCHIVE)


def fill_in_middle(stored: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, level: int = 3) -> DataFrame:
    """Rows of OUTPUT for an archive. rate: per cent of the texts to transform; spm: per cent of these in suffix-first form."""
    small_arrow_batches(stored.sparkSession)
    h = [drawn(F.col("doc_id"), seed, k) for k in (1, 2, 3, 4)]
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    form = F.when((F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    return stored.withColumns({"form": form, "low": F.least(a, b), "high": F.greatest(a, b)}).mapInArrow(transformed(level), OUTPUT)


def digests(output: DataFrame) -> DataFrame:
    """SHA-256 of each output and of the text that its frames give back."""
    return output.mapInArrow(digested, DIGESTS)


def texts(output: DataFrame) -> DataFrame:
    """doc_id, form, output: the transformed texts themselves, for those who want them in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for table in gathered(batches, 1_000_000):
            whole = [b"".join(map(opener.decompress, f)).decode() for f in one_array(table["frames"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([one_array(table["doc_id"]), one_array(table["form"]).cast(pa.string()), pa.array(whole, pa.string())], ["doc_id", "form", "output"])

    return output.mapInArrow(run, "doc_id long, form string, output string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(archive(spark.read.parquet(f"{sf_dir}/documents.parquet")), "frames")
    return digests(fill_in_middle(stored))


OP11_SQL = """
WITH units AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
         WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
