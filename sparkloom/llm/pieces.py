"""SentencePiece encoding that keeps the source bytes of every piece, and decoding (operator 12).

A text is first normalised by longest-prefix matches in the model's compiled character map (a double-array trie), with
the dummy prefix and the white-space marks that the model asks for. For every byte of the result, and one past it, the
place in the source that it comes from is recorded. The normalised text is then segmented by a copy of the model that normalises nothing, and
each piece is projected through the recorded places to the bytes of the source from which it comes, so a caller can
label, cut or mask the source by piece. A model without a character map, as the public one, is handled for whole batches
at once; with a map, text by text.

If no piece holds a mark after another letter, no merge crosses the start of a run of marks, so normalised texts are cut
there, and each distinct unit of a batch is segmented once (a bounded table keeps units from batch to batch). Other models
get whole texts. User-defined symbols are refused, since they match before the character map does.

Defined cases: null text counts as empty; an empty text has no pieces but those for begin and end, whose spans are
empty; repeated rows and null ids are rows of their own; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, one_array, ranges, small_arrow_batches, texts_of
from .tokens import Encoder, listed, tokenizer_path

MARK = "▁".encode()
SPANS = "doc_id long, ids array<int>, begins array<int>, ends array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"
#: Ids that are decoded at a time.
DECODED_IDS = 1 << 19


class CharacterMap:
    """A compiled character map: a double-array trie over source bytes whose leaves point at normalised strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units, self.strings = np.frombuffer(blob[4:4 + size], "<u4").tolist(), blob[4 + size:]
        self.cached: dict[int, bytes] = {}

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes taken) of the longest entry that text has at a place."""
        found, node = None, self.step(0, self.units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != text[k]:
                break
            node = self.step(node, unit)
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, k - at + 1
        return found and (self.string(found[0]), found[1])

    @staticmethod
    def step(node: int, unit: int) -> int:
        return node ^ unit >> 10 << ((unit & 1 << 9) >> 6)

    def string(self, at: int) -> bytes:
        if at not in self.cached:
            self.cached[at] = self.strings[at:self.strings.index(b"\0", at)]
        return self.cached[at]


def char_starts(data: np.ndarray) -> np.ndarray:
    """For each byte the place where its character begins."""
    return np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)


class PieceEncoder(Encoder):
    """The worker process's encoder for one model."""

    def __init__(self, path: str, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if proto is None:
            with open(path, "rb") as file:
                proto = file.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        if any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = model.normalizer_spec
        self.map, self.prefix, self.squeeze, self.escape = CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        whole = [p.piece.encode() for p in model.pieces]
        inner = re.compile(b"(?<!" + MARK + b")(?<!^)" + MARK).search
        self.cuts = self.escape and not self.suffix and model.trainer_spec.model_type == model.trainer_spec.BPE and not any(
            inner(p.piece.encode()) for p in model.pieces if p.type in (p.NORMAL, p.UNUSED)) and MARK in whole
        self.byte_wide = np.array([p.type == p.BYTE for p in model.pieces])
        self.widths = np.where(self.byte_wide, 1, np.fromiter(map(len, whole), np.int64, len(whole)))
        self.unknown, self.begin, self.end = self.processor.unk_id(), self.processor.bos_id(), self.processor.eos_id()
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        spec.name, model.trainer_spec.treat_whitespace_as_suffix = "identity", False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.hashes, self.starts, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def kept(path: str, spaces: bool = True) -> PieceEncoder:
        """The worker process's encoder for this file; it outlives a task."""
        state = sys.modules.setdefault("_sparkloom_worker", types.ModuleType("_sparkloom_worker"))
        held = vars(state).setdefault("pieces", {})
        if path not in held:
            held[path] = PieceEncoder(path)
        return held[path]

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each normalised unit, all ids)."""
        found = self.bare.encode(pieces, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return counts, np.concatenate([np.array(x, np.uint32) for x in found]) if found else np.zeros(0, np.uint32)

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(the normalised text, the source place of each of its bytes and of its end)."""
        out, places, at = bytearray(), [], 0
        mark = MARK if self.escape else b" "

        def next_part(at: int) -> tuple[bytes, int]:
            found = self.map.longest(text, at) if self.map else None
            if found:
                return found
            wide = 1 + sum(text[at] >= x for x in (0xC0, 0xE0, 0xF0))
            return text[at:at + wide], wide

        if self.squeeze:
            while at < len(text) and (part := next_part(at))[0] == b" ":
                at += part[1]
        if at >= len(text):
            return b"", np.array([at])
        if self.prefix and not self.suffix:
            out += mark
            places += [at] * len(mark)
        spaced = self.squeeze
        while at < len(text):
            part, wide = next_part(at)
            while spaced and part.startswith(b" "):
                part = part[1:]
            if part:
                part = part.replace(b" ", mark)
                out += part
                places += [at] * len(part)
                spaced = self.squeeze and part.endswith(mark)
            at += wide
        if self.squeeze:
            while out.endswith(mark):
                at = places[len(out) - len(mark)]
                del out[-len(mark):], places[len(out):]
        if self.prefix and self.suffix:
            out += mark
            places += [at] * len(mark)
        return bytes(out), np.array([*places, at])

    def normalised_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all normalised texts, bounds of the texts in them, source place in its text of each byte, and of each text's end)."""
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        if self.map or self.squeeze or self.suffix or not self.escape:
            each = [self.normalised(data[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            whole = np.frombuffer(b"".join(x for x, _ in each), np.uint8)
            return whole, np.cumsum([0, *(len(x) for x, _ in each)]), np.concatenate([np.zeros(0, np.int64), *(p[:-1] for _, p in each)]).astype(np.int64), np.array([p[-1] for _, p in each], np.int64)
        space = data == 32
        wide = np.where(space, 3, 1)
        if self.prefix:
            first = bounds[:-1][bounds[1:] > bounds[:-1]]
            wide[first] += 3
        ends = np.concatenate([[0], np.cumsum(wide)])
        origin = char_starts(data) - np.repeat(bounds[:-1], np.diff(bounds))
        out, places = np.repeat(np.where(space, MARK[0], data), wide).astype(np.uint8), np.repeat(origin, wide)
        last = ends[1:] - 1
        out[last[space] - 1], out[last[space]] = MARK[1], MARK[2]
        if self.prefix:
            for k, byte in enumerate(MARK):
                out[ends[first] + k] = byte
            # A space right after the dummy prefix has its own three bytes behind it.
            for k, byte in enumerate(MARK):
                out[(ends[first] + 3 + k)[space[first]]] = byte
        return out, ends[bounds], places, np.diff(bounds)

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each text, ids, begin and end of each id's source bytes in its text, bounds of units in the ids)."""
        data, bounds, places, tails = self.normalised_batch(texts)
        if self.cuts:
            head = (data == MARK[0]) & (np.append(data[1:], 0) == MARK[1]) & (np.append(data[2:], [0, 0])[:len(data)] == MARK[2])
            head = np.flatnonzero(head)
            fresh = np.concatenate([[True], np.diff(head) != 3]) if len(head) else np.zeros(0, bool)
            begins = np.union1d(head[fresh], bounds[:-1])
            begins = begins[begins < len(data)]
        else:
            begins = np.unique(bounds[:-1][bounds[1:] > bounds[:-1]])
        offsets = np.append(begins, len(data))
        units = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        starts, lengths = self.places(listed(coded.dictionary))
        codes = coded.indices.to_numpy().astype(np.int64)
        ids = self.ids[ranges(starts[codes], lengths[codes])]
        unit_bounds = np.concatenate([[0], np.cumsum(lengths[codes])])
        counts = np.diff(unit_bounds[np.searchsorted(begins, bounds)])
        stops = self.piece_stops(ids, data, unit_bounds, offsets)
        froms = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
        last = np.append(places, 0)
        at_end = stops == np.repeat(bounds[1:], counts)
        return counts, ids, last[froms], np.where(at_end, np.repeat(tails, counts), last[np.minimum(stops, len(places))]), unit_bounds

    def piece_stops(self, ids: np.ndarray, data: np.ndarray, unit_bounds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where each piece ends in the normalised bytes. The width of a piece is known but for unknown ones, which take what their unit leaves them."""
        unknown = np.flatnonzero(ids == self.unknown)
        widths = self.widths[ids]
        for unit in np.unique(np.searchsorted(unit_bounds, unknown, "right") - 1).tolist():
            low, high = unit_bounds[unit], unit_bounds[unit + 1]
            found = self.bare.encode(data[offsets[unit]:offsets[unit + 1]].tobytes().decode(), return_type="proto").pieces
            widths[low:high] = [len(p.surface.encode()) for p in found]
        return np.cumsum(widths)

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[str]:
        """The text of one document's ids, in parts that begin where units do (bounds), so that no list of ids is long."""
        low = 0
        while low < len(ids) or not low:
            high = len(ids)
            if high - low > DECODED_IDS:
                k = int(np.searchsorted(bounds, low + DECODED_IDS, "right")) - 1
                high = int(bounds[k]) if k >= 0 and bounds[k] > low else int(bounds[k + 1])
            part = ids[low:high].tolist()
            # A part after the first keeps its leading white space behind a piece that is cut off again.
            yield self.processor.decode(part) if not low else self.processor.decode([self.anchor, *part])[1:]
            low = high
            if not len(ids):
                return

    @property
    def anchor(self) -> int:
        return next(i for i in range(self.processor.get_piece_size()) if self.processor.id_to_piece(i) == "a")


def encoded_tables(path: str, batches: Iterator[pa.RecordBatch], limit: int):
    """(encoder, table, counts, ids, begins, ends, bounds of units) of each table of texts."""
    encoder = PieceEncoder.kept(path)
    for table in gathered(batches, limit):
        yield encoder, table, *encoder.spans(texts_of(table))


def spanned(path: str, limit: int = 4_000_000):
    """An Arrow function: texts to rows of SPANS, without the ids for begin and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table, counts, ids, begins, ends, _ in encoded_tables(path, batches, limit):
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([one_array(table["doc_id"]), *[
                pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, begins, ends)]], ["doc_id", "ids", "begins", "ends"])

    return run


def digested(path: str, limit: int = 8_000_000):
    """An Arrow function: texts to rows of DIGESTS, with the ids for begin and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for encoder, table, counts, ids, begins, ends, bounds in encoded_tables(path, batches, limit):
            stops = np.cumsum(counts)
            covered = np.concatenate([[0], np.cumsum(ends - begins)])
            said, back = [], []
            for low, high in zip((stops - counts).tolist(), stops.tolist()):
                own = ids[low:high]
                both = np.concatenate([[encoder.begin], own, [encoder.end]]).astype("<u4")
                said.append(hashlib.sha256(both).hexdigest())
                digest = hashlib.sha256()
                near = bounds[np.searchsorted(bounds, low):np.searchsorted(bounds, high, "right")] - low + 1 if high - low > DECODED_IDS else bounds[:0]
                for part in encoder.decoded(both, near):
                    digest.update(part.encode())
                back.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([
                one_array(table["doc_id"]), pa.array(counts + 2, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string()),
                pa.array(covered[stops] - covered[stops - counts], pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"])

    return run


def columns(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    small_arrow_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, model: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids, begins, ends: every piece of every text with the bytes of the source that it comes from (of a character spelled in bytes, the last byte's piece has them)."""
    return columns(docs, text, doc_id).mapInArrow(spanned(model or tokenizer_path("piece_bpe_32k.model")), SPANS)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text: the library's decoding of each row's ids."""
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.kept(path)
        for table in gathered(batches, 1_000_000):
            back = encoder.processor.decode(one_array(table["ids"]).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([one_array(table["doc_id"]), pa.array(back, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return columns(docs, "text", "doc_id").mapInArrow(digested(tokenizer_path("piece_bpe_32k.model")), DIGESTS)
