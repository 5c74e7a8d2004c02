"""Language-model scores by online logistic context mixing (operator 7).

A text is its words (A-Z lower-cased) and one end. The next token is predicted by four experts: what followed the two words
before it in all training documents (order 2, hashed contexts); what followed the last word earlier in the same text; the
words of the text so far; and the words of the corpus, by class of documents (`class_column`, read for training counts only),
where a document finds its class as it goes and words that no training document holds are spelled. Whether to take an expert
is a bit. Several hashed contexts predict it - how often the expert's context was seen and whether it held the last three
tokens, the frequencies of the last two words, the place in the text and what the other experts held - and a logistic mixer
combines their predictions with weights chosen by a gate. Tables and weights are refined online over all training texts, each
text predicted without its own counts, in parallel and averaged.

A word is spelled byte by byte with a closing byte, in the bits of a Huffman code of bytes; each bit is predicted from six
hashed contexts (the last 1 to 5 bytes of the word, and the whole word so far), whose bit counts are gathered from all
distinct training words and mixed in the same way. All bits sum up to the log10 probability of the text and, without the text's own counts, to bits per byte.

On Spark: tasks turn documents into chunks of about `chunk_bytes` of text, and these into one row of token codes and into
requests, one row for each chunk and bucket of hashes, with the chunk's distinct words or, from its codes, contexts. A bucket counts its words (the
vocabulary) and contexts and answers every chunk; buckets grow in number with the text, so that each holds about as much as
a chunk. Chunks with their answers are written once, learned from and scored. A chunk whose answers do not fit it is an error. Counts of words and contexts thus grow with the
corpus and never leave the executors; the mixers' tables have a fixed size, and only they and a row of totals reach the driver.

Defined cases: null or empty text is just the end; null doc_id belongs to the fold of the empty string; repeated rows
are scored (and counted) each; without training documents N and V are 0 and every word is spelled with even bits; an
empty table gives an empty result; extra columns are not carried. Contexts are told apart by 44 bits of a hash, the
followers of one context by 24.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, drop_materialized, gathered, materialize, one_array, small_arrow_batches, texts_of, word_codes
from .tokens import with_end

ORDERS, SLOT_BITS, PIECE = (1, 2, 3, 4, 5, "word"), 18, 1 << 13
GATES, PRIOR = 6 * 3 * 4, 0.4
#: What each known word of a class gives up for words that the class has not seen.
DISCOUNT = 0.75
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words that are spelled at once; bytes of a task's inputs that stay for further rounds.
BATCH, HELD_INPUTS = 2000, 80_000_000
#: Bits of words that are counted at once.
COUNTED_BITS = 1_000_000
#: Bits of a context's hash and of a follower's; how many of the latter sort a chunk's requests.
CONTEXT_BITS, FOLLOWER_BITS, SORTED_BITS = 44, 24, 20
#: Hashes of what stands before a text and of its end.
BEFORE, END = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
#: Experts besides the corpus' words: order 2, the text's own order 1, the text's words. For each, the sizes of its three tables.
EXPERTS, TABLES, EXPERT_GATES = 3, (16 * 8, 16 * 16 * 16, 16 * 8 * 8), 16
INPUTS = len(TABLES) + 1
CHUNKS = "chunk long, doc_ids array<long>, train array<boolean>, classes array<int>, sizes array<long>, blobs array<binary>"
REQUESTS = "chunk long, bucket int, blobs array<binary>"


def byte_codes(frequencies: dict[int, int]) -> np.ndarray:
    """(length, code) of a Huffman code for each byte value; every value gets one (unseen ones count once)."""
    import heapq

    heap = [(16 * int(frequencies.get(b, 0)) + 1, b, (b,)) for b in range(256)]
    heapq.heapify(heap)
    lengths, codes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    while len(heap) > 1:
        (n, i, left), (m, j, right) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in ((0, left), (1, right)):
            for b in side:
                codes[b] |= bit << lengths[b]
                lengths[b] += 1
        heapq.heappush(heap, (n + m, min(i, j), left + right))
    return np.stack([lengths, codes])


def letters_of(words: pa.Array) -> np.ndarray:
    """The bytes of binary values, none of them null, one after another."""
    _, ends, letters = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return np.frombuffer(letters, np.uint8)[ends[0]:ends[-1]] if letters else np.zeros(0, np.uint8)


def spelled(words: pa.Array, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots of each context for each bit: contexts x bits, the bits, place of each bit's byte in its word, bits per word)."""
    words = words.cast(pa.binary())
    lengths = pc.binary_length(words).to_numpy().astype(np.int64) + 1
    ends = np.cumsum(lengths)
    text = np.full(int(ends[-1]), 32, np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = letters_of(words)
    place = np.arange(len(text)) - np.repeat(ends - lengths, lengths)
    shifted = text.astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.full(int(lengths.max()) + 1, MIX | np.uint64(1), np.uint64))
    running = np.cumsum(shifted * power[place], dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], running[:-1]])
    prefix = before - np.repeat(before[ends - lengths], lengths)
    size = code[0][text]
    owner, bit = np.repeat(np.arange(len(text)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    rest = code[1][text][owner] >> (size[owner] - bit)
    node = ((np.int64(1) << bit) | rest).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    bits = code[1][text][owner] >> (size[owner] - bit - 1) & 1
    slots = np.empty((len(ORDERS), len(node)), np.int32)
    for k, order in enumerate(ORDERS):
        h = np.full(len(text), 0x1000 + k, np.uint64)
        if order == "word":
            h += prefix * np.uint64(0xC2B2AE3D27D4EB4F)
        else:
            for back in range(1, order + 1):
                last = np.zeros(len(text), np.uint64)
                last[back:] = shifted[:-back]
                last[place < back] = 0
                h = (h ^ last) * MIX
                h ^= h >> np.uint64(29)
        x = np.take(h, owner)
        x ^= node
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        x *= MIX
        x >>= np.uint64(64 - SLOT_BITS)
        slots[k] = x
    per_word = np.add.reduceat(size, ends - lengths)
    return slots, bits, np.minimum(place, 3)[owner], per_word


def gather_counts(code: np.ndarray):
    """A mapInArrow function: the task's counts of zeros and ones per slot, in pieces of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, size = np.zeros((len(ORDERS), 2 << SLOT_BITS), np.int64), [], 0

        def add() -> None:
            if held:
                for k in range(len(ORDERS)):
                    tables[k] += np.bincount(np.concatenate([x[k] for x in held]), minlength=2 << SLOT_BITS)

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                slots, bits, _, _ = spelled(batch.column(0).slice(at, BATCH), code)
                slots *= 2
                slots += bits.astype(np.int32)
                held.append(slots)
                size += len(bits)
                if size >= COUNTED_BITS:
                    add()
                    held, size = [], 0
        add()
        pieces = tables.reshape(-1, PIECE)
        used = np.flatnonzero(pieces.any(axis=1))
        for at in range(0, len(used), 64):
            some = used[at:at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pieces[i].tobytes() for i in some], pa.binary())], ["piece", "counts"])

    return run


def add_pieces(table: pa.Table) -> pa.Table:
    total = np.zeros(PIECE, np.int64)
    for x in table["counts"].to_pylist():
        total += np.frombuffer(x, np.int64)
    return pa.table({"piece": pa.array([table["piece"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def bucket(n: np.ndarray, bounds: list[int]) -> np.ndarray:
    return np.searchsorted(np.array(bounds), n, "right")


class Seen:
    """What tables of counts predict in each slot, with all they have seen or, with `alone`, for each bit without one occurrence of it."""

    def __init__(self, tables: np.ndarray, alone: bool):
        zeros, ones = tables[:, ::2].astype(np.float32), tables[:, 1::2].astype(np.float32)
        if alone:
            zeros, ones = (np.stack(x, axis=2).reshape(len(tables), -1) for x in ((np.maximum(zeros - 1, 0), zeros), (ones, np.maximum(ones - 1, 0))))
        self.alone, self.stretched = alone, np.log((ones + PRIOR) / (zeros + PRIOR))
        self.gates = [(bucket(zeros[-1] + ones[-1], [1, 3, 9, 65, 513]) * 12).astype(np.uint8), (bucket(zeros[-2] + ones[-2], [1, 5]) * 4).astype(np.uint8)]

    def inputs(self, slots: np.ndarray, bits: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretched predictions: 7 x bits, gate of each bit)."""
        out = np.empty((len(ORDERS) + 1, slots.shape[1]), np.float32)
        out[-1] = 0.3
        gate = place.copy()
        for k in range(len(ORDERS)):
            at = slots[k] * np.int64(2) + bits if self.alone else slots[k].astype(np.int64)
            np.take(self.stretched[k], at, out=out[k], mode="clip")
            if k >= len(ORDERS) - 2:
                gate += self.gates[len(ORDERS) - 1 - k][at]
        return out, gate


def mixed(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    z, w = np.zeros(len(gate), np.float32), weights.astype(np.float32)
    for k in range(len(x)):
        z += w[:, k][gate] * x[k]
    return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6, 1 - 1e-6)


def refine(tables: np.ndarray, start: np.ndarray, code: np.ndarray, rounds: int = 60):
    """A mapInArrow function: weights after online steps over the task's words, and how much each gate was used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, used, steps, first, held = start.copy(), np.zeros(GATES), 0, [], 0
        mass, known = np.zeros(GATES), Seen(tables, True)

        def inputs(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            slots, bits, place, _ = spelled(words, code)
            return *known.inputs(slots, bits, place), bits

        def learn(x: np.ndarray, gate: np.ndarray, bits: np.ndarray) -> None:
            nonlocal steps
            error = bits - mixed(weights, x, gate)
            total = np.bincount(gate, minlength=GATES)
            rate = 0.4 / (1 + steps / 100)
            for k in range(len(x)):
                weights[:, k] += rate * np.bincount(gate, error * x[k], GATES) / np.maximum(total, 50.0)
            mass[:] += total
            steps += 1

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.column(0).slice(at, BATCH)
                x, gate, bits = inputs(part)
                learn(x, gate, bits)
                if len(first) < 20:
                    # Inputs stay, for they do not change; those of very long words are made anew.
                    held += x.nbytes
                    first.append((x, gate.astype(np.int16), bits.astype(bool)) if held <= HELD_INPUTS else part)
        while first and steps < rounds and len(first) * 10 > steps:
            part = first[steps % len(first)]
            x, gate, bits = part if isinstance(part, tuple) else inputs(part)
            learn(x, gate, bits.astype(np.int64))
        used[:] = mass
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([used.tobytes()], pa.binary())], ["weights", "used"])

    return run


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    if not values.size:
        return b""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    planes = np.empty(raw.shape[::-1], np.uint8)
    for k in range(len(planes)):
        planes[k] = raw[:, k]
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpacked(blob: bytes, kind) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    raw = np.empty(planes.shape[::-1], np.uint8)
    for k in range(len(planes)):
        raw[:, k] = planes[k]
    return raw.reshape(-1).view(kind)


def packed_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers by their steps."""
    return packed(np.diff(values, prepend=values.dtype.type(0))) if len(values) else b""


def unpacked_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64)


def packed_words(words: pa.Array) -> tuple[bytes, bytes]:
    """(lengths, letters) of words."""
    words = words.cast(pa.binary())
    return packed(pc.binary_length(words).to_numpy().astype(np.uint32)), zstandard.ZstdCompressor(level=1).compress(b"".join(words.to_numpy(zero_copy_only=False).tolist()))


def unpacked_words(lengths: bytes, letters: bytes) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(unpacked(lengths, np.uint32))]).astype(np.int32)
    raw = zstandard.ZstdDecompressor().decompress(letters) if letters else b""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shifted(values: np.ndarray, by: int, pos: np.ndarray, before) -> np.ndarray:
    """What stands `by` tokens earlier in the same text; `before` where nothing does."""
    out = np.full(len(values), before, values.dtype)
    out[by:] = values[:-by] if by else values
    out[pos < by] = before
    return out


def places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in it) of each token."""
    starts = np.cumsum(lengths) - lengths
    return np.repeat(np.arange(len(lengths)), lengths), np.arange(int(lengths.sum())) - np.repeat(starts, lengths)


def context_keys(tokens: np.ndarray, pos: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of context and follower, follower's hash) of each token; hashes by code, the end last."""
    h = hashes[tokens]
    one, two = shifted(h, 1, pos, BEFORE), shifted(h, 2, pos, BEFORE)
    context = scrambled(one * np.uint64(0x9E3779B97F4A7C15) + (two ^ (two >> np.uint64(23))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - CONTEXT_BITS)
    follower = h >> np.uint64(64 - FOLLOWER_BITS)
    return context << np.uint64(SORTED_BITS) | (follower & np.uint64((1 << SORTED_BITS) - 1)), follower


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, which of them each key is)."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=starts[1:])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(starts) - 1
    return ordered[starts], order[starts], inverse


def gathered_contexts(lengths: np.ndarray, tokens: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, the follower of each, the key of each token)."""
    keys, follower = context_keys(tokens, places(lengths)[1], np.append(hashes, END))
    keys, first, inverse = distinct(keys)
    return keys, follower[first], inverse


def coded(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(texts, tokens of each text, codes in the order of the words' hashes with the end last, hashes, words)."""
    texts = pc.ascii_lower(texts_of(table))
    offsets, codes, words = word_codes(texts)
    words = words.cast(pa.binary())
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(words))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    lengths, tokens = with_end(np.diff(offsets), rank[codes] if len(codes) else codes, len(hashes))
    return texts, lengths, tokens, hashes[order], words.take(pa.array(order))


def chunked(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """The task's documents in chunks; a chunk's number is that of the task and its place there."""
    yield from enumerate(gathered(batches, chunk_bytes), TaskContext.get().partitionId() << 24)


def chunk_rows(chunk_bytes: int):
    """A mapInArrow function: each chunk as one row of codes."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("classes", pa.list_(pa.int32())),
                        ("sizes", pa.list_(pa.int64())), ("blobs", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in chunked(batches, chunk_bytes):
            texts, lengths, tokens, hashes, _ = coded(table)
            kind = one_array(table["class"])
            # Frequent words first: their codes then take fewer bits.
            order = np.argsort(-np.bincount(tokens, minlength=len(hashes) + 1)[:-1], kind="stable")
            rank = np.append(order, len(order)).astype(np.uint32)
            rank[order] = np.arange(len(order))
            tokens, hashes = rank[tokens], hashes[order]
            yield pa.RecordBatch.from_pylist([{
                "chunk": chunk, "doc_ids": one_array(table["doc_id"]).to_pylist(), "train": pc.greater_equal(kind, 0).to_pylist(), "classes": kind.to_pylist(),
                "sizes": pc.binary_length(texts).to_pylist(), "blobs": [packed(lengths.astype(np.uint32)), packed(tokens), packed(hashes)]}], schema)

    return run


def slices(sorted_values: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Where each of 2^bits buckets, the first bits of numbers of so many bits, begins; and where the last ends."""
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    return np.concatenate([[0], np.searchsorted(sorted_values, bounds), [len(sorted_values)]])


def request_rows(rows: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
    chunk, bucket, blobs = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(blobs, pa.list_(pa.binary()))], ["chunk", "bucket", "blobs"])


def word_requests(classes: int, bits: int, chunk_bytes: int):
    """A mapInArrow function: each chunk's words (hashes, words, counts by class in training documents), a row for each bucket that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in chunked(batches, chunk_bytes):
            _, lengths, tokens, hashes, words = coded(table)
            kind = np.repeat(one_array(table["class"]).to_numpy().astype(np.int64), lengths)
            learned = (kind >= 0) & (tokens < len(hashes))
            counts = np.bincount(tokens[learned].astype(np.int64) * classes + kind[learned], minlength=len(hashes) * classes).astype(np.uint32).reshape(-1, classes)
            w = slices(hashes, 64, bits)
            yield request_rows([(chunk, b, [packed(hashes[x:y]), *packed_words(words.slice(x, y - x)), packed(counts[x:y].reshape(-1))])
                                for b, (x, y) in enumerate(zip(w[:-1], w[1:])) if y > x])

    return run


def context_requests(bits: int):
    """A mapInArrow function over chunks' rows: their hashes of words, and contexts with their followers and occurrences in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, tokens, hashes = coded_blobs(row["blobs"])
                keys, follower, inverse = gathered_contexts(lengths, tokens, hashes)
                times = np.bincount(inverse, np.repeat(np.array(row["train"], bool), lengths), len(keys)).astype(np.uint32)
                hashes, context, follower = np.sort(hashes), keys >> np.uint64(SORTED_BITS), follower.astype(np.uint32)
                w, c = slices(hashes, 64, bits), slices(context, CONTEXT_BITS, bits)
                yield request_rows([(row["chunk"], b, [packed_sorted(hashes[w[b]:w[b + 1]]), packed_sorted(context[c[b]:c[b + 1]]), *(packed(x[c[b]:c[b + 1]]) for x in (follower, times))])
                                    for b in range(1 << bits) if w[b + 1] > w[b] or c[b + 1] > c[b]])

    return run


def coded_blobs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, codes, hashes by code) of a chunk's row."""
    lengths, tokens, hashes = (unpacked(x, kind) for x, kind in zip(blobs, (np.uint32, np.uint32, np.uint64)))
    return lengths.astype(np.int64), tokens, hashes


def blobs_of(table: pa.Table) -> list[list[bytes]]:
    return table["blobs"].to_pylist()


def vocabulary(classes: int):
    """An applyInArrow function: a bucket's distinct words (hashes, words, counts by class)."""

    def run(table: pa.Table) -> pa.Table:
        asked = [x for x in blobs_of(table) if x[0]]
        hashes = np.concatenate([unpacked(x[0], np.uint64) for x in asked]) if asked else np.zeros(0, np.uint64)
        if not len(hashes):
            return pa.table({"bucket": pa.array([], pa.int32()), "blobs": pa.array([], pa.list_(pa.binary()))})
        hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        words = pa.concat_arrays([unpacked_words(x[1], x[2]).cast(pa.large_binary()) for x in asked]).take(pa.array(first))
        counts = np.concatenate([unpacked(x[3], np.uint32) for x in asked]).reshape(-1, classes)
        total = np.stack([np.bincount(inverse, counts[:, k], len(hashes)) for k in range(classes)], axis=1)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()),
                         "blobs": pa.array([[packed(hashes), *packed_words(words), packed(total.reshape(-1))]], pa.list_(pa.binary()))})

    return run


def known_words(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words, counts by class) of each bucket's words that training documents hold."""
    for batch in batches:
        for blobs in batch.column(batch.schema.get_field_index("blobs")).to_pylist():
            counts = unpacked(blobs[3], np.uint32).reshape(-1, classes)
            held = counts.any(axis=1)
            yield unpacked_words(blobs[1], blobs[2]).filter(pa.array(held)), counts[held]


def with_words(function, classes: int):
    """function, which maps batches of words, as one over rows of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(pa.RecordBatch.from_arrays([words], ["word"]) for words, _ in known_words(batches, classes) if len(words))

    return run


def vocabulary_sums(classes: int):
    """A mapInArrow function: (i, n) with i below 256 for letters, then distinct words, and occurrences and distinct words by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257 + 2 * classes, np.int64)
        for words, counts in known_words(batches, classes):
            total[:256] += np.bincount(np.frombuffer(b"".join(words.to_numpy(zero_copy_only=False).tolist()), np.uint8), minlength=256)
            total[256] += len(words)
            total[257:] += np.concatenate([counts.sum(axis=0, dtype=np.int64), (counts > 0).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "n"])

    return run


def costs(words: pa.Array, known: Seen, weights: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The log10 probability of spelling each word."""
    out = [np.zeros(0)]
    for at in range(0, len(words), BATCH):
        slots, bits, place, per_word = spelled(words.slice(at, BATCH), code)
        x, gate = known.inputs(slots, bits, place)
        p = mixed(weights, x, gate)
        out.append(np.add.reduceat(np.log10(np.where(bits == 1, p, 1 - p).astype(np.float64)), np.cumsum(per_word) - per_word))
    return np.concatenate(out)


def answers(classes: int, tables: np.ndarray, weights: np.ndarray, code: np.ndarray):
    """A cogroup function of a bucket's requests and vocabulary: for each chunk the counts by class and costs of its words, and
    for its contexts how often the follower and how often anything followed in training documents."""
    made: list[Seen] = []  # once a task

    def run(requests: pa.Table, words: pa.Table) -> pa.Table:
        asked, sizes = blobs_of(requests), []
        if len(words):
            (hashes, lengths, letters, counts), = blobs_of(words)
            hashes, counts = unpacked(hashes, np.uint64), unpacked(counts, np.uint32).reshape(-1, classes)
            if not made:
                made.append(Seen(tables, False))
            cost = costs(unpacked_words(lengths, letters), made[0], weights, code).astype(np.float32)
        context = [unpacked_sorted(x[1]) for x in asked]
        follower, times = (np.concatenate([unpacked(x[k], np.uint32) for x in asked]) if asked else np.zeros(0, np.uint32) for k in (2, 3))
        sizes = np.cumsum([0, *map(len, context)])
        context = np.concatenate(context) if asked else np.zeros(0, np.uint64)
        # A pair by 64 mixed bits of context and follower.
        pair, group = (distinct(x)[2] for x in (scrambled(context ^ scrambled(follower.astype(np.uint64))), context))
        c, n = (np.minimum(np.bincount(i, times)[i], 2**32 - 1).astype(np.uint32) if len(i) else np.zeros(0, np.uint32) for i in (pair, group))
        rows = []
        for k, x in enumerate(asked):
            at = np.searchsorted(hashes, unpacked_sorted(x[0])) if x[0] else np.zeros(0, np.int64)
            own = slice(sizes[k], sizes[k + 1])
            rows.append([packed(counts[at].reshape(-1)) if len(at) else b"", packed(cost[at]) if len(at) else b"", packed(c[own]), packed(n[own])])
        return pa.table({"chunk": one_array(requests["chunk"]) if asked else pa.array([], pa.int64()), "bucket": one_array(requests["bucket"]) if asked else pa.array([], pa.int32()),
                         "blobs": pa.array(rows, pa.list_(pa.binary()))})

    return run


def joined(chunks: pa.Table, found: pa.Table) -> pa.Table:
    """A cogroup function: a chunk with its answers (lengths, tokens, counts by class, costs, and each token's c and n)."""
    out = []
    rows = blobs_of(found)  # once: a chunk has as many rows of answers as there are buckets
    parts = [rows[i] for i in np.argsort(one_array(found["bucket"]).to_numpy()).tolist()] if len(found) else []
    for blobs in blobs_of(chunks):
        lengths, tokens, hashes = coded_blobs(blobs)
        keys, _, inverse = gathered_contexts(lengths, tokens, hashes)
        whole = lambda k, kind: np.concatenate([unpacked(x[k], kind) for x in parts] or [np.zeros(0, kind)])
        if len(whole(1, np.float32)) != len(hashes) or len(whole(2, np.uint32)) != len(keys):
            raise ValueError("a chunk and its answers differ")
        seen = [whole(k, np.uint32)[inverse] for k in (2, 3)]
        # Answers come in the order of the words' hashes.
        counts, cost, order = whole(0, np.uint32).reshape(len(hashes), -1) if len(hashes) else np.zeros((0, 1), np.uint32), whole(1, np.float32), np.argsort(hashes)
        by_code = [np.empty_like(counts), np.empty_like(cost)]
        by_code[0][order], by_code[1][order] = counts, cost
        out.append([blobs[0], blobs[1], packed(by_code[0].reshape(-1)), packed(by_code[1]), packed(seen[0]), packed(seen[1])])
    return chunks.set_column(chunks.schema.get_field_index("blobs"), "blobs", pa.array(out, pa.list_(pa.binary())))


def earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many equal keys stand before each key, and how many there are in all; keys are told apart by what a sort word leaves."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(max(1, len(keys).bit_length()))
    words = np.sort((scrambled(keys) >> bits << bits) | np.arange(len(keys), dtype=np.uint64))
    key, at = words >> bits, (words & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    rank, total = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    rank[at] = np.arange(len(keys)) - np.repeat(starts, sizes)
    total[at] = np.repeat(sizes, sizes)
    return rank, total


#: Natural log of shares, relative to the largest, that a sum of some classes in double precision does not show.
FAINT = -42.0
#: The levels of the counts 0 to 181, and how far from its start a place lies, from 0 to 127.
LEVELS, FAR = np.minimum(np.log2(np.arange(182) + 1.0) * 2, 15).astype(np.int64), np.minimum(np.log2(np.arange(128) + 1.0), 7).astype(np.int64)


def levels(n: np.ndarray) -> np.ndarray:
    """Counts in 16 levels."""
    return LEVELS[np.minimum(n, len(LEVELS) - 1).astype(np.int64)]


class Totals:
    """Totals of the training documents by class: documents, words, distinct words; and the chances that follow from them."""

    def __init__(self, docs: list[int], words: list[int], kinds: list[int], distinct: int):
        self.docs, self.words, self.kinds = (np.array(x, float) for x in (docs, words, kinds))
        self.tokens, self.ends, self.classes = int(sum(words) + sum(docs)), int(sum(docs)), len(docs)
        self.distinct = distinct + (self.ends > 0)
        self.p_end = (self.docs + 1) / (self.words + self.docs + 2)
        self.prior = np.log((self.docs + 1) / (self.ends + self.classes))
        self.freed = np.where(self.words > 0, DISCOUNT * self.kinds / np.maximum(self.words, 1), 1.0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + (self.distinct + 1.0)))


class Words:
    """What the corpus' words have to say of a chunk's distinct words, the end last: counts, costs, and log probabilities by class."""

    def __init__(self, counts: np.ndarray, cost: np.ndarray, totals: Totals):
        if not len(cost):
            counts, cost = np.zeros((1, totals.classes), np.uint32), np.zeros(1, np.float32)
        self.counts, self.often = counts, levels(np.append(counts.sum(axis=1, dtype=np.float64), [0.0, 0.0]))  # the end and what stands before a text last
        self.spell = cost.astype(np.float64) * np.log(10)
        self.plain, self.totals = np.exp(np.maximum(self.spell, -600)), totals
        every = [self.chances(counts[:, k].astype(np.float64), np.arange(len(cost)), np.full(len(cost), k)) for k in range(totals.classes)]
        self.by_class = np.append(np.stack(every, axis=1), np.log(totals.p_end)[None, :], axis=0)

    def chances(self, c: np.ndarray, words: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Natural log of the words' probabilities in classes that hold them c times."""
        totals = self.totals
        c = np.maximum(c - DISCOUNT, 0) / np.maximum(totals.words, 1.0)[kind]
        freed = totals.freed[kind]
        with np.errstate(divide="ignore"):
            q = np.log(c + freed * self.plain[words])
            # The probability of a long word may be below the least float.
            far = np.flatnonzero(self.spell[words] < -600)
            q[far] = np.logaddexp(np.log(c[far]), np.log(freed[far]) + self.spell[words[far]])
        return q + np.log1p(-totals.p_end)[kind]


class Texts:
    """Some texts of a chunk: for each token, what the experts say. With `alone`, a training text's own counts are left out.

    alike: the same texts with the other `alone`, whose places and ranks are taken over. words: Words(counts, cost, totals), if at hand.
    """

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray, end: int, counts: np.ndarray, cost: np.ndarray, c: np.ndarray, n: np.ndarray,
                 kind: np.ndarray, totals: Totals, alone: bool, words: Words | None = None, alike: Texts | None = None):
        self.lengths, self.tokens, self.end = lengths, tokens, end
        words = words or Words(counts, cost, totals)
        if alike:
            self.doc, self.pos, self.prev, self.prev2, self.word_key, self.rank, self.own, self.rank_two, self.often = (
                alike.doc, alike.pos, alike.prev, alike.prev2, alike.word_key, alike.rank, alike.own, alike.rank_two, alike.often)
        else:
            self.doc, self.pos = places(lengths)
            self.prev, self.prev2 = shifted(tokens, 1, self.pos, -1), shifted(tokens, 2, self.pos, -1)
            self.word_key = (self.doc.astype(np.uint64) << np.uint64(32)) | tokens.astype(np.uint64)
            self.rank, self.own = earlier(self.word_key)
            self.rank_two, _ = earlier(scrambled(self.word_key) + (self.prev + 2).astype(np.uint64) * MIX)
            self.often = words.often[self.prev] * 16 + words.often[self.prev2]
        doc, pos, prev, prev2, rank = self.doc, self.pos, self.prev, self.prev2, self.rank
        c, n = c.astype(np.int64), n.astype(np.int64)
        taught = kind[doc] >= 0
        if alone:
            context = ((doc.astype(np.uint64) << np.uint64(32)) | (prev + 2).astype(np.uint64)) * MIX + scrambled((prev2 + 2).astype(np.uint64))
            _, own_n = earlier(context)
            _, own_c = earlier(scrambled(context) + (tokens + 1).astype(np.uint64) * MIX)
            c, n = np.maximum(c - own_c * taught, 0), np.maximum(n - own_n * taught, 0)
        if alike:
            self.n, self.q = [n, *alike.n[1:]], [c / np.maximum(n, 1), *alike.q[1:]]
        else:
            before = shifted(rank, 1, pos, 0)
            self.n = [n, before, pos]
            self.q = [c / np.maximum(n, 1), self.rank_two / np.maximum(before, 1), np.where(tokens == end, 0.0, rank / np.maximum(pos, 1))]
        self.rest = self.corpus(words, kind, totals, self.own if alone else None, alike)
        self.contexts, self.gates = [], []
        hits = [(q > 0).astype(np.int64) for q in self.q]
        last = shifted(sum(h << k for k, h in enumerate(hits)), 1, pos, 0)
        place = FAR[np.minimum(pos, len(FAR) - 1)]
        for k in range(EXPERTS):
            if alike and k:
                first, second = alike.contexts[k][:2]
                seen = alike.gates[k]
            else:
                seen = levels(self.n[k])
                first = seen * 8 + sum(shifted(hits[k], by, pos, 0) << (by - 1) for by in (1, 2, 3))
                second = seen * 256 + self.often
            self.contexts.append((first, second, (seen * 8 + last) * 8 + place))
            self.gates.append(seen)

    def corpus(self, words: Words, kind: np.ndarray, totals: Totals, own: np.ndarray | None, alike: Texts | None) -> np.ndarray:
        """Natural log of each token's probability among the corpus' words: a mixture over classes that moves along the text."""
        starts = np.cumsum(self.lengths) - self.lengths
        if alike:  # the same but for the classes of training texts
            ahead, (of, at, plain) = alike.ahead, alike.replaced
            ahead[of, at] = plain
        else:
            ahead = np.ascontiguousarray(words.by_class.take(np.where(self.tokens == self.end, len(words.by_class) - 1, self.tokens), axis=0).T)
        none = np.zeros(0, np.int64)
        self.ahead, self.replaced = ahead, (none, none, ahead[0, :0])
        if own is not None:
            at = np.flatnonzero((kind[self.doc] >= 0) & (self.tokens != self.end))
            token, of = self.tokens[at], kind[self.doc[at]]
            self.replaced = of, at, ahead[of, at]
            ahead[of, at] = words.chances(words.counts[token, of].astype(np.float64) - own[at], token, of)
        # Sums along each text from its class's prior, before and after each token.
        after = np.cumsum(ahead, axis=1)
        began = after[:, starts] - ahead[:, starts] - totals.prior[:, None]
        after -= np.repeat(began, self.lengths, axis=1)
        top = after.max(axis=0)
        after -= top
        # What lies so far below the largest term is lost in a sum of doubles.
        near = after > FAINT
        shares = np.zeros_like(after)
        shares[near] = np.exp(after[near])
        whole = top + np.log(shares.sum(axis=0))
        start = np.log(np.exp(totals.prior).sum())
        return whole - shifted(whole, 1, self.pos, start)


class Mixer:
    """The experts' bits: tables of what hashed contexts have seen (taken, not taken) and the weights that mix their predictions."""

    def __init__(self, vector: np.ndarray | None = None):
        sizes = [2 * size for _ in range(EXPERTS) for size in TABLES] + [EXPERTS * EXPERT_GATES * INPUTS]
        self.vector = np.zeros(sum(sizes)) if vector is None else vector
        parts = np.split(self.vector, np.cumsum(sizes)[:-1])
        self.tables = [[parts[k * len(TABLES) + j].reshape(-1, 2) for j in range(len(TABLES))] for k in range(EXPERTS)]
        self.weights = parts[-1].reshape(EXPERTS, EXPERT_GATES, INPUTS)
        self.fixed = None
        if vector is None:
            self.weights[:, :, :-1] = 0.4

    def stretched(self, k: int) -> list[np.ndarray]:
        return [np.log((seen[:, 0] + PRIOR) / (seen[:, 1] + PRIOR)) for seen in self.tables[k]]

    def run(self, texts: Texts, rate: float = 0.0, learns: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each token's probability; with a rate, tables and weights learn from the tokens where `learns` holds."""
        logs = texts.rest.copy()
        for k in reversed(range(EXPERTS)):
            # Only where the expert's context was seen does it say anything. A slot of a table tells the gate, so weights go with the slots.
            x, w, seen = self.stretched(k), self.weights[k], np.flatnonzero(texts.n[k] > 0)
            slots, gates = [of[seen] for of in texts.contexts[k]], texts.gates[k][seen]
            z = (0.3 * w[:, -1])[gates]
            for j, of in enumerate(slots):
                z += (x[j].reshape(EXPERT_GATES, -1) * w[:, j, None]).reshape(-1)[of]
            p = 1 / (1 + np.exp(-np.clip(z, -12, 12))) if self.fixed is None else np.full(len(z), self.fixed)
            # Both ways to the token, in units of what the other experts give it; these units may be below the least float.
            rest, q = logs[seen], texts.q[k][seen]
            low, held = np.flatnonzero(rest < -600), np.flatnonzero(q > 0)
            taken = np.zeros(len(seen))
            taken[held] = p[held] * q[held] * np.exp(-np.maximum(rest[held], -600))
            both = taken + (1 - p)
            with np.errstate(divide="ignore"):
                far = np.logaddexp(np.log(p[low] * q[low]), np.log1p(-p[low]) + rest[low])
            rest += np.log(both)
            rest[low] = far
            logs[seen] = rest
            if rate:
                at = np.flatnonzero(learns[seen])
                share = taken[at] / both[at]
                gate, error = gates[at], share - p[at]
                total = np.bincount(gate, minlength=EXPERT_GATES)
                slots = [of[at] for of in slots]
                for i in range(INPUTS):
                    own = x[i][slots[i]] if i < len(x) else 0.3
                    self.weights[k][:, i] += rate * np.bincount(gate, error * own, EXPERT_GATES) / np.maximum(total, 500.0)
                for table, of in zip(self.tables[k], slots):
                    table[:, 0] += np.bincount(of, share, len(table))
                    table[:, 1] += np.bincount(of, 1 - share, len(table))
        return logs


def parts_of(row: dict, totals: Totals, both: bool, most: int = 120_000) -> Iterator[tuple[slice, Texts, Texts | None]]:
    """A chunk's texts in parts of about `most` tokens, without their own counts; if `both`, also with all counts."""
    blobs = row["blobs"]
    lengths, tokens = unpacked(blobs[0], np.uint32).astype(np.int64), unpacked(blobs[1], np.uint32).astype(np.int64)
    counts, cost = unpacked(blobs[2], np.uint32).reshape(-1, totals.classes), unpacked(blobs[3], np.float32)
    c, n = unpacked(blobs[4], np.uint32), unpacked(blobs[5], np.uint32)
    kind, ends = np.array(row["classes"], np.int64), np.cumsum(lengths)
    a, words = 0, Words(counts, cost, totals)
    while a < len(lengths):
        begin = int(ends[a] - lengths[a])
        b = max(a + 1, int(np.searchsorted(ends, begin + most, "right")))
        part = slice(begin, int(ends[b - 1]))
        given = lengths[a:b], tokens[part], len(cost), counts, cost, c[part], n[part], kind[a:b], totals
        own = Texts(*given, True, words)
        yield slice(a, b), own, Texts(*given, False, words, own) if both else None
        a = b


def learn(totals: Totals):
    """A mapInArrow function: the mixer after the task's training texts, as pieces of one vector (weights by the tokens they saw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, steps, seen = Mixer(), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                taught = np.array(row["train"], bool)
                for which, texts, _ in parts_of(row, totals, False):
                    learns = taught[which][texts.doc]
                    if learns.any():
                        # The first texts are gone over several times, since tables and weights start from nothing.
                        for _ in range(max(1, 6 - 2 * steps)):
                            mixer.run(texts, 1.0 / (1 + steps / 10), learns)
                            steps += 1
                        seen += int(learns.sum())
        if seen:
            mixer.weights *= seen
            vector = np.append(mixer.vector, float(seen))
            vector = np.append(vector, np.zeros(-len(vector) % PIECE)).reshape(-1, PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vector)), pa.int32()), pa.array([x.tobytes() for x in vector], pa.binary())], ["piece", "counts"])

    return run


def add_floats(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x) for x in table["counts"].to_pylist()], axis=0)
    return pa.table({"piece": pa.array([table["piece"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def scored(totals: Totals, vector: np.ndarray, fixed: float | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(vector)
        mixer.fixed = fixed
        for batch in batches:
            for row in batch.to_pylist():
                counts = unpacked(row["blobs"][2], np.uint32).reshape(-1, totals.classes).sum(axis=1, dtype=np.float64)
                every = np.append(counts, float(totals.ends))
                base, known, score, fresh, tokens = [], [], [], [], []
                for _, own, texts in parts_of(row, totals, True):
                    starts = np.cumsum(texts.lengths) - texts.lengths
                    add = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                    of = every[texts.tokens]
                    base.append(add(totals.base(of)))
                    known.append(add((of > 0).astype(np.int64)))
                    score.append(add(mixer.run(texts)) / np.log(10))
                    fresh.append(add(mixer.run(own)) / np.log(10))
                    tokens.append(texts.lengths)
                score, n = np.concatenate(score), len(row["sizes"])
                size = np.maximum(1, np.array(row["sizes"], float))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array([not x for x in row["train"]], pa.bool_()), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(known)),
                    pa.array(np.full(n, totals.tokens, np.int64)), pa.array(np.concatenate(base)), pa.array(score), pa.array(-np.concatenate(fresh) * np.log2(10) / size)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", class_column: str | None = "lang", most_classes: int = 8,
          chunk_bytes: int = 8_000_000, fixed: float | None = None, scanned: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.

    score is the log10 probability that the trained model gives the text. bits_per_byte is what the text costs a model that has
    not learned from it: a training text's own counts of words and contexts are left out, so that training and held-out
    texts compare, and texts that occur again elsewhere stand out.
    scanned: whether docs comes straight from files; else they are written as a table first, since they are read several times.
    fixed: a probability for all of the experts' bits in place of the mixer's, to see what the mixer does.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark, 200)
    named = F.coalesce(F.col(class_column).cast("string"), F.lit("")) if class_column in docs.columns else F.lit("")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), named.alias("name"),
                       (crc_fold(F.col(doc_id), 7) != 2).alias("train"))
    # One row for each of the most frequent class names; all others share the last class.
    sizes = docs.groupBy("name").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("train").cast("long")).alias("docs"))
    total = sizes.agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")).first()
    top = sizes.filter("docs > 0").orderBy(F.desc("docs"), "name").limit(most_classes).collect()
    n_docs = [r["docs"] for r in top] + [(total["docs"] or 0) - sum(r["docs"] for r in top)]
    classes, last = len(n_docs), len(top)
    kind = F.lit(last)
    for k, r in enumerate(top):
        kind = F.when(F.col("name") == r["name"], k).otherwise(kind)
    bits = max(0, ((total["bytes"] or 0) // chunk_bytes).bit_length())
    docs = docs.select("doc_id", "text", F.when(F.col("train"), kind).otherwise(-1).alias("class"))
    docs = docs if scanned else materialize(docs, "texts")
    words = docs.mapInArrow(word_requests(classes, bits, chunk_bytes), REQUESTS).groupBy("bucket").applyInArrow(vocabulary(classes), "bucket int, blobs array<binary>")
    words = materialize(words, "vocabulary", True)
    sums = {r["i"]: r["n"] for r in words.mapInArrow(vocabulary_sums(classes), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    of = lambda a, n: [sums.get(i, 0) for i in range(a, a + n)]
    totals = Totals(n_docs, of(257, classes), of(257 + classes, classes), sums.get(256, 0))
    # How often each byte occurs in distinct training words (256 rows) sets the bits that spell it.
    code = byte_codes({b: sums.get(b, 0) for b in range(256)} | {32: sums.get(256, 0)})
    # The speller: a fixed number of pieces of counts, then one small array of weights a task.
    known = lambda function, schema: words.mapInArrow(with_words(function, classes), schema)
    pieces = known(gather_counts(code), "piece int, counts binary").groupBy("piece").applyInArrow(add_pieces, "piece int, counts binary").toArrow()
    tables = np.zeros((len(ORDERS) * (2 << SLOT_BITS) // PIECE, PIECE), np.int32)
    for i, x in zip(pieces["piece"].to_pylist(), pieces["counts"].to_pylist()):
        tables[i] = np.minimum(np.frombuffer(x, np.int64), 2**31 - 1)
    tables = tables.reshape(len(ORDERS), 2 << SLOT_BITS)
    weights = np.full((GATES, len(ORDERS) + 1), 0.3)
    weights[:, -1] = 0.0
    parts = known(refine(tables, weights, code), "weights binary, used binary").collect()
    if parts:
        used = np.stack([np.frombuffer(r["used"]) for r in parts]) + 1e-9
        each = np.stack([np.frombuffer(r["weights"]).reshape(weights.shape) for r in parts])
        weights = (each * used[:, :, None]).sum(axis=0) / used.sum(axis=0)[:, None]
    # Answers become a table of their own, so that the requests' shuffle can go before chunks and answers meet.
    chunks = materialize(docs.mapInArrow(chunk_rows(chunk_bytes), CHUNKS), "codes")
    found = materialize(chunks.mapInArrow(context_requests(bits), REQUESTS).groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(
        answers(classes, tables, weights, code), REQUESTS), "answers", True)
    drop_materialized(words)
    ready = materialize(chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(joined, CHUNKS), "chunks", True)
    drop_materialized(chunks)
    drop_materialized(found)
    pieces = ready.mapInArrow(learn(totals), "piece int, counts binary").groupBy("piece").applyInArrow(add_floats, "piece int, counts binary").toArrow()
    mixer = Mixer()
    if len(pieces):
        by_piece = dict(zip(pieces["piece"].to_pylist(), pieces["counts"].to_pylist()))
        vector = np.concatenate([np.frombuffer(by_piece[i]) for i in sorted(by_piece)])
        seen = vector[len(mixer.vector)]
        mixer = Mixer(vector[:len(mixer.vector)].copy())
        mixer.weights /= seen
    return ready.mapInArrow(scored(totals, mixer.vector, fixed), RESULT)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), scanned=True)
