"""Encoding whole Arrow columns of texts with a public tokenizer, each distinct piece of text once.

Both vocabularies split a text at white space before merging, so a text's ids are the ids of its pieces in order. Pieces
are dictionary-encoded per batch and looked up in a table that the Python worker keeps between tasks; only pieces that
are not in it go through the tokenizer. The table has a fixed bound and is emptied when full, which changes no result.
A new piece of plain words with, perhaps, marks and a line's end goes straight to the tokenizer's model, since its splitting
is known; all others take the tokenizer's whole way.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import ranges, split_words

#: Texts in which a space meets other white space or an end, or that hold white space beyond ASCII, are encoded whole
#: by tokenizers that keep white space.
TANGLED = r"[ \t\n\x0b\x0c\r] | [\t\n\x0b\x0c\r]|^ | $|[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
KEPT_PIECES, KEPT_RUNS = 3_000_000, 250_000
#: A word of Latin letters, and marks that the tokenizers split off as one run.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$&%#|]*)(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$&%#|]*))?").fullmatch


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies spell each byte: printable ones by themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + others.index(b)) if b in others else chr(b) for b in range(256)}


def listed(strings: pa.Array) -> list[str]:
    """Arrow strings as a list, by way of numpy, which is faster than to_pylist()."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """path: a tokenizers file. spaces: whether the tokenizer keeps white space (byte-level) or drops it."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces = Tokenizer.from_file(path), spaces
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.letters, self.runs, self.model = byte_letters(), {}, self.tokenizer.model  # asked for once: each access makes a new object
        self.hashes, self.starts, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def kept(path: str, spaces: bool) -> Encoder:
        """The worker process's encoder for this file; it outlives a task."""
        state = sys.modules.setdefault("_sparkloom_worker", types.ModuleType("_sparkloom_worker"))
        held = vars(state).setdefault("encoders", {})
        if (path, spaces) not in held:
            held[path, spaces] = Encoder(path, spaces)
        return held[path, spaces]

    def spelled(self, run: str) -> bytes:
        """The ids of one run of letters, with a space before it if it has one, of marks, or a line's end; a bounded table keeps them."""
        if len(self.runs) >= KEPT_RUNS:
            self.runs.clear()
        if not self.spaces:
            letters = run.lower()
        elif run.isascii():
            letters = run.replace(" ", self.letters[32]).replace("\n", self.letters[10])
        else:
            letters = run.encode().decode("latin-1").translate(self.letters)
        found = self.runs[run] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return found

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids) from the tokenizer itself."""
        ids, ends, rest = bytearray(), [], []
        spaces, known, spelled = self.spaces, self.runs.get, self.spelled
        for i, piece in enumerate(pieces):
            found = PLAIN(piece, 1 if spaces and piece[:1] == " " else 0)
            if not found or not (spaces or piece.isascii()):
                rest.append(i)
            else:
                word, marks, line, marks_2 = found.groups()
                word = piece[:found.end(1)]
                ids += known(word) or spelled(word)
                if marks:
                    ids += known(marks) or spelled(marks)
                if line:
                    ids += known("\n") or spelled("\n")
                    ids += known(line) or spelled(line)
                    if marks_2:
                        ids += known(marks_2) or spelled(marks_2)
            ends.append(len(ids))
        counts = np.diff(np.array(ends, np.int64), prepend=0) // 4
        plain, others = np.flatnonzero(counts), []
        for at in range(0, len(rest), 20_000):
            some = rest[at:at + 20_000]
            out = self.tokenizer.encode([pieces[i] for i in some], is_pretokenized=True, add_special_tokens=False)
            if out.ids:
                counts[some] = np.bincount(np.array(out.word_ids, np.int64), minlength=len(some))
            others.append(np.array(out.ids, np.uint32))
        starts, both = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.uint32)
        both[ranges(starts[plain], counts[plain])] = np.frombuffer(bytes(ids), np.uint32)
        if rest:
            both[ranges(starts[rest], counts[rest])] = np.concatenate(others)
        return counts, both

    def places(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of each distinct piece's ids in self.ids."""
        if len(self.hashes) + len(pieces) > KEPT_PIECES:
            self.hashes, self.starts, self.lengths, self.used = self.hashes[:0], self.starts[:0], self.lengths[:0], 0
        digest = xxhash.xxh3_64_intdigest
        wanted = np.fromiter(map(digest, pieces), np.uint64, len(pieces))
        by_hash = np.argsort(wanted)  # sought in order, which keeps to few cache lines
        wanted = wanted[by_hash]
        at = np.searchsorted(self.hashes, wanted)
        known = np.zeros(len(wanted), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == wanted[inside]
        missing = np.flatnonzero(~known)
        if len(missing):
            counts, ids = self.encoded([pieces[i] for i in by_hash[missing].tolist()])
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[self.used:self.used + len(ids)] = ids
            starts = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            put = at[missing]
            self.hashes = np.insert(self.hashes, put, wanted[missing])
            self.starts = np.insert(self.starts, put, starts)
            self.lengths = np.insert(self.lengths, put, counts)
            at += np.cumsum(~known) - ~known
        place = np.empty_like(at)
        place[by_hash] = at
        return self.starts[place], self.lengths[place]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids as uint32, one text after another); texts has no nulls."""
        if not self.spaces:
            return self._encode_pieces(texts)
        tangled = pc.match_substring_regex(texts, TANGLED).to_numpy(zero_copy_only=False)
        if not tangled.any():
            return self._encode_pieces(texts)
        plain, whole = np.flatnonzero(~tangled), np.flatnonzero(tangled)
        counts = np.zeros(len(texts), np.int64)
        counts[plain], plain_ids = self._encode_pieces(texts.take(pa.array(plain)))
        counts[whole], whole_ids = self.encoded_whole(listed(texts.take(pa.array(whole))))
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), np.uint32)
        ids[ranges((ends - counts)[plain], counts[plain])] = plain_ids
        ids[ranges((ends - counts)[whole], counts[whole])] = whole_ids
        return counts, ids

    def encoded_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        return np.fromiter(map(len, each), np.int64, len(each)), np.concatenate(each) if each else np.zeros(0, np.uint32)

    def _encode_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.spaces:
            parts = pc.split_pattern(texts, " ")
            offsets, flat = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
            offsets = offsets - offsets[0]
            coded = flat.dictionary_encode()
            codes, pieces = coded.indices.to_numpy().astype(np.int32), [" " + p for p in listed(coded.dictionary)]
            heads = flat.take(pa.array(offsets[:-1])).dictionary_encode()
            codes = codes.copy()
            codes[offsets[:-1]] = len(pieces) + heads.indices.to_numpy()
            pieces += listed(heads.dictionary)
        else:
            offsets, flat = split_words(texts)
            coded = flat.dictionary_encode()
            codes, pieces = coded.indices.to_numpy().astype(np.int32), listed(coded.dictionary)
        starts, lengths = self.places(pieces)
        sums = np.concatenate([[0], np.cumsum(lengths[codes])])
        # The ids of each distinct piece as one binary value; taking them by code strings them together.
        ends = np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int64)
        table = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(self.ids[ranges(starts, lengths)])])
        taken = table.take(pa.array(codes))
        return np.diff(sums[offsets]), np.frombuffer(taken.buffers()[2], np.uint32, int(sums[-1])) if len(codes) else np.zeros(0, np.uint32)


def with_end(counts: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the id `end` to every text."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return counts + 1, out
