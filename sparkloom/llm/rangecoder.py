"""Adaptive context-mixing range coder for token ids.

Ids are coded in segments of at most 2^20, each from an empty model, so segments decode independently; each carries the CRC
of its ids. The ids of a segment are dealt over lanes (contiguous stretches) that one model serves in lockstep, so every
step is a handful of numpy operations over all lanes. Three predictions are mixed: order 2, the id that last followed the
two preceding ids (hashed), with a confidence that adapts at every step; order 1, the distribution of what followed the
preceding id; order 0, the distribution of all ids. The distributions are counts of what the segment has shown so far, taken
up anew at growing distances. A gate, chosen by the confidence of order 2 and by how often and how uniformly the preceding
id was followed, shares out the probability between the three and learns from the orders that hold the ids. An id is coded
in the highest order that expects it (the order by the gate's weights, then the id by its counts there) by a carryless
range coder with 64-bit state that puts out 16 bits at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = 0x32434D54
HEADER = "<IIIIII"
HEADER_BYTES = struct.calcsize(HEADER)
SEGMENT = 1 << 20
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
#: Resolution of the gates' weights, and the least weight of order 0.
GATE_BITS, LEAST = 12, 16
#: Slots of the contexts of order 2; bits of an id (of its rank in the segment).
SLOT_BITS, ID_BITS = 18, 20
LANE_IDS, MOST_LANES = 256, 4096
PAIR_BITS, PAIR_FACTORS = 20, (0x9E3779B1, 0xC2B2AE3D)
#: Weight of a seen id in order 0 against one of the segment's ids not seen yet.
GAIN = 32
GATES = 8 * 16
#: By how often a context was seen, up to 16 times.
OFTEN = np.array([1, 1, 4, 4, 7, 7, 7, 7, 10, 10, 10, 10, 10, 10, 10, 10, 13])
#: The steps before which order 1 takes up what it has seen; the rest of the model does so also before every 16th.
TAKES = (1, 4, 12, 32, 80, 160, 288, 416)
IDS = (1 << ID_BITS) - 1
U0, U16, U48 = np.uint64(0), np.uint64(16), np.uint64(48)
GATE_SHIFT = np.uint64(GATE_BITS)


def slot_of(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The slot of a context of order 2."""
    return ((last * 0x9E3779B1 + before * 0x85EBCA6B) & 0xFFFFFFFFFF) >> (40 - SLOT_BITS)


def confidence(n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """0 for a context not seen yet, else 1 to 15 by how often it was seen and how many different ids followed."""
    often = OFTEN[np.minimum(n, len(OFTEN) - 1)]
    return np.where(n > 0, often + (kinds > 1) + (kinds * 2 > n + 1), 0)


def spans(steps: int) -> list[tuple[int, int, bool]]:
    """(first step, step after the last, whether order 1 takes up what it has seen before it) of the stretches of a segment."""
    bounds = [0, *sorted({t for t in (*TAKES, *range(16, steps, 16)) if t < steps}), steps]
    return [(a, b, a in TAKES) for a, b in zip(bounds[:-1], bounds[1:])]


class Mixer:
    """Gates' weights of the orders 2, 1 and 0, order 2 and the distribution of order 0; encoder and decoder drive it alike.

    A context's slot in order 2 holds id * 8 + confidence.
    """

    def __init__(self, alphabet: int):
        self.counts = np.ones(alphabet, np.int64)
        self.outcomes = np.tile(np.array([2.0, 2.0, 1.0]), (GATES, 1))
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.settle()

    def settle(self) -> None:
        self.above = np.cumsum(self.counts)
        self.total = int(self.above[-1])
        share = self.outcomes / self.outcomes.sum(axis=1, keepdims=True) * ((1 << GATE_BITS) - LEAST - 2)
        self.w2 = share[:, 0].astype(np.int64) + 1
        self.both = self.w2 + share[:, 1].astype(np.int64) + 1
        whole = np.full(GATES, 1 << GATE_BITS)
        # By gate * 3 + outcome: where its interval starts, and its size.
        self.start = np.stack([np.zeros(GATES, np.int64), self.w2, self.both], axis=1).reshape(-1).astype(np.uint64)
        self.size = np.stack([self.w2, self.both - self.w2, whole - self.both], axis=1).reshape(-1).astype(np.uint64)
        self.w2, self.both = self.w2.astype(np.uint64), self.both.astype(np.uint64)

    def learn(self, ids: np.ndarray, cells: np.ndarray) -> None:
        self.counts += GAIN * np.bincount(ids, minlength=len(self.counts))
        self.outcomes = self.outcomes * 0.8 + np.bincount(cells, minlength=GATES * 3).reshape(GATES, 3)
        self.settle()

    def follow(self, at: np.ndarray, held: np.ndarray, sure: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> None:
        """Order 2 sees which ids followed (fresh: id * 8 + 1): an expected id gains confidence, another one lowers it and then takes the slot."""
        new = np.where(hit, held + (sure < 7), held - ((sure + 1) >> 1))
        np.copyto(new, fresh, where=np.greater(sure < 2, hit))
        self.slots[at] = new


class Follows:
    """What followed each id so far, one preceding id after another: runs of equal ids, in order."""

    def __init__(self, before: np.ndarray, ids: np.ndarray, alphabet: int):
        keys = before.astype(np.int64)
        keys <<= ID_BITS
        keys |= ids
        keys.sort()
        first = np.empty(len(keys), bool)
        first[0] = True
        np.not_equal(keys[1:], keys[:-1], out=first[1:])
        begins = np.flatnonzero(first)
        sizes = np.diff(np.append(begins, len(keys)))
        n = np.bincount(before, minlength=alphabet)
        self.sizes, self.keys = sizes, keys[begins]
        sure = confidence(n, np.bincount(self.keys >> ID_BITS, minlength=alphabet))
        # Numbers below 2^20, or up to it and on top, share a word, so that they are looked up at once: of a context
        # (confidence, where what followed begins, how often anything followed) and of a run (id, place in its context, size).
        at = np.cumsum(n) - n
        self.contexts = sure | at << 4 | n << 24
        self.runs = self.keys & IDS | (begins - at[self.keys >> ID_BITS]) << 20 | sizes << 40

    def by_place(self) -> None:
        """For the decoder: the run of each place."""
        self.runs = np.repeat(self.runs, self.sizes)

    def by_pair(self) -> None:
        """For the encoder: two hash tables of runs. A pair that both have overwritten counts as not seen, which costs bits only."""
        self.tables = []
        for factor in PAIR_FACTORS:
            table = np.zeros(1 << PAIR_BITS, np.int32)
            table[pair_slot(self.keys, factor)] = np.arange(len(self.keys), dtype=np.int32)
            self.tables.append(table)

    def counts(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What followed each of `before`: how often ids below, and this id."""
        wanted = before << ID_BITS | ids
        run = self.tables[0][pair_slot(wanted, PAIR_FACTORS[0])]
        missed = np.flatnonzero(self.keys[run] != wanted)
        again = wanted[missed]
        found = self.tables[1][pair_slot(again, PAIR_FACTORS[1])]
        run[missed] = found
        run = self.runs[run]
        own = run >> 40
        own[missed[self.keys[found] != again]] = 0
        return run >> 20 & IDS, own


def pair_slot(keys: np.ndarray, factor: int) -> np.ndarray:
    return ((keys * factor) & 0xFFFFFFFFFFFF) >> (48 - PAIR_BITS)


def lanes_of(n: int) -> tuple[int, int]:
    lanes = min(MOST_LANES, max(1, n // LANE_IDS))
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray) -> bytes:
    """One block for uint32 ids."""
    return b"".join(encoded(ids[a:a + SEGMENT]) for a in range(0, max(1, len(ids)), SEGMENT))


def encoded(ids: np.ndarray) -> bytes:
    n = len(ids)
    names, ranks = np.unique(ids, return_inverse=True) if n and int(ids.max()) >= SEGMENT << 2 else ranked(ids)
    table = zlib.compress(np.diff(names, prepend=np.uint32(0)).astype("<u4").tobytes())
    lanes, steps = lanes_of(n)
    crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
    if not n:
        return struct.pack(HEADER, MAGIC, 0, 0, 0, crc, 0)
    padded = np.zeros(lanes * steps, np.int32)
    padded[:n] = ranks
    columns = np.zeros((steps + 2, lanes), np.int32)  # two rows of zeros before the first step
    columns[2:] = padded.reshape(lanes, steps).T
    # Lanes are filled one after another, so those in use at a step come first.
    used = np.minimum(lanes, -(-(n - np.arange(steps)) // steps))
    model = Mixer(len(names))
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    follows = None
    for a, b, taken in spans(steps):
        if taken:
            real = Real(used, lanes, 0, a)
            follows = Follows(real(columns[1:a + 1]), real(columns[2:a + 2]), len(names))
            follows.by_pair()
        # Order 2 first, step by step, then the others' shares of all ids that it does not expect, then the coder.
        last, ids = columns[a + 1:b + 1].astype(np.int64), columns[a + 2:b + 2]
        slots, fresh = slot_of(columns[a:b].astype(np.int64), last), ids * 8 + 1
        hits, trusts = np.ones((b - a, lanes), bool), np.zeros((b - a, lanes), np.int32)
        for t in range(a, b):
            m, i = int(used[t]), t - a
            at, new = slots[i, :m], fresh[i, :m]
            held = model.slots[at]
            trust = np.bitwise_and(held, 7, out=trusts[i, :m])
            hit = np.less((held - new).view(np.uint32), 7, out=hits[i, :m])
            model.follow(at, held, trust, hit, new)
        contexts = follows.contexts[last] if follows else np.zeros((b - a, lanes), np.int64)
        cells = (trusts * 48 + (contexts & 15) * 3).reshape(-1)
        below, own, whole = np.zeros(cells.shape, np.uint64), np.ones(cells.shape, np.uint64), np.ones(cells.shape, np.uint64)
        missed = np.flatnonzero(~hits)
        x = ids.reshape(-1)[missed]
        if follows:
            under, times = follows.counts(last.reshape(-1)[missed], x)
            there = times > 0
            known, rest = missed[there], np.flatnonzero(~there)
            below[known], own[known], whole[known] = under[there], times[there], contexts.reshape(-1)[known] >> 24
            cells[known] += 1
            missed, x = missed[rest], x[rest]
        times = model.counts[x]
        below[missed], own[missed], whole[missed] = model.above[x] - times, times, model.total
        cells[missed] += 2
        start, size, below, own, whole = (v.reshape(b - a, lanes) for v in (model.start[cells], model.size[cells], below, own, whole))
        for t in range(a, b):
            m, i = int(used[t]), t - a
            lo, r = low[:m], span[:m]
            r >>= GATE_SHIFT
            lo += start[i, :m] * r
            r *= size[i, :m]
            r //= whole[i, :m]
            lo += below[i, :m] * r
            r *= own[i, :m]
            put_out(low, span, out)
        real = Real(used, lanes, a, b)
        model.learn(real(ids), real(cells.reshape(b - a, lanes)))
    value = (low + np.uint64(2**32 - 1)) >> np.uint64(32)
    at = np.arange(lanes)
    out += [(at, (value >> U16).astype(np.uint16)), (at, (value & np.uint64(0xFFFF)).astype(np.uint16))]
    owner = np.concatenate([x for x, _ in out]).astype(np.uint16)
    pos, words = np.bincount(owner, minlength=lanes), np.concatenate([x for _, x in out])[np.argsort(owner, kind="stable")]
    return struct.pack(HEADER, MAGIC, n, len(table), lanes, crc, steps) + table + pos.astype("<u4").tobytes() + words.astype("<u2").tobytes()


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids in order, rank of each id)."""
    there = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    there[ids] = True
    return np.flatnonzero(there).astype(np.uint32), (np.cumsum(there, dtype=np.int32) - 1)[ids]


class Real:
    """Takes those places of the steps from a to b that hold an id, in any order."""

    def __init__(self, used: np.ndarray, lanes: int, a: int, b: int):
        self.mask = None if used[b - 1] == lanes else np.arange(lanes)[None, :] < used[a:b, None]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return values.reshape(-1) if self.mask is None else values[self.mask]


def due(low: np.ndarray, span: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shifts all lanes that must; yields, time and again, such lanes and their low ends before the shift. Where the span ran short
    of a carry boundary it is cut to that boundary."""
    at = np.flatnonzero(span < TOP)  # wider spans hold a boundary
    while len(at):
        lo, wide = low[at], span[at]
        apart = (lo ^ (lo + wide)) >= TOP
        if apart.any():
            short = apart & (wide < BOTTOM)
            wide[short] = (U0 - lo[short]) & (BOTTOM - np.uint64(1))
            some = np.flatnonzero(short >= apart)
            at, lo, wide = at[some], lo[some], wide[some]
        yield at, lo
        low[at] = lo << U16
        wide <<= U16
        span[at] = wide
        at = at[wide < TOP]


def put_out(low: np.ndarray, span: np.ndarray, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    for at, lo in due(low, span):
        out.append((at, (lo >> U48).astype(np.uint16)))


def decode(block: bytes) -> np.ndarray:
    """The uint32 ids of a block; raises ValueError if it is damaged."""
    parts, at = [], 0
    while at < len(block):
        ids, at = decoded(block, at)
        parts.append(ids)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def decoded(block: bytes, at: int) -> tuple[np.ndarray, int]:
    """The ids of the segment that begins at `at`, and where the next one begins."""
    if len(block) < at + HEADER_BYTES or struct.unpack_from("<I", block, at)[0] != MAGIC:
        raise ValueError("not a block of token ids")
    _, n, table, lanes, crc, steps = struct.unpack_from(HEADER, block, at)
    at += HEADER_BYTES
    if not n:
        return np.zeros(0, np.uint32), at
    if (lanes, steps) != lanes_of(n) or len(block) < at + table + 4 * lanes:
        raise ValueError("a block of token ids is cut short")
    try:
        names = np.cumsum(np.frombuffer(zlib.decompress(block[at:at + table]), "<u4"), dtype=np.uint32)
    except zlib.error as e:
        raise ValueError("a block of token ids is damaged") from e
    at += table
    lengths = np.frombuffer(block, "<u4", lanes, at).astype(np.int64)
    at += 4 * lanes
    size = int(lengths.sum())
    if len(block) < at + 2 * size or int(lengths.max()) > 3 * steps + 8 or not len(names):
        raise ValueError("a block of token ids is cut short")
    if int(lengths.min()) < 2:
        raise ValueError("a block of token ids is cut short")
    # Each lane's words end in zeros, of which a sound lane reads two.
    room = lengths + 4
    words, pos = np.zeros(int(room.sum()), np.uint16), np.cumsum(room) - room
    words[np.arange(size) + np.repeat(4 * np.arange(lanes), lengths)] = np.frombuffer(block, "<u2", size, at)
    at += 2 * size
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << U16) | words[pos]
        pos += 1
    model = Mixer(len(names))
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    columns = np.zeros((steps + 2, lanes), np.int64)  # two rows of zeros before the first step
    cells = np.zeros((steps, lanes), np.int64)
    used = np.minimum(lanes, -(-(n - np.arange(steps)) // steps))
    follows, one, most = None, np.uint64(1), len(words) - 1
    for a, b, taken in spans(steps):
        if taken:
            real = Real(used, lanes, 0, a)
            follows = Follows(real(columns[1:a + 1]), real(columns[2:a + 2]), len(names))
            follows.by_place()
        for t in range(a, b):
            m = int(used[t])
            last = columns[t + 1, :m]
            at_2 = slot_of(columns[t, :m], last)
            held = model.slots[at_2]
            trust = held & 7
            context = follows.contexts[last] if follows else np.zeros(m, np.int64)
            gate = context & 15
            gate += trust << 4
            lo, r = low[:m], span[:m]
            r >>= GATE_SHIFT
            ahead = code[:m] - lo
            in_2, in_0 = ahead < model.w2[gate] * r, ahead >= model.both[gate] * r
            gate *= 3
            gate += 1
            gate += in_0
            gate -= in_2
            cells[t, :m] = gate
            jump = model.start[gate] * r
            ahead -= jump
            lo += jump
            r *= model.size[gate]
            x = held >> 3
            if follows:
                e = np.flatnonzero(in_0 == in_2)  # neither
                context, wide = context[e], r[e]
                wide //= np.maximum(context >> 24, 1).astype(np.uint64)
                place = (context >> 4 & IDS) + (ahead[e] // np.maximum(wide, one)).astype(np.int64)
                run = follows.runs[np.minimum(place, len(follows.runs) - 1)]
                x[e] = run & IDS
                lo[e] += (run >> 20 & IDS).astype(np.uint64) * wide
                wide *= (run >> 40).astype(np.uint64)
                r[e] = wide
            e = np.flatnonzero(in_0)
            wide = r[e] // np.uint64(model.total)
            found = np.searchsorted(model.above, np.minimum(ahead[e] // np.maximum(wide, one), np.uint64(model.total - 1)).astype(np.int64), "right")
            sizes = model.counts[found]
            x[e] = found
            lo[e] += (model.above[found] - sizes).astype(np.uint64) * wide
            wide *= sizes.astype(np.uint64)
            r[e] = wide
            np.minimum(x, len(names) - 1, out=x)
            columns[t + 2, :m] = x
            x *= 8
            x += 1
            model.follow(at_2, held, trust, in_2, x)
            for lane, _ in due(low, span):
                code[lane] = (code[lane] << U16) | words[np.minimum(pos[lane], most)]
                pos[lane] += 1
        real = Real(used, lanes, a, b)
        model.learn(real(columns[a + 2:b + 2]), real(cells[a:b]))
    ids = names[columns[2:].T.reshape(-1)[:n]]
    if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != crc:
        raise ValueError("a block of token ids fails its checksum")
    return ids, at
