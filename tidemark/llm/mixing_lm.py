"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is coded in binary decisions. The most frequent ``WORDS`` words of the training documents, an escape and the end of
a document have Huffman codes; a word after an escape is spelt byte by byte, eight decisions each, with an end byte.
Three predictors see each decision: for words the place in the code alone, with the word before, and with the word before
that; for bytes the place in the byte with the two, three and five bytes before. Contexts are hashed into ``1 << BITS``
slots that hold the counts of both outcomes over all training documents. Decisions are worked on depth
by depth. All decisions of a spelt byte follow from it and the five before; so spelt bytes are gathered over chunks
and equal ones worked on once (``Spelt``), but for own counts. The predictors' log odds are combined by weights that a gate picks (depth of the decision, and which contexts are new), and the result is refined by a map from predicted
to seen probabilities. Weights and map are fitted on all training documents, with each document's own counts left out
(in slots with up to 254 of each outcome; in larger ones they are next to nothing): one pass counts all
decisions by depth, level of each predictor's log odds (``LEVELS`` to each side of 0) and outcome; Newton steps and the
map are worked out on these counts, as many for any corpus. Both are fixed while documents are scored.

Word counts of the base score are exact: frequent words are looked up in the model, all others go to buckets by their
hash and meet the counts there. A document is held out if crc32 of its key as text is divisible by 10, and learnt from
otherwise; a NULL key is neither. NULL and empty texts are the end alone. Repeated rows stay and count each.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import partitions_of, written
from tidemark.llm.words import Hasher, Words, chunks, mix, pack, text_buffers, unpack

WORDS = 1 << 18
BITS = 20
STEPS = 3  # Newton steps that fit the weights to the counted decisions
HOLD = 5.0
BUCKET = 2_000_000
SPLIT_BYTES = 64_000_000  # text of a task, about
END = np.uint64(0xE17D0000E17D)
STEP = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD1342543DE82EF95)
STRIDE = np.uint64(int(STEP) * int(SPREAD) % (1 << 64))
DEPTHS = 8
GATES = DEPTHS * 4
MAP = 33
FINE = 64  # steps of the mixed log odds
MANY = 254  # of an outcome in a slot, up to which a document's own counts matter
FEW = 255
LONG = 2_000_000  # bytes of a document whose own counts are in tables, not sorted
LEVELS = 20  # of log odds above 0, finer near 0, as many below, and one of contexts that are new
WIDE = 2 * LEVELS + 1
SIZES = (None, *[1 << BITS] * 5)  # of the predictors' tables; None: one for each node
PIECE = 16_000  # tokens, or bytes of spelt words, whose decisions are in memory together
ORDERS = (2, 3, 5)  # bytes before that the predictors of spelt bytes see
WAITING = 60  # depths of pieces whose decisions are counted together
SPELT = 1 << 19  # spelt bytes among which equal ones are worked on once


def training(ids, null) -> tuple[np.ndarray, np.ndarray]:
    """(learnt from, held out) of keys."""
    held = np.array([zlib.crc32(str(i).encode()) % 10 == 0 for i in ids.tolist()], bool) & ~null
    return ~held & ~null, held


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a chunk with the documents' ends, and their documents."""
    t = np.insert(words.hash, words.first[1:], END)
    return t, np.repeat(np.arange(len(words.first) - 1), np.diff(words.first) + 1)


class Code:
    """Huffman codes of symbols: for each the nodes passed and the bits taken, as twice the node and the bit."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        parent, side = np.zeros(2 * n - 1, np.int32), np.zeros(2 * n - 1, np.uint8)
        heap = [(int(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        new = n
        while len(heap) > 1:
            (c, i), (d, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = new
            side[j] = 1
            heapq.heappush(heap, (c + d, new))
            new += 1
        nodes, bits, at = [], [], np.arange(n)
        while (at != new - 1).any():
            going = at != new - 1
            nodes.append(np.where(going, parent[at] - n, -1))
            bits.append(side[at])
            at = np.where(going, parent[at], at)
        nodes, bits = np.stack(nodes[::-1], 1), np.stack(bits[::-1], 1)
        used = nodes >= 0
        self.length = used.sum(axis=1)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.steps = (nodes[used] * 2 + bits[used]).astype(np.int32)
        self.rank = np.empty(n, np.int32)  # of the symbols by length, the longest first
        self.rank[np.argsort(-self.length, kind="stable")] = np.arange(n)


def slot(context: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Slots of places in contexts, both multiplied with ``SPREAD``."""
    at = context + place
    at >>= np.uint64(64 - BITS)
    return at.view(np.int64)


class Vocabulary:
    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rest: int):
        order = np.argsort(hashes)
        self.hash, self.count = hashes[order], counts[order]
        # Where the hashes with the same first bits begin, one or two for every word.
        self.shift = np.uint64(64 - len(hashes).bit_length())
        self.begin = np.searchsorted(self.hash, np.arange(1 << 64 - int(self.shift), dtype=np.uint64) << self.shift).astype(np.int32)
        self.code = Code(np.maximum(np.append(self.count, rest), 1))  # the last symbol is the escape

    def symbols(self, t: np.ndarray) -> np.ndarray:
        at = np.minimum(self.begin[t >> self.shift], len(self.hash) - 1).astype(np.int64)
        found = self.hash[at]
        late = np.flatnonzero(found < t)
        while len(late):
            at[late] += 1
            late = late[at[late] < len(self.hash)]
            found[late] = self.hash[at[late]]
            late = late[found[late] < t[late]]
        at[found != t] = len(self.hash)
        return at

    def contexts(self, t: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, hashes of the word before, hashes of the one before that) of all tokens."""
        fresh = np.ones(len(t), bool)
        fresh[1:] = document[1:] != document[:-1]
        one = np.where(fresh, np.uint64(1), np.concatenate([[np.uint64(0)], t[:-1]]))
        two = np.where(fresh, np.uint64(2), np.concatenate([[np.uint64(0)], one[:-1]]))
        return self.symbols(t), mix(one), mix(two + np.uint64(77))

    def word_decisions(self, symbols: np.ndarray, one: np.ndarray, two: np.ndarray):
        """For each depth in the codes (number of tokens that are as deep, bit, slots of the three predictors). Tokens come by rank,
        so that those as deep are the first ones; ``one`` and ``two`` are multiplied with ``SPREAD``."""
        start, length = self.code.start[symbols], self.code.length[symbols]
        for depth, n in enumerate(np.searchsorted(-length, -np.arange(length[0])).tolist()):
            step = self.code.steps[start[:n] + depth].astype(np.int64)
            node = step >> 1
            place = node.view(np.uint64) * STRIDE
            yield n, step & 1, (node, slot(one[:n], place), slot(two[:n], place))


NODE = np.arange(256, dtype=np.uint64) * STRIDE


def spelling(words: Words, which: np.ndarray, ends: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes a..b of the spelt words, one after the other, each with an end byte: (word's place in ``which`` of each byte, byte in
    context). ``ends`` are the words' ends in that row of bytes. A byte in context is one number of the byte, lowest, and the
    five before in its word, most recent first; all decisions of the byte follow from it."""
    place = np.arange(a, b)
    owner = np.searchsorted(ends, place, "right")
    begin = words.start[which]
    n = words.end[which] - begin + 1
    at = place - (ends - n)[owner]
    begin = begin[owner]
    spelt = np.where(at == n[owner] - 1, 32, words.bytes[np.minimum(begin + at, len(words.bytes) - 1)]).astype(np.uint64)
    for k in range(1, ORDERS[-1] + 1):
        spelt |= np.where(at >= k, words.bytes[np.maximum(begin + at - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    return owner, spelt


def seen_by(spelt: np.ndarray, k: int) -> np.ndarray:
    """Of bytes in context what the predictor with ``k`` bytes before sees."""
    return spelt & np.uint64((1 << 8 * (k + 1)) - 1)


def byte_context(spelt: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` bytes before, multiplied with ``SPREAD``."""
    return mix((seen_by(spelt, k) >> np.uint64(8)) + np.uint64(k << 48)) * SPREAD


def byte_place(byte: np.ndarray, depth: int) -> np.ndarray:
    return NODE[1 << depth | byte >> 8 - depth]


def byte_decisions(spelt: np.ndarray):
    """For each depth in the bytes (bit, slots of the three predictors)."""
    byte = (spelt & np.uint64(255)).astype(np.int64)
    contexts = [byte_context(spelt, k) for k in ORDERS]
    for depth in range(8):
        place = byte_place(byte, depth)
        yield byte >> 7 - depth & 1, tuple(slot(c, place) for c in contexts)


def read(words: Words, chosen: np.ndarray, vocab: Vocabulary):
    """Tokens of the chosen documents of a chunk, their documents and symbols, an iterator over the decisions of words (see
    ``decided``), and one over the spelt bytes: (document of each byte, byte in context), ``PIECE`` bytes at a time."""
    t, d = tokens(words)
    word_at = np.insert(np.arange(len(words.hash)), words.first[1:], -1)
    if not chosen.all():
        use = chosen[d]
        t, d, word_at = t[use], d[use], word_at[use]
    symbols, one, two = vocab.contexts(t, d)
    rare = np.flatnonzero((symbols == len(vocab.hash)) & (word_at >= 0))

    def coded():
        # Ranks with their places sort faster than places by rank.
        order = vocab.code.rank[symbols].astype(np.int64) << 32 | np.arange(len(t))
        order.sort()
        order &= (1 << 32) - 1
        for i in range(0, len(t), PIECE):
            here = order[i: i + PIECE]
            document = d[here]
            for depth, (n, bit, slots) in enumerate(vocab.word_decisions(symbols[here], one[here] * SPREAD, two[here] * SPREAD)):
                yield 0, document[:n], depth, bit, slots, min(depth // 2, DEPTHS - 1)

    def spelt():
        which = word_at[rare]
        ends = np.cumsum(words.end[which] - words.start[which] + 1)
        for i in range(0, int(ends[-1]) if len(ends) else 0, PIECE):
            # Only the words that these bytes belong to.
            j, k = np.searchsorted(ends, [i, min(i + PIECE, ends[-1]) - 1], "right")
            before = int(ends[j - 1]) if j else 0
            owner, byte = spelling(words, which[j: k + 1], ends[j: k + 1] - before, i - before, min(i + PIECE, int(ends[-1])) - before)
            yield d[rare[j: k + 1]][owner], byte

    return t, d, symbols, coded(), spelt()


def decided(words: Words, chosen: np.ndarray, vocab: Vocabulary):
    """Tokens of the chosen documents of a chunk, their documents and symbols, and an iterator over their decisions:
    (0 for words or 1 for spelt bytes, document of each decision, depth, bit, slots of the three predictors, gate), all of one
    depth of ``PIECE`` tokens or bytes at a time; those of depth 0 come first and with the deeper ones' tokens in front."""
    t, d, symbols, coded, spelt = read(words, chosen, vocab)

    def pieces():
        yield from coded
        for document, byte in spelt:
            for depth, (bit, slots) in enumerate(byte_decisions(byte)):
                yield 1, document, depth, bit, slots, depth

    return t, d, symbols, pieces()


class Spelt:
    """Spelt bytes gathered over chunks, so that equal ones are worked on once: full after ``size`` bytes."""

    def __init__(self, size: int):
        self.size, self.held, self.owner, self.byte, self.documents = size, 0, [], [], 0

    def add(self, pieces, first: int = 0) -> None:
        """Pieces of ``read``; ``first`` is added to the documents."""
        for document, byte in pieces:
            self.owner.append(document + first)
            self.byte.append(byte)
            self.held += len(byte)

    def full(self) -> bool:
        return self.held >= self.size

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, byte in context) of all that was added since."""
        out = (np.concatenate(self.owner), np.concatenate(self.byte)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.held, self.owner, self.byte, self.documents = 0, [], [], 0
        return out


def less_own(own_at: np.ndarray, few: np.ndarray, level_of: np.ndarray) -> np.ndarray:
    """Levels of decisions (document, slot and bit in one number) whose slots' counts are in ``few``, without those of their document,
    all decisions of which at these slots are among them."""
    places = len(own_at).bit_length()
    if int(own_at.max()).bit_length() + places < 64:
        # Numbers with their places sort faster than places by number.
        ranked = own_at << places | np.arange(len(own_at))
        ranked.sort()
        order = ranked & (1 << places) - 1
        ranked >>= places
    else:
        order = np.argsort(own_at)
        ranked = own_at[order]
    own = (ranked & 1) * 255 + 1  # of a decision that is its document's only one at its slot
    again = np.flatnonzero((ranked[1:] ^ ranked[:-1]) < 2)
    if len(again):
        begin = again[np.diff(again, prepend=-2) > 1]
        n = again[np.diff(again, append=len(ranked) + 1) > 1] + 2 - begin
        start = np.cumsum(n) - n
        several = np.repeat(begin - start, n) + np.arange(n.sum())
        ones = np.add.reduceat(ranked[several] & 1, start)
        own[several] = np.repeat((n - ones) | ones << 8, n)
    level = np.empty(len(own_at), np.uint8)
    ranked >>= 1
    ranked &= (1 << BITS) - 1
    level[order] = level_of[few[ranked] - own]
    return level


def without_own(words: Words, chosen: np.ndarray, vocab: Vocabulary, known: list[tuple[np.ndarray, np.ndarray]], level_of: np.ndarray, apart: Spelt | None = None):
    """Decisions of the chosen documents of a chunk, in pieces: (0 for words or 1 for spelt bytes, levels without the
    document's own counts, gate, bit). Spelt bytes are added to ``apart`` instead, if given, unless the chunk is one long document.

    ``known`` has for each predictor the levels of its slots, or ``FEW``, and ``few`` of these (see there); ``level_of``
    the level for each value of ``few``.
    """
    def pieces(decisions):
        for k, doc, _, bit, slots, gate in decisions:
            out = []
            own = doc << BITS + 1 | bit
            for j, s in enumerate(slots):
                x = known[3 * k + j][0][s]
                at = np.flatnonzero(x == FEW)
                out.append((3 * k + j, x, at, own[at] | s[at] << 1))
            yield k, gate, bit.astype(np.uint8), out

    if len(chosen) == 1 and len(words.bytes) > LONG:
        # One long document: two walks over its pieces.
        own = [np.zeros(2 * len(x), np.uint8) for x, _ in known]
        for *_, out in pieces(decided(words, chosen, vocab)[3]):
            for j, _, _, at in out:
                np.add.at(own[j], at, np.uint8(1))  # a slot of ``FEW`` cannot overflow
        for k, gate, bit, out in pieces(decided(words, chosen, vocab)[3]):
            for j, x, at, s in out:
                x[at] = level_of[known[j][1][s >> 1] - own[j].view(np.uint16)[s >> 1]]
            yield k, [x for _, x, *_ in out], gate, bit
        return
    if apart is None:
        found = list(pieces(decided(words, chosen, vocab)[3]))
    else:
        _, _, _, coded, spelt = read(words, chosen, vocab)
        found = list(pieces(coded))
        apart.add(spelt, apart.documents)
        apart.documents += len(chosen)
    for j in range(len(known)):
        here = [o for *_, out in found for o in out if o[0] == j]
        if not sum(len(o[2]) for o in here):
            continue
        level = less_own(np.concatenate([o[3] for o in here]), known[j][1], level_of)
        ends = np.cumsum([len(o[2]) for o in here])
        for (_, x, where, _), part in zip(here, np.split(level, ends[:-1])):
            x[where] = part
    for k, gate, bit, out in found:
        yield k, [x for _, x, *_ in out], gate, bit


def counted_decisions(chunks_of, vocab: Vocabulary) -> list[np.ndarray]:
    """The predictors' tables, both outcomes' counts of each slot, over (words, chosen documents) of chunks."""
    n = len(vocab.code.length)
    tables = [np.zeros(2 * (size or n), np.uint32) for size in SIZES]
    times = np.zeros(n, np.uint32)
    held = Spelt(SPELT)

    def count_spelt():
        seen, n = np.unique(held.taken()[1], return_counts=True)
        for j in (2, 1, 0):
            # What a predictor sees is part of what the one after it sees.
            seen, where = np.unique(seen_by(seen, ORDERS[j]), return_inverse=True)
            n = np.bincount(where, weights=n).astype(np.uint32)
            for i in range(0, len(seen), PIECE):
                here = seen[i: i + PIECE]
                byte, context = (here & np.uint64(255)).astype(np.int64), byte_context(here, ORDERS[j])
                for depth in range(8):
                    np.add.at(tables[3 + j], slot(context, byte_place(byte, depth)) << 1 | byte >> 7 - depth & 1, n[i: i + PIECE])

    waiting = [], []

    def count_coded():
        # One table after the other, as each about fills a cache.
        for table, found in zip(tables[1:3], waiting):
            for s in found:
                np.add.at(table, s, np.uint32(1))
            found.clear()

    for words, chosen in chunks_of:
        _, _, symbols, coded, spelt = read(words, chosen, vocab)
        np.add.at(times, symbols, np.uint32(1))
        for _, _, _, bit, slots, _ in coded:
            for found, s in zip(waiting, slots[1:]):
                s = s << 1
                s |= bit
                found.append(s)
            if len(waiting[0]) >= WAITING:
                count_coded()
        count_coded()
        for piece in spelt:
            held.add([piece])
            if held.full():
                count_spelt()
    count_spelt()
    # The first predictor's counts are those of the codes' symbols.
    code = vocab.code
    for i in range(0, n, 1 << 14):
        here = slice(i, i + (1 << 14))
        at = slice(code.start[i], code.start[i] + int(code.length[here].sum()))
        np.add.at(tables[0], code.steps[at].astype(np.int64), np.repeat(times[here], code.length[here]))
    return tables


def cell_of(x: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
    """Cells of the levels of the three predictors and the outcome."""
    at = x[0] * np.uint16(WIDE)
    at += x[1]
    at = at * np.uint32(WIDE * 2)
    at += x[2] * np.uint8(2) + bit  # 82 values
    return at.astype(np.int64)


def counted_levels(chunks_of, vocab: Vocabulary, known: list[tuple[np.ndarray, np.ndarray]], level_of: np.ndarray) -> np.ndarray:
    """[words or bytes, cell] decisions by gate, the predictors' levels and outcome over (words, chosen documents) of chunks."""
    cells = np.zeros((2, DEPTHS, WIDE ** 3 * 2), np.int64)
    held = Spelt(SPELT // 4)  # decisions without own counts are in memory together

    def count_spelt():
        for gate, x, bit, n in spelt_levels(*held.taken(), known[3:], level_of):
            np.add.at(cells[1, gate], cell_of(x, bit), n)

    for words, chosen in chunks_of:
        for k, x, gate, bit in without_own(words, chosen, vocab, known, level_of, held):
            np.add.at(cells[k, gate], cell_of(x, bit), 1)
        if held.full():
            count_spelt()
    count_spelt()
    return cells.reshape(2, -1)


def spelt_levels(document: np.ndarray, byte: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]], level_of: np.ndarray):
    """Decisions of spelt bytes of whole documents, in pieces: (gate, levels without the document's own counts, bit, number of them)."""
    if not len(byte):
        return
    order = np.argsort(byte)
    ranked = byte[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    times = np.diff(begin, append=len(ranked))
    seen = ranked[begin]
    document = document[order]
    open_ = [[] for _ in range(8)]
    for i in range(0, len(seen), PIECE):
        n = times[i: i + PIECE]
        for depth, (bit, slots) in enumerate(byte_decisions(seen[i: i + PIECE])):
            bit = bit.astype(np.uint8)
            x = [k[0][s] for k, s in zip(known, slots)]
            own = (x[0] == FEW) | (x[1] == FEW) | (x[2] == FEW)
            at = np.flatnonzero(~own)
            yield depth, [y[at] for y in x], bit[at], n[at]
            # Where own counts matter, each byte by itself.
            at = np.flatnonzero(own)
            which = np.repeat(at, n[at])
            start = begin[i + at]
            there = document[np.repeat(start - np.cumsum(n[at]) + n[at], n[at]) + np.arange(len(which))]
            open_[depth].append((there, bit[which], [y[which] for y in x], [s[which] for s in slots]))
    parts = [(depth, *part) for depth, found in enumerate(open_) for part in found]
    for j, (_, few) in enumerate(known):
        at = [np.flatnonzero(x[j] == FEW) for *_, x, _ in parts]
        if sum(map(len, at)):
            level = less_own(np.concatenate([there[a] << BITS + 1 | s[j][a] << 1 | bit[a] for a, (_, there, bit, _, s) in zip(at, parts)]), few, level_of)
            for a, (*_, x, _), part in zip(at, parts, np.split(level, np.cumsum([len(a) for a in at])[:-1])):
                x[j][a] = part
    for depth, _, bit, x, _ in parts:
        yield depth, x, bit, 1


def few(n: np.ndarray) -> np.ndarray:
    """Both outcomes' counts in one number, the second in the high byte; larger ones than ``MANY`` do not fit."""
    n = np.minimum(n, MANY).astype(np.uint16)
    return n[..., 0] | n[..., 1] << 8


def sparse(n: np.ndarray) -> tuple[bytes | None, bytes]:
    """(places, counts at them) of what is not 0 in a piece of a table, or (None, all counts) if that is shorter. Counts
    take as few bytes each as the largest one needs; a piece has fewer than 65,536 counts."""
    kind = np.min_scalar_type(int(n.max(initial=0)))
    at = np.flatnonzero(n)
    if (2 + kind.itemsize) * len(at) < kind.itemsize * len(n):
        return pack(at.astype(np.uint16)), pack(n[at].astype(kind))
    return None, pack(n.astype(kind))


def add_sparse(total: np.ndarray, at: bytes | None, n: bytes) -> None:
    where = slice(None) if at is None else np.frombuffer(at, np.uint16)
    places = len(total) if at is None else len(where)
    if places:
        total[where] += np.frombuffer(n, f"u{len(n) // places}").astype(np.int64)


def logs(n: np.ndarray) -> np.ndarray:
    """Log odds of rows of both outcomes' counts."""
    return np.log((n[..., 1] + np.float32(0.4)) / (n[..., 0] + np.float32(0.4))).astype(np.float32)


def levels(x: np.ndarray) -> np.ndarray:
    """Levels of log odds, from 0; the middle one is that of 0."""
    size = np.minimum(np.floor(5 * np.arcsinh(2 * np.abs(x))) + 1, LEVELS)
    return (np.where(x == 0, 0, np.sign(x) * size) + LEVELS).astype(np.uint8)


def middles() -> np.ndarray:
    """The log odds that stand for each level."""
    at = np.arange(-LEVELS, LEVELS + 1)
    return np.where(at == 0, 0, np.sign(at) * np.sinh((np.abs(at) - 0.5) / 5) / 2)


class Mixer:
    """Weights by gate over three predictors and a constant, and the map that refines their result."""

    def __init__(self):
        self.weights = np.tile(np.array([0.5, 0.4, 0.2, 0.0], np.float32), (GATES, 1))
        self.seen = np.zeros((GATES, MAP))
        self.ones = np.zeros((GATES, MAP))

    @staticmethod
    def gates(gate: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
        return gate * 4 + (x[1] == 0) * 2 + (x[2] == 0)

    def odds(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        w = self.weights.T
        return np.clip(x[0] * w[0][gate] + x[1] * w[1][gate] + x[2] * w[2][gate] + w[3][gate], -12, 12)

    def slopes(self, x: list[np.ndarray], gate: np.ndarray, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """[gate, statistic] of ``n`` decisions at each x, ``ones`` of them 1: slope and curvature of the log likelihood
        at the weights, and the number of decisions."""
        gate = self.gates(gate, x)
        inputs = [*x, np.full(len(n), 0.3)]
        p = 1 / (1 + np.exp(-self.odds(x, gate).astype(np.float64)))
        wrong, sway = ones - n * p, n * p * (1 - p)
        rows = [wrong * v for v in inputs] + [sway * inputs[i] * inputs[j] for i in range(4) for j in range(i, 4)] + [n]
        return np.stack([np.bincount(gate, weights=v, minlength=GATES) for v in rows], 1)

    def step(self, found: np.ndarray) -> None:
        """One Newton step from added slopes; ``HOLD`` keeps gates with few decisions near their weights."""
        at = np.triu_indices(4)
        for g in np.flatnonzero(found[:, -1]):
            curve = np.zeros((4, 4))
            curve[at] = curve.T[at] = found[g, 4:14]
            move = np.linalg.solve(curve + HOLD * np.eye(4), found[g, :4])
            self.weights[g] += np.clip(move, -1, 1).astype(np.float32)

    def fit(self, counted: np.ndarray) -> None:
        """Weights and map from the decisions by depth, levels of the three predictors and outcome."""
        counted = counted.reshape(-1, 2).astype(np.float64)
        at = np.flatnonzero(counted.sum(axis=1))
        gate, *level = np.unravel_index(at, (DEPTHS, WIDE, WIDE, WIDE))
        x, n, ones = [middles()[i] for i in level], counted[at].sum(axis=1), counted[at, 1]
        for _ in range(STEPS):
            self.step(self.slopes(x, gate, n, ones))
        gate = self.gates(gate, x)
        at = gate * MAP + self.cell(self.odds(x, gate))
        self.seen, self.ones = (np.bincount(at, weights=w, minlength=GATES * MAP).reshape(GATES, MAP) for w in (n, ones))

    @staticmethod
    def cell(s: np.ndarray) -> np.ndarray:
        return np.rint((s + 12) * ((MAP - 1) / 24)).astype(np.int64)

    def log10s(self) -> np.ndarray:
        """[gate, log odds in steps of 1 / FINE from -12, bit]: log10 of the bit's probability."""
        s = np.arange(24 * FINE + 1) / FINE - 12
        p = 1 / (1 + np.exp(-s))
        centre = 1 / (1 + np.exp(-(np.arange(MAP) * 24 / (MAP - 1) - 12)))
        refined = ((self.ones + 20 * centre) / (self.seen + 20))[:, self.cell(s)]
        p = np.clip(0.5 * p + 0.5 * refined, 1e-6, 1 - 1e-6)
        return np.log10(np.stack([1 - p, p], 2)).astype(np.float32)

    def fine(self, x: list[np.ndarray], gate: int, bit: np.ndarray) -> np.ndarray:
        """Places of decisions of one gate in ``log10s``, all in one row."""
        w = self.weights[4 * gate: 4 * gate + 4]
        s = x[0] * w[0, 0]
        s += x[1] * w[0, 1]
        s += x[2] * w[0, 2]
        s += w[0, 3]
        new = x[1] == 0
        new |= x[2] == 0
        at = np.flatnonzero(new)
        g = (x[1][at] == 0) * np.int64(2) + (x[2][at] == 0)
        s[at] = x[0][at] * w[g, 0] + x[1][at] * w[g, 1] + x[2][at] * w[g, 2] + w[g, 3]
        np.clip(s, -12, 12, out=s)
        s += 12
        s *= FINE
        place = np.rint(s, out=s).astype(np.int64)
        place += gate * 4 * (24 * FINE + 1)
        place[at] += g * (24 * FINE + 1)
        place <<= 1
        place |= bit
        return place


def summed_scores(decisions, odds: list[np.ndarray], mixers: list[Mixer], log10s: list[np.ndarray], documents: int) -> np.ndarray:
    """The documents' sums over their decisions (see ``decided``)."""
    out, owner, each = np.zeros(documents), np.zeros(0, np.int64), np.zeros(0)
    for k, doc, depth, bit, slots, gate in decisions:
        found = log10s[k][mixers[k].fine([odds[3 * k + j][s] for j, s in enumerate(slots)], gate, bit)]
        if depth:
            each[: len(doc)] += found
        else:
            out += np.bincount(owner, weights=each, minlength=documents)
            owner, each = doc, found.astype(np.float64)
    return out + np.bincount(owner, weights=each, minlength=documents)


def spelt_scores(byte: np.ndarray, odds: list[np.ndarray], mixer: Mixer, log10s: np.ndarray) -> np.ndarray:
    """The sums of spelt bytes over their eight decisions; equal bytes in context have equal ones."""
    seen, where = np.unique(byte, return_inverse=True)
    out = np.zeros(len(seen))
    for i in range(0, len(seen), PIECE):
        for depth, (bit, slots) in enumerate(byte_decisions(seen[i: i + PIECE])):
            out[i: i + PIECE] += log10s[mixer.fine([o[s] for o, s in zip(odds, slots)], depth, bit)]
    return out[where]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession

    def parts(batch):
        hasher = Hasher()
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        learnt, held = training(np.array(batch.column(0).to_pylist(), object), null)
        data, offsets = text_buffers(batch.column(1))
        for first, last in chunks(offsets, 200_000):
            yield first, last, Words(hasher, data, offsets, first, last, True), learnt[first:last], held[first:last], np.diff(offsets[first: last + 1])

    def learnt_of(batches):
        for batch in batches:
            for _, _, words, learnt, *_ in parts(batch):
                yield words, learnt

    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions_of(docs), size // 40 // BUCKET + 1)

    def count(batches):
        for batch in batches:
            seen = []
            for _, _, words, learnt, *_ in parts(batch):
                t, d = tokens(words)
                seen.append(t[learnt[d]])
            t, n = np.unique(np.concatenate(seen or [np.zeros(0, np.uint64)]), return_counts=True)
            bucket = (t >> np.uint64(5)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            t, n, bucket = t[order], n[order], bucket[order].astype(np.int64)
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*at[1:], len(t)]
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[at]), pa.array([pack(t[i:j]) for i, j in zip(at, ends)], pa.binary()),
                pa.array([pack(n[i:j]) for i, j in zip(at, ends)], pa.binary())], ["bucket", "word", "n"])

    def summed(table: pa.Table) -> pa.Table:
        t, where = np.unique(unpack(table["word"], np.uint64), return_inverse=True)
        n = np.bincount(where, weights=unpack(table["n"], np.int64)).astype(np.int64)
        # Candidates for the model: no word outside a bucket's first WORDS can be among the first of all.
        return pa.table({"bucket": table["bucket"][:1], "word": [pack(t)], "n": [pack(n)], "distinct": [len(t)], "total": [int(n.sum())], "ends": [int(n[t == END].sum())]})

    counts = written(plain.mapInArrow(count, "bucket long, word binary, n binary").groupBy("bucket").applyInArrow(
        summed, "bucket long, word binary, n binary, distinct long, total long, ends long"), "counts")
    distinct, total, ends = (x or 0 for x in counts.agg(F.sum("distinct"), F.sum("total"), F.sum("ends")).first())

    def unfold(batches):
        for batch in batches:
            t, n = unpack(batch.column(0), np.uint64), unpack(batch.column(1), np.int64)
            many = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(t[many].view(np.int64)), pa.array(n[many])], ["word", "n"])

    best = counts.select("word", "n").mapInArrow(unfold, "word long, n long").orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    hashes, frequent = best["word"].to_numpy().view(np.uint64), best["n"].to_numpy()
    if not (hashes == END).any():
        hashes, frequent = np.append(hashes, END), np.append(frequent, ends)
    vocabulary = Vocabulary(hashes, frequent, total - int(frequent.sum()))
    shared = spark.sparkContext.broadcast(vocabulary)
    sizes = [len(vocabulary.code.length), *SIZES[1:]]

    def gather(batches):
        tables = counted_decisions(learnt_of(batches), shared.value)
        task = TaskContext.get().partitionId()
        for i, t in enumerate(tables):
            at, n = zip(*(sparse(x.ravel()) for x in np.array_split(t.reshape(-1, 2), 64)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(64) + i * 64), pa.array(np.full(64, task // some)), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["piece", "part", "at", "n"])

    def total_of(table: pa.Table) -> np.ndarray:
        i, j = divmod(table["piece"][0].as_py(), 64)
        total = np.zeros(2 * (sizes[i] // 64 + (j < sizes[i] % 64)), np.int64)
        for at, n in zip(table["at"], table["n"]):
            add_sparse(total, at.as_py(), n.as_py())
        return total

    def added(table: pa.Table) -> pa.Table:
        at, n = sparse(total_of(table))
        return pa.table({"piece": table["piece"][:1], "part": table["part"][:1], "at": pa.array([at], pa.binary()), "n": pa.array([n], pa.binary())})

    def learned(table: pa.Table) -> pa.Table:
        n = total_of(table).reshape(-1, 2)
        return pa.table({"piece": table["piece"][:1], "odds": [pack(logs(n))], "few": [pack(few(n))], "levels": [pack(np.where((n <= MANY).all(axis=1), np.uint8(FEW), levels(logs(n))))]})

    # Tables of the tasks are added in two steps, so that no group grows with more than the root of their number.
    some = max(1, int((size // SPLIT_BYTES + 1) ** 0.5))
    form = "piece long, part long, n binary"
    table_form = "piece long, part long, at binary, n binary"
    partly = plain.mapInArrow(gather, table_form).groupBy("piece", "part").applyInArrow(added, table_form)
    pieces = {r["piece"]: r for r in partly.groupBy("piece").applyInArrow(learned, "piece long, odds binary, few binary, levels binary").collect()}  # as large for any corpus

    def whole(name, kind):
        return [np.frombuffer(b"".join(pieces[i * 64 + j][name] for j in range(64)), kind) if pieces else np.zeros(n, kind) for i, n in enumerate(sizes)]

    odds_of = whole("odds", np.float32)

    # Weights and map: one pass over all training documents, each document without its own counts.
    counts_of = spark.sparkContext.broadcast(list(zip(whole("levels", np.uint8), whole("few", np.uint16))))
    pieces.clear()

    def measure(batches):
        known = counts_of.value
        level_of = levels(logs(np.stack([np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8], 1).astype(np.float32)))
        cells = counted_levels(learnt_of(batches), shared.value, known, level_of)
        task = TaskContext.get().partitionId()
        for k in range(2):
            for j, x in enumerate(np.array_split(cells[k], 64)):
                at = np.flatnonzero(x)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([k * 64 + j]), pa.array([task // some]), pa.array([pack(np.stack([at, x[at]], 1))], pa.binary())], ["piece", "part", "n"])

    def joined(table: pa.Table) -> pa.Table:
        pairs = unpack(table["n"], np.int64).reshape(-1, 2)
        at, where = np.unique(pairs[:, 0], return_inverse=True)
        n = np.zeros(len(at), np.int64)
        np.add.at(n, where, pairs[:, 1])
        return pa.table({"piece": table["piece"][:1], "part": table["part"][:1], "n": [pack(np.stack([at, n], 1))]})

    mixers = [Mixer(), Mixer()]
    cells = plain.mapInArrow(measure, form).groupBy("piece", "part").applyInArrow(joined, form).groupBy("piece").applyInArrow(joined, form)
    counted = np.zeros((2, DEPTHS * WIDE ** 3 * 2), np.int64)
    parts_of = [np.array_split(c, 64) for c in counted]  # views
    for r in cells.select("piece", "n").collect():  # as many cells for any corpus
        at, n = np.frombuffer(r["n"], np.int64).reshape(-1, 2).T
        parts_of[r["piece"] // 64][r["piece"] % 64][at] = n
    for mixer, c in zip(mixers, counted):
        mixer.fit(c)
    counts_of.destroy()
    model = spark.sparkContext.broadcast((odds_of, mixers, [m.log10s().ravel() for m in mixers]))

    def judge(batches):
        rng = np.random.default_rng()
        odds, mixers, log10s = model.value
        log10s = [x.astype(np.float64) for x in log10s]
        log_count, counted = np.append(np.log10(shared.value.count + 0.1), 0.0), np.append(shared.value.count > 0, False).astype(np.float64)
        for batch in batches:
            n = batch.num_rows
            base, score_, known, count_ = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            held_out, size_ = np.zeros(n, bool), np.zeros(n, np.int64)
            vocab = shared.value
            rows, owners, apart = [], [], Spelt(SPELT)

            def add_spelt():
                owner, byte = apart.taken()
                score_[:] += np.bincount(owner, weights=spelt_scores(byte, odds[3:], mixers[1], log10s[1]), minlength=n)

            for first, last, words, learnt, held, nbytes in parts(batch):
                t, d, symbols, decisions, spelt = read(words, np.ones(last - first, bool), vocab)
                here = slice(first, last)
                m = last - first
                held_out[here], size_[here] = held, nbytes
                count_[here] = np.bincount(d, minlength=m)
                base[here] = np.bincount(d, weights=log_count[symbols], minlength=m)
                known[here] = np.bincount(d, weights=counted[symbols], minlength=m)
                score_[here] += summed_scores(decisions, odds, mixers, log10s, m)
                for piece in spelt:
                    apart.add([piece], first)
                    if apart.full():
                        add_spelt()
                rare = symbols == len(vocab.hash)
                rows.append(t[rare])
                owners.append(first + d[rare])
            if not n:
                continue
            add_spelt()
            row = int(rng.integers(1 << 62)) + np.arange(n)
            t, owner = np.concatenate(rows), row[np.concatenate(owners)]
            bucket = ((t >> np.uint64(5)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            t, owner, bucket = t[order], owner[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*at[1:], len(t)]
            m = len(at)
            blank = lambda kind: pa.nulls(m, kind)
            both_of = lambda a, b: pa.concat_arrays([a, b])
            yield pa.RecordBatch.from_arrays([
                both_of(batch.column(0), blank(batch.column(0).type)), both_of(pa.array(row), blank(pa.int64())), both_of(pa.array(held_out), blank(pa.bool_())),
                both_of(pa.array(count_), blank(pa.int64())), both_of(pa.array(known), blank(pa.int64())), both_of(pa.array(base), blank(pa.float64())),
                both_of(pa.array(score_), blank(pa.float64())), both_of(pa.array(size_), blank(pa.int64())),
                both_of(pa.nulls(n, pa.int64()), pa.array(bucket[at])), both_of(pa.nulls(n, pa.binary()), pa.array([pack(t[i:j]) for i, j in zip(at, ends)], pa.binary())),
                both_of(pa.nulls(n, pa.binary()), pa.array([pack(owner[i:j]) for i, j in zip(at, ends)], pa.binary()))],
                ["id", "row", "held_out", "n_tokens", "known", "base", "score", "bytes", "bucket", "word", "owner"])

    kind = dict(plain.dtypes)["id"]
    judged = written(plain.mapInArrow(
        judge, f"id {kind}, row long, held_out boolean, n_tokens long, known long, base double, score double, bytes long, bucket long, word binary, owner binary"), "scores")

    def look_up(asked: pa.Table, told: pa.Table) -> pa.Table:
        t, owner = unpack(asked["word"], np.uint64), unpack(asked["owner"], np.int64)
        words, n = unpack(told["word"], np.uint64), unpack(told["n"], np.int64)
        found = np.zeros(len(t), np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, t), len(words) - 1)
            found = np.where(words[at] == t, n[at], 0)
        rows, where = np.unique(owner, return_inverse=True)
        return pa.table({"r": rows, "k": np.bincount(where, weights=found > 0, minlength=len(rows)).astype(np.int64),
                         "b": np.bincount(where, weights=np.log10(found + 0.1), minlength=len(rows)).astype(np.float64)})

    rest = judged.where("bucket IS NOT NULL").select("bucket", "word", "owner").groupBy("bucket").cogroup(
        counts.select("bucket", "word", "n").groupBy("bucket")).applyInArrow(look_up, "r long, k long, b double").groupBy("r").agg(
        F.sum("k").alias("k"), F.sum("b").alias("b"))
    below = float(np.log10(total + 0.1 * (distinct + 1)))
    return judged.where("row IS NOT NULL").join(rest, F.col("row") == F.col("r"), "left").select(
        F.col("id").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"))
