"""Byte-level BPE encoding and decoding.

Texts are cut into slices without a regular expression. An array of code-point classes turns a batch of texts into
symbols; each symbol is a function on eight automaton states; functions compose associatively, and the few dozen
that arise are numbered, so that a two-level prefix scan with one table look-up per character gives the state at
every position, and with it the slice starts. Slices feed a bounded cache; all slices of a batch that it lacks
are merged together, one pair per slice and round. Each id keeps the offset at which its bytes end, by which
decoding gathers all bytes of a batch at once.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded each; empty tables give no rows;
a text is never cut. Only the named columns are read.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The code points that \s matches, and the endings split off after an apostrophe.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, DIGIT, OTHER, BLANK, WHITE, APOSTROPHE, SEPARATOR = range(7)
# No letters or digits are assigned from here on.
ASSIGNED = 0x32400
BLOCK = 256
# Characters that are classified at once; a longer text is a batch of its own.
CHUNK = 1 << 19
CACHED = 250_000
# Slices of more bytes are merged with a heap.
LONG = 64
NONE = np.int64(1 << 40)


def code_point_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    kinds[:ASSIGNED] = [{"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(ASSIGNED)]
    kinds[list(WHITE_SPACE)] = WHITE
    kinds[0x20] = BLANK
    kinds[ord("'")] = APOSTROPHE
    return kinds


class Automaton:
    """Where slices start, as a scan over composed transition functions.

    States: nothing open, in letters, in digits, in other signs, after a blank that opens a slice, in white space,
    one or two letters before the end of an apostrophe ending.
    """

    IDLE, LETTERS, DIGITS, OTHERS, OPEN, SPACES, LAST, LAST_TWO = range(8)

    def __init__(self) -> None:
        step, opens = self._transitions()
        monoid = [tuple(range(8)), *dict.fromkeys(step)]
        number = {f: i for i, f in enumerate(monoid)}
        for f in monoid:
            for g in step:
                h = tuple(g[x] for x in f)
                if h not in number:
                    number[h] = len(monoid)
                    monoid.append(h)
        size = len(monoid)
        table = [number[tuple(g[x] for x in f)] if tuple(g[x] for x in f) in number else 0 for f in monoid for g in monoid]
        self.compose = np.array(table, np.uint16)
        self.size = size
        self.apply = np.array(monoid, np.uint8).ravel()
        self.of_symbol = np.array([number[f] for f in step], np.uint16)
        self.opens = np.array(opens, bool).T.ravel()
        self.symbols = len(step)

    def _transitions(self) -> tuple[list[tuple[int, ...]], list[list[bool]]]:
        """For each symbol the next state by state, and whether the character opens a slice."""

        def run(state: int, free: tuple[int, ...], else_state: int) -> tuple[tuple[int, ...], list[bool]]:
            return tuple(state if s in free else else_state for s in range(8)), [s not in free for s in range(8)]

        letter = [self.LETTERS] * 8
        letter[self.LAST], letter[self.LAST_TWO] = self.IDLE, self.LAST
        kinds = [
            (tuple(letter), [s not in (self.LETTERS, self.OPEN, self.LAST, self.LAST_TWO) for s in range(8)]),
            run(self.DIGITS, (self.DIGITS, self.OPEN), self.DIGITS),
            run(self.OTHERS, (self.OTHERS, self.OPEN), self.OTHERS),
            run(self.OTHERS, (self.OTHERS, self.OPEN), self.LAST),
            run(self.OTHERS, (self.OTHERS, self.OPEN), self.LAST_TWO),
            ((self.OPEN,) * 8, [True] * 8),
            ((self.IDLE,) * 8, [True] * 8),
            run(self.SPACES, (self.SPACES,), self.SPACES),
            ((self.IDLE,) * 8, [True] * 8),
        ]
        return [k[0] for k in kinds], [k[1] for k in kinds]

    def scan(self, functions: np.ndarray) -> np.ndarray:
        """All prefix compositions, block by block and then over the blocks."""
        n = len(functions)
        rows = -(-n // BLOCK)
        # Function 0 changes nothing.
        block = np.zeros(rows * BLOCK, np.uint16)
        block[:n] = functions
        block = np.ascontiguousarray(block.reshape(rows, BLOCK).T)
        for j in range(1, BLOCK):
            block[j] = self.compose[block[j - 1] * np.uint16(self.size) + block[j]]
        if rows > 1:
            before = np.concatenate([[np.uint16(0)], self.scan(block[-1])[:-1]])
            block = self.compose[before * np.uint16(self.size) + block]
        return block.T.reshape(-1)[:n]

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Whether each character opens a slice."""
        reached = self.apply[self.scan(self.of_symbol[symbols]).astype(np.int32) * 8 + self.IDLE]
        before = np.concatenate([[self.IDLE], reached[:-1]]).astype(np.uint16)
        return self.opens[before * np.uint16(self.symbols) + symbols]


def symbols_of(points: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Automaton symbols of a row of code points, with texts ending at the positions ``ends``."""
    kind = kinds[points]
    kind[ends] = SEPARATOR
    closed = (kind == BLANK) | (kind == WHITE) | (kind == SEPARATOR)
    follows = np.append(closed[1:], True)
    # By class and whether white space or the end follows.
    table = np.array([0, 0, 1, 1, 2, 2, 5, 7, 6, 7, 2, 2, 8, 8], np.uint8)
    symbols = table[kind * np.uint8(2) + follows]
    marks = np.flatnonzero(kind == APOSTROPHE)
    if len(marks):
        padded = np.append(points, [0, 0])
        first, second = padded[marks + 1], padded[marks + 2]
        # A text's end can't be mistaken for a letter: the separator's code point is none.
        one = np.isin(first, [ord(e) for e in ENDINGS if len(e) == 1])
        two = np.zeros(len(marks), bool)
        for e in ENDINGS:
            if len(e) == 2:
                two |= (first == ord(e[0])) & (second == ord(e[1]))
        symbols[marks[one]] = 3
        symbols[marks[two]] = 4
    return symbols


def read_ranks(text: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base 64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, text.splitlines()) if token}


class Encoder:
    """Encodes texts by a rank table; holds its cache for the life of a task."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.automaton = Automaton()
        self.kinds = code_point_classes()
        self.bytes = np.zeros(256, np.int64)
        for b in range(256):
            self.bytes[b] = ranks[bytes([b])]
        self.numbers = {r: r for r in ranks.values()}
        self.cache: dict[str, tuple[int, ...]] = {}
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self._index(np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64), np.array(merged, np.int64))

    def _index(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(int(len(keys) * 4).bit_length(), 4)
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, np.uint64(2**64 - 1))
        self.merged = np.full(1 << bits, NONE)
        self.probes = 0
        place, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = left[self.slots[place[left]] == np.uint64(2**64 - 1)]
            # Of several keys for a slot the last one written stays.
            self.slots[place[free]] = keys[free]
            self.merged[place[free]] = ranks[free]
            left = left[self.slots[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each joined pair, ``NONE`` where there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        place = self._slot(keys)
        found = np.where(self.slots[place] == keys, self.merged[place], NONE)
        for _ in range(1, self.probes):
            open_ = np.flatnonzero((self.slots[place] != keys) & (self.slots[place] != np.uint64(2**64 - 1)))
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & self.mask
            hit = open_[self.slots[place[open_]] == keys[open_]]
            found[hit] = self.merged[place[hit]]
        return found

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """One long slice: the leftmost pair of lowest rank merges, found with a heap."""
        n = len(word)
        ids = [int(self.bytes[b]) for b in word]
        part = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (rank, i, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j], ids[i] = a + b, b"", rank
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(ids[i] for i in range(n) if part[i])

    def merge_all(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of many slices: every round merges one pair in each that still has one."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[tuple[int, ...]] = [()] * len(words)
        short = []
        for k, b in enumerate(raw):
            if len(b) > LONG:
                out[k] = self.merge_long(b)
            else:
                short.append(k)
        lengths = np.array([len(raw[k]) for k in short], np.int64)
        ids = self.bytes[np.frombuffer(b"".join(raw[k] for k in short), np.uint8)]
        owner = np.repeat(np.arange(len(short)), lengths)
        done_ids, done_owner = [], []
        rank = np.full(len(ids), NONE)
        if len(ids):
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.pair_ranks(ids[:-1], ids[1:]), NONE)
        while len(ids):
            n = len(ids)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank << 22 | np.arange(n), first)
            merges = best < NONE << 22
            if not merges.all():
                ended = np.repeat(~merges, np.diff(np.append(first, n)))
                done_ids.append(ids[ended])
                done_owner.append(owner[ended])
                if not merges.any():
                    break
            at = best[merges] & ((1 << 22) - 1)
            ids[at] = rank[at]
            keep = np.repeat(merges, np.diff(np.append(first, n)))
            keep[at + 1] = False
            # Only the pairs on both sides of a merged one have changed.
            at = np.cumsum(keep)[at] - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                left = left[left + 1 < len(ids)]
                rank[left] = np.where(
                    owner[left] == owner[left + 1], self.pair_ranks(ids[left], ids[left + 1]), NONE
                )
            rank[-1] = NONE
        if short:
            owner = np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            flat = np.concatenate(done_ids)[order].tolist()
            ends = np.cumsum(np.bincount(owner, minlength=len(short))).tolist()
            a = 0
            number = self.numbers
            for k, b in zip(short, ends):
                out[k] = tuple([number[x] for x in flat[a:b]])
                a = b
        return out

    def _merged(self, slices: list[str]) -> None:
        """Put all slices into the cache."""
        cache = self.cache
        lacking = list({s for s in slices if s not in cache})
        if len(cache) + len(lacking) > CACHED:
            cache.clear()
            lacking = list(set(slices))
        # The positions of a round must fit 22 bits.
        for k in range(0, len(lacking), 1 << 15):
            part = lacking[k : k + (1 << 15)]
            cache.update(zip(part, self.merge_all(part)))

    def slices(self, texts: list[str]) -> Iterator[list[str]]:
        """The slices of each text."""
        joined = "\0".join(texts) + "\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.flatnonzero(self.automaton.starts(symbols_of(points, self.kinds, ends)))
        cuts = starts.tolist()
        found = [joined[a:b] for a, b in zip(cuts, cuts[1:] + [len(joined)])]
        a = 0
        for b in np.searchsorted(starts, ends).tolist():
            yield found[a:b]
            a = b + 1

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for batch in chunks(texts):
            parts = list(self.slices(batch))
            self._merged(list(chain.from_iterable(parts)))
            look = self.cache.__getitem__
            for part in parts:
                yield list(chain.from_iterable(map(look, part)))


def chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of bounded total length; a longer text is alone."""
    held: list[str] = []
    size = 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


class Decoder:
    """Bytes of ids, gathered by the offsets at which the bytes of each id end."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where the bytes of each id end."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The bytes of all ids."""
        if not len(ids):
            return b""
        begin = np.concatenate([[0], ends[:-1]])
        source = np.repeat(self.starts[ids] - begin, ends - begin)
        return self.flat[source + np.arange(ends[-1])].tobytes()


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file as a broadcast; its size is that of the file, whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _texts(column: pa.Array, rows: int = 256) -> Iterator[str]:
    """The texts of a column, a few rows at a time, so that a batch is never held twice."""
    for a in range(0, len(column), rows):
        for t in column.slice(a, rows).to_pylist():
            yield t or ""


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """``(doc_id, ids, ends)``: each text's ids, and for each id the offset in UTF-8 bytes at which it ends.

    With ``decoded`` the ids are decoded again by their offsets in the same pass, and the bytes come as a column.
    """
    shipped = vocabulary(docs, path)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "ids", "ends"] + ["decoded"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(shipped.value)
        encoder, decoder = Encoder(ranks), Decoder(ranks)
        for batch in batches:
            # Small outputs, so that a batch of long texts stays small as well.
            row = 0
            for part in chunks(_texts(batch.column(1))):
                ids = [np.array(x, np.int32) for x in encoder.encode(part)]
                ends = [decoder.ends(x) for x in ids]
                offsets = pa.array(np.cumsum([0] + [len(x) for x in ids]).astype(np.int32))
                columns = [
                    batch.column(0).slice(row, len(part)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ends).astype(np.int32))),
                ]
                if decoded:
                    columns.append(pa.array([decoder.decode(i, e) for i, e in zip(ids, ends)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                row += len(part)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, ids array<int>, ends array<int>" + ", decoded binary" * decoded
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the bytes of its ids as ``decoded``."""
    shipped = vocabulary(encoded, path)
    schema = f"{encoded.schema.toDDL()}, decoded binary"
    names = [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(read_ranks(shipped.value))
        for batch in batches:
            ids, ends = batch.column(batch.schema.get_field_index("ids")), batch.column(batch.schema.get_field_index("ends"))
            cuts = [0, *np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)).tolist()]
            i, e = ids.flatten().to_numpy(), ends.flatten().to_numpy()
            made = [decoder.decode(i[a:b], e[a:b].astype(np.int64)) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=names)

    return encoded.mapInArrow(run, schema)
