"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they do not know.

The patterns give the base spans, which always stay. The field tags the tokens of a chunk (a run without white space) as
begin, inside or outside of a secret, from their shape (lengths, kinds of letters and changes between them, how unusual
their letter pairs are in all texts), the neighbouring tokens and words, and features of the whole text. Tokens, features and
scores are arrays over all texts of a batch; Viterbi decodes every chunk in which a bound does not prove that all outside
is best, so that the decoding is exact. White space ends a secret, so that each chunk is a chain of its own. Of a field
span that meets base spans the rest is kept.

The field is trained on pieces of texts of about ``FIT_CHARS`` characters in all, chosen by a hash among the pieces of all
texts. Labels are the secret parts of base spans, and made-up secrets of many kinds that are set into the pieces, bare or after words
and signs that the patterns do not know. Of the plain chunks of words a share of ``FIT_PLAIN`` is trained on.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned each; empty tables give no rows. A row
keeps its other columns, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.bpe import WHITE_SPACE, _texts, chunks
from corpusmap.llm.common import map_rows

# The base patterns, in the order of their kinds. Minimum lengths are part of the patterns where a match
# can't end earlier than its run.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_VALUE = 6

OUTSIDE, BEGIN, INSIDE = range(3)
FIT_CHARS = 16_000_000
FIT_PLAIN = 1 / 16
# Characters of a piece of a text that is trained on, and how many of them hold one made-up secret on average.
PIECE, PER_PLANT = 16_384, 400
EPOCHS, CHAINS = 8, 512
# Tokens of a chunk that are trained on at once; decoding takes chunks whole.
LONGEST = 48
SEED = 5

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """``(start, end, kind)`` of the base patterns."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def secret_values(text: str) -> list[tuple[int, int]]:
    """The parts of the base spans that are secret: of an assignment its value."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    return found + [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)]


WHITE, SMALL, CAPITAL, DIGIT, LETTER, LINE, SIGN = range(7)
# Letters of the pairs: 26, digits, the underscore, five classes of other letters, signs; the last is the edge of a token.
PAIR_LETTERS = 35
ASSIGNED = 0x32400


def code_point_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point its kind, its letter of the pairs, and its lower case."""
    kinds, letters = np.full(0x110000, SIGN, np.uint8), np.full(0x110000, 33, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(ASSIGNED):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            kinds[c] = {"Lu": CAPITAL, "Ll": SMALL}.get(kind, LETTER)
            low = ord(chr(c).lower()[0])
            lower[c] = low
            letters[c] = low - 97 if 97 <= low < 123 else 28 + low % 5
        elif kind[0] == "N":
            kinds[c], letters[c] = DIGIT, 26
    kinds[list(WHITE_SPACE)] = WHITE
    kinds[ord("_")], letters[ord("_")] = LINE, 27
    return kinds, letters, lower


class Tokens:
    """The tokens of some texts as arrays: runs of letters, digits and underscores, and runs of one sign."""

    TABLES: list = []
    POWERS: list = []

    def __init__(self, texts: list[str]) -> None:
        if not self.TABLES:
            self.TABLES.extend(code_point_tables())
        kinds, letters, lower = self.TABLES
        joined = "\n".join(texts) + "\n"
        self.begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.points, self.kind, self.letter = points, kinds[points], letters[points]
        kind = self.kind
        solid, sign = kind != WHITE, kind == SIGN
        before = np.append(True, ~solid[:-1])
        same = np.append(False, (sign[1:] == sign[:-1]) & (~sign[1:] | (points[1:] == points[:-1])))
        opens = solid & (before | ~same)
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(solid & (np.append(~solid[1:], True) | np.append(opens[1:], True))) + 1
        self.chunk = np.cumsum(solid & before)[self.start] - 1
        self.text = np.searchsorted(self.begins, self.start, side="right") - 1
        self.size = self.end - self.start
        # A hash of the first twelve letters in lower case, by sums over the whole batch.
        while len(self.POWERS) < 2:
            self.POWERS.append(np.ones(1, np.uint64))
        if len(self.POWERS[0]) <= len(points):
            for k, base in enumerate((0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64))):
                grown = np.full(len(points) + 1, base, np.uint64)
                grown[0] = 1
                self.POWERS[k] = np.multiply.accumulate(grown)
        up, down = self.POWERS
        sums = np.append(np.uint64(0), np.cumsum((lower[points].astype(np.uint64) + np.uint64(1)) * up[: len(points)]))
        mixed = (sums[np.minimum(self.end, self.start + 12)] - sums[self.start]) * down[self.start]
        self.name = ((mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(52)).astype(np.int64)

    def count(self, of: np.ndarray) -> np.ndarray:
        """How many characters of each token are marked."""
        sums = np.append(0, np.cumsum(of, dtype=np.int64))
        return sums[self.end] - sums[self.start]

    def pairs(self) -> np.ndarray:
        """The pair of letters that begins at each character but the last."""
        return self.letter[:-1].astype(np.int64) * PAIR_LETTERS + self.letter[1:]


def pair_counts(texts: list[str]) -> np.ndarray:
    """How often each pair of letters stands in the words of some texts."""
    made = Tokens(texts)
    word = (made.kind[:-1] != WHITE) & (made.kind[1:] != WHITE) & (made.kind[:-1] != SIGN) & (made.kind[1:] != SIGN)
    return np.bincount(made.pairs()[word], minlength=PAIR_LETTERS**2)


def surprise(counts: np.ndarray) -> np.ndarray:
    """For each pair how unusual its second letter is after the first, in bits."""
    table = counts.reshape(PAIR_LETTERS, PAIR_LETTERS) + 0.5
    return (-np.log2(table / table.sum(1, keepdims=True))).ravel()


# Numbers of values of the feature templates, in order; names of tokens have 4,096.
TEMPLATES = (1, 24 * 16, 8 * 8, 16 * 8, 8 * 8, 4096, 4096, 4096, 4096, 4096, 32, 16 * 8 * 2, 24 * 16, 24 * 4, 8 * 4, 8 * 4)
BASES = np.cumsum((0, *TEMPLATES))
FEATURES = int(BASES[-1])


def _log_size(n: np.ndarray, top: int) -> np.ndarray:
    """Lengths in up to ``top`` classes, two to each doubling."""
    return np.minimum((2 * np.log2(np.maximum(n, 1))).astype(np.int64), top - 1)


def features(t: Tokens, unusual: np.ndarray) -> np.ndarray:
    """The features of every token: one value of each template."""
    n = len(t.start)
    if not n:
        return np.zeros((0, len(TEMPLATES)), np.int32)
    counts = {k: t.count(t.kind == k) for k in (SMALL, CAPITAL, DIGIT, LETTER, SIGN)}
    letters = counts[SMALL] + counts[CAPITAL] + counts[LETTER]
    has = [(c > 0).astype(np.int64) for c in (counts[SMALL], counts[CAPITAL], counts[DIGIT], counts[LETTER] + counts[SIGN])]
    look = has[0] + 2 * has[1] + 4 * has[2] + 8 * has[3]
    size, short = np.minimum(t.size, 23), _log_size(t.size, 16) // 2
    changes = np.append(0, np.cumsum(np.append(False, t.kind[1:] != t.kind[:-1]), dtype=np.int64))
    changes = changes[t.end] - changes[t.start + 1]
    bits = np.append(0.0, np.cumsum(np.append(unusual[t.pairs()], 0.0)))
    mean = (bits[t.end - 1] - bits[t.start]) / np.maximum(t.size - 1, 1)
    odd = np.clip((mean * 2).astype(np.int64), 0, 15)
    at = np.arange(n)
    known = np.where(sign_or_short(t, letters), t.name, 0)

    def beside(step: int, value: np.ndarray) -> np.ndarray:
        j = at + step
        inside = (j >= 0) & (j < n)
        j = np.clip(j, 0, n - 1)
        return np.where(inside & (t.text[j] == t.text), value[j], 0)

    # The last word before a token, past signs and other tokens.
    word = (letters == t.size) & (t.size > 1)
    last = np.maximum.accumulate(np.where(word, at, -1))
    last = np.append(-1, last[:-1])
    near = (last >= 0) & (at - last <= 4) & (t.text[last] == t.text)
    first = np.append(True, t.chunk[1:] != t.chunk[:-1])
    opens = np.flatnonzero(first)
    tokens = np.diff(np.append(opens, n))
    begin, close = t.start[opens], t.end[np.append(opens[1:] - 1, n - 1)]
    length = np.repeat(_log_size(close - begin, 16), tokens)
    many = np.repeat(np.minimum(tokens, 8) - 1, tokens)
    # The whole text: its length, and its shares of digits and signs.
    ends = np.append(t.begins[1:], len(t.points))
    total = np.maximum(ends - t.begins, 1)
    digits = np.add.reduceat((t.kind == DIGIT).astype(np.int64), t.begins) * 20 // total
    signs = np.add.reduceat((t.kind == SIGN).astype(np.int64), t.begins) * 20 // total
    own = (t.size >= 12) + 2 * has[2]
    values = (
        np.zeros(n, np.int64), size * 16 + look, np.minimum(changes, 7) * 8 + short, odd * 8 + short,
        (8 * counts[DIGIT] // (t.size + 1)) * 8 + short, known, beside(-1, known), beside(-2, known), beside(1, known),
        np.where(near, t.name[last], 0), np.minimum(at - np.maximum.accumulate(np.where(first, at, 0)), 15) * 2 + first,
        (length * 8 + many) * 2 + has[2], beside(-1, size * 16 + look),
        np.minimum(np.log2(total).astype(np.int64), 23)[t.text] * 4 + own,
        np.minimum(digits, 7)[t.text] * 4 + own, np.minimum(signs, 7)[t.text] * 4 + own,
    )
    return np.stack([v + b for v, b in zip(values, BASES)], axis=1).astype(np.int32)


def sign_or_short(t: Tokens, letters: np.ndarray) -> np.ndarray:
    """Tokens that are known by name: signs, and words of up to twelve letters."""
    return (letters == t.size) & (t.size <= 12) | (t.kind[t.start] == SIGN)


@dataclass
class Field:
    """Weights of a linear-chain field over the three tags, and how unusual pairs of letters are."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 3)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    unusual: np.ndarray = field(default_factory=lambda: surprise(np.zeros(PAIR_LETTERS**2)))
    trained: bool = False

    # Nothing is inside that does not follow a beginning or an inside.
    BARRED = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]], float)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The scores of each token's tags."""
        out = np.zeros((*rows.shape[:-1], 3))
        for k in range(rows.shape[-1]):
            out += self.emit[rows[..., k]]
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags of a chain that is preceded and followed by outside."""
        steps = self.step + self.BARRED
        best = steps[OUTSIDE] + scores[0]
        back = []
        for s in scores[1:]:
            options = best[:, None] + steps
            back.append(options.argmax(0))
            best = options.max(0) + s
        tag = int((best + steps[:, OUTSIDE]).argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1]

    def open_chunks(self, scores: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """The chunks in which a beginning may win: the gains of all tokens, with the best steps, are not negative in sum."""
        steps = self.step + self.BARRED
        rest = steps[OUTSIDE, OUTSIDE]
        gain = scores[:, BEGIN:].max(1) - scores[:, OUTSIDE] + steps[1:, 1:].max() - rest
        ends = steps[OUTSIDE, BEGIN] + steps[BEGIN:, OUTSIDE].max() - rest - steps[1:, 1:].max()
        # Several secrets in a chunk each pay for their ends, which costs nothing only if that is a gain itself.
        each = np.maximum(gain + max(ends, 0.0), 0.0)
        return np.flatnonzero(np.add.reduceat(each, opens) + min(ends, 0.0) > -1e-9) if len(opens) else opens

    def learn(self, chains: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Maximise the likelihood of tagged chains by AdaGrad; chains of one length are a batch."""
        rng = np.random.default_rng(SEED)
        by_length: dict[int, list[int]] = {}
        for i, (rows, _) in enumerate(chains):
            by_length.setdefault(len(rows), []).append(i)
        groups = [(np.stack([chains[i][0] for i in ids]), np.stack([chains[i][1] for i in ids])) for ids in by_length.values()]
        seen_emit, seen_step = np.full_like(self.emit, 1e-6), np.full_like(self.step, 1e-6)
        for _ in range(EPOCHS):
            batches = []
            for g, (rows, _) in enumerate(groups):
                order = rng.permutation(len(rows))
                batches += [(g, order[k : k + CHAINS]) for k in range(0, len(order), CHAINS)]
            for k in rng.permutation(len(batches)):
                g, ids = batches[k]
                emit, step = self._slopes(groups[g][0][ids], groups[g][1][ids])
                emit += 1e-3 * self.emit
                seen_emit += emit * emit
                self.emit -= 0.2 * emit / np.sqrt(seen_emit)
                seen_step += step * step
                self.step -= 0.2 * step / np.sqrt(seen_step)
        self.trained = True

    def _slopes(self, rows: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected less observed counts, by the forward-backward sums of chains of equal length."""
        n, length = tags.shape
        s = self.scores(rows)
        steps = self.step + self.BARRED
        forward, backward = np.zeros((length, n, 3)), np.zeros((length, n, 3))
        forward[0] = steps[OUTSIDE] + s[:, 0]
        for t in range(1, length):
            forward[t] = np.logaddexp.reduce(forward[t - 1][:, :, None] + steps, axis=1) + s[:, t]
        backward[-1] = steps[:, OUTSIDE]
        for t in range(length - 2, -1, -1):
            backward[t] = np.logaddexp.reduce(steps + (s[:, t + 1] + backward[t + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(forward[-1] + backward[-1], axis=1)
        marginal = np.exp(forward + backward - total[:, None])
        step = np.zeros_like(self.step)
        step[OUTSIDE] += marginal[0].sum(0)
        step[:, OUTSIDE] += marginal[-1].sum(0)
        for t in range(1, length):
            pair = forward[t - 1][:, :, None] + steps + (s[:, t] + backward[t])[:, None, :] - total[:, None, None]
            step += np.exp(pair).sum(0)
        path = np.hstack([np.zeros((n, 1), int), tags, np.zeros((n, 1), int)])
        np.subtract.at(step, (path[:, :-1].ravel(), path[:, 1:].ravel()), 1)
        off = marginal.transpose(1, 0, 2).copy()
        np.put_along_axis(off, tags[:, :, None], np.take_along_axis(off, tags[:, :, None], 2) - 1, 2)
        flat = rows.reshape(-1, rows.shape[-1])
        emit = np.stack([
            np.bincount(flat.ravel(), np.repeat(off[:, :, k].ravel(), flat.shape[1]), FEATURES) for k in range(3)], axis=1)
        return emit, step


# Alphabets and beginnings of made-up secrets, and what may stand before them.
ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=.",
)
BEGINNINGS = ("", "", "", "", "", "xoxb-", "eyJ", "AIza", "pk_test_", "glpat-")
BEFORE = ("", "", "", "", "credentials: ", "auth=", "key ", "access_key = ", "pin is ", "Basic ", "signature: ", "login ", "'")


def planted(text: str, seed: int) -> tuple[str, list[tuple[int, int]]]:
    """A text with made-up secrets at some of its gaps, and where the secrets are; the same for the same text."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed))
    gaps = [m.end() for m in re.finditer(r"\s+", text)]
    if not gaps:
        return text, []
    out, spans, at, size = [], [], 0, 0
    for gap in sorted(set(rng.choice(gaps, min(len(gaps), 1 + len(text) // PER_PLANT)).tolist())):
        letters = ALPHABETS[rng.integers(len(ALPHABETS))]
        value = "".join(letters[i] for i in rng.integers(len(letters), size=rng.integers(14, 48)))
        value = BEGINNINGS[rng.integers(len(BEGINNINGS))] + (value.strip("-_+/=.") or "q")
        lead = BEFORE[rng.integers(len(BEFORE))]
        out += [text[at:gap], lead, value, " "]
        size += gap - at + len(lead)
        spans.append((size, size + len(value)))
        size += len(value) + 1
        at = gap
    return "".join(out) + text[at:], spans


def chains_of(texts: list[str], unusual: np.ndarray, plain: float = 1.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training chains of some texts, tagged by the base patterns, and of the same texts with made-up secrets.

    ``plain`` is the share of the chunks of words without digit or secret that are taken, the first time.
    """
    for turn, part in ((0, [(x, secret_values(x)) for x in texts]), (1, [planted(x, SEED) for x in texts])):
        if not part:
            continue
        t = Tokens([x for x, _ in part])
        rows = features(t, unusual)
        tags = np.zeros(len(rows), np.int64)
        for k, (x, found) in enumerate(part):
            known = found if not turn else found + secret_values(x)
            for a, b in known:
                own = slice(*np.searchsorted(t.start, (t.begins[k] + a, t.begins[k] + b)))
                inside = np.flatnonzero(t.end[own] <= t.begins[k] + b) + own.start
                tags[inside] = INSIDE
                tags[inside[:1]] = BEGIN
        if not len(rows):
            continue
        opens = np.flatnonzero(np.append(True, t.chunk[1:] != t.chunk[:-1]))
        close = np.append(opens[1:], len(rows))
        secret = np.add.reduceat(tags, opens) > 0
        strange = np.add.reduceat(t.count(t.kind == DIGIT) + (t.size > 12), opens) > 0
        share = (t.name[opens] * 2654435761 + t.start[opens] * 40503) % 65536 < plain * 65536
        take = secret | share | strange if not turn else secret
        for a, b in zip(opens[take].tolist(), close[take].tolist()):
            for j in range(a, b, LONGEST):
                if tags[j] != INSIDE:
                    end = min(b, j + LONGEST)
                    yield rows[j:end], tags[j:end]


def count_pairs(docs: DataFrame) -> np.ndarray:
    """The pairs of letters in all texts: one sum per pair and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIR_LETTERS**2, np.int64)
        for batch in batches:
            for part in chunks(_texts(batch.column(0))):
                total += pair_counts(part)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    out = np.zeros(PAIR_LETTERS**2)
    rows = docs.select("text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in rows.collect():
        out[r["pair"]] = r["n"]
    return out


def train(docs: DataFrame, fit_chars: int = FIT_CHARS) -> Field:
    """A field trained on a sample of the pieces of all texts; only their chains reach the driver, as packed numbers."""
    unusual = surprise(count_pairs(docs))
    chars = docs.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    share = min(1.0, fit_chars / max(chars, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in _texts(batch.column(0)):
                for a in range(0, len(text), PIECE):
                    piece = text[a : a + PIECE]
                    key = xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), a)
                    if key < share * 2**64:
                        found = list(chains_of([piece], unusual, FIT_PLAIN))
                        if found:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([np.uint64(key).view(np.int64)]),
                                 pa.array([np.concatenate([r for r, _ in found]).astype(np.int32).tobytes()], pa.binary()),
                                 pa.array([np.concatenate([g for _, g in found]).astype(np.uint8).tobytes()], pa.binary()),
                                 pa.array([np.array([len(g) for _, g in found], np.uint8).tobytes()], pa.binary())],
                                names=["key", "features", "tags", "sizes"],
                            )

    # Equal pieces have equal chains, and say no more together than one.
    rows = docs.select("text").mapInArrow(run, "key bigint, features binary, tags binary, sizes binary").dropDuplicates(["key"])
    chains = []
    for r in sorted(rows.collect(), key=lambda r: r["key"]):
        cells = np.frombuffer(r["features"], np.int32).reshape(-1, len(TEMPLATES))
        tags = np.frombuffer(r["tags"], np.uint8).astype(np.int64)
        cuts = np.cumsum(np.frombuffer(r["sizes"], np.uint8))[:-1]
        chains += zip(np.split(cells, cuts), np.split(tags, cuts))
    made = Field(unusual=unusual)
    if any(BEGIN in tags for _, tags in chains):
        made.learn(chains)
    return made


def field_spans(texts: list[str], model: Field) -> list[list[tuple[int, int]]]:
    """The spans that the field tags in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    t = Tokens(texts)
    if not model.trained or not len(t.start):
        return out
    scores = model.scores(features(t, model.unusual))
    opens = np.flatnonzero(np.append(True, t.chunk[1:] != t.chunk[:-1]))
    close = np.append(opens[1:], len(t.start))
    for c in model.open_chunks(scores, opens).tolist():
        a, b = int(opens[c]), int(close[c])
        tags = model.viterbi(scores[a:b])
        k = 0
        while k < len(tags):
            if tags[k] == OUTSIDE:
                k += 1
                continue
            first = k
            k += 1
            while k < len(tags) and tags[k] == INSIDE:
                k += 1
            row, begin = int(t.text[a]), int(t.begins[t.text[a]])
            out[row].append((int(t.start[a + first]) - begin, int(t.end[a + k - 1]) - begin))
    return out


def _outside(start: int, end: int, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """The parts of a stretch that meet none of the spans."""
    for a, b, _ in sorted(spans):
        if start < a < end:
            yield start, a
        if a < end and start < b:
            start = max(start, b)
    if start < end:
        yield start, end


def scan_all(texts: list[str], model: Field) -> list[list[Span]]:
    """All spans of each text, by start and kind: the base spans, and of those of the field what is outside of them."""
    out = []
    for part in chunks(texts):
        for text, more in zip(part, field_spans(part, model)):
            base = base_spans(text)
            found = base + [(x, y, "crf") for a, b in more for x, y in _outside(a, b, base)]
            out.append(sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))
    return out


def scan(text: str, model: Field) -> list[Span]:
    """All spans of one text."""
    return scan_all([text], model)[0]


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_chars: int = FIT_CHARS) -> DataFrame:
    """``(doc_id, spans, redacted)``: spans as an array of (start, end, kind), and the text without its secrets."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, fit_chars))
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = list(_texts(part.column(1)))
                found = scan_all(texts, model)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in f] for f in found], pa.list_(span)),
                        pa.array([redact(t, f) for t, f in zip(texts, found)], pa.string()),
                    ],
                    names=["doc_id", "spans", "redacted"],
                )

    schema = f"doc_id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>, redacted string"
    return docs.mapInArrow(run, schema)


def redact_documents(docs: DataFrame, fit_chars: int = FIT_CHARS) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) with secrets replaced in the texts, and ``n_chars``, if any, set anew.

    A null text becomes an empty one; repeated rows stay as many; an empty table stays empty; other columns stay as they are.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs.select("text"), fit_chars))
    names = docs.columns

    def each():
        model = shipped.value

        def change(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            columns = list(batch.columns)
            clean = [redact(t, f) for t, f in zip(texts, scan_all(texts, model))]
            columns[names.index("text")] = pa.array(clean, batch.schema.field("text").type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array(map(len, clean), batch.schema.field("n_chars").type)
            return pa.RecordBatch.from_arrays(columns, names=names)

        return change

    return map_rows(docs, each)
