"""Toxicity of deobfuscated text: a noisy channel, decoded by Viterbi under a character language model.

1. A character trigram model is counted over all documents: 128 symbols, so at most 128^3 counts, whatever the data.
2. Every chunk of a text that may be disguised becomes a lattice. A digit or sign may stand for a letter it resembles, or
   for itself; a sign or blank between letters may be a word's end or be put in to split it; a letter like the one
   before may be a repetition. Viterbi finds the reading of least cost under channel and language model.
3. A lexicon is learned from restored words and their prefixes on a sample of labelled rows of at most ``FIT_ROWS``,
   chosen by a hash of the id: features that go with toxicity beyond chance among all features looked at, and then, in
   turn, the feature that explains most toxic documents not yet explained, as long as its precision is high. Near
   copies count about once, by the distinct values of a few min-hashes, so that rare words of a copied text stay out.
4. Texts are scored by the features of their restored words: one minus the chance that none of them means it.

Decoding is cached by chunk within a task; the cache is bounded. Defined cases: null and empty texts get the score of
a text without lexicon words; repeated rows are scored each; ids without a label and labels without a document
do not matter; without usable labels every score is the base rate; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate
from math import log, sqrt
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.bpe import _texts
from corpusmap.llm.common import held_out, training_sample
from corpusmap.scratch import Tables

# Which letters a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "µ": "u",
    "*": "abcdefghijklmnopqrstuvwxyz", "#": "h", "%": "o", "&": "a",
}
SYMBOLS = 128
BOUNDARY, DIGIT, FOREIGN = 0, 1, 2
LATIN = 0x250
# Signs that may end a word, and seldom stand for a letter there.
CLOSING = "!*#%&"
MASKS = "*#%&"
# Costs of the channel, in nats: a letter shown by a sign; a sign put in; a letter doubled, or repeated more often; a digit
# as itself; a word ended by a sign for a letter, or by another sign between letters; and where single characters are set
# apart, a separator put in and one that ends a word.
SUBSTITUTED, SPLIT, DOUBLED, REPEATED, DIGIT_SELF, ENDED, BETWEEN = 1.5, 2.5, 3.0, 0.5, 2.3, 5.0, 1.0
SPACED_SPLIT, SPACED_END = 0.5, 7.0
# With so many doubled letters in a chunk, doubling counts as repetition.
OFTEN = 3
# A feature is taken at once if it goes with toxicity by chance less often than once in so many cases.
CHANCE = 1e8
SKETCH = 8
FIT_ROWS = 40_000
PREFIXES = (4, 5, 6, 7, 8)
# The lower confidence bound of a feature's precision must exceed this.
PRECISION = 0.5
CACHED = 300_000
# Characters on either side among which doubled letters are counted, and after which settled text leaves the states.
NEAR = 64
# A wider gap between single characters, in the runs that are decoded.
WIDE = "\t"


def symbol_table() -> tuple[np.ndarray, dict[str, int]]:
    """The symbol of each code point below ``LATIN``, and of each letter; case is folded."""
    table = np.full(LATIN, BOUNDARY, np.uint8)
    number: dict[str, int] = {}
    for c in range(LATIN):
        low = chr(c).lower()
        if chr(c).isalpha() and len(low) == 1:
            table[c] = number.setdefault(low, len(number) + 3) if len(number) + 3 < SYMBOLS else number.get(low, FOREIGN)
        elif chr(c).isdigit():
            table[c] = DIGIT
    return table, number


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(gram, n)``: counts of symbol trigrams over all texts; a word starts after two boundaries."""
    table, _ = symbol_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                ids = table[np.minimum(points, LATIN - 1)].astype(np.int32)
                ids[points >= LATIN] = FOREIGN
                ids = np.concatenate([[0, 0], ids, [0]])
                ids = ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))]
                before, last = np.append([0], ids[:-2]), ids[:-1]
                gram = (np.where(last == 0, 0, before) * SYMBOLS + last) * SYMBOLS + ids[1:]
                seen, n = np.unique(gram, return_counts=True)
                total[seen] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram bigint, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(grams: DataFrame) -> np.ndarray:
    """Costs ``-log P(c | a, b)`` as an array over all trigrams, each order backed by the next lower one.

    Reads at most 128^3 counts, of which a corpus has a small part.
    """
    counts = np.zeros(SYMBOLS**3)
    for r in grams.collect():
        counts[r["gram"]] = r["n"]
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)

    def backed(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        kinds = (c > 0).sum(-1, keepdims=True)
        return (c + np.maximum(kinds, 1) * lower) / (c.sum(-1, keepdims=True) + np.maximum(kinds, 1))

    one = backed(three.sum((0, 1)), np.full(SYMBOLS, 1 / SYMBOLS))
    two = backed(three.sum(0), one)
    return -np.log(backed(three, two)).astype(np.float32)


class Restorer:
    """Restores the words of texts; caches what it has decoded."""

    # Single characters set apart by white space.
    SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
    GAP = re.compile(r"\s+")
    ODD = re.compile(r"[^\W\d_].*[\d_\W].*[^\W\d_]|[\d_\W].*[^\W\d_]{2}|[^\W\d_]{2}.*[\d_\W]|([^\W\d_])\1")
    EDGES = re.compile(r"^[\W_]+|[\W_]+$")
    # Single characters set apart by signs, and undisguised words.
    APART = re.compile(r"^[\W_]*[^\W_](?:[-._,'/~][^\W_]){2,}[\W_]*$")
    PLAIN = re.compile(r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])")
    # All letters of a run but the last.
    DOUBLE = re.compile(r"(.)(?=\1)+")

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs
        _, self.number = symbol_table()
        self.words = Cache(self.evidence)

    def arcs(self, chunk: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """For each character its readings: a letter, a digit, a blank for a word's end, or nothing."""
        out = []
        n = len(chunk)
        # Doubled letters before each character.
        doubled = [0] * (n + 1)
        for m in self.DOUBLE.finditer(chunk):
            doubled[m.start() + 1] = 1
        doubled = list(accumulate(doubled))
        for i, c in enumerate(chunk):
            again = i > 0 and chunk[i - 1] == c
            if again:
                often = doubled[min(n, i + NEAR)] - doubled[max(0, i - NEAR)] >= OFTEN
                more = (i > 1 and chunk[i - 2] == c) or (i + 1 < n and chunk[i + 1] == c)
                repeated = REPEATED if often or more else DOUBLED
            between = 0 < i < n - 1 and chunk[i - 1].isalnum() and chunk[i + 1].isalnum()
            if c.isalpha():
                read = [(c, 0.0)]
            elif c.isdigit():
                read = [(c, DIGIT_SELF)]
            elif spaced and c == WIDE:
                read = [(" ", 0.0), ("", SPLIT)]
            elif spaced and c == " ":
                read = [(" ", SPACED_END), ("", SPACED_SPLIT)]
            else:
                closing = c in CLOSING and not (i + 1 < n and chunk[i + 1].isalnum())
                ends = 0.0 if c not in LOOKALIKES or closing else ENDED
                read = [(" ", max(ends, BETWEEN) if between else ends)]
                if between:
                    read.append(("", SPLIT))
            # Signs that mask or decorate stand for a letter only between two others.
            if between or c not in MASKS:
                read += [(x, SUBSTITUTED) for x in LOOKALIKES.get(c, "")]
            if again:
                read.append(("", repeated))
            out.append(read)
        return out

    def decode(self, chunk: str, spaced: bool = False) -> str:
        """The reading of least cost; words are set apart by blanks."""
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        settled = []
        for i, read in enumerate(self.arcs(chunk, spaced)):
            if i % NEAR == NEAR - 1:
                # What all live readings begin with is settled; without it their order is the same.
                shared = commonprefix([text for _, text in states.values()])
                settled.append(shared)
                states = {k: (cost, text[len(shared) :]) for k, (cost, text) in states.items()}
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in states.items():
                for c, channel in read:
                    if not c or (c == " " and b == BOUNDARY):
                        state, total, made = (a, b), cost + channel, text
                    else:
                        s = BOUNDARY if c == " " else DIGIT if c.isdigit() else self.number.get(c, FOREIGN)
                        total = cost + channel + self.costs.item(a, b, s)
                        state = (0, 0) if s == BOUNDARY else (b, s)
                        made = text + c
                    if state not in after or (total, made) < after[state]:
                        after[state] = (total, made)
            states = after
        last = min((cost + self.costs.item(a, b, 0) * (b != 0), text) for (a, b), (cost, text) in states.items())[1]
        return "".join(settled) + last

    def _read(self, chunk: str) -> tuple[str, ...]:
        apart = bool(self.APART.search(chunk))
        if apart:
            chunk = re.sub(r"[\W_]", " ", chunk)
        return tuple(map(self._settled, self.decode(chunk, apart).split()))

    def _settled(self, word: str) -> str:
        """A restored word as it reads where nothing is disguised."""
        doubled = self.DOUBLE.findall(word)
        return self._undoubled(word) if word.isalpha() and len(doubled) == 1 else word

    def word(self, chunk: str) -> tuple[str, ...]:
        """The restored words of a chunk without white space."""
        bare = self.EDGES.sub("", chunk)
        if not (self.ODD.search(bare) or (bare != chunk and self._signs(chunk))):
            return (bare,) if bare else ()
        if bare.isalpha() and len(doubled := self.DOUBLE.findall(bare)) == 1 and len(doubled[0]) == 1:
            return (self._undoubled(bare),)
        return self._read(chunk)

    def evidence(self, chunk: str) -> tuple[str, ...]:
        """The restored words of a chunk, and those that stand undisguised beside signs, however the whole is read."""
        read = self.word(chunk)
        return read if chunk.isalpha() else tuple(dict.fromkeys((*read, *self.PLAIN.findall(chunk))))

    def _undoubled(self, word: str) -> str:
        """A word with one doubled letter: decoding it compares just two readings, which differ around the letter."""
        at = self.DOUBLE.search(word).start()
        s = [0, 0, *(self.number.get(c, FOREIGN) for c in word), 0]
        a, b, c, d = s[at + 1 : at + 5]
        cost = self.costs.item
        kept = cost(a, b, c) + cost(b, c, d)
        single = cost(a, b, d) + DOUBLED
        if d:
            kept += cost(c, d, s[at + 5])
            single += cost(b, d, s[at + 5])
        return word[:at] + word[at + 1 :] if single < kept else word

    def _signs(self, chunk: str) -> bool:
        """Whether a chunk begins with a sign that may stand for a letter, or has one before its last character."""
        return chunk[0] in LOOKALIKES or any(c in LOOKALIKES for c in chunk[1:-1] if not c.isalnum())

    def spaced(self, text: str) -> list[str]:
        """The runs of single characters in a text, decoded whole; gaps wider than a run's least are likely word ends."""
        out = []
        for m in self.SPACED.finditer(text):
            least = min(len(g) for g in self.GAP.findall(m[0]))
            run = self.GAP.sub(lambda g: WIDE if len(g[0]) > least else " ", m[0])
            out.append(" ".join(map(self._settled, self.decode(run, True).split())))
        return out

    def restore(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        text = text.lower()
        found = {w for words in map(self.words.__getitem__, set(text.split())) for w in words}
        return found.union(*(run.split() for run in self.spaced(text)))


class Cache(dict):
    """Values of a function by their argument; emptied when full."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        if len(self) >= CACHED:
            self.clear()
        value = self[key] = self.make(key)
        return value


def features(words: set[str]) -> set[str]:
    """A restored text's features: its words, and the beginnings of longer words."""
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def lower_bound(hits: float, n: float, z: float = 1.64) -> float:
    """The lower bound of Wilson's interval for a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn(sample: DataFrame, costs: np.ndarray) -> tuple[dict[str, float], float]:
    """Lexicon ``{feature: chance of toxicity}`` and the chance without any of them.

    Copies of a text count once. What comes to the driver is bounded by the sample: the features of its toxic texts.
    """
    spark = sample.sparkSession
    shipped = spark.sparkContext.broadcast(costs)
    sample = sample.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).agg(
        F.first("text").alias("text"), F.max("label").alias("label")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shipped.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                words = [restorer.restore(t) for t in _texts(part.column(0))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([sorted(features(w)) for w in words], pa.list_(pa.string())),
                        pa.array([min_hashes(w) for w in words], pa.list_(pa.int64())),
                        part.column(1),
                    ],
                    names=["features", "sketch", "label"],
                )

    tables = Tables(spark, "toxicity")
    made = tables.save(
        sample.select("text", "label").mapInArrow(run, "features array<string>, sketch array<bigint>, label int"),
        "features",
    )
    sizes = made.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("hits")).first()
    if not sizes["hits"] or sizes["hits"] == sizes["n"]:
        return {}, sizes["hits"] / sizes["n"] if sizes["n"] else 0.0
    counts = made.select(F.explode("features").alias("feature"), "label").groupBy("feature").agg(
        F.count("*").alias("n"), F.sum("label").alias("hits")
    )
    seen = {r["feature"]: (r["hits"], r["n"]) for r in counts.filter("hits >= 3 AND hits * 2 > n").toLocalIterator()}
    toxic, having, sketches = [], defaultdict(list), []
    for k, r in enumerate(made.filter("label = 1").select("features", "sketch").toLocalIterator()):
        toxic.append(set(r["features"]) & seen.keys())
        sketches.append(r["sketch"])
        for f in toxic[-1]:
            having[f].append(k)
    rate = sizes["hits"] / sizes["n"]
    chance, strong = {}, []
    for f, (hits, n) in seen.items():
        # Near copies count about once.
        apart = sum(len({sketches[k][j] for k in having[f]}) for j in range(SKETCH)) / SKETCH
        total = apart + n - hits
        if lower_bound(apart, total) > PRECISION:
            chance[f] = (apart + 0.5) / (total + 1)
            share = apart / total
            other = (1 - share) * log((1 - share) / (1 - rate)) if share < 1 else 0.0
            if total * (share * log(share / rate) + other) > log(CHANCE):
                strong.append(f)
    # The surest first; one that clean texts have as well must hold on toxic texts without a surer one.
    lexicon, left = {}, set(range(len(toxic)))
    for f in sorted(strong, key=lambda f: (-chance[f], -len(f), f)):
        clean = seen[f][1] - seen[f][0]
        rest = len(left.intersection(having[f]))
        if not clean or lower_bound(rest, rest + clean) > PRECISION:
            lexicon[f] = chance[f]
            left.difference_update(having[f])
    new = Counter(f for k in left for f in toxic[k] & chance.keys())
    while new:
        # Ties go to the longer feature, then by name.
        f = max(new, key=lambda x: (new[x], len(x), x))
        if new[f] < 2:
            break
        clean = seen[f][1] - seen[f][0]
        if clean and lower_bound(new[f], new[f] + clean) <= PRECISION:
            del new[f], chance[f]
            continue
        lexicon[f] = chance[f]
        for k in left.intersection(having[f]):
            new.subtract(toxic[k] & chance.keys())
        left.difference_update(having[f])
        new = Counter({x: c for x, c in new.items() if c > 0})
    clean = sizes["n"] - sizes["hits"]
    return lexicon, (len(left) + 0.5) / (len(left) + clean + 1)


def min_hashes(words: set[str]) -> list[int]:
    """A sketch by which texts of nearly the same words are mostly equal."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in words] or [0], np.uint64)
    return [int((h * np.uint64(2 * j + 1) ^ (h >> np.uint64(31 - j))).min() >> np.uint64(1)) for j in range(SKETCH)]


def score(docs: DataFrame, costs: np.ndarray, lexicon: dict[str, float], base: float) -> DataFrame:
    """``(doc_id, score, n_toxic_words)`` of whole texts."""
    shipped = docs.sparkSession.sparkContext.broadcast((costs, lexicon))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, known = shipped.value
        restorer = Restorer(costs)

        # Every feature of a word begins like the word.
        heads = {f.rstrip("*")[: min(PREFIXES)] for f in known}

        def matched(words: Iterable[str]) -> tuple[str, ...]:
            likely = {w for w in words if w[: min(PREFIXES)] in heads}
            return tuple(features(likely) & known.keys()) if likely else ()

        by_chunk = Cache(lambda chunk: matched(restorer.evidence(chunk)))
        for batch in batches:
            scores, counts = [], []
            for text in _texts(batch.column(1)):
                low = text.lower()
                hits = [f for f in map(by_chunk.__getitem__, set(low.split())) if f]
                hits += [f for run in restorer.spaced(low) for w in run.split() if (f := matched((w,)))]
                doubt = 1 - base
                for f in sorted({f for found in hits for f in found}):
                    doubt *= 1 - known[f]
                scores.append(1 - doubt)
                counts.append(len(hits))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())],
                names=["doc_id", "score", "n_toxic_words"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_toxic_words bigint")


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_toxic_words)`` of every document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    costs = language_model(trigram_counts(docs))
    lexicon, base = learn(training_sample(docs, labels, label, fit_rows), costs)
    return score(docs, costs, lexicon, base).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_toxic_words",
    )


def restored(docs: DataFrame, costs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, restored)``: each text with its disguised chunks decoded, words set apart by blanks."""
    shipped = docs.sparkSession.sparkContext.broadcast(costs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shipped.value)
        read = Cache(restorer.word)

        def one(text: str) -> str:
            spaced = restorer.SPACED.sub(lambda m: " ".join(restorer.spaced(m[0])), text.lower())
            return " ".join(w for chunk in spaced.split() for w in read[chunk])

        for batch in batches:
            texts = pa.array([one(t) for t in _texts(batch.column(1))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "restored"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, restored string")
