"""Document fingerprints by SimHash, in DataFrame functions only.

The terms of a text are its pairs of neighbouring words, and its last word; a term weighs one, and one more for each of
its words that is longer than three characters. Each term hash votes with its weight on 64 signed bits. Votes are
counted four bits to a number: a sum of ``hash >> i & 0x0001000100010001`` holds the votes of bits i, i+16, i+32 and
i+48, and blocks of terms are short enough that no count runs over into the next. So a term costs sixteen
additions in generated code, whatever its text, and a long text is many blocks.

``within`` finds all fingerprints within a Hamming radius by permuted block tables: the bits are cut into blocks, and
two fingerprints that differ in at most ``radius`` bits agree in all but ``radius`` of the blocks; one table for each
choice of blocks brings its blocks to the front, as the key by which queries meet fingerprints; a pair counts only
in the first table in which it meets.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmap.llm.common import words
from corpusmap.scratch import Tables

BITS = 64
LANES = 16
# Terms of a block; their weights sum to less than 2^16.
TERMS = 8192
LONG_WORD = 3
RADIUS = 3
BLOCKS = 6


def _lane(hashed: str, i: int) -> Column:
    return F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(0x0001000100010001))


def simhash(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and ``fp``, the fingerprint of each row as a signed 64-bit number; the keys must tell rows apart.

    A text without words has fingerprint zero. Where ``texts`` is partitioned by one of the keys, nothing is shuffled.
    """
    found = words(F.coalesce(F.col(text_col), F.lit("")))
    split = texts.select(*keys, found.alias("_words"))
    pairs = split.select(
        *keys, F.posexplode_outer(F.arrays_zip("_words", F.slice("_words", 2, 2**31 - 1).alias("_next")))
    )
    first, second = F.col("col")["_words"], F.col("col")["_next"]
    weight = 1 + F.when(F.length(first) > LONG_WORD, 1).otherwise(0) + F.when(F.length(second) > LONG_WORD, 1).otherwise(0)
    terms = pairs.select(
        *keys,
        F.floor(F.coalesce("pos", F.lit(0)) / TERMS).cast("int").alias("block"),
        F.when(first.isNull(), 0).otherwise(weight).cast("bigint").alias("w"),
        F.xxhash64(first, second).alias("h"),
    )
    blocks = terms.groupBy(*keys, "block").agg(
        F.sum("w").alias("total"), *[F.sum(_lane("h", i) * F.col("w")).alias(f"s{i}") for i in range(LANES)]
    )
    counts = blocks.groupBy(*keys).agg(
        F.sum("total").alias("total"),
        *[
            F.sum(F.shiftrightunsigned(f"s{i}", LANES * k).bitwiseAND(F.lit(0xFFFF))).alias(f"b{i + LANES * k}")
            for k in range(BITS // LANES)
            for i in range(LANES)
        ],
    )
    bits = [F.when(F.col(f"b{i}") * 2 > F.col("total"), F.lit(_signed(1 << i))).otherwise(0) for i in range(BITS)]
    return counts.select(*keys, reduce(Column.bitwiseOR, bits).alias("fp"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def likeness(a: str, b: str) -> Column:
    """The share of bits in which two fingerprints agree."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / BITS


def successors(ids: DataFrame, tables: Tables) -> DataFrame:
    """``(doc_id, next_id)`` for distinct ids: the next larger one, and for the largest the smallest.

    Ids are sorted by range; only the first id of each range comes to the driver, one for each shuffle partition.
    """
    ranged = ids.repartitionByRange("doc_id").select("*", F.spark_partition_id().alias("part"))
    ranged = tables.save(ranged, "ranges")
    heads = sorted(
        (r["part"], r["head"]) for r in ranged.groupBy("part").agg(F.min("doc_id").alias("head")).collect()
    )
    following = {part: heads[(k + 1) % len(heads)][1] for k, (part, _) in enumerate(heads)}
    # Without ids there are no ranges.
    pairs = F.create_map(*[F.lit(x) for item in following.items() for x in item]) if following else F.lit(None)
    within = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    after = pairs[F.col("part")] if following else pairs.cast(ids.schema["doc_id"].dataType)
    return ranged.withColumn("within", within).select(
        *ids.columns, F.coalesce("within", after).alias("next_id")
    )


def edited_texts(docs: DataFrame, tables: Tables) -> DataFrame:
    """``docs`` with ``edited``: the last quarter of each text replaced by the start of the next document's.

    Only these starts are sent to the documents before, and both joins read one exchange of the texts, so that a text
    moves once and a quarter. Ids must not be null.
    """
    take = F.floor(F.length("text") / 4).cast("int")
    ids = docs.select("doc_id", take.alias("take"))
    ids = successors(ids.groupBy("doc_id").agg(F.max("take").alias("take")), tables)
    ids = tables.save(ids, "successors")
    wanted = ids.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), "take")
    starts = docs.join(wanted.hint("shuffle_hash"), "doc_id").select(
        F.col("before").alias("doc_id"), F.substring("text", F.lit(1), F.col("take")).alias("start")
    )
    starts = starts.groupBy("doc_id").agg(F.min("start").alias("start"))
    return docs.join(starts, "doc_id", "left").select(
        *docs.columns,
        F.concat(
            F.substring("text", F.lit(1), F.length("text") - take),
            F.substring(F.coalesce("start", F.lit("")), F.lit(1), take),
        ).alias("edited"),
    )


def table_keys(fp: str, radius: int = RADIUS, blocks: int = BLOCKS) -> list[Column]:
    """The front blocks of a fingerprint in each permuted table."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [_signed(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]
    return [
        F.col(fp).bitwiseAND(F.lit(reduce(int.__or__, chosen)))
        for chosen in combinations(masks, blocks - radius)
    ]


def within(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(query, fp)``: for each distinct query fingerprint every distinct fingerprint within the radius.

    ``queries`` has a column ``query``, ``fps`` a column ``fp``; a query's own value is among the results if it is
    among ``fps``. A null fingerprint is near nothing.
    """

    def tabled(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(t).alias("table"), k.alias("key")) for t, k in enumerate(table_keys(name, radius, blocks))]
        return df.select(name, F.inline(F.array(*keys)))

    q = tabled(queries.filter("query IS NOT NULL").select("query").distinct(), "query")
    f = tabled(fps.filter("fp IS NOT NULL").select("fp").distinct(), "fp")
    met = q.join(f, ["table", "key"]).filter(F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius)
    agree = [a == b for a, b in zip(table_keys("query", radius, blocks), table_keys("fp", radius, blocks))]
    first = reduce(lambda rest, t: F.when(agree[t], t).otherwise(rest), reversed(range(len(agree))), F.lit(-1))
    return met.filter(F.col("table") == first).select("query", "fp")


def _both_sides(rows: DataFrame) -> DataFrame:
    """The fingerprints of ``text`` and ``edited`` of each row."""
    rows = rows.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array("text", "edited").alias("texts"),
    )
    keys = ["doc_id", "row", "n_chars", "edited_sha256"]
    found = simhash(rows.select(*keys, F.posexplode("texts").alias("side", "text")), [*keys, "side"])
    return found.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"),
    )


def document_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", query: Column | None = None, radius: int = RADIUS
) -> DataFrame:
    """Fingerprints of each text and of its edited text, their likeness, and that to the next document.

    ``(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next, n_near)``; ``n_near`` counts the other
    distinct fingerprints within the radius, for the documents that ``query`` selects, and is null for the rest.

    Defined cases: a null text counts as empty; rows with equal ids are fingerprinted each, with one next document,
    whose smallest start and fingerprint count if its id is repeated; a row with a null id has no next document
    (``near_next`` is null and its edited text just shorter); a single document is its own next; empty tables give
    no rows.
    """
    tables = Tables(docs.sparkSession, "fingerprints")
    # An alias to the same name would be dropped on one side of the joins only, and the exchanges would differ.
    own_id = F.col(id_col) if id_col == "doc_id" else F.col(id_col).alias("doc_id")
    plain = docs.select(own_id, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The filter is the one that joins by id add, or the exchange would differ.
    edited = edited_texts(plain.filter("doc_id IS NOT NULL"), tables)
    cut = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) AS int))")
    lone = plain.filter("doc_id IS NULL").withColumn("edited", cut)
    both = _both_sides(edited).unionByName(_both_sides(lone))
    both = tables.save(both.drop("row"), "fingerprints")
    after = tables.spark.read.parquet(f"{tables.base}/successors").select("doc_id", "next_id")
    nexts = both.groupBy("doc_id").agg(F.min("fp").alias("next_fp"))
    nexts = after.join(nexts.withColumnRenamed("doc_id", "next_id"), "next_id").select("doc_id", "next_fp")
    made = both.join(nexts, "doc_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp",
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
        *([query.alias("_query")] if query is not None else []),
    )
    if query is None:
        return made
    near = within(made.filter("_query").select(F.col("fp").alias("query")), both, radius)
    near = near.groupBy(F.col("query").alias("fp")).agg((F.count("*") - 1).alias("_near"))
    return made.join(near, "fp", "left").select(
        *[c for c in made.columns if c != "_query"], F.when(F.col("_query"), F.col("_near")).alias("n_near")
    )
