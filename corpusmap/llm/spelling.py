"""Spelling variants: exact neighbours at one edit, by pairs of trie nodes.

The prefixes of all words are the nodes of a trie, their suffixes those of the trie of the reversed words; both are numbered. A word
with one position skipped is the integer pair (node of the prefix before it, node of the suffix after it), and a word
split between two positions is such a pair too. Two words with a skipped pair in common differ by a replacement at that
place, and a word whose split pair is another one's skipped pair lacks just that letter. Of equal letters in a row
only the first is skipped to find deletions, so that each neighbour is met once.

The words of a pair are never paired with each other: a pair keeps how many there are and its two best words, which tells each
of them the number and the best of the others. So a pair is one row, whatever the number of its words. Nodes that
only one word reaches are in no pair of two words and are not numbered, which leaves the few middle places of long words.

Defined cases: a null or empty text has no words; a null id counts as empty text in the hash; repeated rows count each; empty
tables give no rows; ties go to the smaller word in code-point order. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.operators.rank import with_position
from corpusmap.operators.skew import LEAST, SHARE, skew_join
from corpusmap.scratch import Tables

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP, LENGTH, TIMES = 97, 5, 3


def words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP, length: int = LENGTH, times: int = TIMES
) -> DataFrame:
    """``(word, n)``: the runs of letters, one letter lost where ``slip`` divides the hash, and how often each occurs."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    lowered = F.translate("text", UPPER, LOWER)
    runs = rows.select("name", F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "name", "run"))
    place = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.char_length("run")))
    word = F.when(h % slip == 0, cut).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).filter(F.char_length("word") >= length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= times)


def trie_nodes(found: DataFrame, tables: Tables, name: str, piece: Column, *more: Column) -> DataFrame:
    """``(rank, at, node, <more>)``: the numbers of the trie's nodes that several words share, by word and place.

    ``piece`` is what leads to the node of each place ``at``, from 0 to the word's length. A node of one word alone is in no
    pair of two words, so it gets no number.
    """
    places = F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("at")
    steps = found.select("rank", "word", places).select("rank", "at", piece.alias("piece"), *more)
    held = steps.groupBy("piece").agg(F.count("*").alias("held")).filter("held > 1")
    # Written before use: the numbers must not change.
    nodes, seen = tables.save_measured(
        held.withColumn("node", F.monotonically_increasing_id()), f"{name}_nodes", n=F.sum("held"))
    many = max((seen["n"] or 0) * SHARE, LEAST)
    hot = [tuple(r) for r in nodes.filter(F.col("held") > many).select("piece").collect()]
    return skew_join(steps, nodes.select("piece", "node"), ["piece"], F.col("rank"), hot=hot).drop("piece")


def node_pairs(found: DataFrame, tables: Tables) -> DataFrame:
    """``(prefix, suffix, rank, kind)``: the pairs of a word whose nodes other words share, by kind.

    0: split between two positions; 1: one skipped; 2: one skipped that equals the letter before it.
    """
    size = F.char_length("word")
    prefixes = trie_nodes(found, tables, "forward", F.substring(F.col("word"), F.lit(1), F.col("at")))
    # Suffix nodes of the reversed trie, ``at`` being where the suffix begins; the letter before it may be skipped.
    letter = [F.substring(F.col("word"), F.col("at") - k, F.lit(1)) for k in (0, 1)]
    twin = ((F.col("at") > 1) & (letter[0] == letter[1])).alias("twin")
    suffixes = trie_nodes(
        found, tables, "reversed", F.substring(F.reverse("word"), F.lit(1), size - F.col("at")), twin)
    places = F.array(
        F.struct(F.col("at").alias("at"), F.lit(0).alias("kind")),
        F.struct((F.col("at") - 1).alias("at"), F.when(F.col("twin"), 2).otherwise(1).alias("kind")))
    ends = suffixes.select("rank", F.col("node").alias("suffix"), F.inline(places)).filter("at >= 0")
    return ends.join(prefixes.withColumnRenamed("node", "prefix"), ["rank", "at"]).select("prefix", "suffix", "rank", "kind")


def neighbours(pairs: DataFrame, tables: Tables) -> DataFrame:
    """``(rank, n_near, best)``: how many words are one edit away, and the best rank among them."""
    pairs = tables.save(pairs, "pairs")
    skipped = F.col("kind") > 0
    per = pairs.groupBy("prefix", "suffix").agg(
        F.count_if(skipped).alias("n_skipped"), F.count_if(F.col("kind") == 1).alias("n_deleted"),
        F.min(F.when(skipped, F.col("rank"))).alias("first"), F.min(F.when(F.col("kind") == 1, F.col("rank"))).alias("deleted"),
        F.min(F.when(~skipped, F.col("rank"))).alias("split"),
    )
    per = tables.save(per.filter("n_skipped > 1 OR (n_skipped > 0 AND split IS NOT NULL)"), "shared")
    met = tables.save(pairs.join(per, ["prefix", "suffix"]), "met")
    # The best word of a pair but its first.
    rest = met.filter(skipped & (F.col("rank") != F.col("first"))).groupBy("prefix", "suffix").agg(F.min("rank").alias("second"))
    met = met.join(rest, ["prefix", "suffix"], "left")
    other = F.when(F.col("rank") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    shorter = (F.col("kind") == 1) & F.col("split").isNotNull()
    n = F.when(skipped, F.col("n_skipped") - 1 + shorter.cast("int")).otherwise(F.col("n_deleted"))
    best = F.when(skipped, F.least(other, F.when(shorter, F.col("split")))).otherwise(F.col("deleted"))
    return met.groupBy("rank").agg(F.sum(n).alias("n_near"), F.min(best).alias("best"))


def roots(forms: DataFrame, tables: Tables) -> DataFrame:
    """``(word, root)`` of words ``(word, form)``: where the forms lead, by doubling the step until nothing moves.

    A form is twice as frequent as its word, so that no chain is longer than 64 words.
    """
    current = tables.save(forms.select("word", F.coalesce("form", "word").alias("root")), "roots0")
    for i in range(1, 7):
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        current, state = tables.save_measured(
            current.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")),
            f"roots{i}", n=F.count_if(F.col("moved")))
        if not state["n"]:
            break
    return current.select("word", "root")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP, length: int = LENGTH, times: int = TIMES
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word.

    The form is the most frequent word one edit away, if it is at least twice as frequent.
    """
    tables = Tables(docs.sparkSession, "spelling")
    counted = tables.save(words(docs, id_col, text_col, slip, length, times), "words")
    # A word's number is its rank: the least rank is the most frequent word, and of equally frequent ones the smallest.
    found = tables.save(with_position(counted, F.desc("n"), F.asc("word"), name="rank"), "ranked")
    near = tables.save(neighbours(node_pairs(found, tables), tables), "near")
    best = found.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    made = found.join(near.join(best, "best", "left"), "rank", "left")
    is_form = F.col("form_n") >= 2 * F.col("n")
    made = made.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    made = tables.save(made, "forms")
    return made.join(roots(made, tables), "word").select("word", "form", "root", "n", "n_near", "form_n")
