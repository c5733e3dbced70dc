"""Short, unique, descriptive names for clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.text import TOKEN_BUDGET, tokens
from corpusmap.operators.rank import top_per_group, with_position
from corpusmap.operators.report import joined_titles
from corpusmap.operators.tfidf import stop_list

# Words a name must not contain, the noise label and its name.
BANNED_WORDS = ("dynamics", "cluster", "realm", "simulation")
NOISE = -1
NOISE_NAME = "Others"
TERMS_PER_CLUSTER = 6

PROMPT = (
    "Name a group of scientific datasets in two or three words, judging by their titles. "
    "Avoid the words Dynamics, Cluster, Realm and Simulation, and every name already in use: {used}. "
    "Titles: {titles}"
)


def cluster_terms(members: DataFrame, key: str = "cluster", stop_words="english") -> DataFrame:
    """Class-based TF-IDF of title terms ``(cluster, term, tf, score)``: tf times ln(1 + A / f).

    A is the mean number of terms per cluster, f the frequency of a term over all clusters.
    """
    words = members.select(key, F.explode(tokens(F.col("title"))).alias("term"))
    stops = (*stop_list(stop_words), *BANNED_WORDS)
    counts = words.filter(~F.col("term").isin(*stops)).groupBy(key, "term").agg(F.count("*").alias("tf"))
    shape = counts.agg(F.sum("tf").alias("n"), F.count_distinct(key).alias("m")).first()
    average = (shape["n"] or 0) / max(shape["m"], 1)
    totals = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    return counts.join(totals, "term").select(
        key, "term", "tf", (F.col("tf") * F.log(F.lit(1.0) + F.lit(average) / F.col("f"))).alias("score")
    )


def name_clusters(members: DataFrame, key: str = "cluster", stop_words="english") -> DataFrame:
    """One name per cluster ``(cluster, cluster_name)``: its best two or three terms, unique over all.

    Each cluster offers its term pairs and triples in order. Each offered name goes to the cluster that
    offers it earliest, and each cluster takes the first name it won. A cluster that won none gets its best
    term and a number.
    """
    clustered = members.filter(~_is_noise(members, key))
    scored = cluster_terms(clustered, key, stop_words).filter(~F.col("term").rlike("^[0-9]+$"))
    best = top_per_group(scored, key, [F.desc("score"), F.asc("term")], TERMS_PER_CLUSTER, "nth")
    # At most TERMS_PER_CLUSTER terms per cluster are gathered.
    gathered = best.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]).alias("terms")
    )
    picks = [(0, 1), (0, 1, 2), (0, 2), (1, 2), (0, 1, 3), (0, 3), (1, 3), (2, 3), (0, 4), (1, 4), (0, 5)]
    offers = F.array(*[_name_of(pick) for pick in picks])
    offered = gathered.select(key, F.posexplode(offers).alias("pos", "name")).filter(F.col("name").isNotNull())
    won = top_per_group(offered, "name", [F.asc("pos"), F.asc(key)], 1, "w")
    taken = won.groupBy(key).agg(F.min_by("name", "pos").alias("name"))
    everyone = clustered.select(key).distinct().join(gathered, key, "left").join(taken, key, "left")
    stem = F.coalesce(F.try_element_at("terms", F.lit(1)), F.lit("unnamed"))
    lacking = everyone.filter(F.col("name").isNull()).select(key, stem.alias("stem"))
    # Numbered over all such clusters, however many share a term, and without one task per term.
    numbered = with_position(lacking, "stem", key).select(
        key, F.concat("stem", F.lit(" "), F.col("position") + 1).alias("name")
    )
    named = everyone.filter(F.col("name").isNotNull()).select(key, "name").unionByName(numbered)
    noise = members.filter(_is_noise(members, key)).select(key).distinct().select(key, F.lit(NOISE_NAME).alias("name"))
    return named.unionByName(noise).withColumnRenamed("name", "cluster_name")


def _is_noise(members: DataFrame, key: str):
    return F.col(key).cast("string") == str(NOISE)


def _name_of(pick: tuple[int, ...]):
    words = [F.try_element_at("terms", F.lit(i + 1)) for i in pick]
    present = words[0].isNotNull()
    for word in words[1:]:
        present = present & word.isNotNull()
    return F.when(present, F.initcap(F.concat_ws(" ", *words)))


def with_names(points: DataFrame, names: DataFrame, key: str = "cluster") -> DataFrame:
    """Every point with the name of its cluster."""
    return points.join(names, key, "left")


def naming_prompts(
    members: DataFrame, key: str = "cluster", template: str = PROMPT, used: str = "", budget: int = TOKEN_BUDGET
) -> DataFrame:
    """One prompt per cluster for a model of the caller, titles cut to the token budget: ``(cluster, prompt)``."""
    titles = joined_titles(members.filter(~_is_noise(members, key)), key, budget)
    text = F.replace(F.lit(template), F.lit("{used}"), F.lit(used))
    return titles.select(key, F.replace(text, F.lit("{titles}"), F.col("titles")).alias("prompt"))
