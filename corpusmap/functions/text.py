"""Record text: cleaning, tokens, separators and sentinels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmap import schemas

# Keys that never enter a record's text, and words erased from it, in this order.
EXCLUDED_KEYS = (
    "id", "origin", "author", "date_creation", "url", "dt", "nsteps", "temperature", "thermostat", "barostat",
)
ERASED_WORDS = ("None", "none", "Unknown", "n/a", "undefined")

# A word: two or more letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

CHARS_PER_TOKEN = 4
TOKEN_BUDGET = 16385


def strip(col: Column) -> Column:
    """Remove Unicode whitespace from both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def erase_words(col: Column, words=ERASED_WORDS, whole_words: bool = False) -> Column:
    """Erase words one after the other, as substrings, since one erasure may create the next match."""
    for word in words:
        if whole_words:
            literal = "".join("\\" + c if not c.isalnum() else c for c in word)
            col = F.regexp_replace(col, rf"(?<![\p{{L}}\p{{N}}_]){literal}(?![\p{{L}}\p{{N}}_])", "")
        else:
            col = F.replace(col, F.lit(word), F.lit(""))
    return col


def _part(field: T.StructField) -> Column:
    col = F.col(field.name)
    if field.name.startswith("has") and isinstance(field.dataType, T.BooleanType):
        return F.when(col, F.lit(field.name))
    if field.name == "atom_number":
        return F.concat(F.lit("atom_number="), F.coalesce(col.cast("string"), F.lit("none")))
    if isinstance(field.dataType, T.ArrayType):
        return F.array_join(F.transform(col, lambda item: F.coalesce(item.cast("string"), F.lit("None"))), " ")
    if isinstance(field.dataType, T.BooleanType):
        return F.when(col, F.lit("True"))
    if isinstance(field.dataType, T.NumericType):
        return F.when(col != 0, col.cast("string"))
    return F.nullif(col.cast("string"), F.lit(""))


def text_of(
    level: DataFrame, id_col: str = "id", whole_words: bool = False, excluded_keys=EXCLUDED_KEYS,
    words_to_remove=ERASED_WORDS,
) -> DataFrame:
    """One cleaned string per record: ``(id, text)``, parts in column order."""
    kept = [f for f in level.schema.fields if f.name not in excluded_keys and f.name != id_col]
    joined = F.concat_ws(" ", *[_part(field) for field in kept])
    cleaned = strip(erase_words(joined, words_to_remove, whole_words))
    return level.select(F.col(id_col).alias("id"), cleaned.alias("text"))


def tokens(col: Column) -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0))


def truncate_tokens(col: Column, budget: int = TOKEN_BUDGET) -> Column:
    """Keep what fits a budget of model tokens, at four characters per token."""
    return F.substring(col, 1, CHARS_PER_TOKEN * budget)


def year_of(col: Column) -> Column:
    """The part of a date before its first dash."""
    return F.split_part(col, F.lit("-"), F.lit(1))


def id_prefix(col: Column) -> Column:
    """The part of an id before its first underscore."""
    return F.split_part(col, F.lit("_"), F.lit(1))


def list_or(col: Column, default: str) -> Column:
    """``[default]`` for a null or empty list."""
    return F.when(F.size(F.coalesce(col, F.array())) == 0, F.array(F.lit(default))).otherwise(col)


def sentinel_to_none(col: Column, sentinels=("no", "undefined")) -> Column:
    """The text ``none`` for a null or for a sentinel."""
    text = col.cast("string")
    return F.when(text.isNull() | text.isin(*sentinels), F.lit("none")).otherwise(text)


def detailed_defaults(detailed: DataFrame) -> DataFrame:
    """The eleven fact columns as text, with ``none`` where a value is missing."""
    facts = set(schemas.FACT_COLUMNS)
    return detailed.select(
        *[
            (sentinel_to_none(F.col(c)) if c in ("thermostat", "barostat") else sentinel_to_none(F.col(c), ())).alias(c)
            if c in facts
            else F.col(c)
            for c in detailed.columns
        ]
    )
