"""Column expressions for text cleaning and tokenisation (JVM-side, codegen'd)."""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words the tokenizer splits in two (first part, second part),
# stated here in the order the tokenizer lists them.
#   cannot -> can not, gimme -> gim me, gonna -> gon na,
#   gotta -> got ta, lemme -> lem me, wanna -> wan na
SPLIT_WORDS = (("can", "not"), ("gim", "me"), ("gon", "na"),
               ("got", "ta"), ("lem", "me"), ("wan", "na"))


@lru_cache(maxsize=1)
def default_stopwords() -> tuple[str, ...]:
    """Spark's built-in English stop-word list (StopWordsRemover default)."""
    text = resources.files("nearspark.functions").joinpath(
        "resources/stopwords_en.txt").read_text()
    return tuple(w for w in text.split("\n") if w)


def letters_only(c: Column) -> Column:
    """Every character that is not an ASCII letter becomes a space."""
    return F.regexp_replace(c, "[^a-zA-Z]", " ")


def split_camel(c: Column) -> Column:
    """A space at each lower->upper boundary (fooBar -> foo Bar)."""
    return F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " ")


def clean_text(c: Column) -> Column:
    return split_camel(letters_only(c))


def split_contractions(c: Column) -> Column:
    """Split the fixed contraction words, case-insensitively, as whole words."""
    alternatives = "|".join(f"{a}(?={b}\\b)" for a, b in SPLIT_WORDS)
    return F.regexp_replace(c, f"(?i)\\b({alternatives})", "$1 ")


def tokens(c: Column) -> Column:
    """Letters-only text -> array of lowercase tokens (order and repeats kept)."""
    t = F.lower(split_contractions(c))
    return F.filter(F.split(F.trim(t), " +"), lambda x: F.length(x) > 0)


def combine_fields(heavy: Column, light: Column, weight: bool) -> Column:
    """Field weighting: heavy text counts twice when ``weight`` is set."""
    if weight:
        return F.concat(heavy, heavy, light)
    return F.concat(heavy, light)
