"""Title cleaning, tokens and n-grams, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_title(title: Column | str) -> Column:
    """Lower case; runs of three or more equal characters become one; only a-z, 0-9, quote and
    blank stay; blanks squeezed.  An empty result is null."""
    # The run pattern and the kept characters.
    text = F.lower(_col(title))
    text = F.regexp_replace(text, r"(?s)(.)\1{2,}", "$1")
    text = F.regexp_replace(text, r"[^a-z0-9' ]", "")
    words = F.filter(F.split(text, " +"), lambda w: w != "")
    return F.nullif(F.array_join(words, " "), F.lit(""))


def title_tokens(clean: Column | str) -> Column:
    """Words of two or more word characters."""
    return F.regexp_extract_all(_col(clean), F.lit(r"(\b\w\w+\b)"), 1)


def title_ngrams(clean: Column | str) -> Column:
    """Distinct single words and neighbouring word pairs."""


    def grams(words: Column) -> Column:
        n_pairs = F.greatest(F.size(words) - 1, F.lit(0))
        pairs = F.zip_with(
            F.slice(words, 1, n_pairs), F.slice(words, 2, n_pairs), lambda a, b: F.concat_ws(" ", a, b)
        )
        return F.array_distinct(F.concat(words, pairs))

    # Binding the words to a lambda variable finds them once, not once per use.
    return F.transform(F.array(title_tokens(clean)), grams)[0]


def title_weight(clean: Column | str) -> Column:
    """1 for a title of one part, 3 for longer titles."""
    return F.when(F.size(F.split(_col(clean), " ")) == 1, 1).otherwise(3)
