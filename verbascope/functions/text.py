"""Text normalisation and tokenisers that treat all scripts alike.

Marks belong to letters and stay; punctuation and symbols become blanks. The native forms are Catalyst
expressions; the exact forms add what Spark lacks, compatibility composition and case folding, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as Python's str.split knows them, in Java's and RE2's syntax alike.
BLANKS = r"[\s\p{Z}\x1c-\x1f\x85]+"
#: Characters that become blanks.
MARKS_OF_WRITING = r"[\p{P}\p{S}]"
#: Languages of the collection that write without blanks between words.
UNSEGMENTED = ("ja", "th", "zh")


def normalise(text: Column) -> Column:
    """`text` in lower case, sharp s as ss, with blanks for punctuation and symbols; null stays null."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), MARKS_OF_WRITING, " ")


def normalise_exact(text: Column) -> Column:
    """`text` in compatibility composition, case-folded, with blanks for punctuation and symbols; null stays null."""
    @F.pandas_udf("string")
    def exact(texts: pd.Series) -> pd.Series:
        import unicodedata

        import regex

        blank = regex.compile(MARKS_OF_WRITING).sub
        return texts.map(lambda t: blank(" ", unicodedata.normalize("NFKC", t).casefold()), na_action="ignore")

    return exact(text)


def words(text: Column) -> Column:
    """The words of a text between blanks, repeated ones too; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def grams_of_word(word: Column, n: int) -> Column:
    """Every run of `n` characters of a word; a word of at most `n` characters is its own only one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))


def char_grams(text: Column, n: int) -> Column:
    """Character runs of a text, never across blanks."""
    return F.flatten(F.transform(words(text), lambda w: grams_of_word(w, n)))


#: Tokenisers by name; each makes an array of tokens of a normalised text.
TOKENISERS: dict[str, Callable[[Column], Column]] = {"word": words} | {f"char{n}": (lambda text, n=n: char_grams(text, n)) for n in (2, 3, 4, 5)}


def python_tokeniser(name: str) -> Callable[[str], list[str]]:
    """The same tokeniser over one Python string, for operators that work on Arrow batches."""
    if name == "word":
        return str.split
    n = int(name[len("char") :])

    def grams(text: str) -> list[str]:
        return [w[i : i + n] for w in text.split() for i in range(max(1, len(w) - n + 1))]

    return grams


def passage_text(title: Column, text: Column) -> Column:
    """Title and text of a passage as one, without blanks at its ends."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def size_in_mb(published: Column) -> Column:
    """A published size such as 905M or 2.5G in MB; null for other words."""
    number = F.regexp_extract(published, r"^\s*([0-9]+\.?[0-9]*)\s*[MG]\s*$", 1).try_cast("double")
    return number * F.when(published.rlike(r"G\s*$"), F.lit(1024.0)).otherwise(F.lit(1.0))


def renderings(number: Column) -> Column:
    """The ways in which a number may be written in a text: as it is, absolute, to 4, 3 and 2 places, without trailing zeros."""
    shown = lambda x, p: F.format_string(f"%.{p}f", x)
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    both = [number, F.abs(number)]
    return F.array_distinct(F.array(*(bare(shown(x, 4)) for x in both), *(shown(F.abs(number), p) for p in (4, 3, 2)), *(bare(shown(F.abs(number), p)) for p in (3, 2))))


def normalise_sql(expression: str) -> str:
    return f"regexp_replace(replace(lower({expression}), 'ß', 'ss'), '{MARKS_OF_WRITING}', ' ', 'g')"


def words_sql(expression: str) -> str:
    return f"list_filter(string_split_regex(coalesce({expression}, ''), '{BLANKS}'), lambda w: w <> '')"


def char_grams_sql(expression: str, n: int | str) -> str:
    return f"flatten(list_transform({words_sql(expression)}, lambda w: list_transform(range(1, greatest(length(w) - {n} + 1, 1) + 1), lambda i: substring(w, i, {n}))))"


def passage_text_sql() -> str:
    return "trim(coalesce(title, '') || ' ' || coalesce(text, ''), ' ')"
