"""Whether what a text claims can be traced: numbers to stored values, citations to entries, required wording."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import renderings

NUMBER = r"[0-9]+\.?[0-9]*"
#: Values longer than so many characters may agree by prefix, to allow for rounding.
EXACT_LENGTH = 3


def without_comments(text: Column) -> Column:
    """LaTeX without its comments; an escaped per cent sign starts none."""
    return F.regexp_replace(text, r"(?m)(^|[^\\])%.*$", "$1")


def without_commands(text: Column) -> Column:
    """LaTeX without the keys of citations, labels and references, which are no measurements."""
    return F.regexp_replace(text, r"\\(cite|label|ref)\{[^}]*\}", " ")


def numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token): the distinct numbers of each text."""
    found = F.regexp_extract_all(without_commands(without_comments(F.col(text))), F.lit(NUMBER), F.lit(0))
    return df.select(key, F.explode(F.array_distinct(F.transform(found, lambda t: F.rtrim(t, F.lit("."))))).alias("token"))


def rendered_values(values: DataFrame, value: str) -> DataFrame:
    """(shown): every way in which a stored value may be written."""
    return values.where(F.col(value).isNotNull()).select(F.explode(renderings(F.col(value).cast("double"))).alias("shown")).distinct()


def untraced(tokens: DataFrame, shown: DataFrame, allowed: DataFrame) -> DataFrame:
    """The tokens that equal no stored value, are not allowed, and agree with no longer value by prefix either way.

    tokens: (key, token); shown: (shown); allowed: (token). Prefixes are compared among values that begin with
    the same characters, by equality on each prefix of more than EXACT_LENGTH characters, not pair by pair.
    """
    left = tokens.join(shown, tokens.token == shown.shown, "left_anti").join(allowed, "token", "left_anti")
    long = shown.where(F.length("shown") > EXACT_LENGTH)
    beginnings = lambda c, least: F.transform(F.sequence(F.lit(least), F.greatest(F.length(c), F.lit(least))), lambda i: F.substring(F.col(c), F.lit(1), i))
    of_values = long.select(F.explode(beginnings("shown", 1)).alias("token")).distinct()
    left = left.join(of_values, "token", "left_anti")  # a value begins with the token
    own = left.where(F.length("token") > EXACT_LENGTH).select("token").distinct().select("token", F.explode(beginnings("token", EXACT_LENGTH + 1)).alias("shown"))
    return left.join(own.join(long, "shown", "left_semi").select("token").distinct(), "token", "left_anti")  # the token begins with a value


def cited_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cited): the distinct keys of each text's citations."""
    groups = F.regexp_extract_all(without_comments(F.col(text)), F.lit(r"\\cite\{([^}]*)\}"), F.lit(1))
    each = df.select(key, F.explode(F.flatten(F.transform(groups, lambda g: F.split(g, ",")))).alias("cited"))
    return each.select(key, F.trim("cited").alias("cited")).where("cited <> ''").distinct()


def bibliography(df: DataFrame, text: str) -> DataFrame:
    """(entry, kind): the entries of BibTeX texts."""
    pattern = r"@(\w+)\s*\{\s*([^,\s]+)\s*,"
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)).alias("entry"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)).alias("kind"))
    return df.select(F.inline(pairs)).select("entry", F.lower("kind").alias("kind")).distinct()


def citation_report(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, problem): keys that are cited and not defined (`missing`), or defined and not cited (`unused`)."""
    names = cited.select(F.col("cited").alias("name")).distinct()
    defined = entries.select(F.col("entry").alias("name")).distinct()
    side = lambda a, b, problem: a.join(b, "name", "left_anti").withColumn("problem", F.lit(problem))
    return side(names, defined, "missing").unionByName(side(defined, names, "unused"))


def wording(df: DataFrame, key: str, text: str, required: dict[str, str], forbidden: dict[str, str]) -> DataFrame:
    """(key, label, passed): each text against patterns that it must have and patterns that it must not have."""
    whole = lambda p: F.coalesce(F.col(text), F.lit("")).rlike(f"(?ms){p}")
    checks = [F.struct(F.lit(label).alias("label"), whole(p).alias("passed")) for label, p in required.items()]
    checks += [F.struct(F.lit(label).alias("label"), (~whole(p)).alias("passed")) for label, p in forbidden.items()]
    return df.select(key, F.inline(F.array(*checks)))


def context(text: Column, token: str, width: int = 60) -> Column:
    """A token with up to `width` characters of its line on either side; empty if it does not occur."""
    import re

    return F.regexp_extract(text, rf".{{0,{width}}}\b{re.escape(token)}\b.{{0,{width}}}", 0)


def json_leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, number, string): every leaf of each JSON text, however deep; malformed texts have none."""

    def batches(source: Iterator) -> Iterator:
        import json

        import pyarrow as pa

        for batch in source:
            rows = []
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    stack = [("$", json.loads(value))]
                except (TypeError, ValueError):
                    continue
                while stack:
                    path, x = stack.pop()
                    if isinstance(x, dict):
                        stack += [(f"{path}.{k}", v) for k, v in x.items()]
                    elif isinstance(x, list):
                        stack += [(f"{path}[{i}]", v) for i, v in enumerate(x)]
                    elif isinstance(x, str):
                        rows.append((own, path, None, x))
                    elif x is not None:
                        rows.append((own, path, float(x), None))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema[0].type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.string())], names=[key, "path", "number", "string"])

    return df.select(key, text).mapInArrow(batches, f"`{key}` {df.schema[key].dataType.simpleString()}, path string, number double, string string")


def upgraded(entries: DataFrame, venues: DataFrame) -> DataFrame:
    """Entries (entry, kind, fields) with kind and venue of `venues` (entry, kind, venue) where a venue is known."""
    known = venues.select("entry", F.col("kind").alias("venue_kind"), "venue")
    return entries.join(known, "entry", "left").select("entry", F.coalesce("venue_kind", "kind").alias("kind"), "venue", "fields")


def bibtex(entries: DataFrame) -> DataFrame:
    """(entry, text): each entry (entry, kind, fields map) as BibTeX, fields in order of their names."""
    lines = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = {"), e["value"], F.lit("}")))
    return entries.select("entry", F.concat(F.lit("@"), F.col("kind"), F.lit("{"), F.col("entry"), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}")).alias("text"))


def reference_check(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, status, title, year, n_authors) of every cited id (id), by entries (id, title, published, authors): VERIFIED, or NOT_FOUND with nulls.

    An id that is cited often is one row; of entries with one id, the one whose title comes first counts.
    """
    known = entries.groupBy("id").agg(F.min(F.struct("title", F.substring("published", 1, 4).alias("year"), F.size("authors").alias("n_authors"))).alias("e"))
    status = F.when(F.col("e").isNull(), "NOT_FOUND").otherwise("VERIFIED").alias("status")
    return cited.select("id").where("id is not null").distinct().join(known, "id", "left").select("id", status, "e.title", "e.year", F.col("e.n_authors").cast("bigint").alias("n_authors"))
