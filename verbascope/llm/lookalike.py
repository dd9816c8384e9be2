"""One spelling for texts that look the same.

Characters that differ only in width, in the kind of blank, as a ligature or by canonical composition are
brought to one form by rule, and what nobody sees is removed; joiners stay where they change how letters are
shaped. Then every token's script set is resolved: each letter brings the scripts in which a letter of its
looks exists, and the intersection over the token tells in which scripts the whole token can be spelled. A
token of mixed scripts, or wholly in look-alikes of another script, is respelt in the one consistent script,
the language's own first. Letters of tokens that no script can spell take the form that comes first. Letters
of the Arabic script have one look or another as they join to the letter after them; those that look the same
where they stand take the language's own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import materialise

SCRIPTS = ("Latin", "Cyrillic", "Greek")
#: Letters of the same looks in Latin, Cyrillic and Greek, after canonical decomposition; "-" where there is none.
SAME_LOOKS = """
A А Α
B В Β
C С Ϲ
E Е Ε
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
Q Ԛ -
S Ѕ -
T Т Τ
W Ԝ -
X Х Χ
Y Ү Υ
Z - Ζ
Æ Ӕ -
- Г Γ
- П Π
- Ф Φ
a а -
c с ϲ
d ԁ -
e е -
h һ -
i і -
j ј ϳ
o о ο
p р -
q ԛ -
s ѕ -
v ѵ ν
w ԝ -
x х -
y у -
æ ӕ -
ə ә -
ɵ ө -
"""
#: The script of languages that are written in one of the three.
OWN_SCRIPT = {"ru": "Cyrillic", "uk": "Cyrillic", "be": "Cyrillic", "bg": "Cyrillic", "sr": "Cyrillic", "mk": "Cyrillic", "kk": "Cyrillic", "el": "Greek"}
#: Code points of Arabic-script letters that join to the letter before them only, and that join to none.
JOIN_BEFORE = "0622-0625 0627 0629 062F-0632 0648 0671-0673 0675-0677 0688-0699 06C0 06C3-06CB 06CD 06CF 06D2-06D3 06D5 06EE-06EF"
JOIN_NOT = "0621 0674 06DD"
#: Letters of the Arabic script that look the same before a letter that they join, and where they join none: Arabic's own, Persian's own.
SAME_JOINED, SAME_UNJOINED = "\u064a\u06cc \u0643\u06a9", "\u0649\u06cc"
#: Languages that write with Persian's letters.
PERSIAN = ("fa", "ur", "ps", "ckb", "ku", "sd", "ug")
#: Invisible code points outside the categories of controls and formats.
UNSEEN = "034F 115F-1160 17B4-17B5 FE00-FE0F E0100-E01EF"
#: Format characters that are seen.
SEEN_FORMATS = "0600-0605 06DD 070F 08E2 110BD 110CD"
#: Blanks outside the category of spaces.
BLANKS = "0009-000D 001C-001F 0085 2028-2029 2800 3164 FFA0"
#: Blocks of radicals that have the looks of an ideograph.
COMPATIBLE = "2E80-2FDF"
NON_JOINER, JOINER = "\u200c", "\u200d"


def code_points(ranges: str) -> set[int]:
    """The code points of a list of hexadecimal ranges."""
    points: set[int] = set()
    for part in ranges.split():
        first, _, last = part.partition("-")
        points.update(range(int(first, 16), int(last or first, 16) + 1))
    return points


@lru_cache(maxsize=1)
def folds() -> dict[int, str]:
    """Code point to its plain form, for str.translate; made by rule from the Unicode database."""
    unseen, seen, blanks, compatible = map(code_points, (UNSEEN, SEEN_FORMATS, BLANKS, COMPATIBLE))
    table: dict[int, str] = {}
    for point in range(0x110000):
        if 0xAC00 <= point <= 0xD7A3 or 0x3400 <= point <= 0x9FFF or 0x20000 <= point <= 0x323AF:
            continue
        char = chr(point)
        category = unicodedata.category(char)
        if point in blanks or category in ("Zs", "Zl", "Zp"):
            if char != " ":
                table[point] = " "
        elif point in unseen or category in ("Cc", "Cf") and point not in seen and char not in (NON_JOINER, JOINER):
            table[point] = ""
        elif (parts := unicodedata.decomposition(char)).startswith("<"):
            kind, *hexes = parts.split()
            shown = "".join(chr(int(x, 16)) for x in hexes)
            name = unicodedata.name(char, "")
            if (
                kind in ("<wide>", "<narrow>", "<noBreak>")
                or kind in ("<isolated>", "<initial>", "<medial>", "<final>") and not 0xFDF0 <= point <= 0xFDFD and " " not in shown
                or kind == "<compat>" and (point in compatible or "LIGATURE" in name or 0x1C4 <= point <= 0x1CC or 0x1F1 <= point <= 0x1F3 or 0x2160 <= point <= 0x217F)
            ):
                table[point] = shown
    for point, shown in table.items():  # a form may fold to a character that folds further
        table[point] = shown.translate(table)
    return table


@lru_cache(maxsize=1)
def look_alikes() -> tuple[dict[str, dict[str, str]], dict[str, str]]:
    """Of each letter that has doubles: its spelling by script; and its first spelling of all."""
    spellings: dict[str, dict[str, str]] = {}
    for row in SAME_LOOKS.split("\n"):
        if row:
            by_script = {script: letter for script, letter in zip(SCRIPTS, row.split()) if letter != "-"}
            for letter in by_script.values():
                spellings[letter] = by_script
    return spellings, {letter: next(iter(by.values())) for letter, by in spellings.items()}


@lru_cache(maxsize=1)
def patterns():
    import re

    import regex

    any_of_three = r"[\p{Latin}\p{Cyrillic}\p{Greek}]"
    return {
        "blanks": re.compile("  +"),
        "token": regex.compile(rf"{any_of_three}[\p{{Latin}}\p{{Cyrillic}}\p{{Greek}}\p{{M}}]*"),
        "Latin": regex.compile(r"\p{Latin}"),
        "Cyrillic": regex.compile(r"\p{Cyrillic}"),
        "Greek": regex.compile(r"\p{Greek}"),
        "other than Latin": regex.compile(r"[\p{Cyrillic}\p{Greek}]"),
        "other than Cyrillic": regex.compile(r"[\p{Latin}\p{Greek}]"),
        "other than Greek": regex.compile(r"[\p{Latin}\p{Cyrillic}]"),
        "joiners": re.compile(f"[{NON_JOINER}{JOINER}]+"),
        "cursive": regex.compile(r"[\p{Arabic}\p{Syriac}\p{Nko}\p{Mongolian}\p{Mandaic}\p{Adlam}]"),
        "yeh or kaf": re.compile("[\u064a\u0649\u06cc\u0643\u06a9]"),
        "not Persian's": re.compile("[\u064a\u0649\u0643]"),
        "not Arabic's": re.compile("[\u06cc\u06a9]"),
        "emoji": regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}]"),
        "nikhahit": re.compile("\u0e4d([\u0e48-\u0e4b]?)\u0e32"),
        "foldable": re.compile("[" + "".join(re.escape(chr(x)) for x in folds() if x < 0x10000) + "]"),
        "beyond": re.compile("[\U00010000-\U0010ffff]"),
    }


@lru_cache(maxsize=1 << 12)
def joins(char: str) -> tuple[bool, bool]:
    """Whether a letter joins to the one before it, and to the one after it."""
    if not patterns()["cursive"].match(char) or not char.isalpha() or ord(char) in code_points(JOIN_NOT):
        return False, False
    return True, ord(char) not in code_points(JOIN_BEFORE)


def shaping_joiners(text: str) -> str:
    """`text` with the joiners that change the shapes beside them, one each, and without the others."""

    def keep(match) -> str:
        start, end = match.span()
        while start and unicodedata.category(text[start - 1]) == "Mn" and unicodedata.combining(text[start - 1]) not in (9, 0):
            start -= 1  # a mark over a letter is not in the way of joining
        left, right = text[start - 1 : start], text[end : end + 1]
        last = match.group()[-1]
        if left and unicodedata.combining(text[match.start() - 1]) == 9:  # after a virama, joiners choose the conjunct
            return last
        joined = bool(left and right and joins(left)[1] and joins(right)[0])
        if last == NON_JOINER:
            return last if joined else ""
        shaped = bool(left and joins(left)[1]) != joined or bool(right and joins(right)[0]) != joined
        emoji = patterns()["emoji"]
        return last if shaped or left and right and emoji.match(left) and emoji.match(right) else ""

    return patterns()["joiners"].sub(keep, text)


def own_letters(text: str, persian: bool) -> str:
    """`text` with the language's own letter where those of Arabic and Persian look the same; marks over a letter are not in the way of joining."""
    joined, unjoined = ({letter: pair[persian] for pair in pairs.split() for letter in pair} for pairs in (SAME_JOINED, SAME_UNJOINED))

    def own(match) -> str:
        end = match.end()
        while end < len(text) and unicodedata.category(text[end]) == "Mn":
            end += 1
        letter, after = match.group(), text[end : end + 1]
        return (joined if after == JOINER or after and joins(after)[0] else unjoined).get(letter, letter)

    return patterns()["yeh or kaf"].sub(own, text)


@lru_cache(maxsize=1 << 16)
def consistent_token(token: str, own: str | None) -> str:
    """`token` (canonically decomposed) in one script if one can spell all of it."""
    spellings, first = look_alikes()
    possible, actual = set(SCRIPTS), set()
    for char in token:
        if char in spellings:
            possible &= spellings[char].keys()
        else:
            script = next((s for s in SCRIPTS if patterns()[s].match(char)), None)
            if script:
                possible &= {script}
        if len(actual) < 2:
            actual.update(s for s in SCRIPTS if patterns()[s].match(char))
    if actual == {own}:
        return token
    if not possible:
        return "".join(first.get(c, c) for c in token)
    script = own if own in possible else next(s for s in SCRIPTS if s in possible)
    return "".join(spellings[c][script] if c in spellings else c for c in token)


def normal_form(text: str | None, lang: str | None) -> str | None:
    """The one form of all texts of a language that look like `text`; null stays null, blanks become empty."""
    if text is None:
        return None
    use = patterns()
    own = OWN_SCRIPT.get(lang, "Latin")
    if not text.isascii():
        if use["foldable"].search(text) or use["beyond"].search(text):
            text = text.translate(folds())
        if NON_JOINER in text or JOINER in text:
            text = shaping_joiners(text)
        if "\u0e4d" in text:
            text = use["nikhahit"].sub("\\1\u0e33", text)
        text = text.replace("\u0e40\u0e40", "\u0e41")  # two SARA E have the looks of SARA AE
        if use[f"other than {own}"].search(text):
            text = use["token"].sub(lambda m: consistent_token(m.group(), own), unicodedata.normalize("NFD", text))
        text = unicodedata.normalize("NFC", text)
        persian = lang in PERSIAN
        if use["not Persian's" if persian else "not Arabic's"].search(text):
            text = own_letters(text, persian)
    elif not text.isprintable():
        text = text.translate(folds())
        if own != "Latin":
            text = use["token"].sub(lambda m: consistent_token(m.group(), own), text)
    elif own != "Latin":
        text = use["token"].sub(lambda m: consistent_token(m.group(), own), text)
    return (use["blanks"].sub(" ", text) if "  " in text else text).strip(" ")


def normal_forms(df: DataFrame, keys: list[str], lang: str, text: str) -> DataFrame:
    """(*keys, normal) for every row of `df`, in one narrow pass."""

    def batches(source: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in source:
            langs, texts = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()
            forms = pa.array([normal_form(t, x) for x, t in zip(langs, texts)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], forms], names=[*keys, "normal"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(lang).alias("_lang"), F.col(text).alias("_text")).mapInArrow(batches, f"{schema}, normal string")


def appearances(df: DataFrame) -> DataFrame:
    """(kind, id, k1, k2, raw) from (kind, id, scope, lang, value): 128 bits of how a value looks within its scope, 64 of the value.

    Rows without scope, language or id, and null, empty and blank values, have no appearance.
    """

    def batches(source: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in source:
            kinds, ids, scopes, langs, values = (c.to_pylist() for c in batch.columns)
            found = []
            for kind, own, scope, lang, value in zip(kinds, ids, scopes, langs, values):
                if form := normal_form(value, lang):
                    digest = xxhash.xxh3_128_digest(f"{kind}\0{lang}\0{scope}\0{form}".encode())
                    raw = xxhash.xxh3_64_digest(value.encode())
                    found.append((kind, own, *(int.from_bytes(x, "big", signed=True) for x in (digest[:8], digest[8:], raw))))
            columns = list(zip(*found)) or [()] * 5
            types = [batch.schema[0].type, pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "id", "k1", "k2", "raw"])

    there = df.where("id is not null and scope is not null and lang is not null and value is not null")
    return there.select("kind", "id", "scope", "lang", "value").mapInArrow(batches, "kind int, id bigint, k1 bigint, k2 bigint, raw bigint")


FORM = ["kind", "k1", "k2"]
#: Rows of one spelling that meet those of another at a time.
BLOCK_ROWS = 2_000


def look_alikes_of(df: DataFrame) -> DataFrame:
    """(kind, k1, k2, raw, id): the rows whose form has more than one spelling, found by a merged minimum and maximum; kept in the shared folder."""
    rows = materialise(appearances(df))
    several = rows.groupBy(*FORM).agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low < high").select(*FORM)
    return materialise(rows.join(several, FORM, "left_semi"))


def look_alike_classes(df: DataFrame) -> DataFrame:
    """(kind, id, form_id, spelling_id): one row for each row that looks like another and is not the same.

    `spelling_id` is the least id of its copies and `form_id` the least of all that look like it: rows of one form
    look the same, rows of one spelling are the same string. So the classes stay as many as the rows.
    """
    members = look_alikes_of(df)
    spelling = members.groupBy(*FORM, "raw").agg(F.min("id").alias("spelling_id"))
    form = spelling.groupBy(*FORM).agg(F.min("spelling_id").alias("form_id"))
    return members.join(spelling.join(form, FORM), [*FORM, "raw"]).select("kind", "id", "form_id", "spelling_id")


def look_alike_pairs(df: DataFrame) -> DataFrame:
    """(kind, id_a, id_b): rows of one kind and scope whose values look the same and are not; id_a < id_b.

    Copies are never paired with each other: spellings are paired as classes, and only then are their rows put
    in, in blocks of about BLOCK_ROWS, so that a form that many rows have is many tasks' work.
    """
    members = look_alikes_of(df)
    spellings = members.groupBy(*FORM, "raw").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    one = lambda x: spellings.withColumnsRenamed({"raw": f"raw_{x}", "blocks": f"blocks_{x}"})
    pairs = one("a").join(one("b"), FORM).where("raw_a < raw_b")
    for x in "ab":
        pairs = pairs.withColumn(f"block_{x}", F.explode(F.sequence(F.lit(0), (F.col(f"blocks_{x}") - 1).cast("int"))))
    placed = members.join(spellings, [*FORM, "raw"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    side = lambda x: placed.select(*FORM, F.col("raw").alias(f"raw_{x}"), F.col("block").alias(f"block_{x}"), F.col("id").alias(x))
    keyed = pairs.select(*FORM, "raw_a", "block_a", "raw_b", "block_b")
    expanded = keyed.join(side("a"), [*FORM, "raw_a", "block_a"]).join(side("b"), [*FORM, "raw_b", "block_b"])
    return expanded.select("kind", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
