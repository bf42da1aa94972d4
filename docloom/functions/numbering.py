"""Numbering systems as column expressions: decimal, Roman, letters and section signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of Roman numerals by place.
ROMAN_DIGITS = (
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    ("", "M", "MM", "MMM"),
)
ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_to_int(roman: Column) -> Column:
    """Subtractive reading of any string of Roman letters; 0 if empty, null with another letter in it."""
    value = F.create_map(*[F.lit(x) for pair in ROMAN_VALUES.items() for x in pair])
    signs = F.filter(F.split(F.reverse(F.upper(roman)), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))

    def step(acc: Column, sign: Column) -> Column:
        v = F.element_at(value, sign)
        return F.struct(F.when(v < acc["last"], acc["sum"] - v).otherwise(acc["sum"] + v).alias("sum"), v.alias("last"))

    return F.when(F.upper(roman).rlike("^[IVXLCDM]*$"), F.aggregate(signs, start, step, lambda acc: acc["sum"]))


def int_to_roman(number: Column) -> Column:
    """Null outside 1 to 3999."""
    parts = []
    for place in (3, 2, 1, 0):
        digits = F.array(*[F.lit(d) for d in ROMAN_DIGITS[place]])
        digit = (F.floor(number / 10**place) % 10).cast("int")
        parts.append(F.get(digits, digit))
    return F.when(number.between(1, 3999), F.concat(*parts))


def letter_to_int(letter: Column) -> Column:
    """1 to 26 for one ASCII letter, else null."""
    return F.when(letter.rlike("^[A-Za-z]$"), F.ascii(F.upper(letter)) - 64)


def int_to_letter(number: Column) -> Column:
    return F.when(number.between(1, 26), F.char((number + 64).cast("long")))


def decimal_parts(value: Column) -> Column:
    """The whole-number parts between dots."""
    return F.transform(F.filter(F.split(F.rtrim(value, F.lit(".")), r"\."), lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("int"))


def normalise(kind: Column, value: Column) -> Column:
    """Parts of a number as whole numbers: several for decimals and section signs, one for Roman numerals and letters, none for others."""
    one = F.when(kind.startswith("roman"), roman_to_int(value)).when(kind.startswith("letter"), letter_to_int(value))
    decimal = decimal_parts(F.when(kind == "section_symbol", F.trim(F.replace(value, F.lit("§"), F.lit("")))).otherwise(value))
    return F.when(kind.isin("decimal", "section_symbol"), decimal).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<int>"))


def level(parts: Column) -> Column:
    return F.greatest(F.size(parts) - 1, F.lit(0))


def kind_of(text: Column) -> Column:
    """The numbering that a label is written in."""
    bare = F.regexp_replace(text, r"[.()\s]+$|^[(\s]+", "")
    return (
        F.when(text.contains("§"), "section_symbol")
        .when(bare.rlike(r"^\d+(\.\d+)*$"), "decimal")
        .when(bare.rlike("^[IVXLCDM]+$"), "roman_upper")
        .when(bare.rlike("^[ivxlcdm]+$"), "roman_lower")
        .when(bare.rlike("^[A-Z]$"), "letter_upper")
        .when(bare.rlike("^[a-z]$"), "letter_lower")
        .otherwise("mixed")
    )


def convert(number: Column, target: Column) -> Column:
    """A number written in another system; letters beyond 26 stay digits."""
    text = number.cast("string")
    return (
        F.when(target == "roman_upper", F.coalesce(int_to_roman(number), text))
        .when(target == "roman_lower", F.coalesce(F.lower(int_to_roman(number)), text))
        .when(target == "letter_upper", F.coalesce(int_to_letter(number), text))
        .when(target == "letter_lower", F.coalesce(F.lower(int_to_letter(number)), text))
        .when(target == "section_symbol", F.concat(F.lit("§ "), text))
        .otherwise(text)
    )


def is_parent(parent: Column, child: Column) -> Column:
    """The child's parts start with the parent's and go on."""
    return (F.size(child) > F.size(parent)) & (F.slice(child, F.lit(1), F.size(parent)) == parent)
