"""Lengths written as text: numbers, names of units, amounts of a unit, and what a text says of the unit of accuracies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A unit's names and signs, in lower case, and its millimetres.
UNITS = {
    "1000000": ["km", "kilometre", "kilometres", "kilometer", "kilometers"],
    "1000": ["m", "mtr", "metre", "metres", "meter", "meters"],
    "100": ["dm", "decimetre", "decimetres", "decimeter", "decimeters"],
    "10": ["cm", "centimetre", "centimetres", "centimeter", "centimeters"],
    "1": ["mm", "millimetre", "millimetres", "millimeter", "millimeters"],
    "0.001": ["um", "µm", "μm", "micron", "microns", "micrometre", "micrometres", "micrometer", "micrometers"],
    "914.4": ["yd", "yard", "yards"],
    "304.8": ["ft", "foot", "feet"],
    "25.4": ["in", "inch", "inches", '"'],
}
# English words for a number of equal parts, for a number, and for a number of many.
PARTS = {"halves": 2, "thirds": 3, "quarters": 4, "fifths": 5, "sixths": 6, "eighths": 8, "tenths": 10, "twelfths": 12, "sixteenths": 16, "hundredths": 100, "thousandths": 1000, "millionths": 1_000_000}
TIMES = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "eight": 8, "ten": 10, "twelve": 12, "tens": 10, "dozens": 12, "hundreds": 100, "thousands": 1000}
#: Words that say that what follows is the unit of the accuracies, not of some other quantity.
CUES = r"accurac[a-z]*|acc\. *cols?|acc\.|errors?|sigma|spread|genauigkeit|precision|uncertaint[a-z]*|radii"
#: Words between a cue and what it says.
LINKS = r"(?:both|columns?|cols?|figures?|estimates?|radii|given|come|comes|logged|recorded|stated|holds?|written|are|is|as|in)\b|[=:,>\-→]+"

MM_BY_UNIT = {form: mm for mm, forms in UNITS.items() for form in forms}
_BY_LENGTH = sorted(MM_BY_UNIT, key=lambda form: (-len(form), form))
# a bare letter or a quote mark is a unit beside a number or in brackets, but not in prose
_NAMED = "|".join(form for form in _BY_LENGTH if len(form) > 1 and form != "in")
_SIGNS = "|".join(form for form in _BY_LENGTH if len(form) <= 2 and form != '"')
_PARTS, _TIMES = "|".join(PARTS), "|".join(TIMES)
#: Fractions and multiples of a unit: "tenths of a metre", "1/10 m", "thousands of metres", "lengths of three feet".
AMOUNT = rf"(?:(?:{_PARTS}) +of +(?:an?|one|the) +|(?:lengths? +of +)?(?:{_TIMES}) +(?:of +)?)"
NUMBER_AND_UNIT = r"^\s*±?\s*\+?([0-9]+(?:[.,][0-9]*)?(?:[eE][+-]?[0-9]+)?|[.,][0-9]+(?:[eE][+-]?[0-9]+)?)\s*(.*)$"
IN_BRACKETS = r"[(\[]([^()\[\]]*)[)\]]\s*$"
IN_PROSE = rf"(?:{CUES})[ ,]*[^;.,]*?((?:\b{AMOUNT}|\b)(?:{_NAMED})|\b1/[0-9]+ *(?:of +an? +)?(?:{_NAMED}|{_SIGNS}))\b"
SAID = rf"(?:{CUES})[ ,]*([^;.,]*)"


def _looked_up(text: Column, table: dict, kind: str) -> Column:
    known = F.create_map(*[F.lit(x) for key, value in table.items() for x in (key, value)])
    return F.try_element_at(known, text).cast(kind)


def mm_of_unit(text: Column) -> Column:
    """Millimetres of one unit or an amount of it written as ``text``, to a thousandth; NULL where it is no unit of length."""
    said = F.trim(F.lower(text))
    parts = rf"^(?:({_PARTS}) +of +(?:an?|one|the) +|(?:lengths? +of +)?({_TIMES}) +(?:of +)?|1/([0-9]+) *(?:of +an? +)?)(.+)$"
    piece = lambda k: F.regexp_extract(said, parts, k)
    unit = _looked_up(F.trim(piece(4)), MM_BY_UNIT, "decimal(11,3)")
    part = F.coalesce(_looked_up(piece(1), PARTS, "decimal(10,0)"), F.nullif(piece(3), F.lit("")).try_cast("decimal(10,0)"))
    amount = F.when(part > 0, unit / part).otherwise(unit * _looked_up(piece(2), TIMES, "decimal(10,0)"))
    return F.coalesce(_looked_up(said, MM_BY_UNIT, "decimal(11,3)"), F.when(piece(4) != "", amount).cast("decimal(11,3)"))


def cell_number(cell: Column) -> Column:
    """The number at the start of a cell as decimal(24,12), a comma read as the decimal sign; NULL where there is none.

    A sign of minus is no number here: an accuracy is never below 0.
    """
    digits = F.regexp_replace(F.regexp_extract(cell, NUMBER_AND_UNIT, 1), ",", ".")
    return F.nullif(digits, F.lit("")).try_cast("decimal(24,12)")


def cell_unit(cell: Column) -> Column:
    """What follows the number in a cell, without brackets and a full stop; '' where nothing does."""
    rest = F.trim(F.regexp_extract(cell, NUMBER_AND_UNIT, 2))
    return F.trim(F.regexp_replace(F.regexp_replace(rest, r"^[(\[]\s*|\s*[)\]]$", ""), r"\.$", ""))


def header_unit(name: Column) -> Column:
    """What a field name holds in brackets at its end; '' where nothing."""
    return F.trim(F.regexp_extract(name, IN_BRACKETS, 1))


def prose_unit(text: Column) -> Column:
    """What a text says the unit of accuracies is: a unit or an amount of one where it names one, else the words it says; '' where it says nothing of accuracies."""
    low = F.lower(text)
    named = F.regexp_extract(low, IN_PROSE, 1)
    words = F.regexp_replace(F.trim(F.regexp_extract(low, SAID, 1)), rf"^(?:(?:{LINKS}) *)+| +since\b.*$", "")
    return F.when(low.isNull(), None).otherwise(F.coalesce(F.nullif(named, F.lit("")), F.trim(words)))
