"""Names of files and fonts, and recognised texts, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 120
#: What stands for characters that the output face lacks; the rest beyond Latin-1 goes.
ONE_FOR_ONE = (
    ("‘", "'"), ("’", "'"), ("‚", "'"), ("‛", "'"), ("“", '"'), ("”", '"'), ("„", '"'), ("‟", '"'),
    ("–", "-"), ("—", "-"), ("―", "-"), ("−", "-"), ("•", "-"), ("⁄", "/"), ("\u00a0", " "),
)
LONGER = (("…", "..."), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
#: Signs of weight, slant and family in a font's name.
BOLD = (r"^cm(bx|b|ssbx)\d*$", r"^lm(roman|ss|mono)?(bx|b)\d*$", "bold|black|heavy|demi|semibold")
ITALIC = (r"^cm(ti|sl|ssi)\d*$", r"^lm(roman|ss|mono)?(ti|it|sl)\d*$", "italic|oblique|slanted", r"(^|[-,])(i|it|bdi|bdit|bi)(\d|$)")
FAMILIES = {
    "courier": (r"^cm(tt|ttx|vtt)\d*$", "courier|mono|consol"),
    "helvetica": ("^cmss", "sans|helvetica|arial|grotesk"),
    "times": (r"^cm(r|bx|ti|sl|csc|u|b|ro|ssbx?)\d*$", "times|serif|roman|georgia"),
}
SUBSET, FOUNDRY = r"^[A-Z]{6}\+", "(?i)[-,]?(MT|PS|PSMT)$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def safe_file_name(requested: Column, fallback: Column, extension: str) -> Column:
    """The last part of a wanted path without controls and leading dots, of 120 characters, with the
    extension; the fallback with the extension where nothing is left."""
    base = F.element_at(F.split(trimmed(requested), r"[\\/]", -1), -1)
    clean = trimmed(F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1f\x7f]", ""), r"^\.+", ""))
    clean = F.substring(clean, 1, LONGEST)
    named = F.when(F.endswith(F.lower(clean), F.lit(extension)), clean).otherwise(F.concat(clean, F.lit(extension)))
    return F.when(F.length(F.coalesce(clean, F.lit(""))) == 0, F.concat(fallback, F.lit(extension))).otherwise(named)


def ocr_text(text: Column) -> Column:
    """A recognised text in the characters of the output face, blanks squeezed. Texts are taken as composed."""
    plain = F.translate(F.coalesce(text, F.lit("")), "".join(a for a, _ in ONE_FOR_ONE), "".join(b for _, b in ONE_FOR_ONE))
    plain = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), LONGER, plain)
    plain = F.regexp_replace(F.regexp_replace(plain, r"[\t\n\r\f\x0b]", " "), r"[^\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{ff}]", "")
    return F.trim(F.regexp_replace(plain, " +", " "))


def font_signals(name: Column) -> Column:
    """family (null if nothing tells), bold and italic of a font's name, by all of its parts."""
    parts = F.transform(F.split(F.coalesce(name, F.lit("")), r"[\s,;]+"), lambda p: F.lower(F.regexp_replace(F.regexp_replace(p, SUBSET, ""), FOUNDRY, "")))
    tells = lambda signs: F.exists(parts, lambda p: reduce(lambda a, b: a | b, (F.regexp_like(p, F.lit(s)) for s in signs)))
    family = F.coalesce(*(F.when(tells(signs), F.lit(kind)) for kind, signs in FAMILIES.items()))
    return F.struct(family.alias("family"), tells(BOLD).alias("bold"), tells(ITALIC).alias("italic"))
