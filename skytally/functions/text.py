"""Normalisation of text and numbers from feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as feeds understand it, wider than a blank.
_BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, f"^{_BLANK}|{_BLANK}$", "")


def clean_number(raw: Column) -> Column:
    """A finite double or null; hexadecimal whole numbers count as numbers."""
    return trimmed_number(trimmed(raw))


def trimmed_number(text: Column) -> Column:
    """The same of a text without white space around it, best a column, as it is looked at several times."""
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    number = F.when(text.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 15), 16, 10).try_cast("double")).otherwise(number)
    return F.when(F.abs(number) < float("inf"), number)


def clean_text(raw: Column) -> Column:
    return F.nullif(trimmed(raw), F.lit(""))


def identifier(raw: Column) -> Column:
    upper = F.upper(clean_text(raw))
    return F.when(upper.rlike("^~?[0-9A-F]{6}$"), upper)


def source_kind(kind: Column, mlat: Column, tisb: Column) -> Column:
    """What kind of message a position is from: the feed's word for it first, then its flags."""
    low = F.coalesce(F.lower(trimmed(kind)), F.lit(""))
    named = F.when((low == "mlat") | low.startswith("mlat_"), "MLAT").when(low.startswith("tisb"), "TIS-B").when(low.isin("mode_s", "mode-s"), "Mode-S").when(low.startswith("adsb") | low.startswith("adsr"), "ADS-B")
    return F.coalesce(named, F.when(mlat, "MLAT").when(tisb, "TIS-B"), F.lit("UNKNOWN"))


def emergency_state(raw: Column) -> Column:
    """Lower-cased; none, unknown and numbers other than the three emergency codes are no emergency."""
    low = F.lower(clean_text(raw))
    return F.when(~low.isin("none", "unknown") & (~low.rlike("^[0-9]+$") | low.isin("7500", "7600", "7700")), low)


def on_ground(flag: Column, altitude: Column) -> Column:
    low = F.coalesce(F.lower(trimmed(flag)), F.lit(""))
    return F.when(low.isin("true", "ground"), True).when(low.isin("false", "air"), False).otherwise(F.coalesce(F.lower(altitude) == "ground", F.lit(False)))


def visibility_miles(raw: Column) -> Column:
    """Statute miles from texts like 10, 1/2, 1 1/2SM, P6SM, M1/4SM."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(trimmed(raw)), r"\s*SM$", ""), r"^[PM]\s*", ""), r"\s*[+]$", "")
    part = lambda pattern, k: F.regexp_extract(body, pattern, k).try_cast("double")
    mixed, fraction = r"^([0-9]+)\s+([0-9]+)/([0-9]+)$", r"^([0-9]+)/([0-9]+)$"
    return F.when(body.rlike(mixed), part(mixed, 1) + part(mixed, 2) / F.nullif(part(mixed, 3), F.lit(0.0))).when(body.rlike(fraction), part(fraction, 1) / F.nullif(part(fraction, 2), F.lit(0.0))).when(clean_number(body) >= 0, clean_number(body))


def altitude_feet(raw: Column) -> Column:
    """Feet from SFC, FLnnn or n FT."""
    text = F.upper(F.trim(raw))
    level, feet = F.regexp_extract(text, r"^FL ?([0-9]{1,3})$", 1), F.regexp_extract(text, r"^([0-9]+) ?FT", 1)
    return F.when(text.isin("SFC", "GND"), 0).when(level != "", level.try_cast("int") * 100).when(feet != "", feet.try_cast("int"))


def wildcard(pattern: str) -> str:
    """An anchored regular expression of a pattern whose only wildcard is *."""
    import re

    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def search_term(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"[\\%_]", ""), r"\s+", " "))


def is_wildcard(pattern: str) -> bool:
    """Whether a pattern holds text and no other metacharacter than *."""
    return bool(pattern.strip()) and not set(pattern) & set("?[]{}()+|.^$\\")


def dms_degrees(raw: Column) -> Column:
    """Decimal degrees of ddmmssN, dddmmss.sE or the same in three parts; null if it is not one or out of range.

    Counted from the end, since minutes and whole seconds have two digits each.
    """
    shown = F.replace(F.upper(trimmed(raw)), F.lit(","), F.lit("."))
    side, parts = F.right(shown, F.lit(1)), F.split(F.rtrim(F.left(shown, F.greatest(F.length(shown) - 1, F.lit(0)))), r"\s+")
    digits = F.array_join(parts, "")
    whole = F.substring_index(digits, ".", 1)
    n = F.length(whole)
    degrees = F.left(whole, n - 4).try_cast("double")
    minutes, seconds = F.substring(whole, n - 3, F.lit(2)).try_cast("double"), F.substring(digits, n - 1, F.length(digits)).try_cast("double")
    widths = F.transform(parts, lambda p: F.length(F.substring_index(p, ".", 1)))
    shaped = digits.rlike(r"^\d+(\.\d+)?$") & n.between(6, 7) & ((F.size(parts) == 1) | ((F.size(parts) == 3) & (F.slice(widths, 2, 2) == F.array(F.lit(2), F.lit(2)))))
    angle = degrees + minutes / 60 + seconds / 3600
    bound = F.element_at(F.create_map(F.lit("N"), F.lit(90), F.lit("S"), F.lit(90), F.lit("E"), F.lit(180), F.lit("W"), F.lit(180)), side)
    return F.when(shaped & (minutes < 60) & (seconds < 60) & (angle <= bound), F.when(side.isin("N", "E"), angle).otherwise(-angle))


def _area(words: Column, kinds: tuple[str, ...]) -> Column:
    """The first kind that a number follows among words, as LK, its last three letters and the number."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda kind, number: F.struct(kind.alias("kind"), number.alias("number")))
    fits = F.filter(pairs, lambda p: p["kind"].isin(*kinds) & F.coalesce(p["number"].rlike("^[0-9]+[A-Z]?$"), F.lit(False)))
    return F.when(F.size(fits) > 0, F.concat(F.lit("LK"), F.right(fits[0]["kind"], F.lit(3)), fits[0]["number"]))


def airspace_designator(raw: Column) -> Column:
    """LKTRAn or LKTSAn from the ways these areas are written; null for others.

    A text is a row of words: kinds and numbers stand apart, whether blanks, underscores
    and hyphens are between them or nothing; any other character is a word of its own.
    The text as one designator comes first, then one with the country, then one without.
    """
    words = lambda t: F.split(F.trim(F.regexp_replace(t, "(?<![A-Z0-9])((?:LK)?T[RS]A)(?=[0-9])", "$1 ")), " +")
    spaced = F.regexp_replace(F.regexp_replace(F.upper(trimmed(raw)), "[^A-Z0-9 \t\r\n_-]+", " | "), "[^A-Z0-9|]+", " ")
    alone = words(F.regexp_replace(spaced, "[ |]", ""))
    own, bare = ("LKTRA", "LKTSA"), ("TRA", "TSA")
    return F.coalesce(F.when(F.size(alone) == 2, _area(alone, (*own, *bare))), _area(words(spaced), own), _area(words(spaced), bare))
