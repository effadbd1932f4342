"""Codes of airports, runways, frequencies, aircraft types and transponders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, trimmed

# How aircraft types (ICAO designators) are shown, first match first; labels of surfaces; the order of frequencies.
FAMILIES = {
    "a220": "BCS[13]$", "a320": "(A318|A319|A320|A321|A19N|A20N|A21N)$", "a330": "(A332|A333|A337|A338|A339)$", "a350": "(A359|A35K)$", "a380": "A388$", "b717": "B712$", "b727": "B72[12]$",
    "b737": "(B737|B738|B739|B37M|B38M|B39M|B3XM)$", "b747": "B74", "b757": "B75[23]$", "b767": "B76[234]$", "b777": "(B77[23LW]|B77[89])$", "b787": "(B788|B789|B78X)$", "regional": "(E1[3-9]|E2[0-9]|CRJ|RJ[0-9]|ARJ)",
    "turboprop": "(AT4|AT7|DH8|DHC|SF3|F50|JS4)", "business-jet": "(GLF|CL[0-9]|LJ[0-9]|E55|FA[0-9]|C5[0-9]|C68|C7[0-9]|PRM|H25|DA[0-9])", "general-aviation": "(C[0-4]|P28|P32|P46|PA[0-9]|PC1|TBM|BE[0-9]|SR2|M20|DA4)",
}
CATEGORIES = {"A7": "helicopter", "B1": "glider", "B6": "drone"}
SURFACES = {"ASP": "Asphalt", "ASPH": "Asphalt", "CON": "Concrete", "CONC": "Concrete", "GRS": "Grass", "GRSV": "Grass", "TURF": "Turf", "GRE": "Gravel", "WATER": "Water"}
FREQUENCY_ORDER = ("ATIS", "DEL", "GND", "TWR", "APP", "DEP", "CTAF", "UNICOM", "RDO")
NAVAIDS_IN_MHZ = ("VOR", "VOR-DME", "DME", "TACAN", "VORTAC")
_CHARACTERS = "_ABCDEFGHIJKLMNOPQRSTUVWXYZ_____ _______________0123456789______"


def airport_code(raw: Column, letters: int) -> Column:
    """An upper-case code of 4 (ICAO) or 3 (IATA) letters, null for others."""
    code = F.upper(trimmed(raw))
    return F.when(code.rlike(f"^[A-Z]{{{letters}}}$"), code)


def runway(raw: Column) -> Column:
    """Two digits from 01 to 36 and a side, without a word before."""
    text = F.regexp_replace(F.upper(trimmed(raw)), r"\s", "")
    text = F.when(text.startswith("RUNWAY"), F.substring(text, 7, 9)).when(text.startswith("RWY"), F.substring(text, 4, 9)).otherwise(text)
    side = F.regexp_extract(text, "[LCR]$", 0)
    digits = F.left(text, F.length(text) - F.length(side))
    number = F.when((F.length(digits) <= 3) & (F.translate(digits, "0123456789", "") == ""), digits.try_cast("int"))
    return F.when(number.between(1, 36), F.concat(F.lpad(number.cast("string"), 2, "0"), side))


# How far out airports of each type are shown, without and with scheduled service; words that name a heliport.
TIERS = {
    "large_airport": ("significant", "significant"), "medium_airport": ("significant", "significant"), "international_airport": ("significant", "significant"), "small_airport": ("small", "significant"),
    "seaplane_base": ("small", "small"), "balloonport": ("small", "small"), "closed": ("small", "small"), "heliport": ("heliport", "heliport"), "helipad": ("heliport", "heliport"), "heli_surface": ("heliport", "heliport"),
}
HELIPORT_WORDS = ("heliport", "helipad", "helisurface", "vrtulník", "vrtulnik")


def airport_tier(kind: Column, scheduled: Column, name: Column, iata: Column) -> Column:
    """significant, small or heliport: by the table of types; without a known type a service or a code makes it significant, a word in the name a heliport."""
    served = F.coalesce(scheduled, F.lit(False)).cast("int")
    table = F.create_map(*(x for k, tiers in TIERS.items() for x in (F.lit(k), F.array(*map(F.lit, tiers)))))
    by_type = F.get(F.try_element_at(table, F.lower(F.trim(kind))), served)
    words = F.split(F.lower(name), r"[^\p{L}\p{N}_]+")
    by_name = F.when(F.arrays_overlap(words, F.array(*map(F.lit, HELIPORT_WORDS))), "heliport")
    return F.coalesce(by_type, F.when(served == 1, "significant"), by_name, F.when(F.length(iata) > 0, "significant"), F.lit("small"))


def type_family(kind: Column, category: Column) -> Column:
    """How an aircraft is shown: by emitter category where that says it, else by its type."""
    out = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))[F.upper(F.trim(category))]
    named = F.lit("airplane")
    for family, pattern in reversed(FAMILIES.items()):
        named = F.when(F.upper(F.trim(kind)).rlike(f"^{pattern}"), family).otherwise(named)
    return F.coalesce(F.when(F.upper(F.trim(category)).rlike("^C[0-3]$"), "ground"), out, named)


def surface_label(raw: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in SURFACES.items() for x in pair))[F.upper(raw)], raw)


def frequency_rank(kind: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, FREQUENCY_ORDER)), F.upper(kind))
    return F.when(at > 0, at - 1).otherwise(1000).cast("long")


def navaid_frequency(kind: Column, khz: Column) -> Column:
    return F.when(F.upper(F.trim(kind)).isin(*NAVAIDS_IN_MHZ), F.concat(F.format_string("%.3f", khz / 1000), F.lit(" MHz"))).otherwise(F.concat(khz.cast("string"), F.lit(" kHz")))


def is_control_frequency(mhz: Column) -> Column:
    return F.coalesce(mhz.between(118.0, 136.975), F.lit(False))


def metres(feet: Column) -> Column:
    return F.floor(feet * 0.3048 + 0.5).cast("long")


def lasting_text(first: Column, second: Column, upper: bool = False) -> Column:
    """The first text that is not blank, trimmed."""
    out = F.coalesce(clean_text(first), clean_text(second))
    return F.upper(out) if upper else out


def observation_key(hex_: Column, at: Column, source: Column, lat: Column, lon: Column, band: Column) -> Column:
    """Observations with one key are one: coordinates count in millionths of a degree."""
    micro = lambda c: F.floor(c * 1_000_000 + 0.5).cast("long").cast("string")
    return F.concat_ws(":", F.lit("v2"), hex_, F.unix_millis(at).cast("string"), source, micro(lat), micro(lon), band.cast("string"))


def route_key(callsign: Column, day: Column, hex_: Column) -> Column:
    return F.concat(F.lit("flight-route:"), F.lower(hex_), F.lit(":"), F.upper(F.trim(callsign)), F.lit(":"), day)


def squawk(field: Column) -> Column:
    """Four octal digits from the 13 identity bits (C1 A1 C2 A2 C4 A4 X B1 D1 B2 D2 B4 D4)."""
    bit = lambda k: F.shiftright(field, k).bitwiseAND(1)
    digit = lambda one, two, four: (bit(one) + 2 * bit(two) + 4 * bit(four)).cast("string")
    return F.concat(digit(11, 9, 7), digit(5, 3, 1), digit(12, 10, 8), digit(4, 2, 0))


def altitude_25ft(field: Column) -> Column:
    """Feet from 13 altitude bits in steps of 25 ft; null for metric and 100-ft codes."""
    n = F.shiftright(field, 2).bitwiseAND(0x7E0) + F.shiftright(field, 1).bitwiseAND(0x10) + field.bitwiseAND(0xF)
    return F.when((field.bitwiseAND(0x40) == 0) & (field.bitwiseAND(0x10) != 0), n * 25 - 1000)


def packed_callsign(field: Column) -> Column:
    """Eight characters of six bits each, from 48 bits."""
    letters = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substring(F.lit(_CHARACTERS), (F.call_function("shiftright", field, (42 - 6 * k).cast("int")).bitwiseAND(0x3F) + 1).cast("int"), F.lit(1)))
    return F.nullif(F.trim(F.replace(F.array_join(letters, ""), F.lit("_"), F.lit(" "))), F.lit(""))


def crc24(hex_: Column, polynomial: int = 0xFFF409) -> Column:
    """Remainder of a message (hexadecimal text) whose last 24 bits are its parity; 0 if it is intact."""
    digits = F.length(hex_)

    def step(rest: Column, k: Column) -> Column:
        nibble = F.conv(F.substring(hex_, k, F.lit(1)), 16, 10).cast("long")
        rest = rest.bitwiseXOR(F.shiftleft(nibble, 20))
        for _ in range(4):
            rest = F.when(rest.bitwiseAND(0x800000) != 0, F.shiftleft(rest, 1).bitwiseXOR(polynomial)).otherwise(F.shiftleft(rest, 1)).bitwiseAND(0xFFFFFF)
        return rest

    checked = F.aggregate(F.sequence(F.lit(1), digits - 6), F.lit(0).cast("long"), step)
    return checked.bitwiseXOR(F.conv(F.right(hex_, F.lit(6)), 16, 10).cast("long"))
