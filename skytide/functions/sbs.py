"""SBS-1 lines as column expressions, strict: a line counts as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of numbers, and the places of the fields in a line.
INT, NUMBER = r"^[+-]?[0-9]+$", r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
FIELDS = 22
INTS = {"transmission_type": 1, "altitude": 11, "vertical_rate": 16}
DOUBLES = {"ground_speed": 12, "track": 13, "lat": 14, "lon": 15}
TEXTS = {"icao": 4, "squawk": 17}
FLAGS = {"alert": 18, "emergency": 19, "spi": 20, "on_ground": 21}


def _grammar(whole: str) -> str:
    """One expression for a whole line, given that for a whole number."""
    number = r"\s*[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?\s*"
    fields = ["[^,]*"] * FIELDS
    for names, f in ((INTS, whole), (DOUBLES, number), (FLAGS, "0|-1")):
        for n in names.values():
            fields[n] = f"(?:{f})?"
    return "\\A" + ",".join(fields) + "\\z"


#: Lines that certainly fit, and lines whose numbers may be out of range.
SURELY, MAYBE = _grammar("[+-]?[0-9]{1,9}"), _grammar("[+-]?[0-9]+")


def good_line(raw: Column) -> Column:
    """Whether a line can be read as a whole. Almost every line takes one pass of one expression."""
    f = split_line(raw)
    fits = F.lit(True)
    for n in INTS.values():
        fits = fits & ((f[n] == "") | f[n].try_cast("int").isNotNull())
    return F.coalesce(raw.rlike(SURELY) | (raw.rlike(MAYBE) & fits), F.lit(False))


def split_line(raw: Column) -> Column:
    """The fields, trailing empty ones kept."""
    return F.split(raw, ",", -1)


def reject_reason(f: Column) -> Column:
    """Null for a good line, else ``fields`` or the name of the first bad field. Any value that can't be read rejects the
    line; an empty one is absent."""
    checks = F.when(f.isNull() | (F.size(f) != FIELDS), "fields")
    for name, n in INTS.items():
        checks = checks.when((f[n] != "") & ~(f[n].rlike(INT) & f[n].try_cast("int").isNotNull()), name)
    for name, n in DOUBLES.items():
        checks = checks.when((f[n] != "") & ~f[n].rlike(NUMBER), name)
    for name, n in FLAGS.items():
        checks = checks.when(~f[n].isin("", "0", "-1"), name)
    return checks


def parsed(f: Column) -> dict[str, Column]:
    """The typed columns of a good line."""
    when = lambda n, c: F.when(f[n] != "", c)
    moment = lambda d, t: F.when((f[d] != "") | (f[t] != ""), F.concat(f[d], F.lit(" "), f[t]))
    callsign = F.regexp_replace(f[10], r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    out = {"message_type": f[0], "transmission_type": when(1, f[1].try_cast("int")), "icao": when(4, f[4]), "generated": moment(6, 7), "logged": moment(8, 9)}
    out |= {"callsign": F.when(callsign != "", callsign), "altitude": when(11, f[11].try_cast("int"))}
    out |= {k: when(n, F.trim(f[n]).try_cast("double")) for k, n in DOUBLES.items()}
    out |= {"vertical_rate": when(16, f[16].try_cast("int")), "squawk": when(17, f[17])}
    out |= {k: F.when(f[n] == "-1", True).when(f[n] == "0", False) for k, n in FLAGS.items()}
    return out
