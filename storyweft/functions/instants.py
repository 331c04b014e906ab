"""All valid readings of a timestamp text, each with a format, an instant and a cost.

A reading that the source settles (edition, zone, country) costs nothing; its rivals cost ``UNLIKELY`` each, more than any order of records can
outweigh. What only hints at one (the usual meaning of zone letters where no country is known) makes its rivals ``DOUBTFUL``, which the
order may outweigh. Where nothing hints, rivals cost the same and the order decides.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

UNLIKELY, DOUBTFUL = 100.0, 0.75
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MICRO = timedelta(microseconds=1)

# Month names by their first three letters.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

# Zone letters and their offset in minutes, by country; "" holds for all other countries.
LETTERS = {
    "Z": {"": 0}, "UT": {"": 0}, "UTC": {"": 0}, "GMT": {"": 0}, "WET": {"": 0}, "WEST": {"": 60},
    "EST": {"": -300, "AU": 600}, "EDT": {"": -240, "AU": 660}, "CST": {"": -360, "CN": 480, "AU": 570}, "CDT": {"": -300, "AU": 630},
    "MST": {"": -420, "MY": 480}, "MDT": {"": -360}, "PST": {"": -480, "PH": 480}, "PDT": {"": -420},
    "AKST": {"": -540}, "AKDT": {"": -480}, "HST": {"": -600}, "AST": {"": -240, "SA": 180}, "ADT": {"": -180}, "NST": {"": -210}, "NDT": {"": -150},
    "BST": {"": 60, "BD": 360}, "IST": {"IN": 330, "IE": 60, "IL": 120}, "CET": {"": 60}, "CEST": {"": 120}, "EET": {"": 120}, "EEST": {"": 180}, "MSK": {"": 180},
    "SAST": {"": 120}, "WAT": {"": 60}, "CAT": {"": 120}, "EAT": {"": 180}, "GST": {"": 240}, "PKT": {"": 300}, "SGT": {"": 480}, "HKT": {"": 480}, "AWST": {"": 480},
    "JST": {"": 540}, "KST": {"": 540}, "ACST": {"": 570}, "ACDT": {"": 630}, "AEST": {"": 600}, "AEDT": {"": 660}, "NZST": {"": 720}, "NZDT": {"": 780},
}

# Countries by the start of a zone's name, tried in this order.
ZONE_COUNTRY = [
    ("Asia/Kolkata", "IN"), ("Asia/Calcutta", "IN"), ("Europe/Dublin", "IE"), ("Asia/Jerusalem", "IL"), ("Asia/Tel_Aviv", "IL"), ("Asia/Shanghai", "CN"),
    ("Asia/Manila", "PH"), ("Asia/Kuala_Lumpur", "MY"), ("Asia/Dhaka", "BD"), ("Asia/Riyadh", "SA"), ("Australia/", "AU"), ("Pacific/Auckland", "NZ"),
    ("Europe/London", "GB"), ("Africa/Johannesburg", "ZA"), ("America/", "US"),
]

CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9})\d*)?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
ZONE = r"(?:\s*\(?(?:(?:UTC|GMT)?(?P<sign>[+\-−])(?P<oh>\d{2}):?(?P<om>\d{2})?|(?P<let>[A-Za-z]{1,5}))\)?)?"
SHAPES = [
    ("ymd", re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})(?:[Tt\s]\s*{CLOCK}{ZONE})?")),
    ("compact", re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt](?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})(?P<f>)(?P<ap>){ZONE}")),
    ("dmy", re.compile(rf"(?:[A-Za-z]{{3,9}}\.?,?\s+)?(?P<d>\d{{1,2}})\.?[\s-](?P<b>[A-Za-z]{{3,9}})\.?,?[\s-](?P<y>\d{{4}}|\d{{2}})(?:,?\s+(?:at\s+)?{CLOCK}{ZONE})?")),
    ("mdy", re.compile(rf"(?:[A-Za-z]{{3,9}}\.?,?\s+)?(?P<b>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{CLOCK}{ZONE})?")),
    ("slash", re.compile(rf"(?P<a>\d{{1,2}})/(?P<c>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}})(?:,?\s+(?:at\s+)?{CLOCK}{ZONE})?")),
    ("dots", re.compile(rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}}|\d{{2}})(?:,?\s+(?:at\s+)?{CLOCK}{ZONE})?")),
]
DIGITS = re.compile(r"[0-9]{10}(?:[0-9]{3})?", re.ASCII)
SHAPES = [(name, re.compile(p.pattern, re.ASCII)) for name, p in SHAPES]


@lru_cache(None)
def _zone(name: str | None):
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


@lru_cache(None)
def country(tz: str | None, edition: str | None) -> str:
    """The source's country: of its zone, else its edition, else unknown."""
    return next((c for start, c in ZONE_COUNTRY if tz and tz.startswith(start)), edition or "")


def _micros(t: datetime) -> int:
    return (t - EPOCH) // MICRO


def _offsets(sign: str | None, oh: str | None, om: str | None, letters: str | None, where: str):
    """[(offset in minutes, cost)] of a zone text, None if it isn't one, [] if the text names no zone."""
    if sign:
        minutes = int(oh) * 60 + int(om or 0)
        return [(minutes if sign == "+" else -minutes, 0.0)] if int(oh) <= 15 and int(om or 0) < 60 else None
    if not letters:
        return []
    known = LETTERS.get(letters.upper())
    if known is None:
        return None
    own = known.get(where, known.get(""))
    rival = UNLIKELY if where else DOUBTFUL
    return [(o, 0.0 if own in (None, o) else rival) for o in dict.fromkeys(known.values())]


def readings(text: str | None, tz: str | None, edition: str | None) -> list[tuple[str, int, float]]:
    """(format, microseconds since 1970 UTC, cost) of every valid reading; none for missing text, junk and impossible dates.

    Outer white space is ignored. Text without a zone is wall-clock time in ``tz`` (UTC where that is unknown): of a time that
    occurs twice the earlier instant is likely, one that is skipped takes the offset before the change. A date alone is
    the start of its local day. Two-digit years are 20xx. Slash dates are month first for edition US and day first
    for others; without an edition both are as likely. Ten digits are seconds, thirteen milliseconds.
    """
    text = (text or "").strip()
    if not text:
        return []
    if DIGITS.fullmatch(text):
        return [("epoch", int(text) * (1_000_000 if len(text) == 10 else 1000), 0.0)]
    where, out = country(tz, edition), []
    for shape, pattern in SHAPES:
        m = pattern.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
        if shape == "slash":
            first = None if not edition else edition == "US"
            dates = [("slash-mdy", int(g["a"]), int(g["c"]), UNLIKELY if first is False else 0.0), ("slash-dmy", int(g["c"]), int(g["a"]), UNLIKELY if first else 0.0)]
            if edition:  # an edition's order isn't given up because its date is impossible
                dates = [x for x in dates if not x[3]] + [x for x in dates if x[3]]
        else:
            month = MONTHS.get(g["b"][:3].lower(), 0) if g.get("b") else int(g["m"])
            dates = [(shape, month, int(g["d"]), 0.0)]
        hour = int(g["h"]) if g["h"] else 0
        if g["ap"]:
            if not 1 <= hour <= 12:
                return []
            hour = hour % 12 + (12 if g["ap"] in "pP" else 0)
        offsets = _offsets(g["sign"], g["oh"], g["om"], g["let"], where)
        if offsets is None:
            return []
        micro = int((g["f"] or "").ljust(6, "0")[:6] or 0)
        for k, (form, month, day, cost) in enumerate(dates):
            try:
                wall = datetime(year, month, day, hour, int(g["mi"] or 0), int(g["s"] or 0), micro)
            except ValueError:
                if shape == "slash" and edition and k == 0 and not cost:
                    return []  # the settled order names no date
                continue
            if offsets:
                out += [(form, _micros(wall.replace(tzinfo=timezone.utc)) - o * 60_000_000, cost + c) for o, c in offsets]
                continue
            zone = _zone(tz) or timezone.utc
            early = _micros(wall.replace(tzinfo=zone, fold=0))
            out.append((form, early, cost))
            late = _micros(wall.replace(tzinfo=zone, fold=1))
            if late > early:  # the clock was put back
                out.append((form, late, cost + UNLIKELY))
        break
    best: dict[tuple[str, int], float] = {}
    for form, us, cost in out:
        best[form, us] = min(cost, best.get((form, us), cost))
    return [(f, u, c) for (f, u), c in best.items()]
