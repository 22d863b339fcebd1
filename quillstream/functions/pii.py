"""Redaction of personal data, best effort: addresses, numbers with check digits, mail addresses."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import STRING, Value, define

IBAN_LENGTHS = dict(
    pair.split("=")
    for pair in """AL=28 AD=24 AT=20 AZ=28 BH=22 BY=28 BE=16 BA=20 BR=29 BG=22 CR=22 HR=21 CY=28 CZ=24 DK=18 DO=28 TL=23 EG=29 SV=28 EE=20
FO=18 FI=18 FR=27 GE=22 DE=22 GI=23 GR=27 GL=18 GT=28 HU=28 IS=26 IQ=23 IE=22 IL=23 IT=27 JO=30 KZ=20 XK=20 KW=30 LV=21 LB=28 LY=25 LI=21 LT=20
LU=20 MT=31 MR=27 MU=30 MD=24 MC=27 ME=22 NL=18 MK=19 NO=15 PK=24 PS=29 PL=28 PT=25 QA=29 RO=24 LC=32 SM=27 ST=25 SA=24 RS=22 SC=31 SK=24 SI=19
ES=24 SE=24 CH=21 TN=24 TR=26 UA=29 AE=23 GB=22 VA=22 VG=24""".split()
)

BYTE = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
V4 = rf"{BYTE}(?:\.{BYTE}){{3}}"
H = "[a-fA-F0-9]{1,4}"


def _v6() -> str:
    """IPv6 with an embedded IPv4 address first, then plain; by the number of groups before the double colon."""
    forms = [rf"(?:{H}:){{6}}{V4}"]
    groups = lambda n: "" if n == 0 else f"(?:{H}:){{{n - 1}}}{H}"
    forms += [rf"{groups(n)}::(?:{H}:){{0,{4 - n}}}{V4}" for n in range(5)]
    forms.append(rf"(?:{H}:){{7}}{H}")
    forms += [rf"{groups(n)}::(?:{H}:){{0,{5 - n}}}(?:{H})?" for n in range(6)]
    forms.append(rf"(?:{H}:){{5}}{H}::")
    # All forms begin in one of three ways; most places in a text in none of them.
    return f"(?=::|(?:{H}:){{1,6}}:|(?:{H}:){{6}})(?:" + "|".join(f"(?:{f})" for f in forms) + ")"


def _bare(s: str) -> str:
    return s.replace("-", "").replace(" ", "")


#: Twice a digit, and of that the sum of digits.
DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(s: str) -> bool:
    digits = _bare(s)[::-1]
    return sum(map(int, digits[::2] + digits[1::2].translate(DOUBLED))) % 10 == 0


def iban(s: str) -> bool:
    m = _bare(s)
    need = IBAN_LENGTHS.get(m[:2].upper())
    if need is None or len(m) < int(need):
        return False
    turned = m[4:] + m[:4]
    return int("".join(str(ord(c) - 55) if "A" <= c <= "Z" else c for c in turned if c.isdigit() or "A" <= c <= "Z") or "0") % 97 == 1


def ssn(s: str) -> bool:
    m = _bare(s)
    area, group, serial = m[:3], m[3:5], m[5:9]
    return area not in ("000", "666") and not 900 <= int(area) <= 999 and group != "00" and serial != "0000"


class Runs:
    """A pattern whose finds lie within runs of certain characters; only in runs that pass a cheap test is it looked for.

    A find never crosses a run's end, and the pattern looks at nothing around it, so the finds are those in the whole text.
    """

    def __init__(self, run: str, able: Callable[[str], bool], pattern: str):
        self.run, self.able, self.pattern = re.compile(run), able, re.compile(pattern)

    def finditer(self, text: str) -> Iterator[re.Match]:
        for run in self.run.finditer(text):
            if self.able(run.group()):
                yield from self.pattern.finditer(text, run.start(), run.end())


ANY = lambda s: True
TAGGERS = [
    ("IBAN", re.compile(r"[A-Za-z]{2}[ -]?[0-9]{2}[ -]?(?:[A-Za-z0-9][ -]?){11,28}"), iban),
    ("EMAIL", re.compile(r"[0-9a-zA-Z!#$%&'*+-/=?^_`{|}~.]+(?:@|%40)(?:[a-zA-Z0-9-]+[.])*[a-zA-Z0-9-]+"), ANY),
    ("IPV6", Runs(r"[0-9a-fA-F:.]{2,}", lambda s: "::" in s or s.count(":") >= 6, _v6()), ANY),
    ("IPV4", Runs(r"[0-9.]{7,}", lambda s: s.count(".") >= 3, V4), ANY),
    ("MAC_ADDR", re.compile(r"(?:[0-9a-fA-F]{2}[-:]){5}[0-9a-fA-F]{2}"), ANY),
    ("IMEI", re.compile(r"[0-9]{2}-[0-9]{6}-[0-9]{6}-[0-9]"), luhn),
    ("IMEI", re.compile(r"[0-9]{2}-[0-9]{6}-[0-9]{6}-[0-9]{2}"), ANY),
    ("CC_NUMBER", re.compile(r"(?:[0-9][ -]*){12,18}[0-9]"), luhn),
    ("SSN", re.compile(r"[0-9]{3}[ -]+[0-9]{2}[ -]+[0-9]{4}"), ssn),
]


#: What a text must have for a tagger to find anything.
NEEDS = {"EMAIL": ("@", "%40"), "IPV6": (":",), "MAC_ADDR": (":", "-")}
#: Texts without a match of this have nothing to redact: mail marks, groups of hexadecimal digits, or two digits near each other.
SCREEN = r"@|%40|::|[0-9][0-9 .-]*[0-9]|[0-9a-fA-F]{1,4}[:-][0-9a-fA-F]{1,4}[:-]"
DIGIT = re.compile("[0-9]").search


def redact(text: str) -> str:
    """The text with tags in place of what the taggers find. Of overlapping finds the longest ones count, the earlier of two, and all others that overlap none of these."""
    digits = DIGIT(text)
    able = [t for t in TAGGERS if (any(x in text for x in NEEDS[t[0]]) if t[0] in NEEDS else digits)]
    tags = [(m.start(), m.end(), name) for name, pattern, good in able for m in pattern.finditer(text) if good(m.group())]
    if not tags:
        return text
    starts: list[int] = []
    chosen: list[tuple[int, int, str]] = []
    for tag in sorted(tags, key=lambda t: (t[0] - t[1], t[0])):
        i = bisect(starts, tag[0])
        if (not i or chosen[i - 1][1] <= tag[0]) and (i == len(chosen) or tag[1] <= chosen[i][0]):
            starts.insert(i, tag[0])
            chosen.insert(i, tag)
    out, at = [], 0
    for start, end, name in chosen:
        out += [text[at:start], f"<REDACTED_{name}>"]
        at = end
    return "".join(out) + text[at:]


@define("redact_pii_best_effort", ((STRING,), STRING))
def redact_pii(text: Value) -> Column:
    """The text without IBANs, mail, IP and MAC addresses, IMEIs, card and social security numbers.

    Only texts that a native screen lets through go to Python.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    return F.coalesce(run(F.when(text.col.rlike(SCREEN), text.col)), text.col)
