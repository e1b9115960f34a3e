"""Personal data in free text: mentions, typed placeholders with format-preserving pseudonyms.

E-mail addresses, phone numbers, identity numbers, street addresses and names of persons are found by patterns of their written forms; names
by family-name forms (the listed names and the combinations of their recurring beginnings and endings)
next to a given name, an initial or a title. Numbers are validated (check letters and digits, dates, ranges) and permuted within their format by a keyed Feistel network:
a valid number becomes another valid one with its own check digits, an invalid one another invalid one, letters are permuted with the digits, and notation (blanks, dots,
country code or trunk zero) does not matter, so equal values get equal pseudonyms in every document. Other kinds get a keyed token.

Defined results: null ids or texts take no part; empty texts have no mention; repeated rows give each
mention once; overlapping finds go to the first of e-mail, address, account number (no mention), identity number, phone, name; offsets count code
points from 0; other columns are ignored. Lists of up to ``MOST_NAMES`` names travel to every task; of longer lists each text gets the names among its own words by a join, and
the recurring beginnings and endings are those of ``MOST_NAMES`` names picked by hash.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NAMES = 100_000

_UP = "A-ZÀ-ÖØ-Þ"
_EMAIL = re.compile(
    r"(?<![\w.+@-])[^\W_][\w.+-]*(?:[ ]?@[ ]?|\s*[(\[]at[)\]]\s*)[^\W_][\w-]*(?:(?:\.|\s*[(\[]dot[)\]]\s*)[\w-]+)*(?:\.|\s*[(\[]dot[)\]]\s*)[A-Za-z]{2,24}\b", re.I
)
_FILES = {"png", "jpg", "jpeg", "gif", "svg", "webp", "pdf", "js", "css", "html"}
_LEFT, _RIGHT = r"(?<![\w/])(?<!\d[-.,:])", r"(?![\w/])(?![-.,:]\d)"
_ID = re.compile(
    _LEFT + r"(?<!\+)(?:[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]\d{8}|\d{8}-?[A-Z]|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}|\d{3}(?:-\d{2}-|[ ]\d{2}[ ])\d{4}|9\d{8}"
    + r"|[12][ ]?\d{2}[ ]?(?:0[1-9]|1[0-2])[ ]?(?:\d{2}|2[AB])[ ]?\d{3}[ ]?\d{3}[ ]?\d{2}|[1-9]\d[ ]?\d{3}[ ]?\d{3}[ ]?\d{3})" + _RIGHT, re.I
)
#: Account numbers; their groups of digits are no phone numbers.
_IBAN = re.compile(_LEFT + r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?!\w)")
_PHONE = re.compile(
    _LEFT
    + r"(?:(?:\+1|001)[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"  # North America, international
    + r"|(?:(?:\(\+\d{1,3}\)|\+\d{1,3})[ .-]?|00[1-9]\d{0,2}[ .-])\(?\d{1,5}\)?(?:[ ./-]?\d{2,8}){1,5}"  # international
    + r"|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}([-. ])\d{3}\1\d{4}"  # North America
    + r"|0\d(?:[ .]\d{2}){4}"  # France
    + r"|(?:\(0[17]\d{3}\)|0[17]\d{3})[ -]?\d{3}[ ]?\d{3}|02\d[ ]\d{4}[ ]\d{4}"  # United Kingdom
    + r"|(?:\(0\d{2,4}\)|0\d{2,4})[/ ][ ]?\d{4,8}(?:[- ]\d{1,4})?)"  # Germany
    + _RIGHT
)
_CAP = rf"[{_UP}][\w'’-]*"
_HOUSE = r"\d{1,5}[A-Za-z]?(?:[-–/]\d{1,5}[A-Za-z]?)?"
_FLAT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Appt|Studio)\.?[ ]\d{1,4}[A-Za-z]?,[ ])?"
_ADDRESS = re.compile(
    rf"(?<![\w.-])(?:{_FLAT}{_HOUSE}[ ](?:{_CAP}[ ]){{1,4}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Close|Square|Sq|Terrace|Boulevard|Blvd)\b"
    rf"|(?:Unit|Units|Suite)[ ]\d{{1,4}}[A-Za-z]?,[ ](?:{_CAP}[ ]){{1,4}}(?:Business|Industrial|Retail|Science|Trading)[ ](?:Park|Estate)\b"
    rf"|{_FLAT}{_HOUSE},?[ ](?:bis[ ]|ter[ ])?(?:rue|avenue|boulevard|place|chemin|quai|allée|impasse|cours)[ ](?:(?:de|du|des|la|les|l'|d')[ ]?)*{_CAP}(?:[ -]{_CAP})*"
    rf"|(?:{_CAP}[ ])?{_CAP}er[ ](?:Straße|Strasse|Str\.|Allee|Platz|Weg|Ring|Gasse)[ ]{_HOUSE}\b"
    rf"|[{_UP}][\w-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|pfad)[ ]{_HOUSE}\b"
    rf"|(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|C/)[ ](?:(?:de|del|la|los|las)[ ])*{_CAP}(?:[ ](?:de|del|la|los|las|{_CAP}))*,?[ ]{_HOUSE}\b"
    r"|P\.?[ ]?O\.?[ ]?Box[ ]\d{1,6}\b|(?:Postfach|Apartado(?:[ ]de[ ]Correos)?)[ ]\d{1,6}\b)",
)
#: Words that introduce an address in capitals and are no part of it.
_INTRODUCE = {"wohnhaft", "anschrift", "adresse", "wohnort", "domicilio", "domicile"}
#: Legal forms and kinds of firms that follow a founder's name.
_FIRM = re.compile(r"\s+(?:&|and\s+(?:Sons|Partners|Co)\b|(?:Capital|Holdings?|Partners|Logistics|Shipping|Trust|Group|Bank|Insurance|Advisors|Trading|Industries|Consulting|Ventures|GmbH|AG|KG|Ltd|Limited|LLC|LLP|Inc|Corp|Company|Co|SA|SARL|SL|plc|team)\b)", re.I)
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herrn?|Frau|Mme|Mlle|M|Sr|Sra|Don|Doña|Monsieur|Madame|Señora?)\.?\s+$", re.I)
_BEFORE = re.compile(rf"(?:(?<![\w'’.@+-])(?P<given>[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)?)\s+)?(?:(?<![\w'’.@+-])(?P<initial>[^\W\d_]\.)(?:\s*[^\W\d_]\.)*\s*)?(?P<particle>(?:de|del|della|di|da|du|von|van|zu)\s+(?:(?:la|las|los|der|den)\s+)?)?$")
_AFTER_GIVEN = re.compile(rf",\s+(?P<given>[{_UP}a-z][\w'’-]*)(?![\w'’.+-]*\s?(?:@|[(\[]at))(?:\s+[{_UP}]\.(?!\w))?")
#: A family name with a particle; it counts next to a known given name, an initial or a title only.
_PARTICLED = re.compile(rf"(?<![\w'’@.-])(?i:(?:de|del|della|di|da|du|von|van|zu)\s+(?:(?:la|las|los|der|den)\s+)?){_CAP}(?![@])")
#: A title and the capitalised words after it: a name whether or not it is listed.
_TITLED = re.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herrn?|Frau|Mme|Mlle|Sr|Sra|Monsieur|Madame|Señora?)\.?[ ](?P<name>(?:{_CAP}[ ]|[{_UP}]\.[ ]?){{0,2}}(?:(?:de|del|della|di|da|du|von|van|zu)[ ])?{_CAP})(?![@\w])")
#: A given name that is listed, and the one or two capitalised words after it.
_GIVEN_FIRST = re.compile(rf"(?<![\w'’.@+-])(?P<given>{_CAP})[ ](?:[{_UP}]\.[ ]?)?(?P<next>{_CAP})(?:[ -]{_CAP})?(?![@\w])")
#: Capitalised words that come before a family name without being a given name.
_NO_FAMILY = set("i we you he she it they this that these those there here the a an and but or if when will would can could may must shall should does did do is are was were has have had not no yes".split())
_NO_GIVEN = set(
    "mr mrs ms miss mx dr prof herr herrn frau mme mlle sr sra don doña monsieur madame señor señora client clienta cliente kunde kundin customer contact holder reviewer owner "
    "account by to from for with and or an the at of on in a le la el los las der die das von bei nach et y und que about thanks spoke regards names name is was not ask cc re pls see file siehe ver voir mit an "
    "à con de du des por per prepared approved signed sender subject exemple ejemplo beispiel example consultas questions id ref as here also that this asked posted according notified complaint".split()
)


def affixes(names: set[str]) -> tuple[list[str], list[str]]:
    """Beginnings and endings that recur among lower-cased names and together form them."""
    head, tail = Counter(), Counter()
    for n in names:
        for i in range(3, len(n) - 1):
            head[n[:i]] += 1
            tail[n[i:]] += 1
    heads, tails = Counter(), Counter()
    for n in names:
        best = max(((min(head[n[:i]], 9) * min(tail[n[i:]], 9), i) for i in range(3, len(n) - 1) if head[n[:i]] > 1 and tail[n[i:]] > 2), default=None)
        if best:
            heads[n[: best[1]]] += 1
            tails[n[best[1] :]] += 1
    return sorted(h for h, c in heads.items() if c > 1), sorted(t for t, c in tails.items() if c > 2)


def name_forms(rows: list[tuple[str, str]]) -> tuple[list[str], set[str], list[str], list[str]]:
    """(listed family names, listed given names, recurring family beginnings, recurring family endings)."""
    family = sorted({n for n, k in rows if n and k == "family"})
    given = {n.lower() for n, k in rows if n and k == "given"}
    return family, given, *affixes({f.lower() for f in family})


class Finder:
    """Finds mentions in one text; built once a task from the listed names."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        family, self.given, heads, tails = name_forms(names)
        alt = lambda xs: "|".join(map(re.escape, sorted(xs, key=len, reverse=True)))
        starts, ends = affixes(self.given)
        self.given_form = re.compile(rf"(?:{alt(starts)})(?:{alt(ends)})") if starts and ends else None
        form = re.compile(f"(?:{alt(heads)})(?:{alt(tails)})") if heads and tails else None
        rest = {f.lower() for f in family if not (form and form.fullmatch(f.lower()))}
        self.one = "|".join(x for x in (alt(rest), form.pattern if form else "") if x)
        self.family = self._pattern(self.one)

    @staticmethod
    def _pattern(one: str) -> re.Pattern | None:
        # matched against lower-cased text: without case folding the alternatives are told apart by their first letters
        return re.compile(rf"\b(?<!['’@-])(?:{one})(?:-(?:{one}))?(?![\w'’@])") if one else None

    def __call__(self, text: str, listed: list[tuple[str, str]] = ()) -> list[tuple[str, int, int]]:
        """(kind, start, end) in order of their start; ``listed`` are names of long lists that are among the text's words."""
        out: list[tuple[str, int, int]] = []
        taken = bytearray(len(text))

        def add(kind: str, a: int, b: int) -> None:
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((kind, a, b))

        if "@" in text or "at)" in text or "at]" in text or "AT)" in text:
            for m in _EMAIL.finditer(text):
                if m.group().rsplit(".", 1)[-1].lower() not in _FILES:
                    add("email", *m.span())
        for m in _ADDRESS.finditer(text):
            a, b = m.span()
            first = m.group().split(" ", 1)[0]
            if first.lower() in _INTRODUCE:
                a += len(first) + 1
            add("address", a, b)
        for m in _IBAN.finditer(text):
            if iban_ok(m.group()):
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        for m in _ID.finditer(text):
            if is_id(m.group()):
                add("id_number", *m.span())
        at = 0
        while m := _PHONE.search(text, at):
            a, b = m.span()
            # two numbers side by side: the first ends where it would have too many digits
            while sum(c.isdigit() for c in text[a:b]) > 15 and (cut := max(text.rfind(c, a, b) for c in " .-/")) > a:
                b = cut
            if 7 <= sum(c.isdigit() for c in text[a:b]) <= 15:
                add("phone", a, b)
            at = max(b, a + 1)
        low = text.lower()
        if len(low) != len(text):  # a few capitals have longer small forms
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        family, given = self.family, self.given
        if listed:
            family = self._pattern("|".join([*(re.escape(n.lower()) for n, k in listed if k == "family"), *([self.one] if self.one else [])]))
            given = given | {n.lower() for n, k in listed if k == "given"}
        if family:
            for m in family.finditer(low):
                span = self._name(text, low, family, given, *m.span())
                if span:
                    add("name", *span)
            for m in _PARTICLED.finditer(text):
                span = self._name(text, low, family, given, *m.span(), particled=True)
                if span:
                    add("name", *span)
        for m in _TITLED.finditer(text):
            if not _FIRM.match(text, m.end()):
                add("name", *m.span("name"))
        for m in _GIVEN_FIRST.finditer(text):
            if self._is_given(m["given"], given) and m["next"].lower() not in _NO_FAMILY and not _FIRM.match(text, m.end()):
                add("name", *m.span())
        return sorted(out, key=lambda x: x[1])

    def _is_given(self, word: str, given: set[str]) -> bool:
        w = word.lower()
        return w in given or bool(self.given_form and self.given_form.fullmatch(w))

    def _name(self, text: str, low: str, family: re.Pattern, listed: set[str], a: int, b: int, particled: bool = False) -> tuple[int, int] | None:
        if _FIRM.match(text, b):
            return None
        upper = particled or text[a].isupper()
        left = text[max(0, a - 48) : a]
        m = _BEFORE.search(left)
        given, initial = m["given"], m["initial"]
        known = given is not None and self._is_given(given, listed)
        if m["particle"] and not (known or (initial is not None and initial[0].isupper() == upper)):
            given = initial = None  # a preposition
            known = False
        likely = given is not None and given[0].isupper() and len(given) > 2 and given.lower() not in _NO_GIVEN and upper and not particled
        base = a - len(left)
        if given is not None and (known or likely) and (initial is None or initial[0].isupper() == upper):
            return base + m.start("given"), b
        if initial is not None and initial[0].isupper() == upper:
            return base + m.start("initial"), b
        after = _AFTER_GIVEN.match(text, b)
        if after and self._is_given(after["given"], listed) and not (text[after.end() : after.end() + 1] == " " and family.match(low, after.end() + 1)):
            return a, after.end()
        if _TITLE.search(left):
            return a, b
        return None


# ---------------------------------------------------------------- checks of numbers
#: Check letters of Spanish identity numbers by remainder of 23.
_SPANISH = "TRWAGMYFPDXBNJZSQVHLCKE"
_COMPACT = re.compile(r"[^0-9A-Za-z]")


def iban_ok(value: str) -> bool:
    v = _COMPACT.sub("", value).upper()
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _tax_check(ten: str) -> int:
    """Check digit of a German tax number (ISO 7064, mod 11,10)."""
    p = 10
    for c in ten:
        s = (int(c) + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10


def _nir_key(thirteen: str) -> int:
    return 97 - int(thirteen.replace("2A", "19").replace("2B", "18")) % 97


def _ssn_ok(n: int) -> bool:
    """Whether nine digits can be an American social security number."""
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def is_id(value: str) -> bool:
    """Forms that other numbers share count only with their check digits; the others by form."""
    v = _COMPACT.sub("", value).upper()
    if re.fullmatch(r"[12]\d{4}(?:\d{2}|2[AB])\d{8}", v):
        return int(v[13:]) == _nir_key(v[:13])
    if re.fullmatch(r"[1-9]\d{10}", v) and not re.search(r"[.]", value):
        return int(v[10]) == _tax_check(v[:10])
    if re.fullmatch(r"\d{9}", v) and v[0] != "9":
        return _ssn_ok(int(v))
    return True


# ---------------------------------------------------------------- pseudonyms
def _round(key: bytes, label: str, k: int, value: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{label}|{k}|{value}".encode(), key=key[:64], digest_size=16).digest(), "big")


def permute(value: int, size: int, key: bytes, label: str, rounds: int = 8) -> int:
    """Keyed permutation of 0..size-1: an unbalanced Feistel network on two mixed-radix halves, walked until inside."""
    if size < 2:
        return value
    left = isqrt(size - 1) + 1
    right = -(-size // left)
    x = value
    while True:
        a, b = divmod(x, right)
        for k in range(rounds):
            if k % 2:
                b = (b + _round(key, label, k, a)) % right
            else:
                a = (a + _round(key, label, k, b)) % left
        x = a * right + b
        if x < size:
            return x


def unpermute(value: int, size: int, key: bytes, label: str, rounds: int = 8) -> int:
    """Inverse of :func:`permute`."""
    if size < 2:
        return value
    left = isqrt(size - 1) + 1
    right = -(-size // left)
    x = value
    while True:
        a, b = divmod(x, right)
        for k in reversed(range(rounds)):
            if k % 2:
                b = (b - _round(key, label, k, a)) % right
            else:
                a = (a - _round(key, label, k, b)) % left
        x = a * right + b
        if x < size:
            return x


def permute_like(value: int, size: int, key: bytes, label: str, kind: Callable[[int], object]) -> int:
    """Keyed permutation of 0..size-1 that leaves ``kind`` of the value as it is (walked until it is the same)."""
    like, x = kind(value), value
    while True:
        x = permute(x, size, key, label)
        if kind(x) == like:
            return x


def _in_format(value: str, chars: str) -> str:
    """The letters and digits of ``value`` replaced by ``chars`` in their order; case and marks stay."""
    new = iter(chars)
    return "".join((n.lower() if c.islower() else n) if c.isalnum() and c.isascii() and (n := next(new)) else c for c in value)


def _letters(text: str) -> int:
    n = 0
    for c in text:
        n = n * 26 + ord(c) - 65
    return n


def _spell(n: int, width: int) -> str:
    return "".join(chr(65 + n // 26**k % 26) for k in range(width - 1, -1, -1))


def _date(yymmdd: str, key: bytes) -> str | None:
    """Another date of the same century; null for what is no date."""
    try:
        day = (dt.date(2000 + int(yymmdd[:2]), int(yymmdd[2:4]), int(yymmdd[4:])) - dt.date(2000, 1, 1)).days
    except ValueError:
        return None
    return (dt.date(2000, 1, 1) + dt.timedelta(days=permute(day, 36525, key, "date"))).strftime("%y%m%d")


def id_pseudonym(value: str, key: bytes) -> str:
    """Another number of the same form; a valid number becomes a valid one, with its own check letter or digits."""
    v = _COMPACT.sub("", value).upper()
    n_of = lambda x, size, label, kind=bool: permute_like(x, size, key, label, lambda y: kind(y))
    if m := re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", v):
        lead, digits, letter = m.groups()
        if len(digits) == 8 - bool(lead):
            n = int(digits) + "XYZ".index(lead) * 10**7 if lead else int(digits)
            if _SPANISH[n % 23] == letter:
                new = permute(n, 3 * 10**7 if lead else 10**8, key, f"spanish{bool(lead)}")
                return _in_format(value, ("XYZ"[new // 10**7] + f"{new % 10**7:07}" if lead else f"{new:08}") + _SPANISH[new % 23])
            wrong = lambda y: _SPANISH[y // 26 % 23] == chr(65 + y % 26)
            new = permute_like((n * 26) + ord(letter) - 65, (3 * 10**7 if lead else 10**8) * 26, key, f"unchecked{bool(lead)}", wrong)
            n = new // 26
            return _in_format(value, ("XYZ"[n // 10**7] + f"{n % 10**7:07}" if lead else f"{n:08}") + chr(65 + new % 26))
    if m := re.fullmatch(r"(\d{6})(\d{3})(\d{2})", v) if "." in value else None:
        century = next((c for c in ("", "2") if 97 - int(c + v[:9]) % 97 == int(m[3])), None)
        day, serial = _date(m[1], key), f"{permute(int(m[2]), 1000, key, 'serial'):03}"
        if day is None:
            return _in_format(value, f"{permute(int(v), 10**11, key, 'undated'):011}")
        if century is None:
            wrong = lambda y: any(97 - int(c + day + serial) % 97 == y for c in ("", "2"))
            return _in_format(value, day + serial + f"{permute_like(int(m[3]), 100, key, 'check', wrong):02}")
        return _in_format(value, day + serial + f"{97 - int(century + day + serial) % 97:02}")
    if re.fullmatch(r"[12]\d{4}(?:\d{2}|2[AB])\d{8}", v) and int(v[13:]) == _nir_key(v[:13]):
        month = permute(int(v[1:3]) * 12 + int(v[3:5]) - 1, 1200, key, "birth")
        place, serial = (v[5:7] if v[5:7] in ("2A", "2B") else f"{permute(int(v[5:7]), 100, key, 'place'):02}"), f"{permute(int(v[7:13]), 10**6, key, 'order'):06}"
        new = v[0] + f"{month // 12:02}{month % 12 + 1:02}" + place + serial
        return _in_format(value, new + f"{_nir_key(new):02}")
    if re.fullmatch(r"[1-9]\d{10}", v) and int(v[10]) == _tax_check(v[:10]):
        new = f"{permute_like(int(v[:10]), 10**10, key, 'tax', lambda y: y >= 10**9):010}"
        return _in_format(value, new + str(_tax_check(new)))
    if re.fullmatch(r"\d{9}", v):
        return _in_format(value, f"{permute_like(int(v), 10**9, key, 'ssn', _ssn_ok):09}")
    if m := re.fullmatch(r"([A-Z]{2})(\d{6})([A-D])", v):
        new = permute((_letters(m[1]) * 10**6 + int(m[2])) * 4 + ord(m[3]) - 65, 26**2 * 4 * 10**6, key, "nino")
        return _in_format(value, _spell(new // (4 * 10**6), 2) + f"{new // 4 % 10**6:06}" + "ABCD"[new % 4])
    # one letter and digits, or whatever else: letters among letters, digits among digits
    letters, digits = "".join(c for c in v if c.isalpha()), "".join(c for c in v if c.isdigit())
    size = 10 ** len(digits)
    new = permute(_letters(letters) * size + int(digits or 0), 26 ** len(letters) * size, key, f"mixed{len(letters)},{len(digits)}")
    a, d = iter(_spell(new // size, len(letters))), iter(f"{new % size:0{len(digits)}}" if digits else "")
    return _in_format(value, "".join(next(a) if c.isalpha() else next(d) for c in v))


def national_part(value: str) -> list[int]:
    """Places of the digits that identify a subscriber: without country code, its prefix and a trunk zero."""
    at = [i for i, c in enumerate(value) if c.isdigit() and c.isascii()]
    digits = "".join(value[i] for i in at)
    skip = 0
    if "+" in value or digits.startswith("00"):
        skip = 0 if "+" in value else 2
        rest = digits[skip:]
        # country codes are prefix-free: 1 and 7, the listed codes of two digits, and others of three
        two = rest[:2] in {"20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}
        skip += 1 if rest[:1] in ("1", "7") else 2 if two else 3
        skip += digits[skip : skip + 1] == "0"
    elif len(digits) == 11 and digits[0] == "1":
        skip = 1
    elif digits.startswith("0"):
        skip = 1
    return at[min(skip, max(0, len(at) - 4)) :]


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """Numbers permuted within their format, whatever their notation; other kinds get a keyed token."""
    if kind == "id_number":
        return id_pseudonym(value, key)
    if kind == "phone":
        at = national_part(value)
        size = 10 ** len(at)
        new = f"{permute_like(int(''.join(value[i] for i in at)), size, key, f'phone{len(at)}', lambda y: y * 10 >= size):0{len(at)}}"
        chars = list(value)
        for i, c in zip(at, new):
            chars[i] = c
        return "".join(chars)
    plain = " ".join(re.sub(r"\s*[(\[]at[)\]]\s*", "@", re.sub(r"\s*[(\[]dot[)\]]\s*", ".", value, flags=re.I), flags=re.I).lower().split()).replace(" @ ", "@")
    if kind == "name" and ", " in plain:
        plain = " ".join(reversed(plain.split(", ", 1)))
    return hmac.new(key, f"{kind}|{plain}".encode(), "sha256").hexdigest()[:10]


def _names(known: DataFrame, most: int) -> tuple[list[tuple[str, str]], bool]:
    """(names for every task, whether these are all)."""
    rows = known.select("name", "name_kind").where("name is not null and name_kind is not null").distinct()
    few = rows.limit(most + 1).count() <= most
    picked = rows if few else rows.orderBy(F.xxhash64("name"), "name", "name_kind").limit(most)
    return sorted((r["name"], r["name_kind"]) for r in picked.collect()), few


def _with_names(texts: DataFrame, known: DataFrame, most: int) -> tuple[list[tuple[str, str]], DataFrame]:
    """(names for every task; tbl, row_key, text, listed): of a long list the names among a text's own words, by a join on words."""
    names, few = _names(known, most)
    src = texts.select("tbl", F.col("row_key").cast("string").alias("row_key"), "text").where("row_key is not null and text is not null")
    if few:
        return names, src.withColumn("listed", F.array().cast("array<struct<name: string, name_kind: string>>"))
    src = src.distinct().withColumn("print", F.xxhash64("tbl", "row_key", "text"))
    words = src.select("print", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_'’]+"), F.lit(0)))).alias("w"))
    listed = known.select("name", "name_kind").where("name is not null and name_kind is not null").distinct().withColumn("w", F.lower("name"))
    own = words.join(listed, "w").groupBy("print").agg(F.collect_set(F.struct("name", "name_kind")).alias("listed"))  # at most a text's words
    return names, src.join(own, "print", "left").drop("print").withColumn("listed", F.coalesce("listed", F.array()))


_TEXTS = ("tbl", "row_key", "text", "listed")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str, str, list[tuple[str, str]]]]:
    for t, k, text, listed in zip(*(batch.column(i).to_pylist() for i in range(4))):
        yield t, k, text, [(x["name"], x["name_kind"]) for x in listed or ()]


def find_mentions(texts: DataFrame, known: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """(tbl, row_key, pii_kind, start_pos, end_pos) of the mentions in (tbl, row_key, text), once each."""
    names, src = _with_names(texts, known, most)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(names)
        for batch in parts:
            rows = [(t, k, *m) for t, k, text, listed in _rows(batch) for m in find(text, listed)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["tbl", "row_key", "pii_kind", "start_pos", "end_pos"])

    return src.select(*_TEXTS).mapInArrow(run, "tbl string, row_key string, pii_kind string, start_pos long, end_pos long").distinct()


def redact(texts: DataFrame, known: DataFrame, key: bytes, most: int = MOST_NAMES) -> DataFrame:
    """(tbl, row_key, text, n_mentions): the texts with a typed placeholder for every mention, row by row."""
    if not key:
        raise ValueError("a key is needed")
    names, src = _with_names(texts, known, most)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(names)
        memo: dict[tuple[str, str], str] = {}
        for batch in parts:
            rows = []
            for tbl, row_key, t, listed in _rows(batch):
                found, at, made = find(t, listed), 0, []
                for kind, a, b in found:
                    value = (kind, t[a:b])
                    if value not in memo:
                        if len(memo) >= 100_000:
                            memo.clear()
                        memo[value] = pseudonym(*value, key)
                    made += [t[at:a], f"[{kind.upper()}:{memo[value]}]"]
                    at = b
                rows.append((tbl, row_key, "".join(made) + t[at:], len(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int32()))], names=["tbl", "row_key", "text", "n_mentions"])

    return src.select(*_TEXTS).mapInArrow(run, "tbl string, row_key string, text string, n_mentions int")


def free_texts(chunks: DataFrame, feedback: DataFrame, escalations: DataFrame) -> DataFrame:
    """(tbl, row_key, text) of the columns that hold free text."""
    pick = lambda df, tbl, key, text: df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("string").alias("row_key"), F.col(text).cast("string").alias("text"))
    return pick(chunks, "chunks", "chunk_id", "text").unionByName(pick(feedback, "feedback", "id", "comment")).unionByName(pick(escalations, "escalations", "id", "note"))
