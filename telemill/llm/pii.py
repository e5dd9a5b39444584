"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Each kind of value is recognised by its format and validated (Luhn and mod-97 check digits, calendar dates, octets,
ranges of number blocks).  A validated value is written as one number in a mixed radix, one digit for each variable
character, permuted over exactly that range and written back in the same format with valid check digits.  So equal
values get equal pseudonyms in all documents and different values different ones, whatever separators they are written
with, and no value keeps its own: the permutation is a keyed cycle (permute, step, permute back).
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .arrow import map_columns, map_slices
from .feistel import KeyedPermutation
from .spans import Spans

LOWER, UPPER, DIGIT, HEX = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
#: Dates are permuted within these years.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
#: Fixed value: English month names.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


#: Characters of a value that are permuted as one number.
WHOLE = 128


class Pseudonyms:
    """Pseudonyms of single values under one key."""

    def __init__(self, key: bytes):
        self.key = key
        self._cycle = lru_cache(maxsize=512)(lambda n, tweak: KeyedPermutation(n, key, tweak))
        self._remembered = lru_cache(maxsize=50_000)(self._value)

    def value(self, kind: str, text: str) -> str:
        return self._remembered(kind, text) if len(text) <= WHOLE else self._value(kind, text)

    def number(self, x: int, n: int, tweak: str) -> int:
        """Another number below n (the same if n is 1); one to one for each n and tweak."""
        if n < 2:
            return x
        p = self._cycle(n, tweak)
        return p.invert((p(x) + 1) % n)

    def characters(self, text: str, alphabets: list[str], tweak: str) -> str:
        """``text`` with each character replaced within the alphabet of its place.

        What is longer than WHOLE is replaced in pieces, the first under a tweak of all others, each other under one of
        the new piece before it: still one to one, as the pieces can be put back from the second on.
        """
        if len(text) > WHOLE:
            cuts = range(0, len(text), WHOLE // 2)
            before = hashlib.blake2b(text[WHOLE // 2 :].encode(), key=self.key[:64]).hexdigest()
            out = []
            for k in cuts:
                piece, rule = text[k : k + WHOLE // 2], alphabets[k : k + WHOLE // 2]
                out.append(self.characters(piece, rule, f"{tweak}:{len(text)}:{k}:{before}"))
                before = hashlib.blake2b((before + out[-1]).encode() if k else out[-1].encode(), key=self.key[:64]).hexdigest()
            return "".join(out)
        n = x = 1
        x = 0
        for c, a in zip(text, alphabets, strict=True):
            x, n = x * len(a) + a.index(c), n * len(a)
        x = self.number(x, n, f"{tweak}:{','.join(alphabets)}")
        out = []
        for a in reversed(alphabets):
            x, k = divmod(x, len(a))
            out.append(a[k])
        return "".join(reversed(out))

    def classes(self, text: str, tweak: str) -> str:
        """Letters stay letters of the same case, digits digits, everything else stays."""
        variable = [c for c in text if c in DIGIT or c in LOWER or c in UPPER]
        new = iter(self.characters("".join(variable), [DIGIT if c in DIGIT else LOWER if c in LOWER else UPPER for c in variable], tweak))
        return "".join(next(new) if c in DIGIT or c in LOWER or c in UPPER else c for c in text)

    def _value(self, kind: str, text: str) -> str:
        return KINDS[kind][2](self, text)


def relaid(text: str, new: str, among: str = DIGIT) -> str:
    """``text`` with its characters of ``among`` replaced by those of ``new``, in order; separators stay."""
    it = iter(new)
    return "".join(next(it) if c in among else c for c in text)


def digits(text: str) -> str:
    return "".join(c for c in text if c in DIGIT)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        v = int(c) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def is_card(text: str) -> bool:
    d = digits(text)
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn_digit(d[:-1]) == d[-1]


def _card(p: Pseudonyms, text: str) -> str:
    d = digits(text)
    body = d[0] + p.characters(d[1:-1], [DIGIT] * (len(d) - 2), f"card:{d[0]}")
    return relaid(text, body + luhn_digit(body))


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban_parts(text: str) -> str:
    return re.sub(r"\s", "", text)


def is_iban(text: str) -> bool:
    s = _iban_parts(text)
    return 15 <= len(s) <= 34 and 2 <= int(s[2:4]) <= 98 and iban_check(s[:2], s[4:]) == s[2:4]


def _iban(p: Pseudonyms, text: str) -> str:
    s = _iban_parts(text)
    account = p.classes(s[4:], f"iban:{s[:2]}")
    return relaid(text, s[:2] + iban_check(s[:2], account) + account, DIGIT + UPPER)


_AREAS = [f"{k:03d}" for k in range(1, 900) if k != 666]


def is_ssn(text: str) -> bool:
    return text[:3] in set(_AREAS) and text[4:6] != "00" and text[7:] != "0000"


def _ssn(p: Pseudonyms, text: str) -> str:
    x = (_AREAS.index(text[:3]) * 99 + int(text[4:6]) - 1) * 9999 + int(text[7:]) - 1
    x, serial = divmod(p.number(x, len(_AREAS) * 99 * 9999, "ssn"), 9999)
    area, group = divmod(x, 99)
    return f"{_AREAS[area]}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"


def is_phone(text: str) -> bool:
    return 8 <= len(digits(text)) <= 15


def _phone(p: Pseudonyms, text: str) -> str:
    """The country code stays; so do the ranges of area and exchange numbers where the code is 1."""
    d = digits(text)
    code = ""
    if m := re.match(r"(\+|00)([1-9]\d{0,2})(?=\D)", text):
        code = digits(m[1]) + m[2]
    national = d[len(code) :]
    rule = [DIGIT] * len(national)
    if len(national) == 10 and (not code or code.lstrip("0") == "1"):
        for k in (0, 3):
            if national[k] in "23456789":
                rule[k] = "23456789"
        code_tweak = "1"
    else:
        code_tweak = code.lstrip("0")
    return relaid(text, code + p.characters(national, rule, f"phone:{code_tweak}"))


def is_ip(text: str) -> bool:
    return all(int(x) < 256 and str(int(x)) == x for x in text.split("."))


def _ip(p: Pseudonyms, text: str) -> str:
    x = int.from_bytes(bytes(int(k) for k in text.split(".")), "big")
    return ".".join(map(str, p.number(x, 1 << 32, "ip").to_bytes(4, "big")))


_DATE_FORMS = (
    (re.compile(r"(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{2})(?P=s)(?P<d>\d{2})"), "{y:04d}{s}{m:02d}{s}{d:02d}"),
    (re.compile(r"(?P<d>\d{2})(?P<s>[-/.])(?P<m>\d{2})(?P=s)(?P<y>\d{4})"), "{d:02d}{s}{m:02d}{s}{y:04d}"),
    (re.compile(rf"(?P<d>\d{{1,2}}) (?P<n>{'|'.join(MONTHS)}) (?P<y>\d{{4}})"), "{d} {n} {y:04d}"),
    (re.compile(rf"(?P<n>{'|'.join(MONTHS)}) (?P<d>\d{{1,2}}), (?P<y>\d{{4}})"), "{n} {d}, {y:04d}"),
)


def _read_date(text: str) -> tuple[date, str, str] | None:
    for pattern, form in _DATE_FORMS:
        if m := pattern.fullmatch(text):
            g = m.groupdict()
            month = MONTHS.index(g["n"]) + 1 if "n" in g else int(g["m"])
            day = int(g["d"])
            if "n" not in g and month > 12 and not pattern.pattern.startswith("(?P<y>"):
                month, day, form = day, month, "{m:02d}{s}{d:02d}{s}{y:04d}"  # month first
            try:
                when = date(int(g["y"]), month, day)
            except ValueError:
                return None
            return (when, form, g.get("s", "")) if FIRST_DAY <= when <= LAST_DAY else None
    return None


def is_date(text: str) -> bool:
    return _read_date(text) is not None


def _date(p: Pseudonyms, text: str) -> str:
    """The same day gets the same other day in every notation (day first, where both readings are dates)."""
    when, form, sep = _read_date(text)
    day = FIRST_DAY + timedelta(p.number((when - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, "date"))
    if form.startswith("{m"):  # keeps showing its order
        form = "{m:02d}{s}{d:02d}{s}{y:04d}"
    return form.format(y=day.year, m=day.month, d=day.day, s=sep, n=MONTHS[day.month - 1])


def _email(p: Pseudonyms, text: str) -> str:
    """Name and host names but the last two are replaced; case doesn't tell addresses apart, so it is given up."""
    name, _, host = text.lower().partition("@")
    labels = host.split(".")
    changed = ".".join([p.classes(".".join(labels[:-2]), "host"), *labels[-2:]]) if len(labels) > 2 else host
    return f"{p.classes(name, 'email:' + host)}@{changed}"


def _access_key(p: Pseudonyms, text: str) -> str:
    return text[:4] + p.characters(text[4:], [UPPER + DIGIT] * (len(text) - 4), "access-key")


def _secret(p: Pseudonyms, text: str) -> str:
    return p.characters(text, [HEX] * len(text), "secret") if all(c in HEX for c in text) else p.classes(text, "secret")


_any: Callable[[str], bool] = lambda text: True

#: Kind: pattern (group v or all of it), validation, pseudonym; earlier kinds win where places overlap.
KINDS: dict[str, tuple[re.Pattern, Callable[[str], bool], Callable[[Pseudonyms, str], str]]] = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])"), _any, _email),
    "secret": (re.compile(r"""(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)["']?[ \t]{0,3}[=:][ \t]{0,3}["']?(?P<v>[A-Za-z0-9_+/.~-]{6,}[A-Za-z0-9])"""), _any, _secret),
    "access_key": (re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), _any, _access_key),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), is_iban, _iban),
    "card": (re.compile(r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?!\d|[.-]\d)"), is_card, _card),
    "ip": (re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"), is_ip, _ip),
    "date": (re.compile(rf"(?<![\w.+/-])(?:\d{{4}}([-/.])\d{{2}}\1\d{{2}}|\d{{2}}([-/.])\d{{2}}\2\d{{4}}|\d{{1,2}} (?:{'|'.join(MONTHS)}) \d{{4}}|(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}})(?=T\d{{2}}:?\d{{2}}|(?![\w/-]|\.\d))"), is_date, _date),
    "ssn": (re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)"), is_ssn, _ssn),
    "phone": (re.compile(r"(?<![\w.+-])(?:(?:\+|(?<!\d )00)[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d)"), is_phone, _phone),
}
#: Lengths of IBANs by country, tried first; then all that a text allows.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_RUN, _GROUP = re.compile(r"(?:\d[ -]?){12,}\d"), re.compile(r"\d+")


def _cards(text: str, accept: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Within a run of groups of digits, from each group on the longest stretch of whole groups that is accepted."""
    for run in _RUN.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *run.span())]
        first = 0
        if run.start() and text[run.start() - 1] in ".+-":
            first = 1
        last = len(groups) - (text[run.end() : run.end() + 1] == "." and text[run.end() + 1 : run.end() + 2].isdigit())
        while first < last:
            n, stops = 0, []
            for k in range(first, last):
                n += groups[k][1] - groups[k][0]
                if n > 19:
                    break
                if n >= 13:
                    stops.append(k)
            start = groups[first][0]
            first += 1
            for k in reversed(stops):
                if accept(start, groups[k][1]):
                    yield start, groups[k][1]
                    first = k + 1
                    break


def _shortened(kind: str, text: str, accept: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Matches of a pattern, each up to the last end of a group at which it is accepted; else from the next start."""
    pattern, at = KINDS[kind][0], 0
    while m := pattern.search(text, at):
        start, stop = m.span()
        stops = [k for k in range(stop, start + 1, -1) if k == stop or (text[k - 1].isalnum() and not text[k].isalnum())]
        if size := kind == "iban" and IBAN_SIZES.get(text[start : start + 2]):
            stops.sort(key=lambda k: len(_iban_parts(text[start:k])) != size)
        at = start + 1
        for k in stops:
            if (k == stop or pattern.fullmatch(text, start, k)) and accept(start, k):
                yield start, k
                at = k
                break


_DIGIT_OR_END = re.compile(r"""[0-9\s"']|\Z""")


def _secrets(text: str, accept: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Values with a digit, in them or after them before the next blank or quote."""
    stop = -1
    for m in KINDS["secret"][0].finditer(text):
        start, end = m.span("v")
        if stop < start:
            stop = _DIGIT_OR_END.search(text, start).start()
        if text[stop : stop + 1].isdigit() and accept(start, end):
            yield start, end


_WORTH = re.compile(r"[0-9@]")


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the validated values in a text, in order; they don't overlap."""
    if not _WORTH.search(text):
        return []
    found: list[tuple[int, int, str]] = []
    taken = Spans()
    for kind, (pattern, valid, _) in KINDS.items():
        accept = lambda a, b, valid=valid: valid(text[a:b]) and taken.take(a, b)
        if kind == "card":
            places = _cards(text, accept)
        elif kind == "secret":
            places = _secrets(text, accept)
        elif kind in ("iban", "phone"):
            places = _shortened(kind, text, accept)
        else:
            places = (p for m in pattern.finditer(text) if accept(*(p := m.span("v" if "v" in pattern.groupindex else 0))))
        found += [(*p, kind) for p in places]
    return sorted(found)


def replace(text: str, pseudonyms: Pseudonyms) -> tuple[str, list[tuple[int, int, str]]]:
    places = find(text)
    out, at = [], 0
    for start, end, kind in places:
        out += [text[at:start], pseudonyms.value(kind, text[start:end])]
        at = end
    return "".join([*out, text[at:]]), places


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of ``docs`` with pseudonyms in ``text``, and a column ``pii`` of what was replaced (kind, start, stop).

    Starts and stops count characters of the text before.  A null text stays null and has an empty list; all other
    columns, ids included, are passed on whatever they hold, except that an existing column ``pii`` is replaced; an
    empty table stays empty.
    """
    docs = docs.drop("pii")
    places = _parse_datatype_string("array<struct<kind: string, start: int, stop: int>>")
    schema = StructType([*docs.schema.fields, StructField("pii", places)])
    arrow, at = to_arrow_schema(schema), docs.columns.index("text")

    def run(part: pa.RecordBatch, p: Pseudonyms) -> pa.RecordBatch:
        done = [replace(t, p) if t is not None else (None, []) for t in part.column(at).to_pylist()]
        columns = [*part.columns, pa.array([[{"kind": k, "start": a, "stop": b} for a, b, k in found] for _, found in done], arrow.field("pii").type)]
        columns[at] = pa.array([t for t, _ in done], arrow.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    return map_slices(docs, run, schema, lambda: Pseudonyms(key))


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n_pii, kinds (distinct, sorted, comma-joined), n_chars of the new text, and the new text."""

    def run(cols: dict, p: Pseudonyms) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_pii", "kinds", "text")}
        for key_, text in zip(cols["doc_id"], cols["text"], strict=True):
            new, places = replace(text, p) if text is not None else (None, [])
            for k, v in zip(out, (key_, len(places), ",".join(sorted({x[2] for x in places})), new), strict=True):
                out[k].append(v)
        return out

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, n_pii long, kinds string, text string", lambda: Pseudonyms(key))
