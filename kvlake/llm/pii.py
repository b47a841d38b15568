"""Format-preserving pseudonyms for personal data (operator 2).

What is found, and how it is validated: e-mail addresses; phone numbers by their
shape (3-3-4 digits, or + and a country code, or five pairs of digits from a 0); card numbers (13 to 19 digits, Luhn; also among further groups of digits); IBANs (mod 97);
US social security numbers; IPv4 and IPv6 addresses (not after words such as "version"); calendar dates in digits, or with the month's name in four
languages; secrets (values assigned to names such as token, long hexadecimal strings, access keys with the prefix of their
issuer). Numbers that fail their check are left alone.

Each value is sent through a keyed Feistel permutation of its own format: as
many digits or letters of the same kind in the same places, punctuation as it was. What
makes a value valid is kept: card and IBAN check digits are computed anew, dates are
permuted among the days of 1900 to 2099 that are written with as many digits, octets stay octets. A permutation sends
equal values to equal pseudonyms in every document, and different values of a format to different ones,
so records stay linked without the value. The domain of an e-mail address stays.

Domains that are not powers of two (days) are walked until the permutation lands inside them.

The key is never in the code: it is `kvlake.pii.key` of the session, or else a random one, made once and kept in the
shared folder (spark.checkpoint.dir), so that all documents of a corpus are linked.

Defined results: a null text stays null; a text without findings is unchanged; columns of the input
named as the results are replaced; repeated rows give equal rows; an empty table gives none; a text of any length is searched whole, in
time that grows with its length and its findings.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, shared_dir, table

#: The session's setting that names the key.
KEY_SETTING = "kvlake.pii.key"
ROUNDS = 10
#: Alphabets of letters and digits that are permuted among themselves.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
]
HEX = "0123456789abcdef"
_place = {c: (n, i) for n, a in enumerate(ALPHABETS) for i, c in enumerate(a)}
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


def _draw(key: bytes, tweak: str, round_: int, x: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{round_}|{x}".encode(), key=key, digest_size=32).digest(), "big")


def feistel(key: bytes, tweak: str, x: int, radix: int, length: int) -> int:
    """A keyed permutation of the numbers of `length` digits of a radix.

    One digit is shifted by a keyed amount other than zero, as it has no halves.
    """
    if length == 1:
        return (x + 1 + _draw(key, tweak, 0, 0) % (radix - 1)) % radix
    low = length // 2
    sizes = (radix ** (length - low), radix**low)
    a, b = divmod(x, sizes[1])
    for i in range(ROUNDS):  # even: the left half moves, odd: the right one
        if i % 2 == 0:
            a = (a + _draw(key, tweak, i, b)) % sizes[0]
        else:
            b = (b + _draw(key, tweak, i, a)) % sizes[1]
    return a * sizes[1] + b


def permute_digits(key: bytes, tweak: str, digits: str, alphabet: str = ALPHABETS[0]) -> str:
    """Symbols of one alphabet, as many as before."""
    radix, x = len(alphabet), 0
    for c in digits:
        x = x * radix + alphabet.index(c)
    x, out = feistel(key, f"{tweak}|{radix}|{len(digits)}", x, radix, len(digits)), []
    for _ in digits:
        x, r = divmod(x, radix)
        out.append(alphabet[r])
    return "".join(reversed(out))


def permute_text(key: bytes, tweak: str, text: str) -> str:
    """Each alphabet's symbols permuted among its places; the rest stays and enters the tweak."""
    at: dict[int, list[int]] = {}
    shape = []
    for i, c in enumerate(text):
        if c in _place:
            at.setdefault(_place[c][0], []).append(i)
            shape.append(str(_place[c][0]))
        else:
            shape.append(c)
    out, tweak = list(text), f"{tweak}|{''.join(shape)}"
    for n, places in at.items():
        for i, c in zip(places, permute_digits(key, f"{tweak}|{n}", "".join(text[i] for i in places), ALPHABETS[n]), strict=True):
            out[i] = c
    return "".join(out)


def refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """The sum that is 0 modulo 10 for a valid number."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits))) % 10


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def email(key: bytes, m: re.Match) -> str | None:
    local, _, domain = m[0].partition("@")
    return f"{permute_text(key, 'email', local)}@{domain}"


def phone(key: bytes, m: re.Match) -> str | None:
    head = m["cc"] or ""
    rest = m[0][len(head) :]
    return head + refill(rest, permute_digits(key, "phone", _digits(rest)))


class Spans:
    """Replacements (start, end, new) that do not overlap, by start."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.held: list[tuple[int, int, str]] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return not i or self.held[i - 1][1] <= a

    def add(self, a: int, b: int, new: str) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.held.insert(i, (a, b, new))


def phone_abroad(key: bytes, m: re.Match) -> str | None:
    return None if re.fullmatch(r"\+\d+\.\d+", m[0]) else phone(key, m)  # a decimal number


def card(key: bytes, digits: str) -> str:
    body = permute_digits(key, "card", digits[:-1])
    return body + str(-luhn(body + "0") % 10)


def cards(key: bytes, m: re.Match) -> list[tuple[int, int, str]]:
    """The cards among the groups of a run of digits, as (start, end, pseudonym); of overlapping ones the longest, then the first.

    A card has groups of three digits at least.
    """
    groups = [g.span() for g in re.finditer(r"\d+", m[0])]
    runs = []
    for i, (a, _) in enumerate(groups):
        digits = ""
        for x, b in groups[i : i + 7]:
            digits += m[0][x:b]
            if len(digits) > 19 or b - x < 3:
                break
            if len(digits) >= 13 and not luhn(digits) and int(digits):
                runs.append((-len(digits), a, b, digits))
    out = Spans()
    for _, a, b, digits in sorted(runs):
        if out.free(a, b):
            out.add(a, b, refill(m[0][a:b], card(key, digits)))
    return [(m.start() + a, m.start() + b, new) for a, b, new in out.held]


def iban(key: bytes, m: re.Match) -> str | None:
    plain = m[0].replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4]))
    if not 15 <= len(plain) <= 34 or number(plain) % 97 != 1:
        return None
    body = permute_text(key, f"iban|{plain[:2]}", plain[4:])
    new = iter(f"{plain[:2]}{98 - number(f'{plain[:2]}00{body}') % 97:02d}{body}")
    return "".join(c if c == " " else next(new) for c in m[0])


def ssn(key: bytes, m: re.Match) -> str | None:
    area, group, serial = m[0].split("-")
    if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
        return None
    x = m[0]
    while True:  # walk to the next valid number
        x = refill(x, permute_digits(key, "ssn", _digits(x)))
        area, group, serial = x.split("-")
        if not (area in ("000", "666") or area >= "900" or group == "00" or serial == "0000"):
            return x


_numbered = re.compile(r"(?i)(?:version|release|build|section|chapter|v|ver)\.?[ :=]{0,2}$")


def ipv4(key: bytes, m: re.Match) -> str | None:
    octets = m[0].split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets) or _numbered.search(m.string, max(0, m.start() - 12), m.start()):
        return None
    x = 0
    for o in octets:
        x = x << 8 | int(o)
    x = feistel(key, "ipv4", x, 256, 4)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def ipv6(key: bytes, m: re.Match) -> str | None:
    try:
        ipaddress.IPv6Address(m[0])
    except ValueError:
        return None
    digits = m[0].replace(":", "")
    if not re.search(r"\d", digits):
        return None
    new = permute_digits(key, "ipv6|" + re.sub(r"\w", "x", m[0]), digits.lower(), HEX)
    it = iter(new.upper() if digits.upper() == digits else new)
    return "".join(c if c == ":" else next(it) for c in m[0])


def _permuted_day(key: bytes, x: int, fits: Callable[[datetime.date], bool]) -> datetime.date | None:
    """The next day by the permutation that is of the days that fit; None if this one is not among them."""
    x -= FIRST_DAY
    if not 0 <= x < DAYS:
        return None
    while True:
        x = feistel(key, "date", x, 2, 18)
        if x < DAYS and fits(new := datetime.date.fromordinal(x + FIRST_DAY)):
            return new


def _width(n: int, text: str, padded: bool) -> bool:
    """n can be written as `text` is: with two digits if all are `padded`, else with a zero before it or not."""
    return padded or (n < 10) == (len(text) == 1 or text[0] == "0")


def _date(key: bytes, m: re.Match, order: str) -> str | None:
    marks, parts = re.findall(r"[-./]", m[0]), dict(zip(order, re.split(r"[-./]", m[0]), strict=True))
    try:
        x = datetime.date(int(parts["y"]), int(parts["m"]), int(parts["d"])).toordinal()
    except ValueError:
        return None
    padded = len(parts["m"]) == len(parts["d"]) == 2
    new = _permuted_day(key, x, lambda t: _width(t.month, parts["m"], padded) and _width(t.day, parts["d"], padded))
    if new is None:
        return None
    held = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(parts['m'])}d}", "d": f"{new.day:0{len(parts['d'])}d}"}
    return held[order[0]] + marks[0] + held[order[1]] + marks[1] + held[order[2]]


def date_ymd(key: bytes, m: re.Match) -> str | None:
    return _date(key, m, "ymd")


def date_dmy(key: bytes, m: re.Match) -> str | None:
    return _date(key, m, "dmy") or _date(key, m, "mdy")


#: The names of months in English, German, French and Spanish, and short forms in English.
MONTHS = [
    "january february march april may june july august september october november december".split(),
    "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "jan feb mar apr may jun jul aug sep oct nov dec".split(),
]
_MONTH = "(?P<month>" + "|".join(sorted({re.escape(x) for names in MONTHS for x in names}, key=len, reverse=True)) + ")"


def date_named(key: bytes, m: re.Match) -> str | None:
    name, day = m["month"], m["day"]
    names = next(x for x in MONTHS if name.lower() in x)
    try:
        x = datetime.date(int(m["year"]), names.index(name.lower()) + 1, int(day)).toordinal()
    except ValueError:
        return None
    zero = day[0] == "0"
    new = _permuted_day(key, x, lambda t: (t.day < 10) == (zero or len(day) == 1))
    if new is None:
        return None
    word = names[new.month - 1]
    word = word.upper() if name.isupper() else word.capitalize() if name[0].isupper() else word
    held = {"month": word, "day": f"{new.day:0{len(day)}d}", "year": f"{new.year:04d}"}
    out, at = [], 0
    for part in sorted(held, key=m.start):
        out += [m[0][at : m.start(part) - m.start()], held[part]]
        at = m.end(part) - m.start()
    return "".join(out) + m[0][at:]


def secret(key: bytes, m: re.Match) -> str | None:
    value = m["value"]
    a = m.start("value") - m.start()
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) and re.search(r"[0-9]", value):
        low = permute_digits(key, "hex", value.lower(), HEX)
        new = low.upper() if value.upper() == value and value.lower() != value else low
    else:
        new = permute_text(key, "secret", value)
    return m[0][:a] + new + m[0][a + len(value) :]


def access_key(key: bytes, m: re.Match) -> str | None:
    return secret(key, m) if re.search("[0-9]", m["value"]) else None


def hexadecimal(key: bytes, m: re.Match) -> str | None:
    return secret(key, m) if re.search("[0-9]", m[0]) and re.search("[a-fA-F]", m[0]) else None


#: Country codes; all others have three digits.
_COUNTRY = r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: kind, pattern, pseudonym (of the match, or spans in it); earlier kinds take what they match.
KINDS: list[tuple[str, str, Callable[[bytes, re.Match], str | list[tuple[int, int, str]] | None]]] = [
    ("email", r"(?<![\w.+%-])[\w.+%-]*\w@(?:[^\W_](?:[^\W_]|-(?=[^\W_]|-))*\.)+[^\W\d_]{2,}(?![\w])", email),
    ("secret", r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b)\W{0,8}[=:]\W{0,8}(?P<value>[A-Za-z0-9_+/\-]{8,})", secret),
    ("hex", r"(?<![\w])(?P<value>[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\w])", hexadecimal),
    ("secret", r"(?<![\w])(?:AKIA|ASIA)(?P<value>[A-Z0-9]{16})(?![\w])", access_key),
    ("secret", r"(?<![\w])(?:gh[pousr]_|github_pat_|xox[abprs]-|AIza|sk-|sk_live_|eyJ)(?P<value>[A-Za-z0-9_\-.]{20,})(?![\w])", access_key),
    ("iban", r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])", iban),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,}(?![\w-])", cards),
    ("phone", r"(?<![\w.])(?P<cc>\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?![\w])", phone),
    ("phone", rf"(?<![\w.+])(?P<cc>\+{_COUNTRY}[ .-]?)\(?\d(?:\)?[ .-]?\(?\d){{5,12}}(?![\w])", phone_abroad),
    ("phone", r"(?<![\w.+/-])(?P<cc>0[1-9])([ .-])\d{2}(?:\2\d{2}){3}(?![\w./-]\d|\w)", phone),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    ("ipv4", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)", ipv4),
    ("ipv6", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:(?=[0-9A-Fa-f:])){2,7}(?::?[0-9A-Fa-f]{1,4}:?){0,7}(?<!:)(?![\w:])", ipv6),
    ("date_ymd", r"(?<![\w./-])\d{4}([-./])\d{1,2}\1\d{1,2}(?![\w/-])", date_ymd),
    ("date_dmy", r"(?<![\w./-])\d{1,2}([-./])\d{1,2}\1\d{4}(?![\w/-])", date_dmy),
    ("date_named", rf"(?i)(?<![\w./-])(?P<day>\d{{1,2}})(?:st|nd|rd|th|\.)?(?: de | of | |-){_MONTH}\.?(?: de |, | |-)(?P<year>(?:19|20)\d\d)(?![\w/-])", date_named),
    ("date_named", rf"(?i)(?<![\w])\b{_MONTH}\.? (?P<day>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<year>(?:19|20)\d\d)(?![\w/-])", date_named),
]
_compiled = [(k, re.compile(p), f) for k, p, f in KINDS]
_any = re.compile(r"[0-9@]|(?i:token|secret|passw|pwd|key)|AIza|eyJ|sk-|gh[pousr]_|xox")
_rare = {"email": "@", "ipv6": ":"}


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    if not _any.search(text):
        return text, {}
    found: dict[str, int] = {}
    spans = Spans()
    for kind, pattern, pseudonym in _compiled:
        if _rare.get(kind, "") not in text:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if not spans.free(a, b):
                continue
            new = pseudonym(key, m)
            if new:
                new = [(a, b, new)] if isinstance(new, str) else new
                for x in new:
                    spans.add(*x)
                found[kind] = found.get(kind, 0) + len(new)
    if not spans.held:
        return text, found
    out, at = [], 0
    for a, b, new in spans.held:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], found


_made: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key of the session: its setting, or the one kept in the shared folder, which is made if there is none."""
    if named := spark.conf.get(KEY_SETTING, None):
        return hashlib.blake2b(named.encode(), digest_size=32).digest()
    app = spark.sparkContext.applicationId
    if app not in _made:
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/kvlake-pii-key")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            own = jvm.org.apache.hadoop.fs.Path(f"{path.toString()}-{secrets.token_hex(8)}")
            out = fs.create(own, False)
            out.write(bytearray(secrets.token_bytes(32)))
            out.close()
            if not fs.rename(own, path):  # another job was faster
                fs.delete(own, False)
        stream = fs.open(path)
        _made[app] = bytes(stream.readAllBytes())
        stream.close()
    return _made[app]


def scrub(docs: DataFrame, *, text_col: str = "text", key: bytes | None = None, counts: bool = True) -> DataFrame:
    """`docs` with pseudonyms in its text (by `key`, or that of the session); with `counts` also n_pii and pii_kinds (a count by kind)."""
    key = key or key_of(docs.sparkSession)
    new = ["n_pii", "pii_kinds"] * counts
    names = [c for c in docs.columns if c not in new]
    head = docs.select(*names)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(None, {}) if t is None else pseudonymise(t, key) for t in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array([g[0] for g in got], pa.string())
            if counts:
                columns += [pa.array([sum(g[1].values()) for g in got], pa.int64()), pa.array([list(g[1].items()) for g in got], pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names + new)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema.fields)
    return arrow_map(head, run, schema + ", n_pii long, pii_kinds map<string,long>" * counts)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub(table(spark, sf_dir, "documents").select("doc_id", "text"))
