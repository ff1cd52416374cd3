"""Surrogates for personal data: keyed, type-consistent replacements, the same for the same entity everywhere.

E-mail addresses, phone, card and account numbers, IP addresses, social-security numbers, access tokens and person
names are found in whole texts. A name is found by a title or a label ("my name is", "Name:"), and then every other
capitalised mention of its parts in the same text is one, too. Two parts that stand together in a name found anywhere
in the corpus are found wherever they stand together, without a title.

Formatted values are mapped by a keyed permutation of all values of their format: separators, letter classes and
case, country code, kind of network and validity of check digits stay, so distinct values of a format stay
distinct. Name parts become names of the same script, gender and part, composed from a word list and, if taken, a
longer one. A name's parts are entities of their own, so "Mr. Ray Cole" and "Mr. Cole" agree; a given name's gender
is decided over the corpus. Initials follow the given name of their text that they stand for.

Distinctness is checked over the whole corpus: an entity whose surrogate is another's surrogate, or is itself a
real value, gets a further attempt until none is left. A formatted kind that has not room for that goes back to its
permutation, whose values are distinct but may be real ones. The check works on distinct entities, pre-aggregated in
each task; nothing of it comes to the driver but a count. Texts get what differs from the first attempt by a join.

The key is the caller's. Null and empty texts stay as they are; texts without entities are unchanged to the byte.
Repeated rows and equal texts get equal results; ids may be null or repeat, texts may be very long. Other columns pass
through, but for one named ``n_entities``, which is replaced. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skytile.session import discard, free_prefix, ship, stored

ROUNDS = 6
#: Attempts after which formatted kinds go back to their permutation; names grow with each attempt.
MAX_ATTEMPTS = 16

# Word lists of this library: stems by script and part; a surname adds an ending.
GIVEN = {
    ("latin", "f"): ["Alma", "Berta", "Clara", "Doris", "Edda", "Flora", "Greta", "Hilda", "Irma", "Julia", "Lotta", "Marta", "Nora", "Olga", "Paula", "Rosa"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leon", "Max", "Oskar", "Paul", "Rolf", "Simon"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Инна", "Мария", "Нина", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Вадим", "Егор", "Иван", "Марк", "Олег", "Павел"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ιωάννα", "Μαρία", "Σοφία", "Χλόη"],
    ("greek", "m"): ["Άρης", "Γιάννης", "Κώστας", "Μάριος", "Νίκος", "Πέτρος"],
}
STEM = {
    "latin": ["Ander", "Bell", "Castel", "Dorn", "Ester", "Fell", "Grun", "Holm", "Iver", "Karl", "Lind", "Mar", "Nord", "Oster", "Ros", "Stein"],
    "cyrillic": ["Бел", "Вол", "Гор", "Дуб", "Зим", "Кам", "Лес", "Мор"],
    "greek": ["Αλεξ", "Βασιλ", "Γεωργ", "Δημητρ", "Κωνστ", "Μιχαλ", "Νικολ", "Παπ"],
}
END = {"latin": ["berg", "dale", "feld", "gard", "low", "man", "mont", "ner", "sen", "stad", "ton", "vale", "ville", "well", "wick", "wood"], "cyrillic": ["енко", "ский", "ов", "ин"], "greek": ["άκης", "ίδης", "όπουλος", "ίου"]}
LINK = {"latin": ["a", "e", "i", "o", "ar", "en", "il", "or"], "cyrillic": ["а", "о", "ар", "ен"], "greek": ["α", "ο", "αν", "ερ"]}

_TITLES = {"Mr": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "г-н": "m", "κ": "m", "Dr": "n", "Prof": "n", "Professor": "n", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Madame": "f", "Mme": "f", "г-жа": "f", "κα": "f"}
#: Labels that a name of two parts or more follows.
_LABEL = r"(?:(?:[Mm]y|[Hh]is|[Hh]er) name is|(?:(?:[Ff]ull|[Pp]atient|[Cc]ustomer|[Cc]ontact|[Ee]mployee) )?[Nn]ame ?:|[Ss]igned by)"
_ANY_TITLE = "(?:" + "|".join(sorted(_TITLES, key=len, reverse=True)) + ")"
_CAPITAL = r"[^\W\d_" + "".join(chr(c) for c in range(0x530) if chr(c).islower()) + "]"
_WORD = _CAPITAL + "(?:['’]" + _CAPITAL + r")?[^\W\d_]+"
_PART = _WORD + "(?:-" + _WORD + ")*"
_NAME = rf"(?!{_ANY_TITLE}\b)(?:{_CAPITAL}\. ?|{_CAPITAL} )*{_PART}(?: (?:{_CAPITAL}\.? )*{_PART})*"
_PIECE = re.compile(f"{_WORD}|{_CAPITAL}")
_MENTION = re.compile(rf"(?<!\w){_WORD}(?!\w)")
_V4 = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"


def _v6() -> str:
    """All ways to write an IPv6 address, but for the one of zeros alone."""
    h = "[0-9A-Fa-f]{1,4}"
    ways = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{_V4}"]
    for left in range(8):
        right = [f"(?:{h}:){{0,{5 - left}}}{_V4}"] * (left < 6) + [f"{h}(?::{h}){{0,{6 - left}}}"] * (left < 7)
        ways.append((f"{h}(?::{h}){{{left - 1}}}" if left else "") + "::" + (f"(?:{'|'.join(right)})" + "?" * (left > 0) if right else ""))
    return "|".join(ways)


_ENTITY = re.compile(
    r"(?<![A-Za-z0-9À-ÿ._%+-])(?P<email>[A-Za-z0-9À-ÿ._%+-]{0,200}[A-Za-z0-9À-ÿ]@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,63})"
    r"|(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:)(?P<ipv6>" + _v6() + r")(?![\w:]|\.\d)"
    r"|(?<![\w.])(?P<ip>" + _V4 + r")(?![\w]|\.\d)"
    r"|(?<!\w)(?P<token>(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|ghp|xox[bp])[-_][A-Za-z0-9]{16,})(?!\w)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])"
    r"|(?<![\w.])(?P<card>\d(?:[ -]?\d){12,18})(?![\w])"
    rf"|(?<!\w)(?P<title>(?:{_LABEL} )?{_ANY_TITLE}\.? (?:{_ANY_TITLE}\.? )*|{_LABEL} (?={_PART} {_PART}))(?P<name>{_NAME})"
)
#: Found in every text that holds an entity.
_MAYBE = re.compile(rf"[\d@]|::|AKIA[A-Z]{{16}}|(?:sk|ghp|xox[bp])[-_][A-Za-z]{{16}}|(?<!\w){_ANY_TITLE}\.? |{_LABEL} ")
_RUN = re.compile(rf"(?<!\w){_WORD}(?: {_WORD})+(?!\w)")
_KNOWN = {n.lower(): g for (_, g), names in GIVEN.items() for n in names}


_DIGITS, _HEX, _LOWER, _UPPER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
_LETTERS = {"latin": _UPPER, "cyrillic": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}
#: Calling codes by their number of digits: North America and Russia have one, these have two, all others three.
_CALLING = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
#: Networks of special use; addresses stay inside theirs, and all others stay outside of them.
_NETS = {
    4: [ipaddress.ip_network(n) for n in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/4 240.0.0.0/4".split()],
    6: [ipaddress.ip_network(n) for n in "::/96 64:ff9b::/96 2001:db8::/32 fc00::/7 fe80::/10 ff00::/8".split()],
}


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def iban_check(country: str, account: str) -> str:
    """The two check digits of an account number (remainder 97)."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def script(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "greek" if re.search("[Ͱ-Ͽἀ-῿]", word) else "latin"


class Keyed:
    """Surrogates under one key; remembers first attempts."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("surrogates need a key")
        self.key, self.memo = bytes(key), {}

    def __reduce__(self):
        return Keyed, (self.key,)

    def prf(self, kind: str, attempt: int, *parts) -> int:
        message = "\x1f".join([kind, str(attempt), *map(str, parts)]).encode()
        return int.from_bytes(hmac.new(self.key, message, hashlib.blake2b).digest()[:32], "big")

    def permuted(self, value: int, size: int, kind: str, attempt: int) -> int:
        """A keyed permutation of 0..size-1: a balanced Feistel network, walked until it is in range."""
        if size < 2:
            return value
        half = max(1, -(-(size - 1).bit_length() // 2))
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for r in range(ROUNDS):
                left, right = right, left ^ (self.prf(kind, attempt, size, r, right) & mask)
            value = (left << half) | right
            if value < size:
                return value

    def radix(self, chars: list[str], alphabets: list[str], kind: str, attempt: int) -> list[str]:
        value, size = 0, 1
        for c, a in zip(chars, alphabets):
            value, size = value * len(a) + a.index(c), size * len(a)
        value = self.permuted(value, size, kind, attempt)
        out = []
        for a in reversed(alphabets):
            value, i = divmod(value, len(a))
            out.append(a[i])
        return out[::-1]

    def classed(self, text: str, kind: str, attempt: int, fixed: set[int] = frozenset()) -> str:
        """Permute all digits and letters of a text within their classes."""
        spots = [(i, c, next((a for a in (_DIGITS, _LOWER, _UPPER, _ACCENTED) if c in a), None)) for i, c in enumerate(text) if i not in fixed]
        spots = [s for s in spots if s[2]]
        out = list(text)
        for (i, _, _), c in zip(spots, self.radix([s[1] for s in spots], [s[2] for s in spots], kind, attempt)):
            out[i] = c
        return "".join(out)

    def address(self, value: str, kind: str, attempt: int) -> str:
        """Another address of the same special network, or of none."""
        ip = ipaddress.ip_address(value)
        if ip.version == 6 and ip.ipv4_mapped:
            return str(ipaddress.IPv6Address((0xFFFF << 32) + int(ipaddress.ip_address(self.address(str(ip.ipv4_mapped), "ip", attempt)))))
        nets = _NETS[ip.version]
        own = next((n for n in nets if ip in n), None)
        if own is not None:
            base = int(own.network_address)
            return str(type(ip)(base + self.permuted(int(ip) - base, own.num_addresses, f"{kind}{own}", attempt)))
        while True:
            ip = type(ip)(self.permuted(int(ip), 1 << ip.max_prefixlen, kind, attempt))
            if not any(ip in n for n in nets):
                return str(ip)

    def checked(self, value: str, valid, kind: str, attempt: int) -> str:
        """A permutation of the values whose check digits are wrong."""
        while True:
            value = self.classed(value, kind, attempt)
            if not valid(value):
                return value

    def surrogate(self, kind: str, value: str, attempt: int = 0) -> str:
        """The normalised surrogate of a normalised value."""
        if attempt == 0:
            new = self.memo.get((kind, value))
            if new is None:
                if len(self.memo) > 100_000:
                    self.memo.clear()
                new = self.memo[kind, value] = self._surrogate(kind, value, 0)
            return new
        return self._surrogate(kind, value, attempt)

    def _surrogate(self, kind: str, value: str, attempt: int) -> str:
        if kind.startswith("given:"):
            _, how, gender = kind.split(":")
            names = [n for (s, g), ns in GIVEN.items() if s == how and gender in (g, "n") for n in ns]
            h = self.prf(kind, attempt, value)
            out = names[h % len(names)]
            for _ in range(attempt):  # a longer given name where short ones are taken
                h //= 64
                out += "-" + names[h % len(names)]
            return out.lower()
        if kind.startswith("surname:"):
            how, h = kind.split(":")[1], self.prf(kind, attempt, value)
            out = STEM[how][h % len(STEM[how])]
            for _ in range(attempt + 2):
                h //= 64
                out += LINK[how][h % len(LINK[how])]
            return (out + END[how][(h // 64) % len(END[how])]).lower()
        if kind == "email":
            end = value.rindex(".")
            return self.classed(value, kind, attempt, set(range(end, len(value))))
        if kind in ("ip", "ipv6"):
            return self.address(value, kind, attempt)
        if kind == "card":
            valid = lambda v: luhn(v[:-1]) == int(v[-1])
            if not valid(value):
                return self.checked(value, valid, kind, attempt)
            body = "".join(self.radix(list(value[:-1]), [_DIGITS] * (len(value) - 1), "card-checked", attempt))
            return body + str(luhn(body))
        if kind == "iban":
            country, account = value[:2], value[4:]
            valid = lambda v: v[:2] == iban_check(country, v[2:])
            if not valid(value[2:]):
                return country + self.checked(value[2:], valid, kind + country, attempt)
            account = self.classed(account, "iban-checked" + country, attempt)
            return country + iban_check(country, account) + account
        if kind == "phone":
            code = _CALLING.match(value[1:]) if value.startswith("+") else None
            head = "+" + code.group() if code else ""
            return head + self.classed(value[len(head) :], kind + head, attempt)
        if kind == "token" and re.fullmatch("[0-9a-f]+", value):
            return "".join(self.radix(list(value), [_HEX] * len(value), "hex", attempt))
        if kind == "token":
            start = 4 if value.startswith("AKIA") else re.match("[a-z]+[-_]", value).end()
            return value[:start] + self.classed(value[start:], kind + value[:start], attempt)
        return self.classed(value, kind, attempt)

    def initial(self, letter: str) -> str:
        """Another letter of the same script."""
        letters = _LETTERS[script(letter)].replace(letter, "")
        return letters[self.prf("initial", 0, letter) % len(letters)]

    def rewrite(self, text: str | None, items: list[tuple[str, str, str]] = ()) -> tuple[str | None, int]:
        """The text with surrogates, and how many entities it held.

        items: (kind, value, surrogate) where that differs from the first attempt, and ("pair", parts, both kinds and
        surrogates) for parts of names that are known from elsewhere.
        """
        changed, pairs = {}, {}
        for kind, value, new in items:
            if kind == "pair":
                first, first_new, second, second_new = new.split("\x1f")
                one, two = value.split(" ")
                pairs[one, two] = (first, second)
                changed[first, one], changed[second, two] = first_new, second_new
            else:
                changed[kind, value] = new
        found, given = [], {}
        for start, end, kind, raw, value in entities(text, pairs):
            new = None
            if kind != "initial":
                new = changed.get((kind, value)) or self.surrogate(kind, value)
            if kind.startswith("given:"):
                given.setdefault(raw[0], new[0].upper())
            found.append((start, end, kind, raw, new))
        out, last = [], 0
        for start, end, kind, raw, new in found:
            out += [text[last:start], _formatted(kind, raw, new) if kind != "initial" else given.get(raw) or self.initial(raw)]
            last = end
        return ("".join(out) + text[last:], len(found)) if found else (text, 0)


def _normal(kind: str, raw: str) -> str:
    if not raw.isascii() and kind != "email":  # digits of all scripts
        raw = "".join(str(int(c)) if c.isdecimal() else c for c in raw)
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(raw))
    if kind == "email":
        return raw.lower()
    if kind == "phone":
        return ("+" if raw.startswith("+") else "") + re.sub(r"\D", "", raw)
    if kind in ("card", "iban"):
        return re.sub(r"[ -]", "", raw)
    if kind == "token" and re.fullmatch("[0-9a-fA-F]+", raw):
        return raw.lower()
    return raw


def _formatted(kind: str, raw: str, new: str) -> str:
    """The normalised surrogate in the raw value's format: separators, case."""
    if kind in ("phone", "card", "iban"):
        it = iter(new.lstrip("+") if kind == "phone" else new)
        return "".join(next(it) if c.isalnum() else c for c in raw)
    if kind == "email" or kind == "token" and re.fullmatch("[0-9a-fA-F]+", raw):
        return new.upper() if raw.isupper() else "".join(n.upper() if c.isupper() else n for c, n in zip(raw, new))
    if kind == "ipv6":
        return new.upper() if re.search("[A-F]", raw) else new
    if ":" in kind:
        return new.upper() if raw.isupper() else "-".join(p.capitalize() for p in new.split("-"))
    return new


def entities(text: str | None, pairs: dict[tuple[str, str], tuple[str, str]] = {}):
    """(start, end, kind, raw, normal value) of each entity of a text, in order, without overlaps.

    pairs: parts of names known from elsewhere that count where they stand together, and their kinds.
    """
    if not text or not pairs and not _MAYBE.search(text):
        return
    found, parts = [], {}
    for m in _ENTITY.finditer(text):
        if m.lastgroup != "name":
            kind = m.lastgroup
            value = _normal(kind, m.group())
            if value not in ("::1", "::"):
                found.append((m.start(), m.end(), kind, m.group(), value))
            continue
        genders = [_TITLES[t] for t in re.findall(rf"(?<!\w){_ANY_TITLE}\b", m.group("title"))]
        gender, at, name = next((g for g in genders if g != "n"), "n"), m.start("name"), m.group("name")
        for piece in _PIECE.finditer(name):
            part, how = piece.group(), script(piece.group())
            if len(part) == 1:
                kind = "initial"
            else:
                kind = f"surname:{how}" if piece.start() > name.rfind(" ") else f"given:{how}:{_KNOWN.get(part.lower(), gender)}"
                parts.setdefault(part.lower(), kind)
            found.append((at + piece.start(), at + piece.end(), kind, part, part.lower()))
    if pairs:
        for one, two in neighbours(text):
            for part, kind in zip((one, two), pairs.get((one, two), ())):
                parts.setdefault(part, kind)
    if parts:
        taken, i = list(found), 0
        for m in _MENTION.finditer(text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            value = m.group().lower()
            if value in parts and (i == len(taken) or m.end() <= taken[i][0]):
                found.append((m.start(), m.end(), parts[value], m.group(), value))
        found.sort(key=lambda e: e[0])
    yield from found


def neighbours(text: str | None) -> set[tuple[str, str]]:
    """Capitalised words that stand together, in lower case."""
    out = set()
    for m in _RUN.finditer(text or ""):
        w = m.group().lower().split(" ")
        out.update(zip(w, w[1:]))
    return out


def _named_pairs(found: list[tuple]) -> list[tuple[str, str, str]]:
    """("pair", parts, kinds) of parts that stand together in the names of a text."""
    names = [e for e in found if ":" in e[2]]
    return [("pair", f"{a[4]} {b[4]}", f"{a[2]}\x1f{b[2]}") for a, b in zip(names, names[1:]) if a[1] + 1 == b[0] and a[2].startswith("given:")]


def find(docs: DataFrame, text_col: str = "text", key: Column | None = None) -> DataFrame:
    """Distinct kind, value and (of pairs) kinds of the parts, of each task; with ``key``, for each text what it may need.

    Then its entities come with all its capitalised words that stand together, as pairs that may be known.
    """
    each = key is not None
    names = ["key", "kind", "value"] if each else ["kind", "value", "kinds"]

    def scan(batches):
        seen: set = set()
        for batch in batches:
            rows = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                found = [e for e in entities(row[-1]) if e[2] != "initial"]  # a letter stands for many names
                if each:
                    rows += [(row[0], e[2], e[4]) for e in found] + [(row[0], "pair", f"{a} {b}") for a, b in neighbours(row[-1])]
                else:
                    rows += [(e[2], e[4], None) for e in found] + _named_pairs(found)
            rows = list(dict.fromkeys(rows))
            if not each:
                rows = [r for r in rows if r not in seen]
                if len(seen) < 500_000:
                    seen.update(rows)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), kinds)], names=names)

    kinds = [pa.int64(), pa.string(), pa.string()] if each else [pa.string()] * 3
    schema = "key long, kind string, value string" if each else "kind string, value string, kinds string"
    return docs.select(*([key.alias("key")] if key is not None else []), F.col(text_col)).mapInArrow(scan, schema)


def _surrogates(keyed: Keyed, *cols):
    @F.pandas_udf("string")
    def each(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([keyed.surrogate(k, v, a) for k, v, a in zip(kind, value, attempt)], dtype=object)

    return each(*cols)


def _clashes(now: DataFrame, real: bool) -> DataFrame:
    """Entities whose surrogate is another entity's which comes first or (``real``) a real value; ``now`` has them all."""
    both = now.select("kind", F.col("surrogate").alias("s"), "value", "attempt").unionByName(
        now.select("kind", F.col("value").alias("s"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("attempt"))
    )
    # Kinds of given names share a word list, so clashes are looked for across genders of a script.
    family = F.regexp_replace("kind", r"^(given:[a-z]+):.*", "$1")
    groups = both.groupBy(family.alias("family"), "s").agg(F.count("value").alias("n"), F.max(F.col("value").isNull()).alias("real"), F.min(F.when(F.col("value").isNotNull(), F.struct("attempt", "kind", "value"))).alias("keeper"))
    groups = groups.withColumn("real", F.col("real") & (F.lit(real) | ~_permuted(F.col("family"))))
    bad = groups.where("n > 1 or (real and n > 0)").select("family", F.col("s").alias("surrogate"), F.when(~F.col("real"), F.col("keeper")).alias("keeper"))
    hit = now.withColumn("family", family).join(bad, ["family", "surrogate"])
    return hit.where(F.col("keeper").isNull() | (F.col("keeper.kind") != F.col("kind")) | (F.col("keeper.value") != F.col("value"))).select("kind", "value")


def _permuted(kind: Column) -> Column:
    return ~kind.contains(":")


def decided_entities(docs: DataFrame, keyed: Keyed, text_col: str = "text") -> DataFrame:
    """kind, value and surrogate of what differs from the first attempt, and of pairs of name parts."""
    seen = stored(find(docs, text_col).distinct(), "seen")
    # A given name has one gender in all texts: a known one before none, the commoner ones first in order.
    family = F.regexp_replace("kind", r"^(given:[a-z]+):.*", "$1")
    plain = seen.where("kind <> 'pair'").select("kind", "value", family.alias("family")).distinct()
    best = plain.groupBy("family", "value").agg(F.min("kind").alias("as_kind"))  # f, m, n in this order
    names = stored(plain.join(best, ["family", "value"]).select("kind", "value", "as_kind"), "names")
    known = names.select(F.col("as_kind").alias("kind"), "value").distinct().withColumn("attempt", F.lit(0))
    now = stored(known.withColumn("surrogate", _surrogates(keyed, "kind", "value", "attempt")), "entities")
    attempt = 0
    while True:
        attempt += 1
        clash = stored(_clashes(now, attempt <= MAX_ATTEMPTS), "clashes")
        if clash.isEmpty():
            break
        again = now.join(clash.withColumn("again", F.lit(True)), ["kind", "value"], "left")
        # Beyond the last attempt a formatted kind takes its permutation for all of its values.
        back = _permuted(F.col("kind")) & F.lit(attempt > MAX_ATTEMPTS)
        again = again.withColumn("attempt", F.when(back, F.lit(0)).when(F.col("again"), F.lit(attempt)).otherwise(F.col("attempt")))
        again = again.withColumn("surrogate", F.when(back | F.col("again"), _surrogates(keyed, "kind", "value", "attempt")).otherwise(F.col("surrogate")))
        after = stored(again.drop("again"), "entities")
        discard(now, clash)
        now = after
    own = names.join(now.select(F.col("kind").alias("as_kind"), "value", "attempt", "surrogate"), ["as_kind", "value"])
    changed = own.where("attempt > 0 or kind <> as_kind").select("kind", "value", "surrogate")
    # Of the ways to read a pair, one that ends in a surname is taken first.
    parts = F.split("kinds", "\x1f")
    pairs = seen.where("kind = 'pair'").groupBy("value").agg(F.max("kinds").alias("kinds")).select("value", F.split("value", " ").alias("v"), parts.alias("k"))
    side = lambda i: own.select(F.col("kind").alias(f"kind{i}"), F.col("value").alias(f"value{i}"), F.col("surrogate").alias(f"new{i}"))
    pairs = pairs.select("value", *[F.col("k")[i].alias(f"kind{i}") for i in (0, 1)], *[F.col("v")[i].alias(f"value{i}") for i in (0, 1)])
    pairs = pairs.join(side(0), ["kind0", "value0"]).join(side(1), ["kind1", "value1"])
    pairs = pairs.select(F.lit("pair").alias("kind"), "value", F.concat_ws("\x1f", "kind0", "new0", "kind1", "new1").alias("surrogate"))
    return stored(changed.unionByName(pairs), "decided")


def replace(docs: DataFrame, key: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``text_col`` rewritten under the caller's key and the entities of each text counted in ``n_entities``."""
    keyed = Keyed(key)
    decided = decided_entities(docs, keyed, text_col)
    row = F.xxhash64(F.col(id_col), F.col(text_col))

    @F.pandas_udf("text string, n long")
    def renamed(texts: pd.Series, items: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([keyed.rewrite(t, [(x["kind"], x["value"], x["surrogate"]) for x in own] if own is not None else ()) for t, own in zip(texts, items)], columns=["text", "n"])

    # Decided values are joined as rows of (kind, value), so a hot one may be split; a text gets its own few.
    p = free_prefix(docs, start="pii")
    items = find(docs, text_col, row).join(decided, ["kind", "value"]).groupBy(F.col("key").alias(f"{p}key")).agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias(f"{p}items"))
    out = docs.withColumn(f"{p}row", row).join(items, F.col(f"{p}row") == F.col(f"{p}key"), "left").withColumn(f"{p}new", renamed(F.col(text_col), F.col(f"{p}items")))
    keep = [F.col(f"{p}new.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "n_entities"]
    return out.select(*keep, F.col(f"{p}new.n").alias("n_entities"))


#: For runs without a key of their own, such as checks: the setting ``spark.skytile.surrogates.key`` takes its place.
EXAMPLE_KEY = "an example, not a secret"


def session_key(spark) -> bytes:
    return spark.conf.get("spark.skytile.surrogates.key", EXAMPLE_KEY).encode()


def op2_surrogates(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replace(docs.select("doc_id", "text"), session_key(spark))
