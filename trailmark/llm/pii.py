"""PII: detected entities give way to surrogates of their own kind and form, keyed and one to one.

Kinds: e-mail and IPv4 addresses, phone numbers, card numbers (13 to 19 digits with a right check digit), account numbers after a word for them, IBANs
(with right check digits, or after the word), social security numbers, passwords, tokens and access keys, and names: after a title, a listed first
name before a capitalised word, and further mentions of a text's name words in it.

A surrogate keeps type, length, separators, script and letter case. Check digits stay right (or wrong); an address stays in its range (private,
loopback, public, ...); an address's domain is replaced alike in all addresses. A name's words are replaced one by one, whatever stands before or behind them, so
that `Mr. John Smith`, `John` and `SMITH` agree in every text: a listed first name by one of its gender's list, another word by
one of its letters' classes that keeps its last letter, on which gender endings stand.

A surrogate comes from the entity's canonical form (so the same entity is the same surrogate in every document and spelling) by a keyed
permutation of all strings of that form without fixed points: unequal entities stay unequal, and none stays itself. `collisions` checks
this over a corpus: canonical entities against surrogates, by counts. Who has the key can undo the permutations, so there is no default key.

Cases: null text stays null with no entities; a text without entities is left as it is; null ids and repeated rows are treated
each; an empty table gives no rows; texts of any length are read whole; columns that carry an output's name are replaced."""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, columns_or, sliced, tidy, worker_cache

#: Titles by gender, and first names whose gender they tell.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "": ["Dr", "Prof"]}
FIRST = {
    "m": "Adam Alan Albert Alberto Alejandro Alexander Andrew Antonio Arthur Benjamin Carlos Charles Christian Daniel David Diego Edward Eric Felix Fernando François Frank George Günther Hans Heinrich Henry Jack Jacques James Javier Jean John Jorge José Joseph Juan Jürgen Karl Kevin Klaus Louis Luis Manuel Mark Martin Matthew Michael Michel Miguel Nicolas Oliver Pablo Patrick Paul Pedro Peter Philippe Pierre Richard Robert Samuel Stefan Steven Thomas Tobias Walter William Wolfgang".split(),
    "f": "Alice Amanda Amélie Andrea Angela Anna Barbara Beatriz Birgit Camille Carmen Caroline Catherine Charlotte Claire Clara Cristina Diana Dolores Elena Elizabeth Emily Emma Eva Françoise Gabriela Hannah Heike Helen Ines Ingrid Isabel Jane Jennifer Jessica Julia Karen Karin Katharina Laura Linda Lisa Lucia Margaret Maria Marie Marta Mary Monika Nancy Natalie Nicole Nina Olivia Patricia Petra Pilar Rachel Rebecca Rosa Sabine Sandra Sara Sarah Sofia Sophie Susan Susanne Teresa Ursula".split(),
}
#: Address ranges that an address stays in; the rest is public.
RANGES = [ipaddress.ip_network(x) for x in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4")]

_GENDER = {w.lower(): g for g, names in FIRST.items() for w in names}
_WORD = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][^\W\d_]+(?:['’-][^\W\d_]+)*"  # begins with a capital
PATTERNS: list[tuple[str, str]] = [
    ("secret", r"\b(?i:password|passwd|pwd|token|secret|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?(?P<secret>[\w/+.-]{6,})"),
    ("access_key", r"\b(?P<access_key>(?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("email", r"(?<![\w.%+-])(?P<email>[\w%+-][\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"),
    ("iban", r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?)\b"),
    ("account", r"\b(?i:account|acct|konto|kontonummer|cuenta|compte)\b[^\d\n]{0,20}(?P<account>\d(?:[ -]?\d){5,17})(?!\w)"),
    ("ip", r"(?<![\d.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)"),
    ("ssn", r"(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"),
    ("phone", r"(?<!\w)(?P<phone>(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\w)"),
    ("card", r"(?<![\w.])(?P<card>\d(?:[ -]?\d){12,18})(?![\w])"),
]
ENTITY = re.compile("|".join(p for _, p in PATTERNS))
_MARK = re.compile(r"[\d@]").search
_KEYWORDS = ("passw", "pwd", "token", "secret", "api_key", "api-key", "apikey")
#: A capitalised word before another one: a title or a listed first name, or neither.
_BEFORE = re.compile(r"(?<!\w)([A-ZÀ-ÖØ-ÞΑ-ΩА-Я][^\W\d_]*)(\.?)[ \t](?=[A-ZÀ-ÖØ-ÞΑ-ΩА-Я])")
_TITLES = frozenset(t for ts in TITLES.values() for t in ts)
_LISTED = frozenset(w for names in FIRST.values() for w in names)
_AFTER_TITLE = re.compile(rf"(?P<name>{_WORD}(?:[ \t]{_WORD}){{0,2}})")
_FROM_GIVEN = re.compile(rf"(?P<name>{_WORD}(?:[ \t][A-Z]\.)?(?:[ \t]{_WORD}){{1,2}})")
_FRESH: list[bytes] = []


def session_key(spark: SparkSession) -> bytes:
    """The key of spark.trailmark.surrogate.key, or else a random one that lasts as long as this driver: surrogates of two runs
    then have nothing in common, and nothing can undo them."""
    given = spark.conf.get("spark.trailmark.surrogate.key", None)
    if given:
        return given.encode()
    if not _FRESH:
        _FRESH.append(secrets.token_bytes(32))
    return _FRESH[0]


def luhn(digits: str) -> int:
    """Sum of the digits, from the right every second one doubled, modulo 10: 0 where the check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{account}{country}00")
    return f"{98 - int(number) % 97:02d}"


def _round(key: bytes, tweak: bytes, i: int, half: int, size: int) -> int:
    data = tweak + bytes([i]) + half.to_bytes(max(1, (half.bit_length() + 7) // 8), "big")
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=64).digest(), "big") % size


def _permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network over a * a >= size, walked until it is in range."""
    a = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, a)
        for i in range(8) if not back else range(7, -1, -1):
            if i % 2:
                left = (left + (-1 if back else 1) * _round(key, tweak, i, right, a)) % a
            else:
                right = (right + (-1 if back else 1) * _round(key, tweak, i, left, a)) % a
        value = left * a + right
        if value < size:
            return value


def _shifted(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation without fixed points: a step of one in permuted order."""
    if size < 2:
        return value
    return _permute((_permute(value, size, key, tweak, back=True) + 1) % size, size, key, tweak)


_VOWELS = "aeiou"
_CONSONANTS = "bcdfghjklmnpqrstvwxyz"


@lru_cache(maxsize=4096)
def _class_of(c: str) -> str:
    """The characters that may stand for c: same script, case, and vowel or consonant; c alone where none may."""
    if c.isdigit():
        return "".join(chr(ord(c) - unicodedata.digit(c) + i) for i in range(10)) if c.isdecimal() else c
    if not c.isalpha():
        return c
    for own in (_VOWELS, _CONSONANTS):
        if c in own:
            return own
        if c in own.upper():
            return own.upper()
    name = unicodedata.name(c, "").split(" ")[0]
    page = ord(c) & ~0xFF
    case = lambda x: (x.isupper(), x.islower())
    return "".join(x for x in map(chr, range(page, page + 256)) if x.isalpha() and not x.isascii() and case(x) == case(c) and unicodedata.name(x, "").split(" ")[0] == name) or c


def _formed(text: str, classes: list[str], key: bytes, tweak: str) -> str:
    value, size = 0, 1
    for c, own in zip(text, classes, strict=True):
        value, size = value * len(own) + own.index(c), size * len(own)
    value = _shifted(value, size, key, (tweak + "\0" + "\0".join(classes)).encode("utf-8", "surrogatepass"))
    out = []
    for own in reversed(classes):
        value, k = divmod(value, len(own))
        out.append(own[k])
    return "".join(reversed(out))


def _walked(s: str, step: Callable[[str], str], fits: Callable[[str], bool]) -> str:
    """The first of step(s), step(step(s)), ... that fits: of a permutation, one of the strings that fit."""
    out = step(s)
    while not fits(out):
        out = step(out)
    return out


def _valid_ssn(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"


class Replacer:
    """Surrogates under a key. The cache is emptied at its bound."""

    def __init__(self, key: bytes, bound: int = 200_000):
        self.key, self.bound, self.cache = hashlib.blake2b(key, digest_size=32).digest(), bound, {}

    def surrogate(self, kind: str, canonical: str) -> str:
        out = self.cache.get((kind, canonical))
        if out is None:
            if len(self.cache) >= self.bound:
                self.cache.clear()
            out = self.cache[kind, canonical] = self._make(kind, canonical)
        return out

    def _form(self, s: str, tweak: str) -> str:
        return _formed(s, [_class_of(c) for c in s], self.key, tweak)

    def _make(self, kind: str, s: str) -> str:
        if kind == "ip":
            return self._ip(s)
        if kind == "email":  # the top-level domain stays
            local, _, domain = s.rpartition("@")
            head, dot, top = domain.rpartition(".")
            return f"{self._form(local, 'local')}@{self._form(head, f'domain {top}')}{dot}{top}"
        if kind == "card":  # first digit, which tells the kind of card, and check digit stay right
            body = s[0] + self._form(s[1:-1], f"card {s[0]}")
            return body + str(-luhn(body + "0") % 10)
        if kind == "iban":
            country, check, account = s[:2], s[2:4], s[4:]
            if iban_check(country, account) == check:
                account = self._form(account, f"iban {country}")
                return country + iban_check(country, account) + account
            return country + _walked(check + account, lambda x: self._form(x, f"iban {country}"), lambda x: iban_check(country, x[2:]) != x[:2])
        if kind == "ssn":
            return _walked(s, lambda x: self._form(x, kind), lambda x: _valid_ssn(x) == _valid_ssn(s))
        for digits in ("0123456789abcdef", "0123456789ABCDEF"):
            if kind == "secret" and re.fullmatch(rf"(?=.*\d)[{digits}]+", s):
                return _formed(s, [digits] * len(s), self.key, kind)
        if kind == "access_key":
            return s[:4] + _formed(s[4:], ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * (len(s) - 4), self.key, kind)
        if kind == "name":
            gender = _GENDER.get(s)
            if gender is not None:
                names = [w.lower() for w in FIRST[gender]]
                return names[_shifted(names.index(s), len(names), self.key, f"first {gender}".encode())]
            classes = lambda x: [_class_of(c) for c in x[:-1]] + [x[-1]]
            return _walked(s, lambda x: _formed(x, classes(x), self.key, kind), lambda x: x not in _GENDER)
        return self._form(s, kind)

    def _ip(self, s: str) -> str:
        own = ipaddress.ip_address(s)
        home = next((r for r in RANGES if own in r), None)
        if home is not None:
            first = int(home.network_address)
            return str(ipaddress.ip_address(first + _shifted(int(own) - first, home.num_addresses, self.key, f"ip {home}".encode())))
        step = lambda x: str(ipaddress.ip_address(_shifted(int(ipaddress.ip_address(x)), 1 << 32, self.key, b"ip")))
        return _walked(s, step, lambda x: not any(ipaddress.ip_address(x) in r for r in RANGES))


Entity = tuple[str, str, int, int, Callable[[str], str]]  # kind, canonical form, span, how a surrogate is spelled there


def _cased(word: str) -> Callable[[str], str]:
    if word.isupper() and len(word) > 1:
        return str.upper
    return lambda s: "".join(c.upper() if x.isupper() else c for c, x in zip(s, word, strict=True)) if len(s) == len(word) else s[0].upper() + s[1:]


def _name_words(m: re.Match) -> list[Entity]:
    return [("name", w.group().lower(), m.start("name") + w.start(), m.start("name") + w.end(), _cased(w.group())) for w in re.finditer(rf"{_WORD}", m["name"])]


def _entities(m: re.Match, text: str) -> list[Entity]:
    kind = m.lastgroup
    own, a, b = m[kind], m.start(kind), m.end(kind)
    if kind in ("phone", "account", "ssn", "iban", "card"):
        plain = re.sub(r"[^0-9A-Za-z]", "", own)
        if kind == "card" and (luhn(plain) or len(set(plain)) == 1):
            return []
        if kind == "iban" and iban_check(plain[:2], plain[4:]) != plain[2:4] and re.search(r"(?i)\biban\b[^\w\n]{0,5}$", text[max(0, a - 12) : a]) is None:
            return []
        lead = min(3, len(re.match(r"\+(\d*)", own)[1])) if own.startswith("+") else 0

        def spell(s: str) -> str:  # the country stays, the separators too
            chars = iter(plain[:lead] + s)
            return "".join(next(chars) if c.isalnum() else c for c in own)

        return [(kind, plain[lead:], a, b, spell)]
    if kind == "email":
        return [(kind, own.lower(), a, b, lambda s: s if own.islower() or len(s) != len(own) else "".join(y.upper() if x.isupper() else y for x, y in zip(own, s, strict=True)))]
    return [(kind, own, a, b, lambda s: s)]


def _names(text: str) -> list[Entity]:
    """Words of names after titles, and of listed first names with what follows."""
    out, last = [], 0
    for m in _BEFORE.finditer(text):
        word = m[1]
        n = None
        if m.start() >= last:
            if word in _TITLES:
                n = _AFTER_TITLE.match(text, m.end())
            elif word in _LISTED and not m[2]:
                n = _FROM_GIVEN.match(text, m.start())
        if n is not None:
            out += _name_words(n)
            last = n.end()
    return out


def entities(text: str) -> list[Entity]:
    """Entities of a text in order, apart from one another."""
    found: list[Entity] = []
    if _MARK(text) is not None or "AKIA" in text or "ASIA" in text or any(k in text.lower() for k in _KEYWORDS):
        found = [e for m in ENTITY.finditer(text) for e in _entities(m, text)]

    def add(more: list[Entity]) -> None:
        taken = [(e[2], e[3]) for e in found]
        i = 0
        for e in more:  # both in order
            while i < len(taken) and taken[i][1] <= e[2]:
                i += 1
            if i == len(taken) or e[3] <= taken[i][0]:
                found.append(e)
        found.sort(key=lambda e: e[2])

    named = _names(text)
    if named:
        add(named)
        words = {e[1] for e in found if e[0] == "name" and len(e[1]) > 2}
        again = re.compile(rf"(?<![\w'’-])(?:{'|'.join(sorted((re.escape(v) for w in words for v in (w[0].upper() + w[1:], w.upper())), key=len, reverse=True)) or '(?!)'})(?![\w'’-])")
        add([("name", m.group().lower(), m.start(), m.end(), _cased(m.group())) for m in again.finditer(text)])  # further mentions
    return found


def replaced(text: str, replacer: Replacer) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, canonical entity, surrogate) of each."""
    out, found, at = [], [], 0
    for kind, canonical, a, b, spell in entities(text):
        s = replacer.surrogate(kind, canonical)
        out += [text[at:a], spell(s)]
        found.append((kind, canonical, s))
        at = b
    return ("".join(out) + text[at:] if found else text), found


def _replacer(key: bytes) -> Replacer:
    return worker_cache(("replacer", key), lambda: Replacer(key))


def collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> int:
    """Surrogates of the corpus that stand for more than one entity; what is exchanged is each task's distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _replacer(key)
        for whole in batches:
            for b in sliced(whole):
                seen = {x for t in b.column(0) if t.is_valid for x in replaced(t.as_py(), own)[1]}
                kinds = [k for k, _, _ in seen]
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([hashlib.blake2b(e.encode("utf-8", "replace"), digest_size=16).hexdigest() for _, e, _ in seen], pa.string()), pa.array([s for _, _, s in seen], pa.string())], names=["kind", "entity", "surrogate"])

    pairs = columns_or(docs, text=text_col).mapInArrow(tidy(run), "kind string, entity string, surrogate string").distinct()
    return pairs.groupBy("kind", "surrogate").count().where("count > 1").count()


def replace_pii(docs: DataFrame, key: bytes, text_col: str = "text", check: bool = True, attempts: int = 3) -> DataFrame:
    """docs with text replaced, n_entities and kinds (distinct, sorted, comma-joined). With check, a key under which two entities
    of the corpus would meet is given up for the next."""
    for i in range(attempts if check else 0):
        if collisions(docs, key, text_col) == 0:
            break
        key = hashlib.blake2b(key + bytes([i])).digest()
    else:
        if check:
            raise RuntimeError("surrogates of different entities are equal under every key tried")

    def make():
        own = _replacer(key)

        def batch(column: pa.Array) -> list[pa.Array]:
            out, counts, kinds = [], [], []
            for t in column:
                text, found = replaced(t.as_py(), own) if t.is_valid else (None, [])
                out.append(text)
                counts.append(len(found))
                kinds.append(",".join(sorted({k for k, _, _ in found})))
            return [pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())]

        return batch

    order = [*docs.columns, *[c for c in ("n_entities", "kinds") if c not in docs.columns]]
    return append_columns(docs, [text_col], [(text_col, "string"), ("n_entities", "bigint"), ("kinds", "string")], make).select(*[F.col(f"`{c}`") for c in order])
