"""PII surrogates: each detected entity is replaced by a keyed one of its type, gender, script and format.

A surrogate is a keyed permutation over all entities of its kind: the same entity gets the
same surrogate in every document and in every spelling (coreference, without any table),
two entities never share one (distinctness holds by construction), and no entity keeps its
own. So documents are rewritten where they are read, without a shuffle; what was replaced
is then checked over the whole table by ``collisions``.

Names in Latin, Cyrillic or Greek letters are numbered, permuted, and spelled in syllables
of their script with an ending of their gender. Names of other scripts get letters of
their kind and Unicode page. Numbers keep their punctuation, their country code or country,
and a valid check digit. Secrets (keys, tokens, passwords) are told by their form, or by a label
before them, and keep their length, their case and where they have letters and digits.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import forget, written

KEY = b"siltstone"

# Titles by gender (n: none told), given names by gender (they tell a name without a title, and its bearer's gender), the letters of
# each script that stand for each other, and the calling codes of two digits (1 and 7 have one, all others three).
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "г-жа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н"),
    "n": ("Dr", "Prof", "Professor"),
}
GIVEN = {
    "f": ("Alice", "Anna", "Carmen", "Claire", "Elena", "Emma", "Eva", "Helga", "Ines", "Julia", "Karin", "Laura", "Lucia", "Maria", "Marie", "Mary", "Nina", "Olga", "Paula", "Rosa", "Sarah", "Sofia", "Susan", "Ursula"),
    "m": ("Adam", "Bruno", "Carlos", "David", "Diego", "Felix", "Franz", "Georg", "Hans", "Henri", "Ivan", "James", "John", "Jose", "Karl", "Louis", "Luis", "Marc", "Otto", "Paul", "Peter", "Pierre", "Thomas", "Victor"),
}
LETTERS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöüãõåæøœ", "çñßýÿšžč",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъьё", "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "άέήίόύώ",
)
CALLING = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
DIGITS, HEX = "0123456789", "0123456789abcdef"
# What is written before a name, and before a secret; beginnings of keys of well-known forms, and what follows them.
NAME_LABELS = ("Name", "Contact", "Attn", "Dear", "Signed", "Sincerely", "Regards", "Customer", "Patient", "Employee")
SECRET_LABELS = (
    "token", "secret", "password", "passwd", "passphrase", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key", "auth_key", "credential", "bearer",
)
KEY_FORMS = (
    ("AKIA", "[A-Z0-9]{16}"), ("ASIA", "[A-Z0-9]{16}"), ("ghp_", "[A-Za-z0-9]{30,}"), ("gho_", "[A-Za-z0-9]{30,}"), ("github_pat_", "[A-Za-z0-9_]{30,}"), ("glpat-", "[A-Za-z0-9_-]{16,}"), ("sk-", "[A-Za-z0-9_-]{20,}"),
    ("sk_live_", "[A-Za-z0-9]{16,}"), ("xox", "[abprs]-[A-Za-z0-9-]{10,}"), ("AIza", "[A-Za-z0-9_-]{30,}"), ("eyJ", r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Syllables of a name's surrogate, at least.
LEAST_SYLLABLES = 3
_CLASS = {c: (i, j) for i, letters in enumerate(LETTERS) for j, c in enumerate(letters)}
_IDEOGRAPHS = range(0x4E00, 0x9FA6)
_LOWER = "abcdefghijklmnopqrstuvwxyz"

_DIGITAL = re.compile(
    r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.]*\w))"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?![\w:]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)"
    r"|(?<![\w.-])\d{3}([.-])\d{3}\6\d{4}(?![\w-]|\.\d)|(?<![\w.-])00[1-9]\d{0,2}[ .-]\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))",
    re.ASCII,
)
_EMAIL = re.compile(r"(?P<email>[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w@])")
_TITLES = "|".join(t for g in ("f", "m", "n") for t in TITLES[g])
_TITLE = re.compile(rf"(?<!\w)(?:(?:{_TITLES})(?:\. ?| ))*(?P<title>{_TITLES})(?:\. ?| )(?P<first>(?!(?:{_TITLES})(?!\w))[^\W\d_][\w'’-]*)(?: (?P<last>[^\W\d_][\w'’-]*))?")
_LABELLED = re.compile(r"(?<!\w)(?:" + "|".join(NAME_LABELS) + r")(?:: ?|, ?| )(?:\n)?(?P<first>[^\W\d_a-z][^\W\d_]+) (?P<last>[^\W\d_a-z][^\W\d_]+(?:['’-][^\W\d_]+)*)(?!\w)")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(start + rest for start, rest in KEY_FORMS) + r")(?![A-Za-z0-9])|(?<=-----)\s[A-Za-z0-9+/=\s]{40,}(?=-----END)")
_KEY_STARTS = [*(start for start, _ in KEY_FORMS), "-----END"]
_SECRET = re.compile(r"(?:" + "|".join(SECRET_LABELS) + r")(?![a-z])[\"'`]?\s{0,3}(?:(?P<sign>=>|:=|[=:]|\bis\b)|)\s{0,3}(?:(?P<quote>[\"'`])(?P<quoted>[^\s\"'`]{4,512})(?P=quote)|(?P<bare>[^\s\"'`,;<>()\[\]{}|]{6,512}))", re.IGNORECASE)
_RANDOM = re.compile(r"(?=[^\s]*\d)[A-Za-z0-9+/_.~=-]{16,}|[0-9A-Fa-f]{16,}")
_CALLED = re.compile(r"(?<!\w)(?P<first>" + "|".join(sorted((n for names in GIVEN.values() for n in names), key=len, reverse=True)) + r") (?P<last>[^\W\d_a-z][^\W\d_]+(?:['’-][^\W\d_]+)*)")
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_GIVEN = [n for names in GIVEN.values() for n in names]
_LISTED = {n.lower(): g for g, names in GIVEN.items() for n in names}


def _shifted(x: int, size: int, key: bytes) -> int:
    """A keyed permutation of range(size) without fixed points (size 1 has none other): rotate between a Feistel cipher and its inverse."""
    if size < 2:
        return x
    half = max(1, (size.bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def f(r: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(v.to_bytes(width, "big"), digest_size=min(64, width), key=key, salt=bytes([r])).digest(), "big") & mask if width <= 64 else (
            int.from_bytes(b"".join(hashlib.blake2b(v.to_bytes(width, "big") + bytes([b & 255, b >> 8]), digest_size=64, key=key, salt=bytes([r])).digest() for b in range(-(-width // 64))), "big") & mask
        )

    def forth(v: int) -> int:
        a, b = v >> half, v & mask
        for r in range(6):
            a, b = b, a ^ f(r, b)
        return a << half | b

    def back(v: int) -> int:
        a, b = v >> half, v & mask
        for r in range(5, -1, -1):
            a, b = b ^ f(r, a), a
        return a << half | b

    def walk(step: Callable[[int], int], v: int) -> int:
        v = step(v)
        while v >= size:  # until it is in range again: stays a permutation
            v = step(v)
        return v

    return walk(back, (walk(forth, x) + 1) % size)


def _mapped(places: list[tuple[int, int]], key: bytes, kind: str, shape: str) -> list[int]:
    """Digits (value, radix) permuted together within their shape."""
    x, size = 0, 1
    for v, radix in places:
        x, size = x * radix + v, size * radix
    x = _shifted(x, size, hashlib.blake2b(f"{kind}|{shape}".encode(), key=key[:64], digest_size=32).digest())
    out = []
    for _, radix in reversed(places):
        x, v = divmod(x, radix)
        out.append(v)
    return out[::-1]


def _kind_of(c: str) -> tuple | None:
    """What letters outside LETTERS and _IDEOGRAPHS have in common that stand for each other; None for all else, and for letters that have a lower case."""
    category = unicodedata.category(c)
    if category[0] != "L" or c in _CLASS or ord(c) in _IDEOGRAPHS or (c.lower() != c and len(c.lower()) == 1):
        return None
    words = tuple(unicodedata.name(c, "").split()[:2])
    large = words in (("HANGUL", "SYLLABLE"), ("CJK", "UNIFIED"))
    back = len(c.upper()) == 1 and c.upper().lower() == c  # else its upper case is another letter's
    return words, category, back, None if large else ord(c) >> 8


@cache
def _alphabets() -> dict[tuple, str]:
    found: dict[tuple, list[str]] = {}
    for c in map(chr, range(0x80, 0x32400)):
        kind = _kind_of(c)
        if kind is not None:
            found.setdefault(kind, []).append(c)
    return {k: "".join(v) for k, v in found.items()}


@cache
def _other_alphabet(c: str) -> str | None:
    kind = _kind_of(c)
    return None if kind is None else _alphabets().get(kind)


def shaped(text: str, key: bytes, kind: str) -> str:
    """Letters and digits permuted within script, vowels and consonants; case follows the original; the rest stays."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    alphabet = [DIGITS if c in DIGITS else LETTERS[_CLASS[c][0]] if c in _CLASS else _IDEOGRAPHS if ord(c) in _IDEOGRAPHS else _other_alphabet(c) if c > "\x7f" else None for c in low]
    places = [(a.index(ord(c)) if a is _IDEOGRAPHS else a.index(c), len(a)) for c, a in zip(low, alphabet, strict=True) if a is not None]
    shape = "".join(c if a is None else "#" if a is DIGITS else chr(0x4E00) if a is _IDEOGRAPHS else a[0] for c, a in zip(low, alphabet, strict=True))
    values = iter(_mapped(places, key, kind, shape))
    out = []
    for original, a in zip(text, alphabet, strict=True):
        if a is None:
            out.append(original)
            continue
        c = a[next(values)]
        c = chr(c) if a is _IDEOGRAPHS else c
        out.append(c.upper() if original != original.lower() and len(c.upper()) == 1 else c)
    return "".join(out)


class Script:
    """Names of one script: letters that are numbered, plain ones first, and the syllables and endings that spell a surrogate.

    A syllable is a consonant, a vowel, and perhaps a coda, so that any row of them is read in
    one way only. Names with other than plain letters have an accent on their first vowel.
    """

    def __init__(self, name: str, plain: str, onsets: str, vowels: str, accented: str, codas: str, endings: dict[str, tuple[str, str]]):
        self.plain = plain
        every = (chr(i) for i in range(0x61, 0x2000))
        self.letters = plain + "".join(c for c in every if c not in plain and unicodedata.name(c, "").startswith(f"{name} SMALL LETTER") and unicodedata.category(c) == "Ll")
        self.place = {c: i for i, c in enumerate(self.letters)}
        self.syllables = [o + v + c for o in onsets for v in vowels for c in ("", *codas)]
        self.vowels, self.accented, self.endings = vowels, accented, endings

    def has(self, word: str) -> bool:
        return all(c in self.place for c in word)

    def number(self, word: str) -> tuple[int, int]:
        """How many letters the word's alphabet has, and its place among all words of it, shorter ones first."""
        base, n = len(self.plain) if all(c in self.plain for c in word) else len(self.letters), 0
        for c in word:
            n = n * base + self.place[c] + 1
        return base, n

    def word(self, base: int, n: int) -> str:
        out = []
        while n > 0:
            n, c = divmod(n - 1, base)
            out.append(self.letters[c])
        return "".join(reversed(out))

    def spelled(self, base: int, n: int, key: bytes, kind: str) -> str:
        """The n-th word's surrogate: a permutation over the words that have as many syllables."""
        size, k, before = len(self.syllables) ** LEAST_SYLLABLES, LEAST_SYLLABLES, 0
        while n - before >= size:
            before, size, k = before + size, size * len(self.syllables), k + 1
        x = _shifted(n - before, size, hashlib.blake2b(f"{kind}|{base}|{k}".encode(), key=key[:64], digest_size=32).digest())
        parts = []
        for _ in range(k):
            x, part = divmod(x, len(self.syllables))
            parts.append(self.syllables[part])
        if base != len(self.plain):
            parts[0] = parts[0].translate(str.maketrans(self.vowels, self.accented))
        made = "".join(parts)
        after_vowel, after_coda = self.endings[kind[-2:]] if kind[-2:] in self.endings else ("", "")
        return made + (after_vowel if made[-1] in self.vowels + self.accented else after_coda)

    def surrogate(self, word: str, key: bytes, kind: str) -> str:
        """Spelled, but for a word that would spell itself: it changes places with the next one."""
        base, n = self.number(word)
        made = self.spelled(base, n, key, kind)
        if made == word:
            return self.spelled(base, n + 1, key, kind)
        before = self.word(base, n - 1)
        return before if before and self.spelled(base, n - 1, key, kind) == before else made


@cache
def _scripts() -> tuple[Script, ...]:
    # Letters of syllables, and endings of given names after a vowel and after a coda.
    return (
        Script("LATIN", "abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnprstvwz", "aeiou", "áéíóú", "nrls", {"-f": ("lla", "a"), "-m": ("nd", "o")}),
        Script("CYRILLIC", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "бвгджзклмнпрстфхчш", "аеиоу", "яёыюэ", "нрлс", {"-f": ("лла", "а"), "-m": ("рт", "ий")}),
        Script("GREEK", "αβγδεζηθικλμνξοπρσςτυφχψω", "βγδζθκλμνπρστφχ", "αεηιο", "άέήίό", "νρλ", {"-f": ("λλα", "α"), "-m": ("ς", "ος")}),
    )


_RUN = re.compile(r"[^\W\d_]+")


def name_surrogate(name: str, key: bytes, kind: str) -> str:
    """Each run of letters by its script; what is between them stays. The same for every case, in the case of the name."""

    def made(run: str) -> str:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in run)
        for script in _scripts():
            if script.has(low):
                return _cased(script.surrogate(low, key, kind), run)
        return shaped(run, key, kind)

    return _RUN.sub(lambda m: made(m[0]), name)


def _luhn(digits: list[int]) -> int:
    """The check digit after these digits."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _digits_into(text: str, digits: list[int]) -> str:
    new = iter(digits)
    return "".join(str(next(new)) if c in DIGITS else c for c in text)


def _alnum(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{body}{country}00')) % 97:02d}"


def _calling(digits: str) -> int:
    """How many of the digits after a plus sign are the calling code."""
    return 1 if digits[:1] in ("1", "7") else 2 if digits[:2] in CALLING else 3


def canonical(kind: str, entity: str) -> str:
    """What all spellings of an entity have in common. A number without a plus sign or two zeros is one of calling code 1."""
    if kind == "phone":
        digits = "".join(c for c in entity if c in DIGITS)
        return digits if entity.startswith("+") else digits[2:] if entity.startswith("00") else f"1{digits}"
    if kind == "secret":
        return entity
    if kind == "ipv6":
        return ipaddress.IPv6Address(entity).exploded
    return _alnum(entity).lower() if kind in ("card", "iban", "ssn") else entity.lower()


def _like(spelled: str, characters: str) -> str:
    """The characters in place of the letters and digits of what was spelled."""
    new = iter(characters)
    return "".join(next(new) if c.isalnum() else c for c in spelled)


def surrogate(kind: str, entity: str, key: bytes = KEY) -> str:
    """The replacement of an entity: the same for every spelling, in that spelling's case and punctuation."""
    if kind == "ip":
        return ".".join(map(str, _mapped([(int(x), 256) for x in entity.split(".")], key, kind, "")))
    if kind == "ipv6":
        value = int(ipaddress.IPv6Address(entity))
        made = ipaddress.IPv6Address(_shifted(value, 1 << 128, hashlib.blake2b(b"ipv6", key=key[:64], digest_size=32).digest()))
        told = made.compressed if "::" in entity else made.exploded
        return told.upper() if entity != entity.lower() else told
    if kind == "card":
        digits = [int(c) for c in entity if c in DIGITS]
        body = _mapped([(d, 10) for d in digits[1:-1]], key, kind, f"{digits[0]}{len(digits)}")
        return _digits_into(entity, [digits[0], *body, _luhn([digits[0], *body])])
    if kind == "iban":
        whole = _alnum(entity)
        body = shaped(whole[4:], key, f"iban-{whole[:2]}")
        return _like(entity, whole[:2] + _iban_check(whole[:2], body) + body)
    if kind == "phone":
        digits = canonical(kind, entity)
        code = _calling(digits)
        new = _mapped([(int(d), 10) for d in digits[code:]], key, kind, f"{digits[:code]}/{len(digits)}")
        before = "00" + digits[:code] if entity.startswith("00") else digits[:code] if entity.startswith("+") else ""
        return _digits_into(entity, [*map(int, before), *new])
    if kind == "secret":
        return secret_surrogate(entity, key)
    if kind == "email":
        name, _, domain = entity.rpartition("@")
        body, _, top = domain.rpartition(".")
        return f"{shaped(name, key, 'mailbox')}@{shaped(body, key, 'domain')}.{top}"
    if kind.startswith(("given", "family")):
        return name_surrogate(entity, key, kind)
    return shaped(entity, key, kind)


def _is_hex(text: str) -> bool:
    return len(text) > 7 and (all(c in HEX for c in text) or all(c in HEX.upper() for c in text))


def secret_surrogate(secret: str, key: bytes) -> str:
    """Hex digits stay hex digits of one case; else letters are permuted among those of their case, and digits. What is neither stays."""
    hexadecimal = _is_hex(secret)
    upper = hexadecimal and secret != secret.lower()
    alphabets = [(HEX.upper() if upper else HEX) if hexadecimal else next((a for a in (DIGITS, _LOWER, _LOWER.upper()) if c in a), None) for c in secret]
    shape = "".join(c if a is None else a[-1] for c, a in zip(secret, alphabets, strict=True))
    made = secret
    while made == secret or (_is_hex(made), made != made.lower()) != (hexadecimal, secret != secret.lower()):  # on, until it is a secret of this sort again
        places = [(a.index(c), len(a)) for c, a in zip(made, alphabets, strict=True) if a is not None]
        if not places:
            break
        values = iter(_mapped(places, key, "secret", shape))
        made = "".join(c if a is None else a[next(values)] for c, a in zip(made, alphabets, strict=True))
    return made


def _has_any(text: str, words: Iterable[str]) -> bool:
    """Whether a text has one of the words at all: much quicker than a pattern of them, and mostly it hasn't."""
    return any(w in text for w in words)


def _secrets(text: str) -> list[tuple[int, int, str]]:
    """Keys of known forms, and what a label and a sign stand before: quoted, or with a digit or mark among six characters or more. Without a sign, only what looks random."""
    found = [(*m.span(), "secret") for m in _KEY.finditer(text)] if _has_any(text, _KEY_STARTS) else []
    low = text.lower()
    if len(low) != len(text) or not _has_any(low, SECRET_LABELS):
        low = text if len(low) != len(text) else ""
    for m in _SECRET.finditer(text) if low else ():
        if m["quoted"] and m["sign"]:
            found.append((*m.span("quoted"), "secret"))
        elif m["quoted"] or m["bare"]:
            start, end = m.span("quoted" if m["quoted"] else "bare")
            value = text[start:end].rstrip(".:!?")
            if _RANDOM.fullmatch(value) or (m["sign"] and len(value) > 5 and any(not c.isalpha() for c in value) and "://" not in value):
                found.append((start, start + len(value), "secret"))
    return found


def _cased(name: str, like: str) -> str:
    return name.upper() if len(like) > 1 and like == like.upper() else name if like == like.lower() else name[0].upper() + name[1:]


def _valid(kind: str, entity: str) -> bool:
    if kind == "ip":
        return all(int(x) < 256 and str(int(x)) == x for x in entity.split("."))
    if kind == "card":
        digits = [int(c) for c in entity if c in DIGITS]
        return _luhn(digits[:-1]) == digits[-1]
    if kind == "phone":
        return 7 <= sum(c in DIGITS for c in entity) <= 15
    if kind == "iban":
        whole = _alnum(entity)
        return 15 <= len(whole) <= 34 and whole[2:4] == _iban_check(whole[:2], whole[4:])
    if kind == "ipv6":
        try:
            ipaddress.IPv6Address(entity)
        except ValueError:
            return False
        return sum(map(bool, entity.split(":"))) > 2
    return True


def detect(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind), in order.

    A name is one with a title, a listed given name before a capitalised word, or two capitalised
    words after a label (Name:, Dear); where a text has such a name, its bare parts count too.
    Of entities that overlap the first counts, of those that begin together the longest; a secret
    comes before all others.
    """
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    at = 0
    while m := _DIGITAL.search(text, at):
        good = _valid(m.lastgroup, m[0])
        at = m.end() if good else m.start() + 1  # what isn't one may hold another
        if good:
            found.append((*m.span(), m.lastgroup))
    found += _secrets(text)
    names: dict[str, str] = {}
    for m in _TITLE.finditer(text) if _has_any(text, _GENDER) else ():
        first, last = m["first"], m["last"]
        if not first[0].isupper() and first[0].lower() != first[0].upper():
            continue
        if last and (last[0].isupper() or last[0].lower() == last[0].upper()):
            names.setdefault(first, f"given-{_GENDER[m['title']]}")
            names[last] = "family"
        else:
            names.setdefault(first, "family")
    for m in _CALLED.finditer(text) if _has_any(text, _GIVEN) else ():
        names.setdefault(m["first"], f"given-{_LISTED[m['first'].lower()]}")
        names.setdefault(m["last"], "family")
    for m in _LABELLED.finditer(text) if _has_any(text, NAME_LABELS) else ():
        names.setdefault(m["first"], f"given-{_LISTED.get(m['first'].lower(), 'n')}")
        names.setdefault(m["last"], "family")
    for name in list(names):
        if len(name) > 2:
            names.setdefault(name.upper(), names[name])
    if names:
        spoken = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)")
        found += [(*m.span(), names[m[0]]) for m in spoken.finditer(text)]
    out: list[tuple[int, int, str]] = []
    hidden = sorted((x for x in found if x[2] == "secret"), key=lambda x: (x[0], -x[1]))
    taken = [x for x in found if x[2] != "secret" and not any(x[0] < b and a < x[1] for a, b, _ in hidden)] if hidden else found
    for start, end, kind in sorted([*hidden, *taken] if hidden else taken, key=lambda x: (x[0], -x[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end, kind))
    return out


def rewrite(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each replacement; a given name's kind tells its gender."""
    parts, told, at = [], [], 0
    for start, end, kind in detect(text):
        entity = text[start:end]
        new = surrogate(kind, entity, key)
        parts += [text[at:start], new]
        told.append((kind, entity, new))
        at = end
    return "".join([*parts, text[at:]]), told


_KINDS = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))


def replace_pii(docs: DataFrame, text: str = "text", key: bytes = KEY, entities: str = "__entities") -> DataFrame:
    """docs with the text rewritten, and the column ``entities`` of (kind, entity, surrogate) added.

    Null texts stay null, without entities; all other columns and rows, repeated ones too, stay.
    The column replaces one of the same name.
    """
    kept = [c for c in docs.columns if c.lower() != entities.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [("", []) if t is None else rewrite(t, key) for t in batch.column(text).to_pylist()]
            nulls = batch.column(text).is_null().to_pylist()
            texts = pa.array([None if n else m[0] for n, m in zip(nulls, made, strict=True)], pa.string())
            told = pa.array([[dict(zip(("kind", "entity", "surrogate"), x, strict=True)) for x in m[1]] for m in made], _KINDS)
            yield pa.record_batch([*(texts if c == text else batch.column(c) for c in kept), told], [*kept, entities])

    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{entities}` array<struct<kind: string, entity: string, surrogate: string>>"])
    return docs.select(*kept).mapInArrow(run, ddl)


def surrogate_table(replaced: DataFrame, entities: str = "__entities") -> DataFrame:
    """(kind, entity, surrogate, n) of all replacements, entity and surrogate in the form that all their spellings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            forms = [pa.array([canonical(k, x) for k, x in zip(kinds, batch.column(c).to_pylist(), strict=True)], pa.string()) for c in ("entity", "surrogate")]
            yield pa.record_batch([batch.column("kind"), *forms, batch.column("n")], ["kind", "entity", "surrogate", "n"])

    one = replaced.select(F.explode(entities).alias("e"))
    spelled = one.groupBy("e.kind", "e.entity", "e.surrogate").agg(F.count("*").alias("n"))
    return spelled.mapInArrow(run, "kind string, entity string, surrogate string, n long").groupBy("kind", "entity", "surrogate").agg(F.sum("n").alias("n"))


def collisions(pairs: DataFrame) -> DataFrame:
    """(kind, problem, value) over a surrogate_table.

    shared: surrogates of several entities; split: entities of several surrogates; kept:
    entities that kept their own; original: surrogates that are another entity of the table
    (which itself is replaced, so that the texts still tell the two apart).
    """
    told = lambda rows, problem, value: rows.select("kind", F.lit(problem).alias("problem"), F.col(value).alias("value"))
    shared = pairs.groupBy("kind", "surrogate").agg(F.countDistinct("entity").alias("n")).where("n > 1")
    split = pairs.groupBy("kind", "entity").agg(F.countDistinct("surrogate").alias("n")).where("n > 1")
    same = pairs.where("entity = surrogate")
    others = pairs.where("entity <> surrogate").select("kind", "surrogate").distinct().join(pairs.select("kind", F.col("entity").alias("surrogate")).distinct(), ["kind", "surrogate"])
    return told(shared, "shared", "surrogate").unionByName(told(split, "split", "entity")).unionByName(told(same, "kept", "entity")).unionByName(told(others, "original", "surrogate"))


def replace_checked(docs: DataFrame, text: str = "text", key: bytes = KEY, entities: str = "__entities") -> tuple[DataFrame, DataFrame]:
    """replace_pii's rows, written, and collisions of them; fails if surrogates are shared, entities split or kept."""
    replaced = written(replace_pii(docs, text, key, entities), "surrogates")
    pairs = written(surrogate_table(replaced, entities), "pairs")  # read several times below
    found = written(collisions(pairs), "collisions")
    forget(pairs)
    bad = found.where("problem <> 'original'").limit(5).collect()
    if bad:
        raise ValueError(f"surrogates are not distinct and coreferent: {[tuple(r) for r in bad]}")
    return replaced, found
