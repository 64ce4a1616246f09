"""Personal data: detection, and keyed surrogates of the same type, script, gender and format.

Found are e-mail addresses, IBANs with a right check number, payment card numbers, IP addresses (also compressed), US
social security numbers, phone numbers, birth dates after a word for birth, street addresses in four languages, and names:
after a title, before a Chinese, Japanese or Korean one, or a known given name with a surname; with later mentions of
them or of their words (but for words that the text also has in lower case).  Digits of any script and full-width forms
count as the plain ones.  Each surrogate comes from a keyed permutation (over the characters, each position moving within
its own class of characters), so different values get different surrogates and the same value the same one everywhere,
without a table of all values: letters stay letters of their script, digits digits, punctuation stays; card and IBAN check
digits are recomputed; a valid card stays valid and an invalid one invalid; e-mail case and phone punctuation are laid
over the surrogate of the normalised value.  Known given names are permuted within their script and gender; other name
letters keep vowel, consonant and case, and endings that mark gender stay.

Classes of letters are listed for Latin, Cyrillic and Greek; any other letter moves among the letters of its script and
kind in its block of 256 code points, any other digit among the digits of its script.

The key comes from the setting `spark.tessera.surrogateKey`.  Where it is not set, each driver process draws one of its
own, so surrogates cannot be undone, nor told again by another run.

Collision checks: each permutation is one cycle through all values of its format, a step of fixed size between a
Feistel network and its inverse, so no value is its own surrogate and nothing depends on the document.  Where a part of
a format is kept apart (known names, invalid cards, made-up exchanges), the cycle is walked to the next value of the
part.  collisions() checks a whole table of pairs.  Only a value without any character of a class of two stays as it is.

Defined results: null text stays null, without entities; empty text has none; spans are code points of the original text,
end exclusive; overlapping finds keep the first kind in the order above; repeated rows get equal results; very long texts
are read whole, in time that grows with their length.  Not found: names without a title or a known given name, dates
without a word for birth, addresses of other forms.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import secrets
import unicodedata
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, table

KEY_SETTING = "spark.tessera.surrogateKey"
#: The key of this process, where no other is set.
DEFAULT_KEY = secrets.token_hex(32)
ROUNDS = 6

# Titles by gender, and given names by script and gender.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "M", "господин", "г-н", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Fräulein", "Señora", "Señorita", "Sra", "Srta", "Doña", "Madame", "Mme", "Mademoiselle", "Mlle", "госпожа", "г-жа", "κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor")
GIVEN = {
    ("latin", "m"): ("James", "John", "Peter", "Paul", "Thomas", "David", "Hans", "Karl", "Jürgen", "Pierre", "Louis", "Antoine", "Carlos", "Juan", "José", "Miguel"),
    ("latin", "f"): ("Mary", "Anna", "Sarah", "Laura", "Julia", "Emma", "Heike", "Ursula", "Sabine", "Claire", "Hélène", "Sophie", "María", "Carmen", "Lucía", "Isabel"),
    ("cyrillic", "m"): ("Иван", "Пётр", "Сергей", "Николай", "Михаил", "Андрей"),
    ("cyrillic", "f"): ("Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία"),
}
CLASSES = [
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "àâäáãåèéêëìíîïòóôöõùúûü",
    "çñßšžčćłńśź",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщъь",
    "αεηιουωάέήίόύώ",
    "βγδζθκλμνξπρστφχψς",
]
_CLASS = {c: alphabet for alphabet in CLASSES for c in alphabet}


@lru_cache(65536)
def _letters(c: str) -> str | None:
    """The class of a lower-case or caseless character: a listed one, or by script, kind and block; None for no class."""
    if c in _CLASS:
        return _CLASS[c]
    kind = unicodedata.category(c)
    if kind == "Nd":
        zero = ord(c) - unicodedata.digit(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if kind not in ("Ll", "Lo"):
        return None
    script, first = unicodedata.name(c, "").split(" ")[0], ord(c) & ~0xFF
    own = "".join(x for x in map(chr, range(first, first + 256)) if unicodedata.category(x) == kind and x.lower() == x and x not in _CLASS and unicodedata.name(x, "").split(" ")[0] == script)
    return own if len(own) > 1 else None


@lru_cache(65536)
def _capitals(c: str) -> str | None:
    """The class of a character whose capital stands there, without letters whose capital is missing or that of another."""
    own = "".join(x for x in _letters(c) or "" if len(x.upper()) == 1 and x.upper().lower() == x)
    return own if len(own) > 1 and c in own else None


_KNOWN = {name: group for group, names in GIVEN.items() for name in names}
# Country calling codes of one and two digits; the others have three.
_CODES = {*"17", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

_TITLE = "|".join(sorted(map(re.escape, MALE + FEMALE + NEUTRAL), key=len, reverse=True))
_DIGIT = re.compile("[0-9]")
#: Digits of other scripts, and full-width forms of ASCII.
_WIDE = re.compile(r"(?![0-9])\d|[\uff01-\uff5e]")
#: No look-behind in front, so that the search skips to the titles' first letters.
_NAME = re.compile(rf"({_TITLE})(\.? )([^\W\d_][^\W\d_]+(?:[ -][^\W\d_][^\W\d_]+){{0,2}})")
_DOMAIN = re.compile(r"@((?:[\w-]+\.)+[^\W\d_]{2,})")
_LOCAL = re.compile(r"[\w.+%-]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?!\d)")
_IP4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
_IP6_SHORT = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w]|:[\w:])")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(r"(?<![\w+])(?:\+1[ .-]?)?\(?\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+.-])(?:\+1[ .-]?)?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\w+])\+\d{7,15}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\(?\d{1,8}\)?){2,5}(?!\d)")

# Words for birth, months, kinds of streets, frequent Chinese surnames, titles behind and before names.
_BORN = re.compile(r"(?i:\b(?:born(?: on)?|date of birth|birth ?date|birthday|dob|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento|родил(?:ся|ась)|дата рождения))[ :]{1,3}(?:is )?")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_DATE = re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d\d)-(?P<d>\d\d)(?!\d)|(?P<a>\d\d?)(?P<sep>[./-])(?P<b>\d\d?)(?P=sep)(?P<y2>\d{{4}})(?!\d)|(?P<d3>\d\d?) (?P<m3>{'|'.join(MONTHS)}) (?P<y3>\d{{4}})(?!\d)|(?P<m4>{'|'.join(MONTHS)}) (?P<d4>\d\d?), (?P<y4>\d{{4}})(?!\d)")
_FIRST_DAY, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()
_STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Ct|Square|Terrace|rue|avenue|boulevard|place|Calle|Avenida|Plaza|bis|ter|de|del|la|du|des"
#: One of these is in every text that the patterns for birth dates and addresses can match: looking for them is quick.
_CUES = ("born", "birth", "dob", "geboren", "geburtsdatum", "né", "naissance", "nacid", "nacimiento", "родил", "рождения")
_STREET_WORDS = (" Street", " St", " Road", " Rd", " Avenue", " Ave", " Lane", " Ln", " Drive", " Boulevard", " Blvd", " Court", " Ct", " Square", " Terrace", "straße ", "strasse ", "gasse ", "allee ", "platz ", "weg ", " rue ", " avenue ", " boulevard ", " place ", "Calle ", "Avenida ", "Plaza ")
_STREET_END = re.compile("straße|strasse|gasse|allee|platz|weg")
_ADDRESS = re.compile(r"(?<!\w)\d{1,5} (?:[^\W\d_a-z][\w'’]+ ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Ct|Square|Terrace)\b|(?<!\w)[A-ZÄÖÜ][a-zäöüß]{2,}(?:straße|strasse|gasse|allee|platz|weg) \d{1,4}(?!\w)|(?<!\w)\d{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|place) (?:de la |du |des |de )?[A-ZÀ-Þ]\w+(?:[ -][A-ZÀ-Þ]\w+){0,3}|(?<!\w)(?:Calle|Avenida|Plaza) (?:de la |del |de )?[A-ZÀ-Þ]\w+(?: [A-ZÀ-Þ]\w+){0,3},? \d{1,4}(?!\w)")
_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_BEFORE_TITLE = re.compile(rf"[{_SURNAMES}][\u4e00-\u9fff]{{1,2}}(?=先生|女士|小姐|太太)|(?:[\u4e00-\u9fff]{{1,4}}|[\u30a1-\u30fa\u30fc]{{2,8}})(?=さん|様|氏)|(?<!\w)[\uac00-\ud7a3]{{2,4}}(?= 씨)")
_AFTER_TITLE = re.compile(r"(?<!\w)(?:السيدة|السيد|الدكتورة|الدكتور) ([\u0621-\u064a]{2,})|(?<!\w)(?:श्रीमती|श्री|डॉ\.) ([\u0905-\u0963]{2,})|(?<!\w)(?:גברת|מר|ד״ר) ([\u05d0-\u05ea]{2,})")
_GIVEN = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(_KNOWN, key=lambda n: (-len(n), n)))}) ([^\W\d_][^\W\d_]+)(?!\w)")
_GIVEN_WORDS = tuple(f"{n} " for n in _KNOWN)
#: Endings of names that tell the gender of who bears them; they stay.
_ENDING = re.compile(r"(?:(?:ов|ев|ёв|ин|ын)а?|ск(?:ий|ая)|[aoаяα])\Z", re.IGNORECASE)


def _told(text: str, words: tuple[str, ...]) -> bool:
    return any(w in text for w in words)


def fold(text: str) -> str:
    """text with the digits of all scripts and full-width forms as plain ones, character by character."""
    if text.isascii() or not _WIDE.search(text):
        return text
    return _WIDE.sub(lambda m: chr(ord(m[0]) - 0xFEE0) if "\uff01" <= m[0] <= "\uff5e" else str(unicodedata.digit(m[0])), text)


def _dressed(was: str, plain: str, made: str) -> str:
    """made, the surrogate of plain, in the digits and forms that was, the original, has in place of the plain ones."""
    if was == plain:
        return made

    def like(old: str, new: str) -> str:
        if "\uff01" <= old <= "\uff5e" and "!" <= new <= "~":
            return chr(ord(new) + 0xFEE0)
        return chr(ord(old) - unicodedata.digit(old) + int(new)) if old.isdecimal() and new in "0123456789" else new

    if len(made) == len(was):
        return "".join(n if o == p else like(o, n) for o, p, n in zip(was, plain, made, strict=True))
    first = next((o for o, p in zip(was, plain, strict=True) if o != p and o.isdecimal()), "0")
    return "".join(like(first, n) if n.isdecimal() else n for n in made)


def _day(value: str) -> tuple[date, str] | None:
    """A date and its form ("y-m-d", "dmy", "mdy", "d month", "month d"), if it is one from 1900 to 2099.

    Of two numbers in front of the year the second is the month, unless only the first can be one.
    """
    m = _DATE.fullmatch(value)
    if not m:
        return None
    if m["y"]:
        y, month, day, form = m["y"], m["m"], m["d"], "y-m-d"
    elif m["sep"]:
        american = int(m["a"]) <= 12 < int(m["b"])
        y, month, day, form = (m["y2"], m["a"], m["b"], "mdy") if american else (m["y2"], m["b"], m["a"], "dmy")
    else:
        named = m["m3"] or m["m4"]
        y, month, day, form = m["y3"] or m["y4"], MONTHS.index(named) + 1, m["d3"] or m["d4"], "d month" if m["m3"] else "month d"
    try:
        found = date(int(y), int(month), int(day))
    except ValueError:
        return None
    return (found, form) if 0 <= found.toordinal() - _FIRST_DAY < _DAYS else None


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _groups(value: str) -> list[int] | None:
    """The eight numbers of an IPv6 address."""
    try:
        n = int(ipaddress.IPv6Address(value))
    except ValueError:
        return None
    return [n >> (112 - 16 * i) & 0xFFFF for i in range(8)]


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, kind) by start."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    text = fold(text)

    def take(kind: str, spans: list[tuple[int, int]]) -> None:
        """Notes spans and blanks them out of the text, all at once."""
        nonlocal text
        if spans:
            spans.sort()
            parts, done = [], 0
            for a, b in spans:
                if a < done:
                    continue
                found.append((a, b, kind))
                parts += [text[done:a], chr(0) * (b - a)]
                done = b
            text = "".join([*parts, text[done:]])

    if "@" in text:
        spans, floor = [], 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > floor and _LOCAL.match(text[a - 1]):
                a -= 1
            while a < m.start() and text[a] in ".+%-":
                a += 1
            if a < m.start():
                spans.append((a, m.end()))
            floor = m.end()
        take("email", spans)
    if "::" in text:
        take("ip6", [m.span() for m in _IP6_SHORT.finditer(text) if any(_groups(m[0]) or ())])
    if _DIGIT.search(text):
        take("iban", [m.span() for m in _IBAN.finditer(text) if 15 <= len(v := m[0].replace(" ", "")) <= 34 and _iban_ok(v)])
        take("card", [m.span() for m in _CARD.finditer(text)])
        take("ip", [m.span() for m in _IP4.finditer(text)])
        if text.count(":") >= 7:
            take("ip6", [m.span() for m in _IP6.finditer(text) if any(_groups(m[0]) or ())])
        take("ssn", [m.span() for m in _SSN.finditer(text)])
        if _told(text.lower(), _CUES):
            take("birth", [d.span() for m in _BORN.finditer(text) if (d := _DATE.match(text, m.end()))])
        take("phone", [m.span() for m in _PHONE.finditer(text) if 7 <= sum(c.isdigit() for c in m[0]) <= 15])
        if _told(text, _STREET_WORDS):
            take("address", [m.span() for m in _ADDRESS.finditer(text)])
    take("name", _names(text))
    return sorted(found)


_WORDS, _END = re.compile(r"(\w+)"), object()


def _names(text: str) -> list[tuple[int, int]]:
    """Up to three capitalised words after a title, a known given name with a capitalised word, names beside titles of
    scripts without capitals, and where else the text has them, together or one by one."""
    out: list[tuple[int, int]] = []
    for m in _NAME.finditer(text):
        end, first = m.start(3), True
        for part in re.finditer("[^ -]+", m[3]):
            if not part[0][0].isupper():
                break
            end, first = m.start(3) + part.end(), False
        if not first and not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")):
            out.append((m.start(3), end))
    if _told(text, _GIVEN_WORDS):
        out += [m.span() for m in _GIVEN.finditer(text) if m[1][0].isupper()]
    joined = []
    if not text.isascii():
        joined = [m.span() for m in _BEFORE_TITLE.finditer(text)]
        out += joined + [m.span(m.lastindex) for m in _AFTER_TITLE.finditer(text)]
    if not out:
        return out
    out = _disjoint(out)
    wholes = {text[a:b] for a, b in out}
    parts = {w for name in wholes for w in re.split("[ -]", name)}
    cut = _WORDS.split(text)
    plain = {text[a:b] for a, b in _occurrences(text, cut, {w.lower() for w in parts} - parts)}
    out += _occurrences(text, cut, wholes | {w for w in parts if w.lower() not in plain})
    run_on = {text[a:b] for a, b in joined if b - a > 1}  # scripts without spaces: a name of two letters or more counts anywhere
    for size in {len(w) for w in run_on}:
        out += [(i, i + size) for i in range(len(text) - size + 1) if text[i : i + size] in run_on]
    return _disjoint(out)


def _occurrences(text: str, cut: list[str], phrases: set[str]) -> list[tuple[int, int]]:
    """Where the text, cut at the borders of its words, has one of the phrases between such borders; at each place the
    longest.  Phrases begin with a word; they are told apart word by word in one pass, however many there are."""
    trie: dict = {}
    for phrase in phrases:
        node = trie
        for step in _WORDS.split(phrase)[1:]:
            node = node.setdefault(step, {})
        # a phrase that ends in a word has an empty last step
        node[_END] = len(phrase)
    if not trie:
        return []
    out, at = [], 0
    for i in range(1, len(cut), 2):
        at += len(cut[i - 1])
        node, k, best = trie.get(cut[i]), i + 1, 0
        while node:
            if k % 2:
                node = node.get(cut[k])
            else:
                for end, below in node.items():  # other ends than words: the text goes on with something else than a word
                    if end is not _END and _END in below and cut[k].startswith(end) and (not end or len(cut[k]) > len(end) or k + 1 == len(cut)):
                        best = max(best, below[_END])
                node = node.get(cut[k])
            k += 1
            if k >= len(cut):
                break
        if best:
            out.append((at, at + best))
        at += len(cut[i])
    return out


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of overlapping spans the first, and of those the longest."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


class Surrogates:
    """Keyed permutations of values by kind."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()

    def _stream(self, tweak: str, n: int) -> list[int]:
        stream = b""
        while len(stream) < 4 * n:
            stream += hashlib.blake2b(f"{tweak}|{len(stream)}".encode(), key=self.key, digest_size=64).digest()
        return [int.from_bytes(stream[4 * i : 4 * i + 4], "big") for i in range(n)]

    def _feistel(self, digits: list[int], radix: list[int], tweak: str, back: bool) -> list[int]:
        """A permutation of all vectors with these radices, or its inverse."""
        half = (len(digits) + 1) // 2
        parts, radices = [digits[:half], digits[half:]], [radix[:half], radix[half:]]
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            to = r % 2
            added = self._stream(f"{tweak}|{r}|{radix}|{','.join(map(str, parts[1 - to]))}", len(parts[to]))
            parts[to] = [(d - x if back else d + x) % m for d, x, m in zip(parts[to], added, radices[to], strict=True)]
        return parts[0] + parts[1]

    def _permute(self, digits: list[int], radix: list[int], tweak: str) -> list[int]:
        """The next vector on one cycle through all vectors with these radices; a step prime to their number makes it one."""
        steps = _steps(radix[-1], tuple(sorted(set(radix))))
        out = self._feistel(digits, radix, tweak, False)
        carry = steps[self._stream(f"{tweak}|step|{radix}", 1)[0] % len(steps)]
        for i in reversed(range(len(out))):
            carry, out[i] = divmod(out[i] + carry, radix[i])
            if not carry:
                break
        return self._feistel(out, radix, tweak, True)

    def chars(self, value: str, tweak: str, alphabets: list[str | None] | None = None, cased: bool = False, ending: int = 0) -> str:
        """value with every character of a class replaced within the class; others, and None in alphabets, stay.

        cased: values that differ in case are different; ending: that many characters at the end stay.
        """
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        own = alphabets or [None if i >= len(value) - ending else (_capitals if cased and c != v else _letters)(c) for i, (c, v) in enumerate(zip(low, value, strict=True))]
        at = [i for i, a in enumerate(own) if a and low[i] in a]
        if not at:
            return value
        moving = set(at)
        fixed = "".join("*" if i in moving else value[i] if cased else c for i, c in enumerate(low)) if len(at) < len(low) else ""
        moved = self._permute([own[i].index(low[i]) for i in at], [len(own[i]) for i in at], f"{tweak}|{fixed}|{''.join(own[i][0] for i in at)}")
        out = list(value)
        for i, d in zip(at, moved, strict=True):
            c = own[i][d]
            out[i] = c.upper() if value[i] != low[i] and len(c.upper()) == 1 and c.upper().lower() == c else c
        return "".join(out)

    def _email(self, value: str) -> str:
        local, domain = value.rsplit("@", 1)
        name, top = domain.rsplit(".", 1)
        return f"{self.chars(local, f'local|{domain.lower()}')}@{self.chars(name, 'domain')}.{top}"

    def _digits(self, value: str, tweak: str, keep: int = 0) -> str:
        """All digits but the first keep ones; a first digit other than 0 stays so."""
        out, seen, alphabets = [], 0, []
        digits = "".join(c for c in value if c.isdigit())
        for i, c in enumerate(digits):
            alphabets.append(None if i < keep else "123456789" if i == keep and c != "0" else "0123456789")
        moved = self.chars(digits, tweak, alphabets)
        for c in value:
            out.append(moved[seen] if c.isdigit() else c)
            seen += c.isdigit()
        return "".join(out)

    def _phone(self, value: str) -> str:
        digits = "".join(c for c in value if c.isdigit())
        american = len(digits) == 10 and value[0] != "+" or len(digits) == 11 and digits[0] == "1"
        code = len(digits) - 10 if american else next(n for n in (1, 2, 3) if n == 3 or digits[:n] in _CODES)
        national = digits[code:]
        made_up = american and national[3:6] == "555"  # a made-up exchange stays one
        alphabets = [None if made_up and i in (3, 4, 5) else "123456789" if i == 0 and c != "0" else "0123456789" for i, c in enumerate(national)]
        tweak = f"phone|{'1' if american else digits[:code]}"
        moved = self.chars(national, tweak, alphabets)
        while american and not made_up and moved[3:6] == "555":
            moved = self.chars(moved, tweak, alphabets)
        moved = digits[:code] + moved
        at = iter(moved)
        return "".join(next(at) if c.isdigit() else c for c in value)

    def _card(self, value: str) -> str:
        digits = "".join(c for c in value if c.isdigit())
        if _luhn(digits):
            body = self._digits(digits[:-1], "card", 1)
            moved = next(body + c for c in "0123456789" if _luhn(body + c))
        else:
            moved = self._digits(digits, "number", 1)
            while _luhn(moved):  # walking the cycle stays one to one
                moved = self._digits(moved, "number", 1)
        at = iter(moved)
        return "".join(next(at) if c.isdigit() else c for c in value)

    def _iban(self, value: str) -> str:
        bare = value.replace(" ", "")
        body = self.chars(bare[4:], f"iban|{bare[:2]}", ["ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isalpha() else "0123456789" for c in bare[4:]]) if bare[4:].isdigit() else "".join(self._mixed(bare[4:], f"iban|{bare[:2]}"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + bare[:2] + "00")) % 97
        at = iter(f"{bare[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(at) for c in value)

    def _mixed(self, value: str, tweak: str) -> list[str]:
        radix = [26 if c.isalpha() else 10 for c in value]
        moved = self._permute([ord(c) - 65 if c.isalpha() else int(c) for c in value], radix, tweak)
        return [chr(65 + d) if r == 26 else str(d) for d, r in zip(moved, radix, strict=True)]

    def _ip(self, value: str) -> str:
        octets = [int(x) for x in value.split(".")]
        unicast = 1 <= octets[0] <= 223
        moved = self._permute([octets[0] - 1 if unicast else octets[0] - 224 if octets[0] else 32, *octets[1:]], [223 if unicast else 33, 256, 256, 256], f"ip|{unicast}")
        first = moved[0] + 1 if unicast else 0 if moved[0] == 32 else moved[0] + 224
        return ".".join(map(str, [first, *moved[1:]]))

    def _ip6(self, value: str) -> str:
        """Groups other than 0 move among those, so that an address keeps its short form."""
        groups = _groups(value)
        at = [i for i, g in enumerate(groups) if g]
        moved = self._permute([groups[i] - 1 for i in at], [65535] * len(at), f"ip6|{at}")
        made = iter(f"{d + 1:04x}" if re.search("(?<![0-9A-Fa-f])0[0-9A-Fa-f]{3}", value) else f"{d + 1:x}" for d in moved)
        out = re.sub("[0-9A-Fa-f]+", lambda m: next(made) if int(m[0], 16) else m[0], value)
        return out.upper() if value != value.lower() else out

    def _word(self, word: str) -> str:
        """A known given name becomes the next one of its script and gender, another word never a known one."""
        if word in _KNOWN:
            order = _order(self.key, *_KNOWN[word])
            return order[(order.index(word) + 1) % len(order)]
        marked = _ENDING.search(word)
        ending = len(marked[0]) if marked and len(word) - len(marked[0]) >= 3 else 0
        made = self.chars(word, "name", cased=True, ending=ending)
        while made in _KNOWN:
            made = self.chars(made, "name", cased=True, ending=ending)
        return made

    def _birth(self, value: str) -> str:
        """Another day, past the 12th of its month if the value's is, so that its form can be read in no other way."""
        known = _day(value)
        if not known:
            made = self._digits(value, "date")
            while _day(made):
                made = self._digits(made, "date")
            return made
        at, late = known[0].toordinal() - _FIRST_DAY, known[0].day > 12
        while True:
            high, low = self._permute([at // 256, at % 256], [_DAYS // 256 + 1, 256], "birth")
            at = high * 256 + low
            if at < _DAYS and (date.fromordinal(_FIRST_DAY + at).day > 12) == late:
                break
        day, form = date.fromordinal(_FIRST_DAY + at), known[1]
        if form == "y-m-d":
            return day.isoformat()
        if form == "d month":
            return f"{day.day} {MONTHS[day.month - 1]} {day.year}"
        if form == "month d":
            return f"{MONTHS[day.month - 1]} {day.day}, {day.year}"
        m = _DATE.fullmatch(value)
        short = len(m["a"] + m["b"]) < 4 and not (m["a"] + m["b"]).startswith("0") and m["b"][0] != "0"
        first, second = (day.month, day.day) if form == "mdy" else (day.day, day.month)
        return m["sep"].join([str(first) if short else f"{first:02d}", str(second) if short else f"{second:02d}", str(day.year)])

    def _address(self, value: str) -> str:
        """House numbers and the words of the street's name; kinds of streets stay."""
        out = []
        for part in re.split(r"(\d+|[^\W\d_]+)", value):
            end = _STREET_END.search(part)
            if part.isdigit():
                out.append(self._digits(part, "house"))
            elif end and part.endswith(end[0]) and end.start():
                out.append(self.chars(part, "street", cased=True, ending=len(part) - end.start()))
            elif part in _STREETS.split("|"):
                out.append(part)
            else:
                out.append(self.chars(part, "street", cased=True))
        return "".join(out)

    def _name(self, value: str) -> str:
        return "".join(p if p in (" ", "-") else self._word(p) for p in re.split("([ -])", value))

    def of(self, kind: str, value: str) -> str:
        """The surrogate of a value."""
        made = {"email": self._email, "phone": self._phone, "card": self._card, "iban": self._iban, "ip": self._ip, "ip6": self._ip6, "ssn": lambda v: self._digits(v, "ssn"), "birth": self._birth, "address": self._address}
        return made.get(kind, self._name)(value)


@lru_cache(256)
def _steps(last: int, radices: tuple[int, ...]) -> list[int]:
    return [n for n in range(1, last) if all(math.gcd(n, m) == 1 for m in radices)] or [1]


@lru_cache(64)
def _order(key: bytes, script: str, gender: str) -> list[str]:
    return sorted(GIVEN[script, gender], key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())


def _normal(kind: str, value: str) -> str:
    if kind == "email":
        return value.lower()
    if kind == "phone":
        digits = "".join(c for c in value if c.isdigit())
        return digits[-10:] if len(digits) == 11 and digits[0] == "1" or len(digits) == 10 and value[0] != "+" else "+" + digits
    if kind in ("card", "iban"):
        return re.sub("[ -]", "", value)
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "birth":
        known = _day(value)
        return known[0].isoformat() if known else value
    if kind == "ip6":
        return str(ipaddress.IPv6Address(value))
    return value


def replace(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, kind, surrogate) of each entity of the original."""
    spans = detect(text)
    if not spans:
        return text, []
    out, done, entities = [], 0, []
    for a, b, kind in spans:
        plain = fold(text[a:b])
        made = _dressed(text[a:b], plain, surrogates.of(kind, plain))
        out += [text[done:a], made]
        done = b
        entities.append((a, b, kind, made))
    return "".join([*out, text[done:]]), entities


RESULT = "struct<text:string,n_entities:long,entities:string>"


def key_of(spark) -> str:
    """The key that the session names, or that of this process."""
    return spark.conf.get(KEY_SETTING, None) or DEFAULT_KEY


def with_surrogates(docs: DataFrame, out_col: str = "safe", text_col: str = "text", key: str | None = None) -> DataFrame:
    """docs with a column of (text with surrogates, number of entities, kind:start:end of each, comma-joined)."""
    key = key or key_of(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def safe(texts: pa.Array) -> pa.Array:
        own = Surrogates(key)
        found = [replace(t.as_py(), own) for t in texts]
        parts = [pa.array([t for t, _ in found], pa.string()), pa.array([len(e) for _, e in found], pa.int64()), pa.array([",".join(f"{k}:{a}:{b}" for a, b, k, _ in e) for _, e in found], pa.string())]
        return pa.StructArray.from_arrays(parts, ["text", "n_entities", "entities"])

    return docs.withColumn(out_col, safe(F.col(text_col).cast("string")))


def pairs(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """kind, value (normalised), surrogate (normalised) of every entity."""
    key = key or key_of(docs.sparkSession)

    @F.arrow_udf("array<struct<kind:string,value:string,surrogate:string>>")
    def listed(texts: pa.Array) -> pa.Array:
        own, out = Surrogates(key), []
        for t in texts:
            text = t.as_py()
            out.append([{"kind": k, "value": _normal(k, fold(text[a:b])), "surrogate": _normal(k, fold(s))} for a, b, k, s in replace(text, own)[1]])
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string())])))

    return docs.select(F.inline(listed(F.col(text_col).cast("string"))))


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates of pairs() that stand for several values, or values with several surrogates: none is the aim."""
    once = found.distinct()
    merged = once.groupBy("kind", F.col("surrogate").alias("of")).agg(F.count("*").alias("n")).withColumn("what", F.lit("surrogate"))
    split = once.groupBy("kind", F.col("value").alias("of")).agg(F.count("*").alias("n")).withColumn("what", F.lit("value"))
    return merged.unionByName(split).filter("n > 1")


def op7_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs).select("doc_id", "safe.text", "safe.n_entities", "safe.entities")


def replaced(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with surrogates in text and n_chars to match, other columns as they are."""
    done = with_surrogates(docs.select(packed(docs).alias("doc"), F.col("text")), key=key)
    new = {"text": F.col("safe.text"), "n_chars": F.coalesce(F.length("safe.text"), F.lit(0)).cast("long")}
    return done.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
