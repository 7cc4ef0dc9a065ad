"""PII replaced by keyed, type-consistent surrogates.

Detected: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards (by issuer digit and check digit, also
before or behind other numbers), account numbers (IBAN, by their check digits), social security numbers, secrets (long hex
strings, keys with a vendor's prefix) and persons behind a title in any case. A surrogate
comes from a keyed permutation of the entity's own format: every character moves within its class (vowels, consonants,
digits, hex digits, by script and case), so lengths, punctuation and scripts stay, and two entities of a format never
share a surrogate. Cards keep their valid check digit, addresses their private or public range, e-mails a consistent
domain, persons their title's gender. Letters outside the classes move among the letters of their Unicode neighbourhood
with the same case.

A family name moves by a permutation without fixed points that depends on the key alone, so a family stays together,
two families never meet and none keeps its name. Given names are made of keyed syllables with an ending of the title's
gender, some ten million for each, in Latin or Cyrillic; in other scripts the own given name moves.

Coreference: the surrogate depends on key, type and canonical value alone. Distinctness is checked over the table of all
distinct entities: where two share a surrogate, or one equals its original, all but the smallest try again with the
next tweak until none is left; from ``LAST`` tweaks on, names and e-mails take keyed letters instead of their own format,
after ``ATTEMPTS`` whatever is left takes its kind and a long digest, which is always free. Such exceptions travel with the replacing tasks up to a bound, beyond it they are joined to the documents that hold them.

Defined cases: null texts stay null with 0 entities; repeated rows give equal texts; an empty table gives no rows;
entities may be of any length. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import byte_slices, discard, materialise, table, text_key, worker_memory

#: Exceptions up to which they travel with the tasks; beyond, they are joined to documents, with the same result.
MAX_EXCEPTIONS = 100_000
#: Attempts after which a surrogate no longer keeps its entity's own format, and the most attempts of all.
LAST = 8
ATTEMPTS = 40
#: Surrogates remembered by a task.
REMEMBERED = 50_000
SLICE_BYTES = 4 << 20
KEY = "development key: pass your own"

# fixed values: titles by gender, n for either
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "M."), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа"), "n": ("Dr", "Prof", "Professor")}
#: Capitalised words that may follow a name and are none.
NO_NAMES = frozenset(
    "I He She They It We You His Her Their My Our Your The A An And But Or If In On At To For From With As By Of When While Then There This That These Those Was Is Has Had Will Would "
    "Er Sie Es Wir Ihr Ich Der Die Das Ein Eine Und Aber Oder Im Am Zu Mit Als Wenn Dann Il Elle Ils Elles Nous Vous Je Le La Les Un Une Et Mais Ou Dans Sur Pour Avec Comme Quand "
    "El Ella Ellos Nosotros Yo Los Las Una Y Pero En Con Por Para Cuando Он Она Они Мы Вы Я И Но В На С По К От Для Как Когда".split()
)
#: Onsets and vowels of given names by script, and endings by gender.
SYLLABLES = {"latin": ("b c d f g k l m n p r s t v".split(), "a e i o u".split()), "cyrillic": ("б в г д к л м н п р с т ф".split(), "а е и о у".split())}
ENDINGS = {("m", "latin"): "n s r rd x l".split(), ("f", "latin"): "na la ra lia sa tta".split(), ("m", "cyrillic"): "н р л с й м".split(), ("f", "cyrillic"): "на ла ра са ня та".split()}
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝ", "çðñþß", "ÇÐÑÞ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
HEX = ("0123456789abcdef", "0123456789ABCDEF")

_DIGIT = re.compile(r"\d")
_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]++@(?:[\w-]++\.)+[^\W\d_]{2,}")
_NUMBERS = (
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?=[A-Fa-f]*\d)[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])")),
    ("key", re.compile(r"(?<![0-9A-Za-z_-])(?:AKIA[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{30,}+|sk-[0-9A-Za-z_-]{20,}+|xox[abprs]-[0-9A-Za-z-]{10,}+)(?![0-9A-Za-z_-])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}([- ])\d{2}\1\d{4}(?![\d-])")),
    ("ipv4", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)")),
    ("ipv6", re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]{1,34}(?![\w:])")),
    ("phone", re.compile(r"(?<![\w])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)")),
    ("phone", re.compile(r"(?<!\w)\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d(?:[ .-]?\d{2}){4}(?!\d)")),
    ("phone", re.compile(r"(?<![\w+.-])0\d([ .-])\d{2}(?:\1\d{2}){3}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+.-])(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}([ .-])\d{3}\1\d{4}|0\d{2,4} \d{3,4} \d{3,4})(?![\w-])")),
)
#: What a pattern must not follow is asked of its matches: they are few, and without it white space and words are passed over quickly.
_RUN = re.compile(r"\d(?:[ -]?\d){12,}+")
_GROUP = re.compile(r"\d+")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{1,4}){3,9}+")
_WORD = re.compile(r"[0-9A-Z]+")
_ALL_TITLES = tuple(t for ts in TITLES.values() for t in ts)
_TITLED = {t.rstrip(".").lower(): g for g, ts in TITLES.items() for t in ts}
_NAME = r"[^\W\d_]+(?:['’-](?![^\W\d_]\b)[^\W\d_]+)*"
#: Titles as they are written: as given, in capitals, in small letters; "M" only with its point.
_FORMS = sorted({f for t in _ALL_TITLES if t != "M." for f in (t, t.upper(), t.lower())}, key=len, reverse=True)
_INITIAL = re.compile(r"(?<!\w)[^\W\d_]\. ?\Z")
_PERSON = re.compile(rf"({'|'.join(map(re.escape, _FORMS))}|M(?=\. ))(\.?) ((?:{_NAME})(?: (?:{_NAME})){{0,2}})")


def find_cards(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digit groups are tried at every end with 13 to 19 digits, the longest first; what is no card is tried again inside.

    A card in several groups begins with four digits, has one kind of separator and no group below three but the last.
    """
    for run in _RUN.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *run.span())][text[run.start() - 1 : run.start()] == "+" :]
        i = 0
        while i < len(groups):
            digits, ends, sign = "", [], None
            for j in range(i, len(groups)):
                size = groups[j][1] - groups[j][0]
                if j > i:
                    sign = sign or text[groups[j][0] - 1]
                    if groups[i][1] - groups[i][0] != 4 or text[groups[j][0] - 1] != sign or j > i + 1 and groups[j - 1][1] - groups[j - 1][0] < 3:
                        break
                digits += text[slice(*groups[j])] if size <= 19 else "0" * 20
                if len(digits) > 19:
                    break
                if len(digits) >= 13:
                    ends.append((j, digits))
            hit = next((j for j, d in reversed(ends) if "2" <= d[0] <= "6" and luhn_digit(d[:-1]) == int(d[-1])), None)
            if hit is not None:
                yield groups[i][0], groups[hit][1]
            i = i + 1 if hit is None else hit + 1


def iban_check(country: str, rest: str) -> str:
    """The two check digits of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def find_ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while run := _IBAN.search(text, at):
        at = run.start() + 1
        if text[run.start() - 1 : run.start()].isalnum():
            continue
        ends = [m.end() for m in _WORD.finditer(text, *run.span())]
        for end in reversed(ends):
            value = text[run.start() : end].replace(" ", "")
            if 15 <= len(value) <= 34 and iban_check(value[:2], value[4:]) == value[2:4] and not text[end : end + 1].isalnum():
                yield run.start(), end
                at = end
                break


def find_persons(text: str) -> Iterator[tuple[int, int, str]]:
    """Names behind a title. Their case tells where they end: a title in capitals has names in capitals, any other capitalised ones."""
    at = 0
    while m := _PERSON.search(text, at):
        # inside a word it is no title, but one may follow
        before = text[m.start() - 1 : m.start()]
        at = m.start() + 1
        if before.isalnum() or before in ("_", ".", "-") and before:
            continue
        title, words = m[1], m[3].split(" ")
        shouted, whispered = title.isupper() and len(title) > 1, title.islower()
        if title == "M" and _INITIAL.search(text, max(0, m.start() - 4), m.start()):
            continue
        names: list[str] = []
        behind = [*words[1:], text[m.end(3) : m.end(3) + 2].strip()]
        for w, after in zip(words, behind, strict=True):
            # such a word is a name only as the first one, and if no sentence goes on behind it
            no_name = w.capitalize() in NO_NAMES and (names or after[:1].islower())
            if no_name or w[0].islower() or shouted and w != w.upper():
                break
            names.append(w)
        if not names and whispered and title in ("mr", "mrs") and words[0].islower() and words[0].capitalize() not in NO_NAMES:
            names = words[:1]
        if not names and shouted and words[0][0].isupper() and words[0].capitalize() not in NO_NAMES:
            names = words[:1]
        if names:
            at = m.start(3) + len(" ".join(names))
            yield m.start(3), at, "person_" + _TITLED[title.lower()]


def is_entity(kind: str, value: str) -> bool:
    """What a pattern alone can't tell: that an address is one."""
    if kind == "ipv6":
        try:
            return bool(_DIGIT.search(value)) and ipaddress.IPv6Address(value) != 0
        except ValueError:
            return False
    return True


def find_entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type), in order and without overlaps."""
    t, found = text or "", []
    if "@" in t:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(t)]
    digits = _DIGIT.search(t)
    for kind, pattern in _NUMBERS:
        if digits or kind == "key":
            found += [(*m.span(), kind) for m in pattern.finditer(t) if is_entity(kind, m[0])]
    if digits:
        found += [(*span, "card") for span in find_cards(t)] + [(*span, "iban") for span in find_ibans(t)]
    found += find_persons(t)
    order = {"email": 0, "secret": 1, "key": 2, "iban": 3, "card": 4, "ssn": 5, "ipv4": 6, "ipv6": 7, "phone": 8}
    out, end = [], 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], order.get(x[2], 9), -x[1])):
        if s >= end:
            out.append((s, e, kind))
            end = e
    return out


def _shouted(name: str) -> bool:
    """Written in capitals, initials apart."""
    return name.isupper() and any(len(w) > 1 for w in name.split(" "))


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "email" or kind == "secret":
        return value.lower()
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(value))
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "phone":
        return re.sub(r"[^\d+]", "", value)
    if kind.startswith("person") and (_shouted(value) or value.islower()):
        return value.title()
    return value


def _round_key(key: str, tweak: str) -> bytes:
    return hashlib.blake2b(f"{key}|{tweak}".encode(), digest_size=32).digest()


def _feistel(n: int, domain: int, k: bytes, back: bool = False) -> int:
    """A keyed permutation of range(domain) or its inverse: a Feistel network, walked until it lands inside."""
    half = max(1, ((domain - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mix(x: int, r: int) -> int:
        h = hashlib.blake2b(x.to_bytes((half + 7) // 8, "little") + bytes([r]), key=k, digest_size=min(64, (half + 7) // 8 + 8)).digest()
        return int.from_bytes(h, "little") & mask

    while True:
        left, right = n >> half, n & mask
        for r in range(8):
            left, right = (right ^ mix(left, 7 - r), left) if back else (right, left ^ mix(right, r))
        n = (left << half) | right
        if n < domain:
            return n


def permute(n: int, domain: int, key: str, tweak: str) -> int:
    """A keyed permutation of range(domain)."""
    return n if domain < 2 else _feistel(n, domain, _round_key(key, tweak))


def derange(n: int, domain: int, key: str, tweak: str) -> int:
    """A keyed permutation of range(domain) without fixed points: the next one in a keyed order."""
    if domain < 2:
        return n
    k = _round_key(key, tweak)
    return _feistel((_feistel(n, domain, k, back=True) + 1) % domain, domain, k)


@cache
def _neighbours(c: str) -> str:
    """Letters outside CLASSES of the same 256 code points, category and case; empty for other characters."""
    like = lambda x: (x.isalnum(), unicodedata.category(x), x.isupper())
    start = ord(c) & ~255
    return "".join(x for x in map(chr, range(start, start + 256)) if like(x) == like(c) and not any(x in k for k in CLASSES)) if c.isalnum() else ""


def permute_text(value: str, key: str, tweak: str, classes: tuple[str, ...] = CLASSES, move: Callable = permute, names: bool = False) -> str:
    """All characters that belong to a class move within it, by one permutation of the whole string; in names all letters move."""
    slots = [(c, next((k for k in classes if c in k), names and _neighbours(c) or None)) for c in value]
    n, domain = 0, 1
    for c, k in slots:
        if k:
            n, domain = n * len(k) + k.index(c), domain * len(k)
    n = move(n, domain, key, f"{tweak}|{''.join('.' if k is None else k[0] for _, k in slots)}")
    out = []
    for c, k in reversed(slots):
        if k:
            n, i = divmod(n, len(k))
            c = k[i]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(body: str) -> int:
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(body))))
    return -total % 10


def _ip_range(n: int) -> str:
    a, b = n >> 24, n >> 16 & 255
    return "private" if a == 10 or a == 172 and 16 <= b < 32 or a == 192 and b == 168 else "local" if a in (0, 127) or a >= 224 else "public"


def _letters(n: int, kind: str, value: str, key: str, tweak: str) -> str:
    """n keyed letters for a value."""
    h = hashlib.blake2b(f"{kind}|{value}".encode(), key=_round_key(key, "letters|" + tweak), digest_size=n).digest()
    return "".join(chr(97 + x % 26) for x in h)


def given_name(value: str, gender: str, script: str, key: str, tweak: str) -> str:
    """Keyed syllables with the ending of a gender; a name of neutral title takes either."""
    h = int.from_bytes(hashlib.blake2b(value.encode(), key=_round_key(key, "given|" + tweak), digest_size=16).digest(), "big")
    onsets, vowels = SYLLABLES[script]
    h, which = divmod(h, 2)
    endings = ENDINGS["mf"[which] if gender == "n" else gender, script]
    out = ""
    for _ in range(3):
        h, a = divmod(h, len(onsets))
        h, b = divmod(h, len(vowels))
        out += onsets[a] + vowels[b]
    return (out + endings[h % len(endings)]).capitalize()


def surrogate(kind: str, value: str, key: str, attempt: int = 0) -> str:
    """The surrogate of a canonical value."""
    tweak = f"{kind}|{attempt}"
    if attempt >= ATTEMPTS - 1:  # no value of its own format is free
        return f"{kind}-{hashlib.blake2b(value.encode(), key=_round_key(key, kind), digest_size=16).hexdigest()}"
    if kind == "iban":
        rest = permute_text(value[4:], key, tweak + value[:2])
        return value[:2] + iban_check(value[:2], rest) + rest
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        if attempt >= LAST:
            return f"{_letters(12, kind, value, key, tweak)}@{_letters(8, kind, domain, key, 'domain')}.{top}"
        return f"{permute_text(local, key, tweak + '|' + domain, names=True)}@{permute_text(host, key, tweak, names=True)}.{top}"
    if kind == "secret":
        return permute_text(value, key, tweak, HEX[:1])
    if kind == "key":
        at = 4 if value.startswith(("AKIA", "gh")) else value.index("-") + 1
        return value[:at] + permute_text(value[at:], key, tweak + value[:at])
    if kind == "card":
        body = value[0] + permute_text(value[1:-1], key, tweak + value[0])
        return body + str(luhn_digit(body))
    if kind == "ssn":
        return permute_text(value, key, tweak)
    if kind == "phone":
        keep = 2 if value.startswith(("+1", "+7")) else 3 if value.startswith("+") else int(value.startswith("0"))
        return value[:keep] + permute_text(value[keep:], key, tweak + value[:keep])
    if kind == "ipv4":
        n = int.from_bytes(bytes(map(int, value.split("."))), "big")
        same = _ip_range(n)
        n = permute(n, 1 << 32, key, tweak)
        while _ip_range(n) != same:
            n = permute(n, 1 << 32, key, tweak)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "ipv6":
        n = int(ipaddress.IPv6Address(value))
        network = n >> 112
        return str(ipaddress.IPv6Address(network << 112 | permute(n & (1 << 112) - 1, 1 << 112, key, f"{tweak}|{network}")))
    names = value.split(" ")
    gender, script = kind[-1], "cyrillic" if re.search("[А-яЁё]", value) else "latin" if re.search("[A-Za-zÀ-ɏ]", value) else "other"
    family = permute_text(names[-1], key, "family", move=derange, names=True)
    if family == names[-1] or len(names) == 1 and attempt >= LAST:
        family = _letters(9, "family", names[-1], key, tweak if len(names) == 1 else "").capitalize()
    middle = [permute_text(n, key, "middle", move=derange, names=True) for n in names[1:-1]]
    if len(names) == 1:
        return family
    if script == "other":
        first = permute_text(names[0], key, tweak, move=derange, names=True)
        first = _letters(9, kind, value, key, tweak).capitalize() if attempt >= LAST or first == names[0] else first
    else:
        first = given_name(value, gender, script, key, tweak)
    return " ".join([first, *middle, family])


def fit_layout(kind: str, mention: str, new: str) -> str:
    """The surrogate in the mention's case and with its separators."""
    if kind in ("card", "ssn", "phone", "iban"):
        signs = re.findall("[0-9A-Z]" if kind == "iban" else r"\d", mention)
        own = new if kind == "iban" else re.sub(r"\D", "", new)
        if len(own) != len(signs) or new.startswith(f"{kind}-"):
            return new
        given = iter(own)
        return re.sub("[0-9A-Z]" if kind == "iban" else r"\d", lambda _: next(given), mention)
    if kind.startswith("person"):
        return new.upper() if _shouted(mention) else new.lower() if mention.islower() else new
    return new.upper() if kind in ("email", "secret", "ipv6") and mention.isupper() else new


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, value``: the distinct entities of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                rows = sorted({(k, canonical(k, t[s:e])) for t in texts.slice(lo, hi - lo).to_pylist() for s, e, k in find_entities(t)})
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["kind", "value"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, value string").distinct()


def resolve_collisions(known: DataFrame, key: str) -> DataFrame:
    """``kind, value, attempt`` of the exceptions, so that all surrogates differ and none is an original's own."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(new=[surrogate(k, v, key, a) for k, v, a in zip(f["kind"], f["value"], f["attempt"], strict=True)])

    schema = "kind string, value string, attempt int, new string"
    now = materialise(known.select("kind", "value", F.lit(0).alias("attempt")).mapInPandas(draw, schema), "surrogates")
    for _ in range(ATTEMPTS):
        shared = now.groupBy("kind", "new").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        clash = now.join(shared, ["kind", "new"], "left").filter("value = new OR (n > 1 AND value <> first)").select("kind", "value", "attempt")
        clash = materialise(clash, "clash")
        if not clash.limit(1).count():
            return now.filter("attempt > 0").select("kind", "value", "attempt")
        again = clash.withColumn("attempt", F.col("attempt") + 1).mapInPandas(draw, schema)
        before, now = now, materialise(now.join(clash.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(again), "surrogates")
        discard(before, clash)
    return now.filter("attempt > 0").select("kind", "value", "attempt")


def replace_entities(text: str | None, key: str, exceptions: dict, memory: dict) -> tuple[str | None, int]:
    """The text with surrogates, and how many entities it had."""
    if text is None:
        return None, 0
    out, at, found = [], 0, find_entities(text)
    for s, e, kind in found:
        who = (kind, canonical(kind, text[s:e]))
        asked = (*who, exceptions.get(who, 0))
        if asked not in memory:
            if len(memory) > REMEMBERED:
                memory.clear()
            memory[asked] = surrogate(*who, key, asked[2])
        out += [text[at:s], fit_layout(kind, text[s:e], memory[asked])]
        at = e
    return "".join([*out, text[at:]]), len(found)


def _replacing(key: str, exceptions: dict):
    """Batches (doc_id, text and, where exceptions are joined, own) to doc_id, text, n_entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        memory: dict = {}
        for batch in batches:
            texts = batch.column("text")
            own = batch.column("own") if "own" in batch.schema.names else None
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                theirs = [None] * (hi - lo) if own is None else own.slice(lo, hi - lo).to_pylist()
                known = (exceptions if x is None else {(r["kind"], r["value"]): r["attempt"] for r in x} for x in theirs)
                got = [replace_entities(t, key, k, memory) for t, k in zip(texts.slice(lo, hi - lo).to_pylist(), known, strict=True)]
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array([t for t, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_entities"])

    return run


def _held_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in byte_slices(texts, SLICE_BYTES):
            rows = [(k, kind, value) for k, t in zip(batch.column("k").slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist(), strict=True) for kind, value in sorted({(kind, canonical(kind, t[s:e])) for s, e, kind in find_entities(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))], ["k", "kind", "value"])


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``doc_id, text, n_entities``: all texts with their entities replaced."""
    exceptions = resolve_collisions(materialise(entities(docs), "entities"), key)
    some = exceptions.limit(MAX_EXCEPTIONS + 1).collect()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, text string, n_entities long"
    if len(some) <= MAX_EXCEPTIONS:
        return rows.mapInArrow(_replacing(key, {(r.kind, r.value): r.attempt for r in some}), schema)
    # equal texts hold equal entities: exceptions are gathered by the text's hash
    held = docs.select(text_key("text").alias("k"), "text").mapInArrow(_held_entities, "k long, kind string, value string").distinct()
    own = held.join(exceptions, ["kind", "value"]).groupBy("k").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("own"))
    joined = rows.withColumn("k", text_key("text")).join(own, "k", "left").select("doc_id", "text", F.coalesce("own", F.expr("cast(array() as array<struct<kind:string,value:string,attempt:int>>)")).alias("own"))
    return joined.mapInArrow(_replacing(key, {}), schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents"))
