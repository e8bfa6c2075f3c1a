"""Personal data: detection and keyed surrogates.

Every entity gets a replacement of its own type and format that depends on a
key and on what the entity refers to, not on how it is written: the same
number with other separators gets the same new digits, a name in capitals the
same new name in capitals. Values are enciphered by a keyed permutation of
their own format (a Feistel network over their characters' classes), so two
different originals of a format cannot get one surrogate. A collision check
over the distinct entities of the corpus finds what is left (originals of
different formats, surrogates that are originals elsewhere) and draws again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from keyloom.llm.common import Batches, free, map_named, mapped, materialize, quoted, slim

KEY_SETTING = "spark.keyloom.pii.key"  #: the registered query's key, in hexadecimal
LOCAL = 10  #: last digits of a phone number, by which it is known; those before, a country's code, stay
LONG = 512  #: characters that are permuted as one number
TURNS = 200  #: a format of two values keeps one itself as often with a probability of 2 ** -200
DENSE = 0.9  #: share of collisions left from which a redraw counts as no help
STALLED = 5  #: redraws in a row without help, after which the formats left count as too full

#: Given names by script and gender; a surrogate comes from the same list.
NAMES = {
    ("latin", "f"): "Alice Amelia Anna Barbara Camille Carla Catherine Charlotte Clara Claire Diana Elena Elisabeth Emily Emma Eva Florence Grace Hannah Helen Ingrid Irene Isabel Jane Jennifer Jessica Julia Karen Katherine Laura Linda Lucia Margaret Maria Marie Martha Mary Monica Nancy Nicole Olivia Patricia Paula Rachel Rebecca Rosa Ruth Sandra Sarah Sophie Susan Teresa Ursula Victoria",
    ("latin", "m"): "Adam Albert Alexander Andrew Anthony Antonio Arthur Benjamin Brian Carlos Charles Christopher Daniel David Dennis Edward Eric Ernest Francis Frank Fernando George Gerald Gregory Harold Henry Hugo Jacob James Jason Javier John Joseph Juan Jürgen Karl Kevin Klaus Lawrence Luis Martin Matthew Michael Miguel Nicholas Oscar Patrick Paul Pedro Peter Philip Pierre Raymond Richard Robert Samuel Stephen Steven Thomas Timothy Victor Walter William Wolfgang",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Екатерина Елена Ирина Ксения Людмила Мария Надежда Наталья Ольга Светлана Татьяна Юлия",
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Владимир Виктор Дмитрий Иван Игорь Константин Максим Михаил Николай Олег Павел Сергей",
    ("greek", "f"): "Αικατερίνη Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Κατερίνα Μαρία Σοφία Χριστίνα",
    ("greek", "m"): "Αλέξανδρος Ανδρέας Βασίλης Γεώργιος Δημήτρης Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Χρήστος",
}
TITLES = {"mr": "m", "mrs": "f", "ms": "f", "miss": "f", "sir": "m", "herr": "m", "frau": "f", "monsieur": "m", "madame": "f", "mme": "f", "señor": "m", "señora": "f", "sr": "m", "sra": "f", "dr": "", "prof": ""}
#: Letters that take each other's place in names, by class; others take the place of letters near them in Unicode.
LETTERS = ("aeiou", "bcdfghjklmnprstvwzqxy", "áéíóúàèìòùâêîôûäöü", "ñçßšžčřńś", "аеиоуяэюёы", "бвгдзклмнпрстфхжцчшщйьъ", "αειουηω", "βγδζκλμνπρστφχθξψς")

_GIVEN = {n.lower(): (k, n) for k, names in NAMES.items() for n in names.split()}
_NAME = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
PATTERNS: dict[str, re.Pattern[str]] = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9_][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+(?![\w@])"),
    "secret": re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>]{6,})"),
    "key": re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]*\d)"),
    "card": re.compile(r"(?<![\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\d-])"),
    "ssn": re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]?\d{3,4}(?![\w-])"),
}
_TITLED = re.compile(rf"\b((?i:{'|'.join(TITLES)}))\b\.? ({_NAME})(?: ({_NAME}))?")
_FULL = re.compile(rf"\b(?=({_NAME}) ({_NAME})\b)")  #: every pair, those that share a word too


@lru_cache(maxsize=16384)
def _stream(key: bytes, label: str, data: str) -> int:
    return int.from_bytes(hmac.new(key, f"{label}\0{data}".encode(), hashlib.sha256).digest(), "big")


def _draw(key: bytes, label: str, data: int, size: int) -> int:
    """A keyed number of as many bits as ``size`` has, or more."""
    if size.bit_length() <= 256:
        return _stream(key, label, str(data))
    # not held, and hex as long numbers have no decimal form
    return sum(_stream.__wrapped__(key, f"{label}|{i}", f"{data:x}") << 256 * i for i in range(size.bit_length() // 256 + 1))


def permute(key: bytes, label: str, digits: list[int], radices: list[int]) -> list[int]:
    """Keyed permutation of all values with these radices."""
    size = 1
    for r in radices:
        size *= r
    if size < 2:
        return list(digits)
    half = len(radices) // 2
    sizes = [1, 1]
    for i, r in enumerate(radices):
        sizes[i >= half] *= r
    value = [0, 0]
    for i, (d, r) in enumerate(zip(digits, radices, strict=True)):
        value[i >= half] = value[i >= half] * r + d
    tag = f"{label}|{radices}"
    if half == 0:  # one place: a keyed shift
        value[1] = (value[1] + 1 + _stream(key, tag, "shift") % (sizes[1] - 1)) % sizes[1] if sizes[1] > 1 else 0
    else:
        for turn in range(8):
            to = turn % 2
            value[to] = (value[to] + _draw(key, f"{tag}|{turn}", value[1 - to], sizes[to])) % sizes[to]
    out = []
    for i in range(len(radices) - 1, -1, -1):
        out.append(value[i >= half] % radices[i])
        value[i >= half] //= radices[i]
    return out[::-1]


@lru_cache(maxsize=4096)
def alphabet(c: str, alphabets: tuple[str, ...]) -> str:
    """The letters and digits that may take the place of ``c``; "" where it stays.

    A letter of no listed alphabet, where letters are listed at all beyond those
    of a format, is replaced by one of its own kind (in the same case) of the
    same 256 code points, so its script stays.
    """
    for a in alphabets:
        if c in a:
            return a
    if alphabets is not LETTERS or not c.isalpha():
        return ""
    kind, base = unicodedata.category(c), ord(c) & ~0xFF
    near = (chr(base + i) for i in range(256))
    return "".join(x for x in near if unicodedata.category(x) == kind and x.lower() == x and unicodedata.normalize("NFC", x) == x and not any(x in a for a in LETTERS))


def _classes(text: str, alphabets: tuple[str, ...]) -> tuple[list[int], list[str]]:
    """Places of characters that are enciphered, and the alphabet of each."""
    found = [(i, a) for i, c in enumerate(text) if len(a := alphabet(c, alphabets)) > 1 and c in a]
    return [i for i, _ in found], [a for _, a in found]


def encipher(key: bytes, label: str, text: str, alphabets: tuple[str, ...]) -> str:
    """``text`` with each character of an alphabet replaced by one of the same alphabet; a permutation for each format."""
    places, own = _classes(text, alphabets)
    at = set(places)
    fixed = [(i, c) for i, c in enumerate(text) if i not in at]
    digits, radices = [a.index(text[i]) for i, a in zip(places, own, strict=True)], [len(a) for a in own]
    if len(places) <= LONG:
        new = permute(key, f"{label}|{len(text)}|{fixed}", digits, radices)
    else:  # piece by piece, each by what stands before it, so it stays a permutation
        new, before = [], hashlib.sha256(f"{len(text)}|{fixed}".encode())
        for i in range(0, len(places), LONG):
            part = digits[i : i + LONG]
            new += permute(key, f"{label}|{i}|{before.hexdigest()}", part, radices[i : i + LONG])
            before.update(bytes(part))
    out = list(text)
    for i, a, d in zip(places, own, new, strict=True):
        out[i] = a[d]
    return "".join(out)


_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(map(int, reversed(digits)))) % 10


def canonical(kind: str, text: str) -> str:
    """What the mention refers to, whatever its spelling."""
    if kind in ("phone", "card", "ssn"):
        digits = "".join(c for c in text if c.isdigit())
        return digits[-LOCAL:] if kind == "phone" else digits  # with its country's code or without, it is one number
    if kind in ("email", "surname") or kind.startswith("given"):
        return unicodedata.normalize("NFC", text).lower()
    return text.replace(" ", "") if kind == "iban" else text


def surrogate(key: bytes, kind: str, value: str, draw: int = 0) -> str:
    """The replacement of a canonical value."""
    label = f"{kind}|{draw}"
    for turn in range(TURNS):  # a value that stays itself is enciphered again
        new = _surrogate(key, f"{label}|{turn}", kind, value)
        if new != value:
            return new
    if any(map(str.isalnum, value)):
        raise ValueError(f"no surrogate differs from a value of kind {kind}")
    return value  # without letter or digit there is nothing to replace


def _surrogate(key: bytes, label: str, kind: str, value: str) -> str:
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        names = [encipher(key, f"{label}|host", x, (_LOWER, _DIGITS)) for x in labels[:-1]]
        return f"{encipher(key, label, local, (_LOWER, _DIGITS))}@{'.'.join([*names, labels[-1]])}"
    if kind == "ip":
        octets = list(map(int, value.split(".")))
        fixed = 1 if octets[0] in (10, 127) else 2 if octets[:2] == [192, 168] or octets[0] == 172 and 16 <= octets[1] < 32 else 0
        # the first octet stays clear of the ranges kept for private use
        first = [x for x in range(1, 224) if x not in (10, 127, 172, 192)]
        if fixed == 0 and octets[0] in first:
            new = permute(key, label, [first.index(octets[0]), *octets[1:]], [len(first), 256, 256, 256])
            return ".".join(map(str, [first[new[0]], *new[1:]]))
        fixed = max(fixed, 1)
        return ".".join(map(str, octets[:fixed] + permute(key, f"{label}|{octets[:fixed]}", octets[fixed:], [256] * (4 - fixed))))
    if kind == "card":
        body = value[0] + encipher(key, f"{label}|{value[0]}", value[1:-1], (_DIGITS,))
        off = luhn(value)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)) == off)
    if kind == "phone":
        return encipher(key, label, value, (_DIGITS,))
    if kind == "ssn":
        a, b, c = int(value[:3]), int(value[3:5]), int(value[5:])
        area = [x for x in range(1, 900) if x != 666]
        x, y, z = permute(key, label, [area.index(a), b - 1, c - 1], [len(area), 99, 9999])
        return f"{area[x]:03d}{y + 1:02d}{z + 1:04d}"
    if kind == "iban":
        body = encipher(key, f"{label}|{value[:2]}", value[4:], (_DIGITS, _UPPER))
        number = int("".join(str(int(c, 36)) for c in f"{body}{value[:2]}00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind == "key":
        head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|AIza|eyJ", value)
        n = head.end() if head else 0
        return value[:n] + encipher(key, f"{label}|{value[:n]}", value[n:], (_DIGITS, _UPPER, _LOWER))
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", value):
            return encipher(key, f"{label}|hex", value, (_HEX,))
        return encipher(key, label, value, (_DIGITS, _UPPER, _LOWER))
    if kind.startswith("given"):
        _, script, gender = kind.split("-")
        names = [n.lower() for n in NAMES[script, gender].split()]
        order = sorted(names, key=lambda n: _stream(key, label, n))
        return order[(order.index(value) + 1) % len(order)] if value in order else value
    return encipher(key, label, value, LETTERS)


def spell(kind: str, mention: str, value: str, new: str) -> str:
    """The surrogate written as the mention was: separators and capitals."""
    if kind in ("phone", "card", "ssn") or kind == "iban":
        if kind == "phone":
            new = "".join(c for c in mention if c.isdigit())[: -len(value)] + new
        left = iter(new)
        return "".join(next(left) if (c.isdigit() or kind == "iban" and c != " ") else c for c in mention)
    if kind == "surname" or kind.startswith("given"):
        if mention.isupper():
            return new.upper()
        return "-".join(x[:1].upper() + x[1:] for x in new.split("-"))
    if kind == "email" and mention != value:
        return new.upper() if mention.isupper() else new
    return new


def _capital(word: str) -> bool:
    """Whether a word begins as a name does: with a capital, or with a letter of a script that has none."""
    c = word[0]
    return c.isupper() or c.isalpha() and c.lower() == c.upper()


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order and without overlap."""
    if not text:
        return []
    starts: list[int] = []  # of what was found, ascending
    found: dict[int, tuple[int, int, str]] = {}

    def take(a: int, b: int, kind: str) -> None:
        k = bisect_left(starts, a)
        if (k and found[starts[k - 1]][1] > a) or (k < len(starts) and starts[k] < b):
            return
        starts.insert(k, a)
        found[a] = (a, b, kind)

    digits = any(d in text for d in _DIGITS)
    low = text.lower() if "=" in text or ":" in text else ""
    for kind, pattern in PATTERNS.items():
        if kind == "email" and "@" not in text or kind == "secret" and not any(w in low for w in ("passw", "pwd", "secret", "token", "key")):
            continue
        if kind not in ("email", "secret", "key") and not digits:
            continue
        for m in pattern.finditer(text):
            if kind == "secret":
                take(m.start(1), m.end(1), kind)
                continue
            if kind == "card":
                number = canonical(kind, m[0])
                if luhn(number) and not (len(number) == 16 and number.isdigit() and m[0].isdigit() and number[0] in "3456"):
                    continue
            if kind == "iban":
                number = canonical(kind, m[0])
                if int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 != 1:
                    continue
            if kind == "phone" and not 9 <= len(canonical(kind, m[0])) <= 13:
                continue
            take(m.start(), m.end(), kind)
    for m in _TITLED.finditer(text):
        if not _capital(m[2]):
            continue
        gender = TITLES[m[1].lower()]
        parts = [(g, m.span(g)) for g in (2, 3) if m[g] and _capital(m[g])]
        for i, (g, (a, b)) in enumerate(parts):
            known = _GIVEN.get(m[g].lower())
            if i == 0 and known and len(parts) > 1 and (not gender or known[0][1] == gender):
                take(a, b, f"given-{known[0][0]}-{known[0][1]}")
            else:
                take(a, b, "surname")
    for m in _FULL.finditer(text):
        known = _GIVEN.get(m[1].lower())
        if known and _capital(m[1]) and _capital(m[2]):
            take(*m.span(1), f"given-{known[0][0]}-{known[0][1]}")
            take(*m.span(2), "surname")
    return [found[a] for a in starts]


Draws = dict[tuple[str, str], int | str]  #: the attempt, or the surrogate itself


def replace(text: str | None, key: bytes, draws: Draws) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, kind, surrogate) by places in the original."""
    spans = detect(text)
    if not spans:
        return text, []
    out, at, log = [], 0, []
    for a, b, kind in spans:
        mention = text[a:b]
        value = canonical(kind, mention)
        draw = draws.get((kind, value), 0)
        new = spell(kind, mention, value, draw if isinstance(draw, str) else surrogate(key, kind, value, draw))
        out += [text[at:a], new]
        log.append((a, b, kind, new))
        at = b
    return "".join([*out, text[at:]]), log


def _entities(key: bytes) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = sorted({(kind, canonical(kind, t[x:y])) for t in b.column(0).to_pylist() for x, y, kind in detect(t)})
            if rows:
                kinds, values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values)], ["kind", "value"])

    return slim(run)


def _drawn(key: bytes) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            kinds, values, draws = (c.to_pylist() for c in b.columns)
            new = [surrogate(key, *x) for x in zip(kinds, values, draws, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], ["kind", "value", "draw", "new"])

    return slim(run)


def shape(kind: str, value: str) -> str:
    """What values must have in common to be each other's surrogates."""
    if kind == "ip":
        octets = value.split(".")
        return ".".join(octets[: 1 if octets[0] in ("10", "127") else 2 if octets[0] in ("192", "172") else 0])
    if kind in ("phone", "card", "ssn"):
        return f"{len(value)} {value[: 1 if kind == 'card' else 0]}"
    if kind == "surname":
        return "".join((alphabet(c, LETTERS) or c)[0] for c in value)
    head = value[:2] if kind == "iban" else value.rpartition(".")[2] if kind == "email" else ""
    return f"{head} {re.sub('[a-z]', 'a', re.sub('[A-Z]', 'A', re.sub('[0-9]', '0', value)))}"


def _shaped(batches: Batches) -> Batches:
    for b in batches:
        shapes = [shape(k, v) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shapes, pa.string())], [*b.schema.names, "shape"])


def _rotated(settled: DataFrame, bad: DataFrame, key: bytes) -> DataFrame:
    """``settled`` where each format of a ``bad`` value passes its own values round in a keyed order.

    The values of a format are distinct, and no surrogate of another format is
    one of them, so no two entities share a surrogate. A value alone in its
    format takes part with those of its kind.
    """
    shaped = materialize(settled.join(bad, ["kind", "value"], "left").select("kind", "value", "draw", "new", "bad").mapInArrow(slim(_shaped), "kind string, value string, draw int, new string, bad int, shape string"), "shaped")
    sizes = shaped.groupBy("kind", "shape").agg(F.count("*").alias("n"), F.max("bad").alias("full")).where("full = 1")
    lone = sizes.where("n = 1").select("kind").distinct().withColumn("lone", F.lit(1))
    held = shaped.join(sizes.select("kind", "shape", "full"), ["kind", "shape"], "left").join(lone, "kind", "left")
    turn = F.sha2(F.concat(F.lit(key.hex()), F.lit("|"), "value"), 256)
    ring = Window.partitionBy("kind", "ring").orderBy(turn, "value")
    whole = Window.partitionBy("kind", "ring").orderBy(turn, "value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = held.where("lone = 1 or full = 1").withColumn("ring", F.when(F.col("lone").isNull(), F.col("shape")))
    moved = named.withColumn("new", F.coalesce(F.lead("value").over(ring), F.first("value").over(whole))).withColumn("draw", F.lit(-1))
    columns = ["kind", "value", "draw", "new"]
    return materialize(held.where("lone is null and full is null").select(columns).union(moved.select(columns)), "rotated")


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, draw, new`` of the entities whose first surrogate another entity has or is.

    draw: the attempt without collision, where new is null. Redraws go on until
    no collision is left; what they leave in a format too full for them passes
    its own values round (draw -1, and new the surrogate).
    """
    entities = materialize(
        docs.select(F.col("text").cast("string")).mapInArrow(_entities(key), "kind string, value string").distinct().withColumn("draw", F.lit(0)),
        "entities",
    )
    schema = "kind string, value string, draw int, new string"
    settled = mapped(entities, _drawn(key), schema, "drawn")
    group = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    before, stalled = 0, 0
    while True:
        shared = settled.groupBy(group.alias("g"), "new").agg(F.min("value").alias("stays"), F.count("*").alias("n")).where("n > 1")
        again = settled.join(shared.withColumnRenamed("new", "n2"), (group == F.col("g")) & (F.col("new") == F.col("n2"))).where("value != stays").select("kind", "value")
        # names come from closed lists, where a surrogate is some original always
        known = settled.where(~F.col("kind").startswith("given")).select(F.col("kind").alias("k2"), F.col("value").alias("v2"))
        taken = settled.join(known, (F.col("kind") == F.col("k2")) & (F.col("new") == F.col("v2")), "left_semi").select("kind", "value")
        # what has no letter or digit has nothing to replace
        bad = materialize(again.union(taken).where(r"value rlike '[\\p{L}\\p{N}]'").distinct().withColumn("bad", F.lit(1)), "collisions")
        n = bad.count()
        stalled = stalled + 1 if before and n > DENSE * before else 0
        if stalled == STALLED:
            settled = _rotated(settled, bad, key)
        if not n or stalled == STALLED:
            break
        before = n
        again = settled.drop("new").join(bad, ["kind", "value"], "left").select("kind", "value", (F.col("draw") + F.coalesce("bad", F.lit(0))).alias("draw"))
        settled = mapped(again, _drawn(key), schema, "drawn")
    return settled.where("draw != 0").select("kind", "value", "draw", F.when(F.col("draw") < 0, F.col("new")).alias("new"))


SPAN = T.StructType().add("start", "integer").add("end", "integer").add("kind", "string").add("surrogate", "string")
DRAWN = T.StructType().add("kind", "string").add("value", "string").add("draw", "integer").add("new", "string")


def added(columns: list[str]) -> str:
    """Name of the column that :func:`pseudonymize` adds to those: ``_entities`` where it is unused."""
    return free(columns, "_entities")[0]


def pseudonymize(docs: DataFrame, key: bytes, draws: DataFrame | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``, and where they stand in the original (see :func:`added`).

    Null and empty texts stay as they are. Repeated rows and repeated entities
    get equal surrogates. Other columns are passed on, whatever their names; an
    empty table gives no rows. The key decides all surrogates; without it they
    cannot be told from fresh values. ``draws``: the result of :func:`collisions`
    over a larger corpus that the texts are of.
    """
    again = collisions(docs, key) if draws is None else draws
    again = materialize(again if "new" in again.columns else again.withColumn("new", F.lit(None).cast("string")), "again")
    entities = added(docs.columns)
    held_by, own, original = free([*docs.columns, entities], "_h", "_draws", "_original")
    texts = docs.withColumn(original, F.col("text").cast("string"))
    if again.isEmpty():
        texts = texts.withColumn(own, F.lit(None).cast(T.ArrayType(DRAWN)))
    else:  # the few with another draw come to each text by a join
        held = texts.select(original).distinct().mapInArrow(slim(_held), "_h string, kind string, value string")
        drawn = held.join(again, ["kind", "value"]).groupBy(F.col("_h").alias(held_by)).agg(F.collect_list(F.struct("kind", "value", "draw", "new")).alias(own))
        texts = texts.join(materialize(drawn, "draws"), F.sha2(F.col(original), 256) == F.col(held_by), "left").drop(held_by)
    others = [c for c in docs.columns if c != "text"]
    out = docs.select(*quoted(others)).schema.add("text", "string")
    names = [*out.fieldNames(), entities]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = [replace(t, key, {(x["kind"], x["value"]): x["draw"] if x["new"] is None else x["new"] for x in d or ()}) for t, d in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            log = [[dict(zip(("start", "end", "kind", "surrogate"), x, strict=True)) for x in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array([r[0] for r in rows], pa.string()), pa.array(log, spans)], names)

    done = map_named(texts.select(*quoted([*others, original, own])), run, out.add(entities, T.ArrayType(SPAN)))
    return done.select(*quoted([*docs.columns, entities]))


def _held(batches: Batches) -> Batches:
    for b in batches:
        rows = sorted({(hashlib.sha256(t.encode()).hexdigest(), kind, canonical(kind, t[x:y])) for t in b.column(0).to_pylist() if t for x, y, kind in detect(t)})
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["_h", "kind", "value"])


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING; where it is unset, a random one that holds for the session."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return bytes.fromhex(spark.conf.get(KEY_SETTING))


def query(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import bound_batches, table

    bound_batches(spark)
    found = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("_entities", lambda x: x["kind"]))), ",")
    return found.select("doc_id", "text", F.size("_entities").cast("long").alias("n_entities"), kinds.alias("kinds"))
