"""License scans: ordered signature rules behind literal gates.

A text is reduced to lower-cased words. Rules of whose literal strings the text holds one
are tried in order; a match inside one of the same or a higher priority is
suppressed, so "apache license version 2" is not also a bare name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as _c, _parser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from keyloom.llm.common import Batches, slim
from keyloom.llm.license_rules import LEADS, LICENSES

#: Phrases whose every place is reported, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Kinds of rule: priority and what a match is worth.
KINDS = {"identifier": (4, 1.0), "sentence": (3, 0.95), "lead": (2, 0.9), "name": (1, 0.6)}
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
DETECTION = T.ArrayType(
    T.StructType()
    .add("label", "string").add("kind", "string").add("rule", "integer")
    .add("first_word", "long").add("last_word", "long").add("score", "double")
)


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    pattern: re.Pattern[str]


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signatures in order."""
    out = []
    for line in LICENSES.strip().splitlines():
        label, names, spdx, sentences = (x.strip() for x in line.split(" | "))
        for x in spdx.split(" ;; "):
            out.append(Rule(label, "identifier", re.compile(rf" spdx licen[cs]e identifier {x}(?= )")))
        for x in sentences.split(" ;; "):
            out.append(Rule(label, "sentence", re.compile(rf" {x}(?= )")))
        for x in names.split(" ;; "):
            out.append(Rule(label, "lead", re.compile(rf" {LEADS} (?:{x})(?= )")))
            out.append(Rule(label, "name", re.compile(rf" (?:{x})(?= )")))
    return tuple(out)


def needed(pattern) -> tuple[str, ...]:
    """Literal strings of which every match of a parsed pattern holds one; () if there are none."""
    runs, found, run = [], [], ""
    for op, arg in pattern:
        if op is _c.LITERAL:
            run += chr(arg)
            continue
        runs, run = [*runs, run], ""
        if op is _c.SUBPATTERN:
            found.append(needed(arg[3]))
        elif op is _c.BRANCH:
            every = [needed(x) for x in arg[1]]
            found.append(tuple(dict.fromkeys(x for one in every for x in one)) if all(every) else ())
        elif op is _c.MAX_REPEAT and arg[0]:
            found.append(needed(arg[2]))
    found += [(x,) for x in [*runs, run] if x]
    # few strings of some length turn most texts away
    return max(found, key=lambda x: (min(map(len, x), default=0) > 2, -len(x), min(map(len, x), default=0)), default=())


@lru_cache(maxsize=1)
def _gates() -> tuple[tuple[Rule, tuple[str, ...]], ...]:
    """Each rule with literal strings of which a matching text holds one."""
    return tuple((rule, needed(_parser.parse(rule.pattern.pattern))) for rule in rules())


@lru_cache(maxsize=1)
def _literals() -> tuple[str, ...]:
    return tuple(sorted({x for _, gate in _gates() for x in gate}))


def reduce(text: str | None) -> tuple[int, bytes]:
    """Number of words, and the words with a space before, between and after."""
    if not text:
        return 0, b""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return len(words), b" " + b" ".join(words) + b" "


def places(line: bytes, phrase: str) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively, overlapping ones too."""
    want, out, at, seen, word = f" {phrase} ".encode(), [], -1, 0, 0
    while (at := line.find(want, at + 1)) >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        out.append(word)
    return out


def standing(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Matches (start, end, priority, rule) that are not within another of the same or a higher priority, in text order.

    Of equal ones of one priority the first rule's stands. Whatever holds a
    match comes before it here, and containment is transitive, so the furthest
    end met so far of each priority and those above it decides.
    """
    out, furthest = [], [-1] * (max(x[0] for x in KINDS.values()) + 1)
    for x in sorted(found, key=lambda x: (x[0], -x[1], -x[2], x[3])):
        _, end, priority, _ = x
        if furthest[priority] < end:
            out.append(x)
        for p in range(priority + 1):
            furthest[p] = max(furthest[p], end)
    return out


def detect(line: bytes) -> list[tuple[str, str, int, int, int, float]]:
    """(label, kind, rule, first word, last word, score) of what stands after suppression, in text order."""
    text = line.decode("utf-8", "replace")
    found = []
    held = {x for x in _literals() if x in text}
    for number, (rule, gate) in enumerate(_gates()):
        if not held.isdisjoint(gate):
            found += [(m.start(), m.end(), KINDS[rule.kind][0], number) for m in rule.pattern.finditer(text)]
    out, at, word = [], 0, 0
    for a, b, _, number in standing(found):
        word += text.count(" ", at, a)
        at, rule = a, rules()[number]
        out.append((rule.label, rule.kind, number, word, word + text.count(" ", a, b) - 1, KINDS[rule.kind][1]))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections`` of every row.

    Null and empty texts have no words and no labels (empty strings), nulls for
    the places and score 0. Repeated rows repeat; an empty table gives no rows;
    other columns are not read.
    """
    out = docs.select("doc_id").schema.add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long")
    out = out.add("base_labels", "string").add("labels", "string").add("score", "double").add("detections", DETECTION)
    names = out.fieldNames()

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                n, line = reduce(text)
                base = {k: p for k in PHRASES if line and (p := places(line, k))}
                at = [i for p in base.values() for i in p]
                hits = detect(line) if line else []
                labels = {PHRASES[k] for k in base}
                score = max([x[5] for x in hits] + [0.9] * bool(base), default=0.0)
                rows.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in hits})), score, [dict(zip(("label", "kind", "rule", "first_word", "last_word", "score"), x, strict=True)) for x in hits]))
            schema = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("rule", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())])))])
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(slim(run), out)


def query(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import bound_batches, table

    bound_batches(spark)
    return scan(table(spark, sf_dir, "documents")).drop("detections")
