"""License detection by ordered signature rules.

Several hundred rules, written by hand (license_rules.py): sentences of license texts, tags
with versions, names, wordings and copyright lines, each a regular expression over the
lower-cased UTF-8 bytes with a label. Base phrases are rules too.

One Aho-Corasick pass over a text finds which keywords it has; only the rules gated by those
keywords run. A rule's keyword is the rarest word that each of its matches must hold: a name
rather than one of the words that all licenses share (COMMON). Detections are then taken in order of
priority, longer and earlier first; one that lies inside the interval of a detection already taken
is suppressed. Base phrases are facts about the text: they are always reported, and neither
suppress others nor are suppressed.

Null and empty texts have no words and score 0. Whole texts are scanned, however long; repeated
rows are judged one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import re._parser as sre
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm import license_rules
from quern.llm.common import LOWER, buffer_of, configure, pieces, texts, word_spans

#: (phrase, label) that every place is reported of.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Words that tell nothing about which license a text speaks of, the most common first.
COMMON = (
    "the of and to in a is licen this or for by with be not under license licensed licence software use terms as any without version copyright distributed "
    "released available provided published permission work public general open source free rights reserved notice all you may copy made file data "
    "code subject material commons creative distribution document program"
).split()

#: Weight of one detection in the score: wordings that state a grant, bare mentions, base phrases.
STATED, MENTIONED, BASED = 0.9, 0.5, 0.7

_SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_WORD = rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"


def _sure(form: list) -> Iterator[str]:
    """Strings without a space that each match of a parsed pattern holds: runs of letters outside choices and repeats."""
    run = ""
    for kind, value in form:
        if kind is sre.SUBPATTERN:
            inner = list(_sure(value[-1]))
            yield from inner
        elif kind is sre.LITERAL and value != 0x20:
            run += chr(value)
            continue
        if run:
            yield run
        run = ""
    if run:
        yield run


@dataclass(frozen=True)
class Rule:
    form: str
    label: str
    priority: int
    weight: float
    base: bool

    @property
    def keyword(self) -> str:
        """A string that every match holds: of the words outside groups the one that is least common, the longest of several."""
        words = list(_sure(sre.parse(self.form)))
        rare = [w for w in words if w not in COMMON and not w.isdigit()]
        return max(rare, key=len) if rare else max(words, key=lambda w: (COMMON.index(w) if w in COMMON else -1, len(w)))

    def pattern(self) -> re.Pattern[bytes]:
        body = self.form.encode("latin-1").replace(b" ?", b"(?:" + _SEP + b")?").replace(b" ", _SEP)
        first = rb"" if self.form.startswith("\\") else rb"(?<!" + _WORD + rb")"
        return re.compile(first + body + rb"(?!" + _WORD + rb")", re.S)


@lru_cache
def rules() -> tuple[Rule, ...]:
    """All rules. A lower priority number wins: sections in order, in each the rules in order; base phrases stand outside."""
    out = []
    for section, weight in ((license_rules.GRANTS, STATED), (license_rules.TAGS, STATED), (license_rules.NAMES, MENTIONED), (license_rules.MENTIONS, MENTIONED)):
        for line in section.strip().splitlines():
            label, form = line.split("\t")
            out.append(Rule(form, label, len(out), weight, False))
    return tuple(out + [Rule(p, label, len(out) + k, BASED, True) for k, (p, label) in enumerate(BASE)])


@lru_cache
def _machine() -> tuple[ahocorasick.Automaton, dict[str, list[tuple[Rule, re.Pattern[bytes]]]]]:
    gated: dict[str, list] = {}
    for r in rules():
        gated.setdefault(r.keyword, []).append((r, r.pattern()))
    found = ahocorasick.Automaton()
    for w in gated:
        found.add_word(w, w)
    found.make_automaton()
    return found, gated


def _gated(low: bytes) -> Iterator[tuple[Rule, re.Pattern[bytes]]]:
    automaton, gated = _machine()
    for w in sorted({w for _, w in automaton.iter(low.decode("latin-1"))}):
        yield from gated[w]


def detect(low: bytes) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of what is reported of a lower-cased text, in order of place."""
    return resolved([(m.start(), m.end(), r) for r, p in _gated(low) for m in p.finditer(low)])


def resolved(every: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """What is left of all detections once those inside others of higher rank are suppressed."""
    every.sort(key=lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].form))
    taken = [x for x in every if x[2].base]
    kept: list[tuple[int, int, Rule]] = []
    spans: list[tuple[int, int]] = []  # of kept, in order
    longest = 0
    for x in every:
        if not x[2].base:
            near = spans[bisect_left(spans, (x[0] - longest,)) : bisect_left(spans, (x[0] + 1,))]
            if not any(x[1] <= b for _, b in near):
                kept.append(x)
                insort(spans, x[:2])
                longest = max(longest, x[1] - x[0])
    return sorted(taken + kept, key=lambda x: (x[0], x[1], x[2].form))


FOUND = "doc_id long, n_words long, detections array<struct<start_word:long,start:long,stop:long,label:string,phrase:string,base:boolean>>, score double"
_DETECTION = pa.list_(pa.struct([("start_word", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("phrase", pa.string()), ("base", pa.bool_())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, detections (words and bytes from 0) and score (1 minus the product of what each detection leaves open)."""
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offsets = buffer_of(batch.column("text"))
            n_words, detections, score = [], [], []
            for lo, hi in pieces(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                data = LOWER[whole[offsets[lo] : offsets[hi]]]
                starts, _ = word_spans(data, at)
                first = np.searchsorted(starts, at)
                n_words += np.diff(first).tolist()
                body = data.tobytes()
                for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    found = detect(body[a:b])
                    word = (np.searchsorted(starts, [a + x[0] for x in found]) - first[k]).tolist() if found else []
                    detections.append([{"start_word": w, "start": s, "stop": e, "label": r.label, "phrase": r.form, "base": r.base} for w, (s, e, r) in zip(word, found)])
                    left = 1.0
                    for _, _, r in found:
                        left *= 1 - r.weight
                    score.append(1 - left)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(detections, _DETECTION), pa.array(score, pa.float64())], ["doc_id", "n_words", "detections", "score"])

    return texts(docs).mapInArrow(run, FOUND)
