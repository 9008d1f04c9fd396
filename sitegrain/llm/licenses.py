"""License scans by ordered signature rules (operator 11).

A text becomes its words, lower case and one blank apart, so that line breaks, comment signs and punctuation do not
matter. Several hundred rules (license_rules) are regular expressions over such words. A rule runs only where its keyword,
a word that all its matches hold, stands: around each place of the keyword, as far as any match reaches (REACH bytes).
Of overlapping detections one that lies within another of the same or a higher rank is suppressed (of equal intervals and
ranks the first rule's stands); detections that merely touch or cross all stay. Base phrases are rules too, the lowest, and keep their
labels even where they are suppressed.

A text's score is 1 less the product over its labels of the doubt in the surest detection of each.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased, counted from 0. Defined cases: null and empty texts, and texts without
words, have no places and no labels (an empty string) and score 0; repeated rows give repeated results; an empty table gives an empty result; other
columns take no part, whatever their names. A text is handled whole, in memory, whatever its length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import license_rules as L

#: Lower case; all ASCII but digits and letters is blank.
_FOLD = K.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32

#: Bytes around a keyword within which all matches that hold it lie.
REACH = 256

DIGEST = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_suppressed long"
FOUND = "doc_id long, label string, rank int, first_word long, n_words long, suppressed boolean"


class Detection(NamedTuple):
    first: int
    end: int
    rank: int
    order: int
    label: str
    base: bool


class Matcher:
    """The compiled rules by keyword."""

    def __init__(self, rules: list[L.Rule]):
        self.gates = defaultdict(list)
        for order, rule in enumerate(rules):
            pattern = re.compile(rb"(?<= )(?:" + rule.pattern.encode() + rb")(?= )")
            self.gates[rule.keyword].append((order, rule, pattern))

    def detections(self, words: bytes, begins: np.ndarray) -> dict[int, list[Detection]]:
        """Detections of each text of `words`: texts begin with a blank, words end with one; begins has the texts' places and the end."""
        blanks, out = np.flatnonzero(np.frombuffer(words, np.uint8) == 32), defaultdict(list)
        for keyword, gated in self.gates.items():
            for row, a, b in self._windows(words, begins, f" {keyword} ".encode()):
                base = np.searchsorted(blanks, begins[row]) + 1
                for order, rule, pattern in gated:
                    for m in pattern.finditer(words, a, b):
                        first, last = np.searchsorted(blanks, m.start()) - base, np.searchsorted(blanks, m.end()) - base
                        version = m.groupdict().get("v")
                        label = f"{rule.label}-{version.decode().replace(' ', '.')}" if version else rule.label
                        out[row].append(Detection(int(first), int(last) + 1, rule.rank, order, label, rule.base))
        return out

    def _windows(self, words: bytes, begins: np.ndarray, keyword: bytes) -> Iterator[tuple[int, int, int]]:
        """(text, start, end) of the disjoint stretches around the places of a keyword."""
        at, places = words.find(keyword), []
        while at >= 0:
            places.append(at)
            at = words.find(keyword, at + 1)
        if not places:
            return
        rows = np.searchsorted(begins, places, "right") - 1
        held = None
        for row, at in zip(rows.tolist(), places, strict=True):
            a, b = max(int(begins[row]), at - REACH), min(int(begins[row + 1]), at + len(keyword) + REACH)
            if held and held[0] == row and a <= held[2]:
                held = (row, held[1], b)
            else:
                if held:
                    yield held
                held = (row, a, b)
        yield held


@lru_cache(1)
def matcher() -> Matcher:
    return Matcher(L.rules())


def suppressed(found: list[Detection]) -> list[tuple[Detection, bool]]:
    """Detections by place, each with whether another of the same or a higher rank contains it."""
    ranked, reach = sorted(found, key=lambda d: (d.first, -d.end, -d.rank, d.order)), {}
    out = []
    for d in ranked:
        out.append((d, any(end >= d.end for rank, end in reach.items() if rank >= d.rank)))
        reach[d.rank] = max(reach.get(d.rank, 0), d.end)
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts as words, see Matcher.detections; the texts' places in them; and their numbers of words."""
    low = _FOLD[data]
    ink = low != 32
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = ink[firsts]
    nth = np.concatenate([[0], np.cumsum(start)])
    kept = np.concatenate([[0], np.cumsum(ink)])
    n = len(offsets) - 1
    begins = kept[offsets] + nth[offsets] + np.arange(n + 1)
    out = np.full(begins[-1], 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    at = (kept[:-1] + nth[1:] + row)[ink]  # a blank for each text and each word before; a word's own blank follows it
    out[at] = low[ink]
    return out.tobytes(), begins, np.diff(nth[offsets])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[list[tuple[Detection, bool]]]]]:
    rules = matcher()
    for batch in batches:
        for a, b, data, offsets in K.text_chunks(batch.column("text")):
            words, begins, n = _words(data, offsets)
            found = rules.detections(words, begins)
            yield batch.column("doc_id").slice(a, b - a), n, [suppressed(found[row]) if row in found else [] for row in range(b - a)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, n_words, rows in _scan(batches):
        columns: dict[str, list] = {name.split()[0]: [] for name in DIGEST.split(", ")[2:]}
        for row in rows:
            base = [d for d, _ in row if d.base]
            sure: dict[str, float] = {}
            for d, hidden in row:
                if d.base or not hidden:
                    sure[d.label] = max(sure.get(d.label, 0.0), L.SURE[d.rank])
            columns["n_base"].append(len(base))
            columns["first_word"].append(min((d.first for d in base), default=None))
            columns["last_word"].append(max((d.first for d in base), default=None))
            columns["base_labels"].append(",".join(sorted({d.label for d in base})))
            columns["labels"].append(",".join(sorted(sure)))
            columns["score"].append(1.0 - float(np.prod([1.0 - sure[label] for label in sorted(sure)])))
            columns["n_suppressed"].append(sum(hidden for _, hidden in row))
        kinds = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string()}
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_words": pa.array(n_words, pa.int64())} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()})


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, rows in _scan(batches):
        flat = [(i, d, hidden) for i, row in enumerate(rows) for d, hidden in row]
        yield pa.RecordBatch.from_pydict({
            "doc_id": ids.take(pa.array([i for i, _, _ in flat], pa.int64())), "label": pa.array([d.label for _, d, _ in flat], pa.string()), "rank": pa.array([d.rank for _, d, _ in flat], pa.int32()),
            "first_word": pa.array([d.first for _, d, _ in flat], pa.int64()), "n_words": pa.array([d.end - d.first for _, d, _ in flat], pa.int64()), "suppressed": pa.array([x for _, _, x in flat], pa.bool_()),
        })


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def detections(docs: DataFrame) -> DataFrame:
    """A row for each detection in docs(doc_id, text), suppressed ones too; see FOUND."""
    return _texts(docs).mapInArrow(_found, FOUND)


def digest(docs: DataFrame) -> DataFrame:
    """A row for each of docs(doc_id, text); see DIGEST."""
    return _texts(docs).mapInArrow(_digests, DIGEST)
