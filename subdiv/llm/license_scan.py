"""License scan: ordered signature rules behind a keyword prefilter.

Text is reduced to lower-case words with single blanks between; a rule is a regular
expression over it with a label, a keyword, a priority and a relevance.  Only rules whose
keyword occurs are tried.  A detection contained in one of equal or higher priority goes,
and of two that overlap the one of lower priority (then the shorter, then the later) goes.
Null texts count as empty: no words, no labels, score 0.  Repeated rows each get their
own, equal result; other columns of the input are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.llm import text as X

# Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Label, keyword, pattern of the name in lower-case words.
LICENSES = [
    ("mit", "mit", r"mit"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("gpl-2", "g", r"(?:gnu )?(?:gpl|general public license)(?: version)? v?2(?: 0)?"),
    ("gpl-3", "g", r"(?:gnu )?(?:gpl|general public license)(?: version)? v?3(?: 0)?"),
    ("lgpl-2.1", "l", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version)? v?2 1"),
    ("lgpl-3", "l", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version)? v?3(?: 0)?"),
    ("agpl-3", "a", r"(?:gnu )?(?:agpl|affero general public license)(?: version)? v?3(?: 0)?"),
    ("mpl-1.1", "m", r"(?:mpl|mozilla public license)(?: version)? 1 1"),
    ("mpl-2", "m", r"(?:mpl|mozilla public license)(?: version)? 2(?: 0)?"),
    ("epl-1", "e", r"(?:epl|eclipse public license)(?: version)? v?1(?: 0)?"),
    ("epl-2", "e", r"(?:epl|eclipse public license)(?: version)? v?2(?: 0)?"),
    ("cddl-1", "d", r"(?:cddl|common development and distribution license)(?: version)? 1(?: 0)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost-1", "boost", r"boost(?: software)?(?: license)?(?: version)? 1(?: 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("artistic-2", "artistic", r"artistic(?: license)?(?: version)? 2(?: 0)?"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("eupl-1.2", "eupl", r"eupl(?: version)? v?1 2"),
    ("ofl-1.1", "o", r"(?:sil )?(?:ofl|open font license)(?: version)? 1 1"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by", "c", r"(?:cc by|creative commons attribution)(?: [234] [05])?(?! (?:nc|sa|nd|noncommercial|sharealike|noderivatives))"),
    ("cc-by-sa", "c", r"(?:cc by sa|creative commons attribution sharealike)(?: [234] [05])?"),
    ("cc-by-nd", "c", r"(?:cc by nd|creative commons attribution noderivatives)(?: [234] [05])?"),
    ("cc-by-nc", "c", r"(?:cc by nc|creative commons attribution noncommercial)(?: [234] [05])?(?! (?:sa|nd|sharealike|noderivatives))"),
    ("cc-by-nc-sa", "c", r"(?:cc by nc sa|creative commons attribution noncommercial sharealike)(?: [234] [05])?"),
    ("cc-by-nc-nd", "c", r"(?:cc by nc nd|creative commons attribution noncommercial noderivatives)(?: [234] [05])?"),
    ("odbl-1", "o", r"(?:odbl|open database license)(?: version)?(?: 1(?: 0)?)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python-2", "p", r"(?:psf|python software foundation)(?: license)?(?: version)? 2"),
]

# Wording around a name; {} is the name.  Priority, relevance (0-100), wording.
WORDINGS = [
    (90, 100, r"spdx license identifiers? {}"),
    (80, 100, r"(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (75, 95, r"(?:dual )?licensed (?:as|with) (?:the )?{}(?: licen[cs]e)?"),
    (70, 95, r"(?:is|are) (?:subject to|governed by|covered by) (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (60, 90, r"under (?:the )?(?:terms of (?:the )?)?{} licen[cs]e"),
    (50, 80, r"(?:the )?{} licen[cs]e"),
    (40, 80, r"licen[cs]e {}"),
    (30, 60, r"all content {}"),
]

# Rules without a named license.
GENERAL = [
    ("public-domain", "public", 60, 90, r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "reserved", 50, 70, r"all rights reserved"),
    ("copyright", "copyright", 20, 40, r"copyright (?:c )?(?:19|20)\d\d"),
    ("proprietary", "proprietary", 50, 80, r"proprietary and confidential"),
]


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    priority: int
    relevance: int
    pattern: re.Pattern


def signatures() -> list[Signature]:
    """All rules, highest priority first."""
    rules = [
        Signature(label, keyword, priority, relevance, re.compile("(?<= )" + wording.format(f"(?:{name})") + "(?= )"))
        for label, keyword, name in LICENSES
        for priority, relevance, wording in WORDINGS
    ]
    rules += [Signature(label, keyword, priority, relevance, re.compile(f"(?<= ){pattern}(?= )")) for label, keyword, priority, relevance, pattern in GENERAL]
    return sorted(rules, key=lambda s: (-s.priority, s.label, s.pattern.pattern))


def _needed() -> re.Pattern:
    """What any text with a detection or base phrase holds: of a wording the part after its name, or before it if that is optional."""
    parts = [after if after and not after.endswith("?") else before for before, after in (wording.split("{}") for _, _, wording in WORDINGS)]
    parts += [pattern.replace(r"\d", ".") for *_, pattern in GENERAL] + [phrase for phrase, _ in BASE]
    return re.compile("|".join(dict.fromkeys(p.replace(" ", " +") for p in parts)).encode(), re.S)


_ANY = _needed()
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if X.ALNUM[c] else 32 for c in range(256))


def reduced(text: bytes) -> str:
    """Lower-case words with one blank before, between and after them."""
    return re.sub(" {2,}", " ", f" {text.translate(_TABLE).decode('utf-8', 'replace')} ")


def base_places(text: str) -> list[tuple[int, str]]:
    """First word (from 0) and label of every place of a base phrase in a reduced text."""
    found = []
    for phrase, label in BASE:
        at = text.find(f" {phrase} ")
        while at >= 0:
            found.append((text.count(" ", 0, at), label))
            at = text.find(f" {phrase} ", at + 1)
    return sorted(found)


def detect(text: str, rules: list[Signature]) -> list[tuple[int, int, Signature]]:
    """Detections ``(start, end, rule)`` in a reduced text that no other suppresses, by start."""
    present: dict[str, bool] = {}
    found = []
    for rule in rules:
        if rule.keyword not in present:
            present[rule.keyword] = rule.keyword in text
        if present[rule.keyword]:
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(text)]
    found.sort(key=lambda f: (-f[2].priority, f[0] - f[1], f[0], f[2].label))
    kept: list[tuple[int, int, Signature]] = []
    for start, end, rule in found:
        if all(end <= a or b <= start for a, b, _ in kept):
            kept.append((start, end, rule))
    return sorted(kept, key=lambda f: f[:2])


def scan(docs: DataFrame) -> DataFrame:
    """Words, base places, labels and score of every document; one pass, nothing is shuffled."""

    def run(batch):
        rules, parts = signatures(), []
        for block in X.blocks(batch.column("text")):
            n_words = block.words(X.ALNUM).count
            rows = []
            for i in range(block.n):
                raw = bytes(block.data[block.offsets[i] : block.offsets[i + 1]])
                if not _ANY.search(raw.translate(_TABLE)):
                    rows.append((0, None, None, "", "", 0.0, []))
                    continue
                text = reduced(raw)
                places = base_places(text)
                found = detect(text, rules)
                base = sorted({label for _, label in places})
                labels = sorted({*base, *(r.label for _, _, r in found)})
                score = max([1.0 if base else 0.0, *(r.relevance / 100 for _, _, r in found)])
                spans = [{"label": r.label, "first_word": text.count(" ", 0, a) - 1, "n_words": text.count(" ", a, b) + 1} for a, b, r in found]
                rows.append((len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(labels), score, spans))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))]
            names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
            parts.append(X.record_batch(doc_id=batch.column("doc_id").slice(block.first, block.n), n_words=n_words.astype(np.int64), **{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}))
        return parts

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "detections array<struct<label:string,first_word:long,n_words:long>>"
    )
    return X.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
