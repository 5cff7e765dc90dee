"""License scans by ordered signature rules.

A rule is a regular expression over a text's words (letters and digits, A-Z in lower case, joined by one space), with a
priority and a confidence. Rules are written as license names times the forms in which a license is declared: an SPDX tag,
a canonical address, a grant ("licensed under ..."), a title ("... license") and a metadata field. A rule runs only where
the text has one of each of its sets of keywords, which is found by one hash lookup a word. Detections are resolved in order of priority:
one that lies within a kept one of the same or higher priority is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.textvec import MARKS, Words, blocks, byte_table, find_words

# Fixed values of the base: phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# label, keywords (any of them), the name as words, SPDX id as words, address as words. None where a form doesn't exist.
LICENSES = [
    ("mit", "mit", r"mit(?: expat)?", r"mit", r"opensource org licenses mit"),
    ("apache-1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1(?: [01])?", r"apache 1 [01]", r"apache org licenses license 1 [01]"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", r"apache 2 0", r"apache org licenses license 2 0"),
    ("gpl-1", "general", r"gnu general public license(?: version)? 1(?: 0)?", None, None),
    ("gpl-2", "general", r"gnu general public license(?: version)? 2(?: 0)?", None, r"gnu org licenses old licenses gpl 2 0"),
    ("gpl-3", "general", r"gnu general public license(?: version)? 3(?: 0)?", None, r"gnu org licenses gpl 3 0"),
    ("gpl-2", "gpl gplv2 gpl2", r"(?:gnu )?gpl(?:(?: version)? )?v?2(?: 0)?", r"gpl 2 0(?: only| or later)?", None),
    ("gpl-3", "gpl gplv3 gpl3", r"(?:gnu )?gpl(?:(?: version)? )?v?3(?: 0)?", r"gpl 3 0(?: only| or later)?", None),
    ("lgpl-2", "lesser", r"gnu lesser general public license(?: version)? 2(?: [01])?", None, None),
    ("lgpl-3", "lesser", r"gnu lesser general public license(?: version)? 3(?: 0)?", None, None),
    ("lgpl-2", "lgpl lgplv2 lgpl2", r"(?:gnu )?lgpl(?:(?: version)? )?v?2(?: [01])?", r"lgpl 2 [01](?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "lgpl lgplv3 lgpl3", r"(?:gnu )?lgpl(?:(?: version)? )?v?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("agpl-3", "affero", r"gnu affero general public license(?: version)? 3(?: 0)?", None, None),
    ("agpl-3", "agpl agplv3 agpl3", r"(?:gnu )?agpl(?:(?: version)? )?v?3(?: 0)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0"),
    ("fdl-1", "documentation", r"gnu free documentation license(?: version)? 1(?: [123])?", r"gfdl 1 [123](?: only| or later)?", r"gnu org licenses fdl(?: 1 [123])?"),
    ("bsd-2", "bsd freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", r"bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)", r"bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)", r"bsd 4 clause", None),
    ("bsd-0", "bsd 0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", r"0bsd", r"opensource org licenses 0bsd"),
    ("mpl-1", "mozilla", r"mozilla public license(?: version)? 1(?: [01])?", None, r"mozilla org mpl 1 [01]"),
    ("mpl-2", "mozilla", r"mozilla public license(?: version)? 2(?: 0)?", None, r"mozilla org mpl 2 0"),
    ("mpl-2", "mpl mplv2 mpl2", r"mpl(?:(?: version)? )?v?2(?: 0)?", r"mpl 2 0", None),
    ("epl-1", "eclipse", r"eclipse public license(?: version)? v?1(?: 0)?", None, r"eclipse org legal epl v10"),
    ("epl-2", "eclipse", r"eclipse public license(?: version)? v?2(?: 0)?", None, r"eclipse org legal epl v20"),
    ("cddl-1", "cddl cddlv1 cddl1", r"cddl(?:(?: version)? )?v?1(?: [01])?", r"cddl 1 [01]", r"opensource org licenses cddl 1 0"),
    ("isc", "isc", r"isc", r"isc", r"opensource org licenses isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib", r"zlib net zlib license"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl", r"wtfpl net"),
    ("artistic-1", "artistic", r"artistic license(?: version)? 1(?: 0)?", r"artistic 1 0", r"opensource org licenses artistic 1 0"),
    ("artistic-2", "artistic", r"artistic license(?: version)? 2(?: 0)?", r"artistic 2 0", r"opensource org licenses artistic 2 0"),
    ("bsl-1", "boost", r"boost software license(?: version)?(?: 1(?: 0)?)?", r"bsl 1 0", r"boost org license 1 0"),
    ("python-2", "python psf", r"(?:python software foundation|psf)(?: license)?(?: version)?(?: 2)?", r"python 2 0", r"python org psf license"),
    ("ms-pl", "microsoft", r"microsoft public", r"ms pl", r"opensource org licenses ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal", r"ms rl", r"opensource org licenses ms rl"),
    ("ofl-1", "ofl", r"(?:sil )?ofl(?: version)?(?: 1(?: 1)?)?", r"ofl 1 1", r"scripts sil org ofl"),
    ("eupl-1", "eupl euplv1 eupl1", r"eupl(?:(?: version)? )?v?1(?: [12])?", r"eupl 1 [12]", r"joinup ec europa eu software page eupl"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql", r"opensource org licenses postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa", r"opensource org licenses ncsa"),
    ("cc0", "cc0", r"cc0(?: 1(?: 0)?)?(?: universal)?", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", "cc", r"cc by(?: [1-4](?: [05])?)?", r"cc by [1-4] [05]", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4](?: [05])?)?", r"cc by sa [1-4] [05]", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4](?: [05])?)?", r"cc by nc [1-4] [05]", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4](?: [05])?)?", r"cc by nd [1-4] [05]", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4](?: [05])?)?", r"cc by nc sa [1-4] [05]", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4](?: [05])?)?", r"cc by nc nd [1-4] [05]", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4](?: [05])?)?", None, None),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4](?: [05])?)?", None, None),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4](?: [05])?)?", None, None),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4](?: [05])?)?", None, None),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[frozenset[str], ...]  # one of each set is needed
    pattern: re.Pattern[bytes]
    priority: int
    confidence: float

    def may_match(self, words: set[str]) -> bool:
        return not any(k.isdisjoint(words) for k in self.keywords)


# Forms in order of priority: what stands before the name, after it, the keywords, priority and confidence.
NAME_FORMS = [
    (r"(?:licensed|released|distributed|published|available|provided|redistributed) under (?:the )?(?:terms of )?(?:the )?", r"(?: license)?", ("under",), 80, 0.95),
    (r"", r" license(?: v(?:ersion)? ?[0-9]+(?: [0-9])?)?", ("license",), 60, 0.8),
    (r"license (?:is |type |name )?", r"", ("license",), 40, 0.6),
    (r"", r"", (), 20, 0.5),
]
SHORT_NAMES = {"mit", "isc", "zlib", "postgresql", "ncsa", "unlicense", "python-2", "ms-pl", "ms-rl"}


def _rules() -> list[Rule]:
    rules = []

    def add(label: str, words: tuple[str, ...], body: str, priority: int, confidence: float) -> None:
        pattern = re.compile(rb"(?<= )(?:" + body.encode() + rb")(?= )")
        rules.append(Rule(label, tuple(frozenset(w.split()) for w in words), pattern, priority, confidence))

    for label, keyword, name, spdx, address in LICENSES:
        if spdx:
            add(label, ("spdx", "identifier"), f"spdx license identifier {spdx}", 100, 1.0)
        if address:
            add(label, (address.split()[0],), address, 90, 0.99)
        for before, after, words, priority, confidence in NAME_FORMS:
            if words or label not in SHORT_NAMES:  # a bare short name says too little
                add(label, (keyword, *words), f"{before}{name}{after}", priority, confidence)
    return rules


RULES = _rules()
_TABLE = byte_table(MARKS)
_PLAIN = bytes(32 if c == 0 else c - 1 for c in _TABLE.tolist())


def _hashes(words: list[str]) -> np.ndarray:
    joined = " ".join(words).encode()
    return find_words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), _TABLE).hash


KEYWORDS = sorted({k for r in RULES for any_of in r.keywords for k in any_of})
_KEY_HASHES = _hashes(KEYWORDS)
_KEY_ORDER = np.argsort(_KEY_HASHES)
_BASE = [(label, _hashes(phrase.split())) for phrase, label in BASE_PHRASES.items()]


def base_places(words: Words) -> list[tuple[str, np.ndarray]]:
    """Per base label the word numbers (in the block) at which its phrase starts."""
    found = []
    text = words.text
    for label, phrase in _BASE:
        n = len(words.hash) - len(phrase) + 1
        if n <= 0:
            found.append((label, np.zeros(0, np.int64)))
            continue
        at = np.flatnonzero(words.hash[:n] == phrase[0])
        for step, h in enumerate(phrase[1:], 1):
            at = at[words.hash[at + step] == h]
        found.append((label, at[text[at] == text[at + len(phrase) - 1]]))
    return found


def keywords_of_texts(words: Words) -> dict[int, set[str]]:
    """The keywords that each text has; texts without any are left out."""
    ordered = _KEY_HASHES[_KEY_ORDER]
    near = np.minimum(np.searchsorted(ordered, words.hash), len(ordered) - 1)
    hit = np.flatnonzero(ordered[near] == words.hash)
    held: dict[int, set[str]] = {}
    for text, key in zip(words.text[hit].tolist(), _KEY_ORDER[near[hit]].tolist(), strict=True):
        held.setdefault(text, set()).add(KEYWORDS[key])
    return held


def detections(plain: bytes, keywords: set[str]) -> list[tuple[int, int, str, float]]:
    """Kept detections ``(first word, word after the last, label, confidence)`` of a text of words joined by single spaces,
    with a space before and after."""
    found = []
    spaces = None
    for rule in RULES:
        if rule.may_match(keywords):
            for m in rule.pattern.finditer(plain):
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
                start, end = np.searchsorted(spaces, (m.start() - 1, m.end())).tolist()
                found.append((rule.priority, start, end, rule.label, rule.confidence))
    return resolve(found)


def resolve(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Drop each detection within a kept one: higher priorities first, of one priority the longer, then the earlier."""
    kept: list[tuple[int, int, str, float]] = []
    starts: list[int] = []
    ends: list[int] = []  # the largest end of all kept ones that start no later
    fresh: list[tuple[int, int]] = []

    def settle() -> None:
        spans = sorted([*zip(starts, ends, strict=True), *fresh])
        fresh.clear()
        starts[:] = [s for s, _ in spans]
        most, out = -1, []
        for _, e in spans:
            most = max(most, e)
            out.append(most)
        ends[:] = out

    level = None
    for priority, start, end, label, confidence in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        if (priority, end - start) != level:
            settle()
            level = (priority, end - start)
        at = bisect_right(starts, start) - 1
        if at >= 0 and ends[at] >= end:
            continue
        kept.append((start, end, label, confidence))
        fresh.append((start, end))
    return sorted(kept)


RESULT_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<first_word:long, end_word:long, label:string, confidence:double>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(
        pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])
    )
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column("_text")):
            words = find_words(data, offsets, _TABLE)
            rows = hi - lo
            places: list[list[tuple[int, str]]] = [[] for _ in range(rows)]
            text = words.text
            for label, at in base_places(words):
                for place, row in zip(at.tolist(), text[at].tolist(), strict=True):
                    places[row].append((place - int(words.bounds[row]), label))
            spans: list[list[dict]] = [[] for _ in range(rows)]
            scores, labels, base_labels = [0.0] * rows, [""] * rows, [""] * rows
            for row, keywords in keywords_of_texts(words).items():
                if any(r.may_match(keywords) for r in RULES):
                    plain = data[offsets[row] : offsets[row + 1]].tobytes().translate(_PLAIN)
                    for start, end, label, confidence in detections(b" " + b" ".join(plain.split()) + b" ", keywords):
                        spans[row].append({"first_word": start, "end_word": end, "label": label, "confidence": confidence})
            for row in range(rows):
                if places[row] or spans[row]:
                    base = {label for _, label in places[row]}
                    base_labels[row] = ",".join(sorted(base))
                    labels[row] = ",".join(sorted(base | {s["label"] for s in spans[row]}))
                    scores[row] = max([0.9 if base else 0.0, *(s["confidence"] for s in spans[row])])
            starts = [[p for p, _ in x] for x in places]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, rows),
                    pa.array(np.diff(words.bounds).astype(np.int64)),
                    pa.array([len(x) for x in starts], pa.int64()),
                    pa.array([min(x, default=None) for x in starts], pa.int64()),
                    pa.array([max(x, default=None) for x in starts], pa.int64()),
                    pa.array(base_labels, pa.string()),
                    pa.array(labels, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(spans, spans_type),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are numbered from 0. Base columns count the places of the base phrases; ``labels`` adds those of the kept
    detections, which ``spans`` lists. ``score`` is the highest confidence, 0.9 at least where there is a base place and 0
    where nothing is found. Null and empty texts have no words. Every row is scanned on its own, repeated rows and null ids
    too; other columns are not read; an empty table gives no rows.
    """
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("_text"))
    return named.mapInArrow(_scan, RESULT_SCHEMA)
