import random
import re
from itertools import product

from riskframe.llm.licenses import BASE_PHRASES, RULES, resolve, scan_licenses

from .conftest import LOW


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places = [(i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


ROWS = [
    (1, "Released under the MIT License."),
    (2, "Licensed under the Apache License, Version 2.0. And again: apache license\nversion 2!", ),
    (3, "cc-by-nc CC BY NC cc by nc-sa 4.0"),
    (4, "This work is licensed under the GNU General Public License, version 3."),
    (5, "SPDX-License-Identifier: BSD-3-Clause"),
    (6, "see https://www.gnu.org/licenses/gpl-3.0 for it"),
    (7, None),
    (8, ""),
    (9, "mit dem Hund under the, mit license"),
    (10, "ünder the mit license und under the mit licenseé"),
    (11, "word " * 30_000 + "under the MIT license " + "word " * 30_000),
    (None, "under the mit license"),
    (1, "Released under the MIT License."),
    (12, "Licensed under the Mozilla Public License 2.0 or CC0"),
]


def test_base_columns(documents):
    got = scan_licenses(documents(ROWS)).collect()
    assert len(got) == len(ROWS)
    texts = dict(ROWS)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[3] == "cc-by-nc,cc-by-nc-sa" and labels[4] == labels[6] == "gpl-3" and labels[5] == "bsd-3" and labels[12] == "cc0,mpl-2"
    assert labels[9] == "mit" and labels[7] == labels[8] == ""
    assert scan_licenses(documents(ROWS).where("false")).count() == 0


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 200 and len({r.pattern.pattern for r in RULES}) == len(RULES)


def test_containment_by_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        found = []
        for _ in range(rng.randrange(25)):
            start = rng.randrange(20)
            found.append((rng.choice([10, 20, 30]), start, start + rng.randrange(1, 9), rng.choice("abc"), 0.5))
        kept = []
        for d in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
            if not any(k[1] <= d[1] and d[2] <= k[2] and (k[0], k[2] - k[1]) != (d[0], d[2] - d[1]) for k in kept):
                kept.append(d)
        assert resolve(found) == sorted((s, e, label, c) for _, s, e, label, c in kept)


def forms(parsed):
    """The texts of a parsed pattern: all alternatives and optional parts, the first of each class, one of a repeat."""
    parts = []
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            parts.append([chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])])
        elif name == "MAX_REPEAT":
            parts.append(([""] if value[0] == 0 else []) + forms(value[2]))
        elif name == "SUBPATTERN":
            parts.append(forms(value[3]))
        elif name == "BRANCH":
            parts.append([x for one in value[1] for x in forms(one)])
        else:
            assert name == "ASSERT", name
            parts.append([""])
    return ["".join(x) for x in product(*parts)]


def test_every_alternative_passes_the_gate():
    for rule in RULES:
        for text in forms(re._parser.parse(rule.pattern.pattern.decode())):
            assert rule.pattern.search(f" {text} ".encode()) and rule.may_match(set(text.split())), (rule.label, text)


def test_names_in_one_word(documents):
    texts = {
        "FreeBSD license": "bsd-2", "0BSD license": "bsd-0", "PSF license": "python-2", "GPLv2": "gpl-2", "GNU GPLv3+": "gpl-3", "GPL3": "gpl-3",
        "LGPLv2.1": "lgpl-2", "LGPLv3": "lgpl-3", "AGPLv3": "agpl-3", "MPLv2.0": "mpl-2", "EUPLv1.2": "eupl-1", "GPL version 2": "gpl-2", "GPLv23": "",
    }
    got = {r.doc_id: r.labels for r in scan_licenses(documents([(i, f"so {t}, as said") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
