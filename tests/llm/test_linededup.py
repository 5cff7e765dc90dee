import re

from riskframe.llm.linededup import repeated_units, without_repeats

from .conftest import LOW

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def units(text, least, least_line=None, runs=False, across=False):
    """(start, end, words, content) of a text's units, by plain scanning."""
    words = list(WORD.finditer(text or ""))
    lines, sentences = [], []
    for i, m in enumerate(words):
        gap = text[words[i - 1].end() : m.start()] if i else "\n"
        x = m.group()
        capital = (x[0].isascii() and x[0].isupper() and len(x) > 1 and (x[1].islower() or ord(x[1]) > 127)) or 0xC0 <= ord(x[0]) <= 0xDE
        if not i or "\n" in gap:
            lines.append(i)
        if not i or "\n" in gap or capital or (re.search(r"[.!?]", gap) and re.search(r"[ \t\r]", gap)):
            sentences.append(i)
    spans = set()
    for first, last in zip(lines, [*lines, len(words)][1:], strict=True):
        inside = [s for s in sentences if first <= s < last]
        own = list(zip(inside, [*inside, last][1:], strict=True))
        if last - first >= (least if least_line is None else least_line):
            spans.add((first, last))
        if len(own) > 1:
            spans |= {(s, e) for s, e in own if e - s >= least}
        if runs and not across:
            spans |= {span for span in joined(own, least) if span != (first, last)}
    if runs and across and words:
        spans |= joined(list(zip(sentences, [*sentences, len(words)][1:], strict=True)), least)
        if len(words) < least:
            spans.add((0, len(words)))
    out = []
    for first, last in spans:
        end = words[last].start() if last < len(words) else len(text)
        out.append((words[first].start(), end, last - first, " ".join(m.group().translate(LOW) for m in words[first:last])))
    return sorted(out)


def joined(own, least):
    """The runs of each short one of the spans with those after it and with those before it."""
    spans = set()
    for i, (s, e) in enumerate(own):
        if e - s < least:
            spans |= set([(s, x) for _, x in own[i:] if x - s >= least][:1] + [(x, e) for x, _ in own[: i + 1] if e - x >= least][-1:])
    return spans


def expected(rows, least, least_line=None, runs=False, across=False):
    first, cuts = {}, []
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for start, end, n, content in units(text, least, least_line, runs, across):
            if content in first:
                cuts.append((doc_id, start, end, n, *first[content]))
            else:
                first[content] = (doc_id, start)
    return sorted(cuts)


ONE = "The first passage has quite a few words in it"
ROWS = [
    (1, f"Intro here.\n{ONE}.\nthe end of this text has words enough, of course!"),
    (2, f"lower words and then {ONE}. more of it follows here"),
    (3, f"É {ONE.upper()}\n{ONE}; {ONE}?"),
    (4, "short one.\nshort one.\n"),
    (5, None),
    (6, ""),
    (7, "  ...  \n\n"),
    (8, f"Ünïcode first. {ONE}. Last of all. " * 40),
]


def test_units_and_offsets(documents):
    got = repeated_units(documents(ROWS), 6)
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in got.collect()) == expected(ROWS, 6)


def test_texts_lose_repeats_only(documents):
    frame = documents([*ROWS, ROWS[1]])
    cuts = expected(ROWS, 6)
    got = without_repeats(frame, 6)
    assert got.columns == frame.columns
    texts = [(r.doc_id, r.text) for r in got.collect()]
    for doc_id, text in ROWS:
        left = text
        if text is not None:
            hit = {i for d, s, e, *_ in cuts if d == doc_id for i in range(s, e)}
            left = "".join(c for i, c in enumerate(text) if i not in hit)
        assert texts.count((doc_id, left)) == 1 + (doc_id == 2)


def test_repeated_rows_and_null_ids(documents):
    assert repeated_units(documents([(1, ONE), (1, ONE)])).count() == 0
    [row] = repeated_units(documents([(None, ONE), (1, ONE)])).collect()
    assert (row.doc_id, row.kept_doc_id) == (None, 1)
    assert repeated_units(documents(ROWS).where("false")).count() == 0


def test_short_whole_lines(documents):
    frame = documents([(1, "All rights reserved.\nOne\nanything else"), (2, "text. Yes sir. And\nall rights reserved\nOne"), (3, "a text. Yes sir. Then")])
    got = repeated_units(frame, min_line_words=1).collect()
    assert sorted((r.doc_id, r.n_words, r.kept_doc_id) for r in got) == [(2, 1, 1), (2, 3, 1)]
    texts = {r.doc_id: r.text for r in without_repeats(frame, min_line_words=1).collect()}
    assert texts[2] == "text. Yes sir. And\n" and texts[3] == "a text. Yes sir. Then"
    assert repeated_units(frame).count() == 0


PASSAGE = "Der Mann ging mit dem Hund in den Wald, weil das Wetter am Morgen sehr schön war. Ja. Dort sah Anna Berg den alten Baum und die Bank. Gut so. "


def test_passages_of_short_units(documents):
    texts = {1: f"heute früh. {PASSAGE}Alles war still", 2: f"Gestern sagte jemand laut. {PASSAGE}Niemand hat es geglaubt"}
    frame = documents(list(texts.items()))
    got = {r.doc_id: r.text for r in without_repeats(frame, runs=True).collect()}
    assert got == {1: texts[1], 2: "Gestern sagte jemand laut. Niemand hat es geglaubt"}
    assert all(r.n_words >= 6 for r in repeated_units(frame, runs=True).collect())


def test_runs_by_brute_force():
    from riskframe.llm.linededup import find_units
    from riskframe.llm.textvec import text_bytes
    import pyarrow as pa
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice(["Ab ", "ab ", "é ", "Éa ", "ab. ", "ab\n"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    want = set()
    for row, text in enumerate(texts):
        kept, parts = units(text, 1), {}
        words = [m for m in WORD.finditer(text)]
        for line_start, line_end in ((m.start(), m.end()) for m in re.finditer(r"[^\n]+", text)):
            inside = [m for m in words if line_start <= m.start() < line_end]
            cuts = [i for i, m in enumerate(inside) if not i or m.group()[0] in "É" or m.group() == "Ab" or "." in text[inside[i - 1].end() : m.start()]]
            spans = list(zip(cuts, [*cuts, len(inside)][1:]))
            runs = set()
            for i, (a, b) in enumerate(spans):
                if b - a < 6:
                    runs |= set([(a, e) for _, e in spans[i:] if e - a >= 6][:1]) | set([(s, b) for s, _ in spans[: i + 1] if b - s >= 6][-1:])
            want |= {(row, inside[a].start(), b - a) for a, b in runs if (a, b) != (0, len(inside))}
    data, offsets = text_bytes(pa.array(texts))
    plain, joined = (list(zip(*(x.tolist() for x in find_units(data, offsets, 6, 6, runs)))) for runs in (False, True))
    assert {(t, s, n) for t, s, _, n, *_ in joined[len(plain) :]} == want and joined[: len(plain)] == plain


LINES = "Terms of use\nAll of it is given as it is.\nNo promise is made.\nAsk us first\nbefore you copy any part of this page."


def test_passages_of_short_lines(documents):
    texts = {1: f"One text\n{LINES}\nContents\nAll rights reserved.", 2: f"Contents\nall else is new here\n{LINES}\nThe end", 3: "Contents\nno more\nThe end", 4: "contents, no more: the END!"}
    frame = documents(list(texts.items()))
    got = {r.doc_id: r.text for r in without_repeats(frame, 20, runs=True, across_lines=True).collect()}
    assert got == {1: texts[1], 2: "Contents\nall else is new here\nThe end", 3: texts[3], 4: ""}


def test_runs_across_lines_by_brute_force(documents):
    import random

    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(["Ab ", "ab ", "é ", "Éa ", "ab. ", "ab\n", "\n"]) for _ in range(rng.randrange(40)))) for i in range(80)]
    for least in (3, 6, 9):
        got = repeated_units(documents(rows), least, runs=True, across_lines=True)
        assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in got.collect()) == expected(rows, least, None, True, True)
