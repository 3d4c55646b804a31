"""License scans and personal data against plain brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import license_scan, pii
from inkwell.llm._text import text_bytes
from inkwell.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXTS = ["a@b.c", "x@@y.com.au a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 0000255.1.1.1", "é +1 (988) 555-2485 ñ", "4539 1488 0343 6467 x", "", None, "@" * 50,
         "a" * 20_000 + "@" + "b.c", "1" * 20_000, "+1+2+3 555 555 5555", "+1 (269) 555-3296 4524132264652876 and", "1 2 3 4 5 6 7 8 9 0 1 2 3", "%40@x-.y-z.1"]


def base(text):
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in re.sub("[ -]", "", m[0])][::-1]
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0:
            spans.append(("card", *m.span()))
    return spans + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def check_pii(row, text):
    expected = base(text or "")
    assert [getattr(row, f"n_{k}") for k in pii.PATTERN_KINDS] == [sum(s[0] == k for s in expected) for k in pii.PATTERN_KINDS]
    assert row.base_sha256 == hashlib.sha256(pii.written(expected).encode()).hexdigest()
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(",") if s)]
    assert [s for s in spans if s[0] in pii.PATTERN_KINDS] == expected and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), *s[1:]))
    own = [s for s in spans if s[0] not in pii.PATTERN_KINDS]
    assert not any(a < e and s < b for _, a, b in own for _, s, e in expected)


def test_patterns_of_odd_texts(frame):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in pii.find(frame(rows)).collect()}
    for i, text in rows:
        check_pii(got[i], text)
    assert pii.find(frame([])).count() == 0 and len(pii.find(frame([(1, "a@b.c")] * 3)).collect()) == 3


def test_personal_data_query_against_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op10_pii"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check_pii(r, texts[r.doc_id])


def test_field_learns_its_table_and_finds_new_cases():
    field = pii.train()
    rows = pii.labelled()
    right = [pii.viterbi(field, [pii.bins(t, {})])[0].tolist() == y for t, y in rows]
    assert np.mean(right) > 0.95
    texts = ["then use password=0f3a9c1b77de42aa55 é", 'ist token = "77aa66bb55cc44dd33ee22ff11009988" so', "we saw Dr. Adams there", "just words, The End. And So on"]
    found = pii.Finder(field).spans(*text_bytes(pa.array(texts)))
    assert [[t[a:b] for _, a, b in s] for t, s in zip(texts, found, strict=True)] == [["password=0f3a9c1b77de42aa55"], ["77aa66bb55cc44dd33ee22ff11009988"], ["Adams"], []]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(pii.BINS + 1, k)).astype(np.float32), rng.normal(size=(k, k)).astype(np.float32), rng.normal(size=k).astype(np.float32))
    chains = [rng.integers(0, pii.BINS, (n, 18)) for n in (1, 2, 3, 4, 1, 3)]
    for chain, path in zip(chains, pii.viterbi(field, chains), strict=True):
        emit = field.emit[chain].sum(axis=1)
        best = max(
            np.ndindex(*(k,) * len(chain)),
            key=lambda p: field.first[p[0]] + sum(emit[i, x] for i, x in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:])),
        )
        assert path.tolist() == list(best)


def test_redaction_keeps_everything_else(frame):
    rows = [(1, "é write a@b.cc or 1.2.3.4"), (2, None), (3, ""), (4, "clean. Text")]
    docs = frame(rows)
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns and [got[i].text for i in (1, 2, 3, 4)] == ["é write [EMAIL] or [IP]", None, "", "clean. Text"]
    assert pii.masked("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a[IP]f"


def check_license(row, text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    every, score = set(labels), 1.0 if places else 0.0
    for notice, label in license_scan.NOTICES:  # an unbroken notice is always found
        p = notice.split()
        if any(words[i : i + len(p)] == p for i in range(len(words) - len(p) + 1)):
            every.add(label)
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    assert every <= {*row.labels.split(",")} - {""} and 0 <= row.score <= 1 and row.score >= score


@pytest.mark.parametrize("source", ["odd", "table"])
def test_licenses_against_brute_force(spark, small, frame, source):
    odd = [(1, None), (2, ""), (3, "mit"), (4, "MIT License cc by CC-BY apache license mit license"), (5, "Licensed under the very Apache License, Version 2.0"),
           (6, "cc by cc by"), (7, "cc é by"), (8, "This work is licensed under the GNU General Public License, version 3."), (9, "w " * 30_000 + "mit license")]
    texts = dict(odd) if source == "odd" else {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = (license_scan.scan(frame(odd)) if source == "odd" else QUERIES["op7_license_scan"](spark, small)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check_license(r, texts[r.doc_id])
    if source == "odd":
        assert license_scan.scan(frame([])).count() == 0 and license_scan.scan(frame([(1, "mit license")] * 2)).count() == 2
        assert {r.doc_id: r.labels for r in rows}[8] == "gpl,gpl-3.0"


def test_spans_with_a_word_more_or_less_are_merged(frame):
    notice = "redistribution and use in source and binary forms with or without modification are permitted"
    text = "x y " + notice.replace("binary", "binary code") + " z"
    row = license_scan.scan(frame([(1, text), (2, "redistribution and use in source")])).orderBy("doc_id").collect()
    assert row[0].labels == "bsd" and row[0].score == pytest.approx(10 / 12) and row[1].labels == "" and row[1].score == pytest.approx(3 / 12)
    long = [("a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3 b4 b5 b6 b7 b8 b9 c1 c2 c3 c4 c5 c6", "long")]
    text = long[0][0].replace("b3", "b3 extra")
    assert license_scan.scan(frame([(1, text)]), notices=long).first().labels == "long"


EDITED = [label for notice, label in license_scan.NOTICES if len(notice.split()) >= 14]


def test_real_notices_survive_one_edited_word(frame):
    notices = {label: notice.split() for notice, label in license_scan.NOTICES}
    rows = []
    for label in EDITED:
        w = notices[label]
        m = len(w) // 2
        rows += [(f"{label} {how}", " ".join(["x", "y", *w[:m], *new, *w[to:], "z"])) for how, new, to in (("more", ["qq"], m), ("less", [], m + 1), ("other", ["qq"], m + 1))]
    rows.append(("none", " ".join(notices["isc"][:9])))
    rows += [("short", "licensed under the apache qq license version 2 0"), ("two", "licensed under the gnu general public license version 2"), ("sa", "licensed under cc by sa 4 0")]
    names = [name for name, _ in rows]
    got = {names[r.doc_id]: r.labels.split(",") for r in license_scan.scan(frame([(i, text) for i, (_, text) in enumerate(rows)])).collect()}
    assert len(EDITED) == 5 and not [name for name in names[:15] if name.split()[0] not in got[name]]
    assert got["none"] == [""] and "gpl-3.0" not in got["two"] and "gpl-2.0" in got["two"] and "cc-by-4.0" not in got["sa"] and "cc-by-sa-4.0" in got["sa"]


def test_templates_of_any_length_and_whole_licenses(frame):
    many = [f"w{i}" for i in range(200)]
    docs = frame([(1, "x " + " ".join(many) + " y"), (2, " ".join(many[:150])), (3, " ".join(many[:90] + ["qq"] + many[91:]))])
    for phrases, notices, whole in (([(" ".join(many), "long")], [], [1]), ([], [(" ".join(many), "long")], [1, 3])):
        got = {r.doc_id: r.labels for r in license_scan.scan(docs, phrases=phrases, notices=notices).collect()}
        assert got == {i: "long" if i in whole else "" for i in (1, 2, 3)}
    parts = [
        ("mit-text", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
        ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ]
    parts += [(label, words) for words, label in license_scan.paragraphs()]
    rows = license_scan.scan(frame([(i, f"so {text} then") for i, (_, text) in enumerate(parts)])).collect()
    assert {label for label, _ in parts} >= {"apache-2.0", "gpl", "gpl-2.0", "gpl-3.0", "mpl-2.0", "mit-text", "bsd", "isc"}
    assert len(rows) == len(parts) and not [r.doc_id for r in rows if parts[r.doc_id][0] not in r.labels.split(",")]


def test_names_of_many_words_and_cues_in_signs():
    field = pii.train()
    names = ["Anna Maria Keller", "Anna Maria Luisa Keller", "Hans Karl Georg Otto Franz Weber"]
    texts = [f"so we wrote to Dr. {name} about it and then the rest of us went home" for name in names] + ["they saw (Mr. Brown) there", "word " * 50 + "[Prof. Hans Peter Meyer] " + "word " * 50]
    found = pii.Finder(field).spans(*text_bytes(pa.array(texts)))
    assert [[t[a:b] for _, a, b in s] for t, s in zip(texts, found, strict=True)] == [[n] for n in names] + [["Brown"], ["Hans Peter Meyer"]]
    docs = pii.Finder(field).spans(*text_bytes(pa.array(["so Dr. Anna Maria", "Keller came late"])))  # a chain ends with its text
    assert [len(s) for s in docs] == [1, 0]
