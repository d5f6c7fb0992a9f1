import re

import pytest

from tidemark.llm import licenses

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(text):
    low = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [
        (k, label) for phrase, label in BASE.items() for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    starts = [k for k, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


TEXTS = [
    None, "", "...", "CC BY", "cc-by/cc by cc  by", "xcc by", "cc byé", "All rights\nreserved. ALL RIGHTS RESERVED",
    "the GNU General Public License, version 3. cc by-nc 4.0 " * 3, "general public license" * 2, "all all rights reserved",
    "The MIT License\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", "cc by " * 5000,
]


def test_base_places_against_brute_force(texts_frame):
    rows = licenses.scan_licenses(texts_frame(TEXTS)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows] == [brute(t) for t in TEXTS]
    for row in rows:
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1


def test_base_places_on_documents(small):
    docs = small("documents")
    want = {row.doc_id: brute(row.text) for row in docs.collect()}
    for r in licenses.scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]


@pytest.mark.parametrize(
    ("expression", "order"),
    [
        ("MIT", ["MIT"]),
        ("MIT or Apache-2.0 and ISC", ["MIT", "Apache-2.0", "ISC", "and", "or"]),
        ("(MIT OR Apache-2.0) AND ISC", ["MIT", "Apache-2.0", "or", "ISC", "and"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT */", ["GPL-2.0-only", "Classpath-exception-2.0", "with", "MIT", "or"]),
        ("MIT and see the file", ["MIT"]), ("MIT or later", ["MIT"]), ("mit and (isc or bsd)", ["mit", "isc", "bsd", "or", "and"]),
        ("GPL-2.0 WITH (A OR B)", None), ("MIT AND unheard", ["MIT", "unheard", "and"]),
        ("(MIT", None), ("MIT)", None), ("OR MIT", None), ("MIT AND", None), ("", None), ("()", None),
    ],
)
def test_shunting_yard(expression, order):
    assert licenses.postfix(expression) == order


def test_evaluation_takes_the_stricter_or_the_freer_side():
    assert licenses.evaluate("MIT OR GPL-3.0-or-later") == ({"mit", "gpl"}, licenses.LIMITS["mit"])
    assert licenses.evaluate("MIT AND GPL-3.0-or-later") == ({"mit", "gpl"}, licenses.LIMITS["gpl"])
    labels, limit = licenses.evaluate("MIT AND (GPL-2.0-only WITH Classpath-exception-2.0)")
    assert labels == {"mit", "gpl"} and limit < licenses.LIMITS["gpl"]
    assert licenses.scan("SPDX-License-Identifier: MIT AND (", licenses.automaton())[5] == "unparsed"


def test_both_spellings_of_the_tag():
    machine = licenses.automaton()
    for spelling in ("License", "Licence"):
        assert licenses.scan(f"see SPDX-{spelling}-Identifier: MIT\nmore", machine)[5] == "mit"
    assert licenses.scan("SPDX-License-Identifier: GPL-2.0 WITH (A OR B)", machine)[5] == "unparsed"
    assert licenses.scan("SPDX-License-Identifier: MIT and see the file", machine)[5] == "mit"
