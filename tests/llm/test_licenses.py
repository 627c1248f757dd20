import textwrap

import pytest

from quillon.llm import licenses

SCANNER = licenses.Scanner()


def confirmed(text):
    return sorted(r[2] for r in SCANNER.scan(text) if r[-1])


@pytest.mark.parametrize("name", licenses.TEMPLATES)
@pytest.mark.parametrize("width", [30, 50, 72, 10_000])
def test_wrapped_text_is_confirmed_whole(name, width):
    body = "\n".join("# " + x for x in textwrap.wrap(licenses.TEMPLATES[name], width, break_long_words=False))
    text = f"Some words before.\n\n{body}\n\nOther words after it, and the end."
    rows = [r for r in SCANNER.scan(text) if r[-1]]
    assert [(r[2], r[5], r[1]) for r in rows] == [(name, 0, body)]


def test_notice_within_a_long_line():
    line = "once upon a time there was a small house by the river " * 20
    assert confirmed(f"{line} Released under the MIT License. {line}") == ["MIT"]


def test_hints_without_wording_stay_unconfirmed():
    rows = SCANNER.scan("My licence was lost on the way.\n\n\n\nReleased under the MIT License.")
    assert [(r[0], r[-1]) for r in rows] == [(0, False), (4, True)]


def test_all_notices_of_neighbouring_lines():
    assert confirmed("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.") == ["Apache-2.0", "MIT", "MIT"]
    assert confirmed("Released under the MIT License. Or: licensed under CC BY-NC 4.0. All rights reserved.") == ["CC-BY-NC-4.0-short", "MIT", "reserved"]


@pytest.mark.parametrize("text,want", [
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 4.", []),
    ("This library is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
    ("This library is licensed under the GNU Lesser General Public License, version 2.", []),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", ["CC-BY-3.0"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
    ("This work is licensed under a Creative Commons Attribution 2.0 Generic License.", []),
    ("This work is not licensed under the GNU General Public License, version 3.", []),
    ("This code was never released under the MIT License.", []),
    ("I did not. Released under the MIT License.", ["MIT"]),
    ("SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only-spdx"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later-spdx"]),
])
def test_telling_words_decide(text, want):
    assert confirmed(text) == want


@pytest.mark.parametrize("words", [10, 100, 1000])
def test_a_notice_counts_in_lines_of_any_length(words):
    around = " ".join(f"w{i}" for i in range(words // 2))
    assert confirmed(f"{around} Released under the MIT License. {around}") == ["MIT"]
    assert confirmed(f"{around}\n{licenses.TEMPLATES['GPL-2.0-header']}\n{around}") == ["GPL-2.0-header"]


def test_numbered_clauses_and_a_changed_clause():
    text = licenses.TEMPLATES["BSD-3-Clause"]
    numbered = text.replace("Redistributions of", "\n1. Redistributions of").replace("Redistributions in", "\n2. Redistributions in").replace("Neither", "\n3. Neither")
    assert confirmed(numbered) == ["BSD-3-Clause"]
    assert confirmed(licenses.TEMPLATES["BSD-2-Clause"]) == ["BSD-2-Clause"]


def test_of_overlapping_stretches_the_one_whose_template_saves_most_stays():
    scanner = licenses.Scanner({"many": "a licence we go on to it as at an end", "long": "an end notwithstanding immeasurable circumnavigational responsibilities"})
    text = "a licence we go on to it as at an end notwithstanding immeasurable circumnavigational responsibilities"
    assert [r[2] for r in scanner.scan(text)] == ["long"]


def test_a_notice_among_few_words_is_confirmed():
    for n in range(12):
        assert confirmed(" ".join(["rights"] * n + ["All rights reserved."] + ["reserved"] * n)) == ["reserved"]


def test_rows_of_odd_documents(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Released under the MIT License.", "x"), (3, "Released under the MIT License.", "x"), (None, "w " * 200_000 + "All rights reserved.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = licenses.scan_licenses(docs)
    assert sorted(map(repr, ((r.id, r.license, r.confirmed, r.line) for r in got.collect()))) == sorted(map(repr, [(3, "MIT", True, 0), (3, "MIT", True, 0), (None, "reserved", True, 0)]))
    assert got.columns == ["id", "line", "block", "license", "saved", "n_words", "n_missing", "n_inserted", "confirmed"]
