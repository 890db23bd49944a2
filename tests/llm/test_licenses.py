import re

import pytest
from gleaner.llm import licenses
from pyspark.sql import functions as F

from .util import docs

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0."""


def plain(text):
    known = {s: name for name, all_ in licenses.SENTENCES.items() for s in all_}
    ids = []
    norm = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    for part in re.split(licenses.SENTENCE_END, text or ""):
        if norm(part) in known:
            ids.append(known[norm(part)])
        else:
            ids += [known.get(norm(y)) for y in part.split("\n") if norm(y)]
    line = [x for k, x in enumerate(ids) if x or not k or ids[k - 1]]
    out, at = [], 0
    while at < len(line):
        for name, status, rule in licenses.RULES:
            k, matched = at, 0
            for n, want in enumerate(rule):
                if n and k < len(line) and line[k] is None:
                    k += 1
                if k >= len(line) or line[k] != want:
                    break
                k, matched = k + 1, matched + 1
            if matched == len(rule):
                out.append((name, status, len(rule)))
                at = k
                break
        else:
            at += 1
    return out


CASES = [
    "Some prose.\nReleased under the MIT License.\nMore.",
    "Licensed under CC BY-NC 4.0.\nAll rights reserved.",
    "LICENSED  under the\tApache License, Version 2.0. And then.",
    "The license of this is unknown. All rights are reserved to nobody.",
    "mit license! mit license? x. mit license",
    "This program is free software: you can redistribute it.",
    ". ".join(s[0] for k, s in licenses.SENTENCES.items() if k.startswith("mit.")),
    ". ".join(licenses.SENTENCES[k][0] for k in ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")) + ".",
    licenses.SENTENCES["mit.grant"][0] + ".\nunknown words here.\nmore unknown.\n" + licenses.SENTENCES["mit.notice"][0],
    licenses.SENTENCES["mit.notice"][0] + ". " + licenses.SENTENCES["mit.grant"][0],
    "", "   ", "word " * 200_000 + "\nAll rights reserved.", None,
]


def test_matches_brute_force(spark):
    rows = list(enumerate(CASES)) + [(0, CASES[0]), (None, CASES[1])]
    table = docs(spark, rows).withColumns({"license": F.lit("x"), "Status": F.lit("y"), "rule": F.lit(1), "col": F.lit(2)})
    got = licenses.scan(table)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "rule", "col", "license_no", "license", "status", "sentences"]
    want = sorted(((i, k, *r) for i, x in rows for k, r in enumerate(plain(x))), key=repr)
    assert sorted(((r.doc_id, r.license_no, r.license, r.status, r.sentences) for r in got.collect()), key=repr) == want
    assert len(want) >= 14


def test_empty_table(spark):
    assert licenses.scan(docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", list(licenses.SENTENCES))
def test_each_sentence_is_normal_has_a_cue_and_a_rule(name):
    for s in licenses.SENTENCES[name]:
        assert s == re.sub("[^a-z0-9]+", " ", s.lower()).strip()
        assert re.search(licenses.CUE_PATTERN, s)


def test_a_notice_in_its_own_layout(spark):
    wrapped = "def f():\n    pass\n\n" + APACHE.replace("except in", "except\n   in") + "\n\nmore text here"
    got = licenses.scan(docs(spark, [(1, wrapped)])).collect()
    assert [(r.license, r.status, r.sentences) for r in got] == [("Apache-2.0", "notice", 2)]


MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
APACHE_HEADER = """Copyright 2020 A. Author

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_published_headers(spark, mark):
    commented = lambda x: "\n".join((mark + y).rstrip(" ") for y in x.split("\n"))
    rows = [(1, commented(MPL)), (2, commented(APACHE_HEADER)), (3, commented(APACHE_HEADER.replace("http:", "https:"))), (4, commented(MPL.replace("v. 2.0", "v. 1.1")))]
    got = sorted((r.doc_id, r.license, r.status, r.sentences) for r in licenses.scan(docs(spark, rows)).collect())
    assert got == [(1, "MPL-2.0", "notice", 1), (2, "Apache-2.0", "notice", 3), (3, "Apache-2.0", "notice", 3)]


TEXTS = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def test_published_texts_are_recognised_as_texts(spark):
    import os

    top = "/usr/share/common-licenses"
    names = [n for n in TEXTS if os.path.exists(f"{top}/{n}")]
    rows = [(k, open(f"{top}/{n}", encoding="utf-8", errors="replace").read()) for k, n in enumerate(names)]
    got = licenses.scan(docs(spark, rows)).filter("license_no = 0").collect()
    assert {names[r.doc_id]: (r.license, r.status) for r in got} == {n: (TEXTS[n], "text") for n in names}


def test_each_rule_holds_a_cue():
    import re

    for _, _, ids in licenses.RULES:
        assert any(re.search(licenses.CUE_PATTERN, x) for name in ids for x in licenses.SENTENCES[name])


@pytest.mark.parametrize(
    "text, found",
    [
        ("Released under the terms of the GNU GPL v3.", ["GPL-3.0"]),
        ("This project is licensed under the MIT License.", ["MIT"]),
        ('Licensed under the MIT license (the "License").', ["MIT"]),
        ("The software is distributed under the terms and conditions of the Apache License, Version 2.0. More follows.", ["Apache-2.0"]),
        ("Some words.\nIt is available under CC BY-SA 4.0\nAnd more words", ["CC-BY-SA-4.0"]),
        ("It is available under the counter.", []),
        ("We are licensed under the MIT License of another kind.", []),
        ("Prices are released under the MIT rule.", []),
    ],
)
def test_names_however_they_are_put(spark, text, found):
    rows = licenses.scan(docs(spark, [(1, text)])).orderBy("license_no").collect()
    assert [(r.license, r.status) for r in rows] == [(x, "name") for x in found]
