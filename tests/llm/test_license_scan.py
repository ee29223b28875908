import re
import textwrap
import time
from collections import Counter

from churnforge.llm.license_scan import TEMPLATES, LicenceScanner, bigrams, scan_licences
from churnforge.llm.queries import q_op8


def brute(text):
    """Every unit against every template, without size bounds or shortcuts."""
    units = {(0, len(text)): text}
    at = 0
    for line in text.split("\n"):
        if "\n" in text:
            units[at, at + len(line)] = line
        place = at
        for p in re.split(r"(?<=[.!?;])\s+", line):
            place = text.index(p, place)
            units[place, place + len(p)] = p
        at += len(line) + 1
    out = []
    for span, unit in units.items():
        a, best = Counter(bigrams(unit)), None
        for name in sorted(TEMPLATES):
            for t in TEMPLATES[name]:
                b = Counter(bigrams(t))
                if a and (v := 2 * (a & b).total() / (a.total() + b.total())) >= 0.8 and (best is None or v > best[1]):
                    best = name, v
        if best:
            out.append((*span, *best))
    return sorted(out)


MIT = TEMPLATES["MIT"][2]
CASES = ["", "\n", "word", "Released under the MIT License.", "released UNDER the mit-license",
         "Some text here. Released under the MIT License. More text follows here.",
         "first line\nAll rights reserved.\nlast line", "reserved all rights",
         MIT, MIT.replace(", ", ",\n"), "x " + MIT.replace("copies", "clones"), MIT * 2, "prose\n" + MIT + "\nprose",
         "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", "the of and " * 20_000]


def test_equals_brute_force(docs_of):
    scanner = LicenceScanner(TEMPLATES, 0.8)
    for t in CASES:
        assert scanner.scan(t) == brute(t), t[:60]
    rows = list(enumerate(CASES)) + [(None, None), (3, CASES[3])]
    out = scan_licences(docs_of(rows)).collect()
    assert [(r["doc_id"], [tuple(m) for m in r["matches"]]) for r in out] == [(d, brute(t or "")) for d, t in rows]
    assert scan_licences(docs_of([])).count() == 0


def test_finds_the_planted_lines(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r["doc_id"]: r["licences"].split(",") for r in q_op8(spark, sf).collect()}
    planted = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
               "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "all-rights-reserved",
               "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for d, t in texts.items():
        for line, name in planted.items():
            assert (line in t) == (name in out[d]), (d, name)


def brute_windows(text, name, template):
    """Highest coefficient of any word window with a template."""
    grams, b, best = bigrams(text), Counter(bigrams(template)), 0
    for i in range(len(grams)):
        a = Counter()
        for j in range(i, min(len(grams), i + 2 * b.total())):
            a[grams[j]] += 1
            best = max(best, 2 * (a & b).total() / (a.total() + b.total()))
    return best


PROSE = "The survey of the valley was begun in the spring and carried on by two parties until the rain came. " * 40


def test_a_wrapped_notice_inside_a_long_document(docs_of, spark, tmp_path):
    for name, notice in (("MIT", MIT), ("Apache-2.0", TEMPLATES["Apache-2.0"][1]), ("BSD-2-Clause", TEMPLATES["BSD-2-Clause"][0])):
        wrapped = textwrap.fill(notice, 80)
        for given in (wrapped, "".join(f"# {line}\n" for line in wrapped.split("\n")), wrapped.replace("copies", "clones")):
            text = textwrap.fill(PROSE, 80) + "\n\n" + given + "\n\n" + textwrap.fill(PROSE, 80)
            hits = [m for m in LicenceScanner(TEMPLATES, 0.8).scan(text) if m[2] == name and "\n" in text[m[0]:m[1]]]
            assert len(hits) == 1, name
            place = text.index(given)
            assert place <= hits[0][0] < hits[0][1] <= place + len(given)
            assert hits[0][3] == brute_windows(text, name, notice)
    path = str(tmp_path / "documents.parquet")
    docs_of([(1, PROSE + "\n" + textwrap.fill(MIT, 80) + "\n" + PROSE), (2, PROSE + MIT + " " + PROSE), (3, PROSE)]).write.parquet(path)
    out = {r["doc_id"]: r["licences"] for r in q_op8(spark, str(tmp_path)).collect()}
    assert out == {1: "MIT", 2: "MIT", 3: ""}


def test_windows_by_place_and_letters_that_grow():
    wrapped = textwrap.fill(MIT, 80)
    text = "İİ\n" + wrapped + "\n" + wrapped.replace("copies", "clones") + "\n" + PROSE
    hits = LicenceScanner(TEMPLATES, 0.8).scan(text)
    assert [m[2] for m in hits] == ["MIT", "MIT"] and hits[0][3] == 1 > hits[1][3]
    assert text[hits[0][0]:].startswith("Permission") and text[:hits[0][1]].endswith("Software")
    assert len(LicenceScanner(TEMPLATES, 0.8, inline=True).scan(MIT * 2)) == 2


def test_whole_licence_texts_are_found():
    """As files of their own with a title and a copyright line, and inside a longer document."""
    scanner = LicenceScanner(TEMPLATES, 0.8)
    disclaimer = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
                  "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
                  "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
                  "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
    given = [("MIT", MIT + "\n\n" + disclaimer)]
    given += [(name, max(TEMPLATES[name], key=len)) for name in (
        "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0",
        "CC0-1.0", "CC-BY-SA-4.0", "Unlicense")]
    for name, text in given:
        own = "License\n\nCopyright (c) 2015 Some One\n\n" + textwrap.fill(text, 72)
        assert (0, len(own), name) in [m[:3] for m in scanner.scan(own)], name
        hits = [m for m in scanner.scan(textwrap.fill(PROSE, 72) + "\n" + own + "\n" + PROSE * 3) if m[1] - m[0] > 0.9 * len(text)]
        assert [m[2] for m in hits] == [name] and hits[0][3] > 0.95, name


def test_many_notices_in_one_document():
    """Windows are compared with those around them only."""
    notice = "Permission is hereby granted to anyone who asks in writing, free of charge and without any other condition."
    scanner = LicenceScanner({"own": [notice]}, 0.8)
    started = time.time()
    text = "\n".join(f"Entry {i} of the list.\n" + textwrap.fill(notice, 40) for i in range(4000))
    assert len(scanner.scan(text)) == 4000
    assert time.time() - started < 30
