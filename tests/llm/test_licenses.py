"""License scans against loops over words, and the rules on known notices."""

import random
import re

from runledger.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    words = WORD.findall(licenses.lower(text or ""))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), sorted({n for _, n in places}))


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, label string")
    return licenses.scan(docs).collect()


def test_base_places(spark):
    rng = random.Random(3)
    parts = ["MIT", "License", "mit", "license", "apache", "general", "public", "é", "x", "permit", "licenses", "中"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice([" ", "-", "\n", ", ", ""]) for _ in range(rng.randint(0, 40))))
            for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "MIT License"), (1002, "mit license"), (1002, "mit license"),
             (1003, "general  public. LICENSE " * 5000)]
    found = run(spark, rows)
    key = lambda r: (str(r[0]), str(r[1:]))
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found], key=key) == sorted(
        [(d, *brute(t)) for d, t in rows], key=key)
    assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 for r in found)


def test_rules():
    assert len(licenses.rules()) > 200
    for text, label in [
            ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("Licensed under the Apache License, Version 2.0.", "apache"),
            ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("released under the terms of the BSD 3-clause license", "bsd"),
            ("see https://www.mozilla.org/MPL/2.0/", "mpl"), ("the GNU Lesser General Public License, version 2.1", "lgpl"),
            ("GNU Affero General Public Licence v3", "agpl"), ("Eclipse Public License 2.0", "epl"), ("CC0 1.0 Universal", "cc0")]:
        assert {d[2] for d in licenses.detect(licenses.lower(text), licenses.rules())} == {label}, text


def test_contained_detections_give_way():
    rules = [("a", re.compile("aaa b"), "long", 5, 0.5), ("b", re.compile("b"), "short", 5, 0.5),
             ("c", re.compile("b c"), "crossing", 1, 0.5), ("a", re.compile("aaa b"), "weak", 1, 0.5)]
    assert [d[2] for d in licenses.detect("aaa b c", rules)] == ["long", "crossing"]


def test_plain_text_has_no_labels(spark):
    assert [r.labels for r in run(spark, [(1, "permit the emission of licensed taxis under the bridge")])] == [[]]
    assert run(spark, []) == []


def test_suppression_against_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60)))
        rules = sorted([("", re.compile("".join(rng.choice(["a", "b", "a+", "b{1,3}", "[ab]*", " "]) for _ in range(rng.randint(1, 4)))),
                         f"l{i}", rng.choice([1, 1, 2, 3]), 0.5) for i in range(5)], key=lambda r: -r[3])
        hits = sorted((-p, m.start() - m.end(), m.start(), m.end(), label, w)
                      for _, e, label, p, w in rules for m in e.finditer(text))
        kept = []
        for _, _, start, end, label, weight in hits:
            if not any(a <= start and end <= b for a, b, _, _ in kept):
                kept.append((start, end, label, weight))
        assert licenses.detect(text, rules) == sorted(kept)


def test_a_text_full_of_notices():
    text = "licensed under the mit license, see mit license. " * 20_000
    assert {d[2] for d in licenses.detect(text, licenses.rules())} == {"mit"}


NAMES = [
    ("agpl", "GNU Affero General Public License"), ("lgpl", "GNU Lesser General Public License"), ("gpl", "GNU General Public License"),
    ("gfdl", "GNU Free Documentation License"), ("mit", "MIT License"), ("apache", "Apache Software License"), ("bsd", "BSD 3-Clause License"),
    ("mpl", "Mozilla Public License"), ("epl", "Eclipse Public License"), ("edl", "Eclipse Distribution License"),
    ("cddl", "Common Development and Distribution License"), ("cpl", "Common Public License"),
    ("cpal", "Common Public Attribution License"), ("cc0", "CC0 1.0 Universal"), ("cc-by-nc-nd", "CC BY-NC-ND 4.0"),
    ("cc-by-nc-sa", "CC BY-NC-SA 4.0"), ("cc-by-nc", "CC BY-NC 4.0"), ("cc-by-nd", "CC BY-ND 4.0"), ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by", "CC BY 4.0"), ("creative-commons", "Creative Commons Attribution Share Alike International License"),
    ("isc", "ISC License"), ("zlib", "zlib License"), ("unlicense", "The Unlicense"),
    ("wtfpl", "Do What The Fox You Want To Public License"), ("artistic", "Perl Artistic License"), ("boost", "Boost Software License"),
    ("postgresql", "PostgreSQL License"), ("python", "Python Software Foundation License"), ("php", "PHP License"),
    ("ruby", "Ruby License"), ("openssl", "OpenSSL License"), ("ssleay", "Original SSLeay License"), ("ofl", "SIL Open Font License"),
    ("ms-pl", "Microsoft Public License"), ("ms-rl", "Microsoft Reciprocal License"), ("eupl", "European Union Public Licence"),
    ("osl", "Open Software License"), ("afl", "Academic Free License"), ("ncsa", "NCSA Open Source License"), ("qpl", "Q Public License"),
    ("sleepycat", "Sleepycat License"), ("vim", "Vim License"), ("x11", "X11 License"), ("w3c", "W3C Software Notice and License"),
    ("odbl", "Open Data Commons Open Database License"), ("odc-by", "Open Data Commons Attribution License"),
    ("pddl", "Public Domain Dedication and License"), ("beerware", "Beerware License"), ("json", "JSON License"),
    ("upl", "Universal Permissive License"), ("mulan", "Mulan Permissive Software License"), ("cecill", "CeCILL Free Software License"),
    ("ecl", "Educational Community License"), ("sspl", "Server Side Public License"), ("busl", "Business Source License"),
    ("elastic", "Elastic License"), ("openrail", "BigScience OpenRAIL-M License")]


def test_names_wrapped_between_any_two_words():
    ordered = licenses.rules()
    assert {label for label, _ in NAMES} == {row[0] for row in licenses.LICENSES}
    for label, name in [*NAMES, ("odbl", "Open Data Commons Database License")]:
        words = f"Licensed under the {name}".lower().split()
        plain = [(d[2], d[3]) for d in licenses.detect(" ".join(words), ordered)]
        assert (label, 0.95) in plain, name
        for gap in ("\n", "  ", "\n    ", "\t", "\u00a0"):
            texts = [gap.join(words), *(" ".join(words[:i]) + gap + " ".join(words[i:]) for i in range(1, len(words)))]
            for text in texts:
                assert [(d[2], d[3]) for d in licenses.detect(text, ordered)] == plain, repr(text)


def test_wrapped_names_reach_the_scan(spark):
    found = run(spark, [(1, "Licensed under the SIL Open\nFont License."), (2, "licensed under the GNU General\n  Public License")])
    assert {r.doc_id: r.labels for r in found} == {1: ["ofl"], 2: ["gpl"]}
    assert {r.doc_id: round(r.score, 6) for r in found} == {1: 0.95, 2: 0.98}


def labels(text):
    return sorted({d[2] for d in licenses.detect(licenses.lower(text), licenses.rules())})


def test_identifier_expressions():
    for text, expected in [
            ("SPDX-License-Identifier: (MIT AND GPL-2.0-only)", ["gpl", "mit"]), ("MIT OR Apache-2.0", ["apache", "mit"]),
            ("// SPDX-License-Identifier: (Apache-2.0 OR (MIT AND BSD-3-Clause))", ["apache", "bsd", "mit"]),
            ("/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */", ["gpl"]),
            ("# SPDX-License-Identifier: ISC.\nMIT is a school", ["isc"]), ("SPDX-License-Identifier: LicenseRef-own OR MIT", ["mit"]),
            ("SPDX-License-Identifier: ", []), ("SPDX-License-Identifier: ((", []), ("spdx-license-identifier: mit and", ["mit"]),
            ("MIT OR Unlicense", ["mit", "unlicense"]), ("vim or json, ruby and python", [])]:
        assert labels(text) == expected, text


def test_short_forms_and_wrapped_names():
    for text, expected in [
            ("Apache-2.0", ["apache"]), ("GPLv3", ["gpl"]), ("GPL v2 or later", ["gpl"]), ("BSD 3-Clause", ["bsd"]), ("MIT-licensed", ["mit"]),
            ("GNU Lesser\n# General Public License", ["lgpl"]), (" * GNU Lesser\n * General\n * Public License", ["lgpl"]),
            ("Mozilla Public\n            License", ["mpl"]), ("Mozilla Public" + " " * 5000 + "License", ["mpl"]),
            ("Creative Commons" + " Attribution" * 40 + " License", ["creative-commons"]),
            ("the python license plate", []), ("a Boost licence\nnumber", []), ("the Python License", ["python"])]:
        assert labels(text) == expected, text


def test_sentences_of_the_licences():
    """Every sentence is found by its own label, wrapped behind comment marks and with other punctuation too."""
    ordered = licenses.rules()
    index = licenses.keyword_index(ordered)
    assert len(licenses.SHORT_FORMS) + len(licenses.BODIES) >= 200
    for label, keyword, words in licenses.BODIES:
        assert keyword in words.split(), words
        parts = words.split()
        for text in (words, "\n# ".join(parts), ", \"".join(parts), "// " + " ".join(parts[:5]) + "\n//   " + " ".join(parts[5:])):
            assert label in {d[2] for d in licenses.detect(text, ordered, index)}, text
        assert not {d[2] for d in licenses.detect(" ".join(parts[::-1]), ordered, index) if d[3] == licenses.BODY[1]}


def test_keywords_gate_nothing_that_would_match():
    """Every rule's own expression is tried wherever it would match."""
    ordered = licenses.rules()
    texts = [w for _, _, w in licenses.BODIES] + [f"licensed under the {n.lower()} 2.0" for _, n in NAMES] + [
        "gnu gpl v3, lgpl-2.1+, agplv3; mit/x11, apache v2 and cc-by-sa 4.0", "mit or apache-2.0", "python-2.0, psf-2.0, 0bsd, cc0-1.0"]
    for text in texts:
        every = [("", *r[1:]) for r in ordered]
        assert licenses.detect(text, ordered) == licenses.detect(text, every), text
