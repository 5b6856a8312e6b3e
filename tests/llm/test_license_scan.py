import re
from functools import reduce
from re import _constants as C
from re import _parser

import pytest
from pyspark.sql import functions as F

from driftlog.llm import license_scan as L
from driftlog.llm.license_rules import rules

from .conftest import EDGES, prose

TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "SPDX-License-Identifier: GPL-3.0-or-later\nall rights  Reserved.",
    "This is free under CC BY-SA 4.0, cc-by; not ccx by",
    "GNU General Public License version 2 or later; gnu lesser general public license v2.1",
    "Permission is hereby granted, free of charge, to any person. (MIT License)",
    "ALL RIGHTS, RESERVED!! all rights reserved all rights reservedx",
    "a BSD 3-Clause license? the 3-clause BSD license",
    "Released under the Foo Bar License",
    "éall rights reserved xall rights reserved all rights reserved",
    "İ CC\x00BY — cc\nby",
]


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places, labels = [], set()
    for phrase, label in L.PHRASES:
        k = phrase.split()
        hit = [i for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
        places += hit
        labels |= {label} if hit else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places(make_docs):
    rows = [(100 + i, t) for i, t in enumerate(TEXTS)] + EDGES + [(300, prose(1, 3000) + " cc by " + "all rights reserved " * 300)]
    got = L.license_scan(make_docs(rows)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize("text,labels", [*zip(TEXTS, ["apache-2.0", "gpl-3.0-or-later,reserved", "cc-by,cc-by-sa-4.0", "gpl,gpl-2.0-or-later,lgpl-2.1", "mit", "reserved", "bsd-3-clause", "other-licence", "reserved", "cc-by"], strict=True)])
def test_labels(make_docs, text, labels):
    assert set(labels.split(",")) <= set(L.license_scan(make_docs([(1, text)])).first().labels.split(","))


def test_containment_keeps_the_longest_and_the_first_priority(make_docs):
    got = {(d.priority, d.label) for d in L.license_scan(make_docs([(1, "spdx-license-identifier: apache-2.0; gnu general public license, version 3")])).first().detections}
    assert (1, "apache-2.0") in got and (2, "gpl-3.0") in got
    assert not {x for _, x in got} & {"apache", "gpl"}


def test_rules_compile_and_name_their_keyword():
    assert len(rules()) > 200
    for r in rules():
        re.compile(r.pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        assert r.keyword == r.keyword.lower() and r.priority in (1, 2, 3)


def samples(parsed, white):
    """Texts that a parsed regex matches: each of its branches and set members in turn, the others at their first, with ``white`` for white space."""

    def of(op, av):
        if op is C.LITERAL:
            return [chr(av)]
        if op is C.IN:
            return [x for o, v in av for x in of(o, v)]
        if op is C.RANGE:
            return [chr(av[0])]
        if op is C.CATEGORY:
            return {C.CATEGORY_SPACE: [white], C.CATEGORY_WORD: ["w"]}[av]
        if op is C.BRANCH:
            return [x for part in av[1] for x in samples(part, white)]
        if op is C.SUBPATTERN:
            return samples(av[-1], white)
        if op is C.MAX_REPEAT:
            return [""] * (av[0] == 0) + [x * max(1, av[0]) for x in samples(av[2], white)]
        return {C.ASSERT_NOT: [""]}[op]

    parts = [of(op, av) for op, av in parsed]
    first = [p[0] for p in parts]
    return list(dict.fromkeys("".join([*first[:i], x, *first[i + 1 :]]) for i, p in enumerate(parts) for x in p))


def test_every_match_of_a_rule_holds_its_keyword(spark):
    rows = set()
    for r in rules():
        pattern = r.pattern.replace(r"\p{N}{2}", "[0-9]{2}").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        for white in "\n\t":
            found = [s for s in samples(_parser.parse(pattern), white) if re.search(pattern, s)]
            assert found
            rows |= {(r.keyword, s.replace("\n", "\n\t ")) for s in found if re.search(pattern, s.replace("\n", "\n\t "))} | {(r.keyword, s) for s in found}
    short = {"cc by", "cc-by", "cc_by", "ccby"}  # these rules stand under four keywords, one for each mark
    df = spark.createDataFrame(sorted(rows), "keyword string, low string")
    known = {k: (short if k in short else {k}) for k, _ in rows}
    met = reduce(lambda a, b: a | b, [F.col("keyword").isin([k for k in known if q in known[k]]) & L.holds(F.col("low"), *L.gate(q)) for q in known])
    assert {k for k, _ in rows} == {r.keyword for r in rules()}
    assert df.where(~met).collect() == []


def test_names_broken_by_white_space(make_docs):
    texts = {
        "GNU Lesser General\nPublic License v2.1": "lgpl-2.1",
        "Permission is hereby\n * granted": "",
        "Permission is hereby\ngranted, free of charge": "mit",
        "Permission  to  use, copy, modify, and distribute this software": "isc",
        "All Rights\tReserved": "reserved",
        "Creative Commons Zero": "cc0-1.0",
        "Creative\r\nCommons Zero": "cc0-1.0",
        "Creative\nCommons Attribution 4.0": "cc-by-4.0",
        "under CC\nBY-SA 4.0": "cc-by-sa-4.0",
        "Common\nDevelopment and Distribution License 1.1": "cddl-1.1",
        "dedicated to the public\ndomain": "pd",
    }
    got = L.license_scan(make_docs(list(enumerate(texts)))).collect()
    named = {r.doc_id: {d.label for d in r.detections} for r in got}
    assert {t: want in named[i] if want else not named[i] for i, (t, want) in enumerate(texts.items())} == dict.fromkeys(texts, True)


def test_no_python_in_the_plan(make_docs):
    plan = L.license_scan(make_docs(EDGES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert L.license_scan(make_docs([])).count() == 0
