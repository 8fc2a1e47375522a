import math
import random
import re

import numpy as np
import pytest
from millrace.llm import licenses
from millrace.llm.license_texts import NOTICES, TEXTS


def plain_match(unit, total, df, templates, threshold):
    """Dense vectors over all words that occur, no cues and no postings."""
    vocabulary = sorted(licenses.vocabulary(templates))
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    other = sum(idf.values()) / len(idf)
    found = re.findall("[a-z0-9]+", unit.lower())
    axis = {w: i for i, w in enumerate(sorted({*vocabulary, *found}))}

    def vector(ws):
        v = np.zeros(len(axis))
        for w in ws:
            v[axis[w]] += 1
        return np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0) * np.array([idf.get(w, other) for w in axis])

    best, a = (), vector(found)
    for name in templates:
        for t in templates[name]:
            ws = re.findall("[a-z0-9]+", t.lower())
            b = vector(ws)
            cos = round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9) if found else 0
            if cos >= threshold and not (t.startswith("SPDX") and not set(ws) <= set(found)):
                best = min(best or (2, ""), (-cos, name))
    return (-best[0], best[1]) if best else None


def test_cosines_against_dense_vectors():
    rng = random.Random(11)
    vocabulary = sorted(licenses.vocabulary())
    df = {w: rng.randint(0, 900) for w in vocabulary}
    s, seen = licenses.Scanner(1000, df), 0
    for _ in range(400):
        t = rng.choice(licenses.TEMPLATES[rng.choice(sorted(licenses.TEMPLATES))])
        unit = " ".join([w for w in re.findall(r"\S+", t) if rng.random() < rng.choice([1, 0.9, 0.6])] + rng.choices([*vocabulary, "qq", "zz"], k=rng.choice([0, 2, 8])))
        got, want = s.match(licenses.words(unit)), plain_match(unit, 1000, df, licenses.TEMPLATES, licenses.THRESHOLD)
        assert (got is None) == (want is None)
        if got:
            assert abs(got[0] - want[0]) < 1e-8 and (got[1] == want[1] or plain_match(unit, 1000, df, {got[1]: licenses.TEMPLATES[got[1]]}, licenses.THRESHOLD)[0] > want[0] - 1e-8)
            seen += 1
            assert not s.cues.isdisjoint(licenses.words(unit))
    assert seen > 200


@pytest.mark.parametrize("name", sorted(NOTICES.keys() | TEXTS.keys()))
def test_each_licence_by_each_of_its_forms(name):
    s = licenses.Scanner(1000, {})
    code = "\n\nint main() { return 0; }\n" * 400
    for t in (*NOTICES.get(name, ()), f"SPDX-License-Identifier: {name}"):
        wrapped = re.sub(r"(.{50,70}) ", r"\1\n// ", t)
        assert s.scan(f"// {wrapped}\n{code}", False)[1] == name
    if name in TEXTS:
        text = f"Some Project\n\nCopyright (c) 2011, Ann Other and contributors.\n\n{TEXTS[name]}\n"
        wrapped = re.sub(r"(.{50,70}) ", r"\1\n", text)
        assert s.scan(wrapped, True)[1:] == (name, True)
        assert s.scan("".join(f" * {line}\n" for line in wrapped.split("\n")) + code, False)[1:] == (name, False)


def test_identifiers_that_no_template_has():
    s = licenses.Scanner(1000, {})
    for other in ("LPPL-1.3c", "Foo", "Apache-1.1", "GPL-1.0-only"):
        assert s.scan(f"# SPDX-License-Identifier: {other}\nx = 1\n", False) is None
    assert s.scan("# SPDX-License-Identifier: GPL-2.0-or-later\nx = 1\n", False)[1] == "GPL-2.0"
    assert s.scan("plain words\n\nand more of them", True) is None and s.scan("", True) is None and s.scan(None, False) is None


def test_inheritance_against_walks_up(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        path = "/".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))
        path = rng.choice([None, *[f"{path}/f{i}".lstrip("/")] * 20])
        license = rng.choice([None, None, None, "MIT", "ISC", "Zlib"])
        rows.append((i % 590, path, license, rng.choice([0.8, 0.9]) if license else None, bool(license) and rng.random() < 0.15))
    given = {}
    for _, path, license, score, is_file in rows:
        if is_file and path is not None:
            d = path.rpartition("/")[0]
            given[d] = min(given.get(d, (0, "~")), (-score, license))
    want = []
    for i, path, license, score, is_file in rows:
        out = (i, path, license, score, is_file, "own", 0) if license else (i, path, None, None, is_file, "none", None)
        if license is None and path is not None:
            d, steps = path.rpartition("/")[0], 0
            while True:
                if d in given:
                    out = (i, path, given[d][1], -given[d][0], is_file, "inherited", steps)
                    break
                if not d:
                    break
                d, steps = d.rpartition("/")[0], steps + 1
        want.append(out)
    scanned = spark.createDataFrame(rows, "file_id long, path string, license string, score double, is_license_file boolean")
    got = licenses.inherit(scanned).select("file_id", "path", "license", "score", "is_license_file", "origin", "distance").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_common_words_are_no_notice():
    """Long texts of the words that licences share with any text, even where the table tells no word's weight."""
    rng, s = random.Random(2), licenses.Scanner(1000, {})
    for _ in range(200):
        text = " ".join(rng.choices(["the", "of", "and", "to", "in", "is", "or", "for", "any", "a", "this", "with", "be", "by", "thing", "ring", "erth"], k=rng.randint(20, 800)))
        assert s.scan(text, True) is None
