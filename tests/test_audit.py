"""Audit files and findings."""

import csv
import glob

import pytest

from millrace.sources import audit as A


def test_audit_files(spark, tmp_path):
    selected = spark.createDataFrame(
        [("x1", "p1", "ltr", 4, "e1", 100, 0.25, -1.5, "two\nlines"), ("x2", "p1", "fim", 4, "e1", 100, 0.0, float("-inf"), None), ("x3", "p2", "fim", 1, "e2", 7, 0.5, -0.5, "t")],
        "example_id string, pair_id string, model string, repetition int, excerpt_id string, target_start int, p_z double, log_p_z double, target_text string",
    )
    tokens = spark.createDataFrame([("x1", 0, "a", -0.5), ("x1", 1, "b\n", -0.75), ("x2", 0, "c", float("-inf"))], "example_id string, pos int, token string, logprob double")
    words = spark.createDataFrame([("x1", 0, "ab")], "example_id string, word_index int, word string")
    assert {r.example_id: r.log_p_z_delta for r in A.audit_index(selected, tokens).collect()} == {"x1": 0.25, "x2": None, "x3": None}
    A.write_audit(selected, tokens, words, str(tmp_path))
    found = [r for p in glob.glob(f"{tmp_path}/index/*.csv") for r in csv.DictReader(open(p, encoding="utf-8"))]
    assert sorted(r["example_id"] for r in found) == ["x1", "x2", "x3"]
    assert all("\n" not in r["target_text"] for r in found)
    page = "".join(open(p, encoding="utf-8").read() for p in glob.glob(f"{tmp_path}/index.md/*.txt"))
    assert page.count("## p1") == 1 and page.index("x2: fim") < page.index("x1: ltr") < page.index("## p2")
    assert "differs by +0.25" in page and "two / lines" in page


@pytest.mark.parametrize("baseline", ["p50", "none"])
def test_insights(spark, baseline):
    schema = "arm string, family string, windows long, p_z double, rouge double, geomean double, support double, nll double, extractable long"
    overall = spark.createDataFrame(
        [("l1", "ltr", 200, 0.125, 0.5, 0.1, 0.9, 2.0, 3), ("p50", "native", 200, 0.1, 0.5, 0.4, 0.8, 2.0, 2), ("p25", "native", 200, 0.1, 0.5, 0.4, 0.7, 1.0, 2), ("s50", "native", 200, 0.1, 0.5, 0.1, 0.25, 3.0, 0)],
        schema,
    )
    pairs = spark.createDataFrame([("p25", -0.5), ("s50", 0.25)], "arm string, delta double")
    got = A.insights(overall, pairs, baseline)
    assert got[1] == "- l1: mean p_z 0.125, ROUGE-L 0.5000, 3 of 200 windows extractable (150.0 per 10k)."
    assert "geometric mean: p25; by support: p50; by NLL: p25." in got[2]
    assert ("- s50: support -55.00 points against p50." in got) == (baseline == "p50")
    assert got[-1] == f"- Closest to {baseline}: s50, mean log10 +0.2500."
    assert A.insights(overall.filter("family = 'ltr'"), pairs, baseline) == got[:2]
