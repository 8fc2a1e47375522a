"""Order of lines over files of unlike size and over splits, against a plain reader."""

import json
import random

import pytest

from millrace.sources import lines, scans


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files whose sizes don't follow their names, with blank and broken lines, and lines that are no objects."""
    rng, path = random.Random(2), tmp_path_factory.mktemp("lines")
    for name, n in (("a", 700), ("b", 3), ("c", 2500), ("d", 0), ("e", 90)):
        out = []
        for i in range(n):
            row = json.dumps({"key": rng.choice([f"k{rng.randrange(40)}", None]), "n": len(out), "pad": "x" * rng.randrange(60), "file": name, "who": f"{name}{i}"})
            out.append(rng.choice([row] * 9 + ["", "  ", row[:-3], "[1]", "7"]))
        (path / f"{name}.jsonl").write_text("\n".join(out) + ("\n" if name != "c" else ""))
    return path


def plain(folder):
    return [x for f in sorted(folder.glob("*.jsonl")) for x in f.read_text().splitlines()]


def parsed(line):
    try:
        row = json.loads(line)
    except ValueError:
        return None
    return row if isinstance(row, dict) else None


@pytest.fixture(params=["128m", "7k"])
def splits(spark, request):
    keys = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_numbers_are_those_of_a_plain_reader(spark, folder, splits):
    got = lines.numbered(lines.text_lines(spark, str(folder)))
    assert [r.line for r in got.orderBy("number").collect()] == plain(folder)
    assert sorted(r.number for r in got.collect()) == list(range(len(plain(folder))))


@pytest.mark.parametrize("most", [None, 0, 5, 702, 1500, 10**6])
def test_documents_within_a_budget(spark, folder, splits, most):
    got = lines.documents(spark, str(folder), "who string, n int", most)
    want = [(i, r["who"], r["n"]) for i, r in enumerate(map(parsed, plain(folder)[:most])) if r is not None]
    assert sorted((r.number, r.who, r.n) for r in got.collect()) == want


def test_first_and_last_of_a_key(spark, folder, splits):
    first, last = {}, {}
    for row in filter(None, map(parsed, plain(folder))):
        first.setdefault(row["key"], row["who"])
        last[row["key"]] = row["who"]
    rows = lines.placed(spark.read.schema("key string, who string, file string").json(str(folder))).filter("file is not null")
    assert {r.key: r.who for r in lines.last_of_key(rows, ["key"]).collect()} == last
    assert {r.key: r.who for r in lines.first_of_key(rows, ["key"]).collect()} == first


def test_window_rows_and_members_over_folders(spark, tmp_path):
    for name, x in (("a", 1), ("b", 2), ("c", 3)):  # the largest file comes first in Spark's order
        pad = [json.dumps({"id": f"{name}{i}", "p": 0.0, "pad": "y" * 50}) for i in range({"a": 500, "b": 90, "c": 1}[name])]
        (tmp_path / f"{name}.jsonl").write_text("\n".join([*pad, json.dumps({"id": "x", "p": float(x)})]))
    rows = scans.window_rows(spark, str(tmp_path), {"id": "string"}, ["p"])
    assert {r.id: r.p for r in rows.collect()}["x"] == 3.0
    members = tmp_path / "members"
    members.mkdir()
    for name, x, n in (("a", 1, 300), ("b", 2, 1)):
        other = [json.dumps({"excerpt_id": f"{name}{i}", "bucket_base_index": i}) for i in range(n)]
        (members / f"{name}.jsonl").write_text("\n".join([json.dumps({"excerpt_id": "x", "bucket_base_index": x}), *other]))
    got = {r.base_excerpt_id: r for r in scans.bucket_members(spark, str(members), 8).collect()}
    assert got["x"].bucket_base_index == 1 and got["x"].replica_count == 8 and len(got) == 302
