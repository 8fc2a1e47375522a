"""Licence scans: sparse TF-IDF cosine to templates, and inheritance along directories.

Every text is cut into units: sentences, lines, paragraphs, the comment it begins with, and the whole text of a licence file. A
unit's vector holds (1 + ln tf) * idf of its words; idf = ln((1 + N) / (1 + df)) + 1 counts documents over the whole
table for the words of the templates, and any other word weighs as much as their mean. A unit whose cosine
to a template reaches THRESHOLD is a notice (one that names a licence by its SPDX identifier must hold all of
it, or another's line would do); a file's own licence is its best notice.

Only units that hold a cue are compared: for each template, the cues are its heaviest words up to the
point where a unit without any of them can't reach the threshold any more, so none is lost.

A file is a licence file by its name (LICENSE, COPYING, NOTICE and the like), or if its notices hold at
least half of its words. A file without a notice takes the licence of the nearest directory above it that
has a licence file: its directory's ancestors, once for each distinct directory, are joined to the
directories of licence files by path, and files to their directories. Both joins spread the rows of a
directory that is above or around very many.

Defined results: null and empty texts have no notice but inherit; a null path has no directory and
inherits nothing; of several notices, or licence files in a directory, the largest cosine (to 9 digits)
wins, then the licence that sorts first; repeated rows are judged each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize, spread_join, table
from .license_texts import NOTICES, TEXTS

THRESHOLD = 0.7
WORD = re.compile(r"[a-z0-9]+")
#: Lines of comment, and empty ones, that a file begins with.
HEADER = re.compile(r"(?:[ \t]*(?:#|//|/?\*|;|%|--)[^\n]*(?:\n|\Z)|[ \t]*\n)+")
LICENSE_NAME = re.compile(r"(^|/)(un)?(licen[cs]e|copying|notice|copyright)([.-][^/]*)?$", re.I)

#: What marks the line that names a licence by its identifier; such a line must hold every word of its template.
SPDX = "SPDX-License-Identifier:"


def _templates() -> dict[str, tuple[str, ...]]:
    """Of each licence: its notices, its whole text, the first paragraph if no other licence begins so, and the line that names it."""
    first = {name: text.partition("\n\n")[0] for name, text in TEXTS.items()}
    out = {}
    for name in sorted(NOTICES.keys() | TEXTS.keys()):
        own = [t[name] for t in (TEXTS, first) if name in t and list(t.values()).count(t[name]) == 1]
        out[name] = tuple(dict.fromkeys([*NOTICES.get(name, ()), *own, f"{SPDX} {name}"]))
    return out


TEMPLATES = _templates()


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def vocabulary(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> set[str]:
    return {w for texts in templates.values() for t in texts for w in words(t)}


class Scanner:
    """Templates' vectors under the corpus's weights."""

    def __init__(self, total: int, df: dict[str, int], templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in sorted(vocabulary(templates))}
        self.other = sum(self.idf.values()) / len(self.idf)
        self.names, self.needs, self.cues = [], [], set()
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for name in sorted(templates):
            for t in templates[name]:
                v = {w: (1 + math.log(n)) * self.idf[w] for w, n in Counter(words(t)).items()}
                norm = math.sqrt(sum(x * x for x in v.values()))
                for w, x in v.items():
                    self.postings.setdefault(w, []).append((len(self.names), x / norm))
                self.names.append(name)
                self.needs.append(frozenset(v) if t.startswith(SPDX) else frozenset())
                left = norm * norm
                for w in sorted(v, key=lambda w: (-v[w], w)):
                    if left < (threshold * norm) ** 2:
                        break
                    self.cues.add(w)
                    left -= v[w] ** 2
        self.cues = frozenset(self.cues)

    def match(self, found: list[str]) -> tuple[float, str] | None:
        """(cosine, licence) of a unit's words, if it is a notice."""
        count = Counter(found)
        idf, other = self.idf, self.other
        v = {w: (1 + math.log(n)) * idf.get(w, other) for w, n in count.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        dot = [0.0] * len(self.names)
        for w, x in v.items():
            for i, y in self.postings.get(w, ()):
                dot[i] += x * y
        best = None
        for i, x in enumerate(dot):
            cos = round(x / norm, 9) if norm else 0.0
            if cos >= self.threshold and (best is None or cos > best[0]) and self.needs[i] <= v.keys():
                best = (cos, self.names[i])
        return best

    def units(self, text: str) -> Iterator[str]:
        if header := HEADER.match(text):
            yield header[0]
        for block in re.split(r"\n[\s#/*;%-]*\n", text):
            lines = block.split("\n")
            if len(lines) > 1:
                yield block
            for line in lines:
                parts = re.split(r"(?<=[.!?])\s+", line)
                if len(parts) > 1:
                    yield line
                yield from parts

    def scan(self, text: str | None, named: bool) -> tuple[float, str, bool] | None:
        """(cosine, licence, whether the text is a licence file), or None."""
        if not text:
            return None
        found = words(text)
        if self.cues.isdisjoint(found):
            return None
        best, noticed = None, 0
        for unit in [text, *self.units(text)] if named else self.units(text):
            own = words(unit)
            if self.cues.isdisjoint(own):
                continue
            hit = self.match(own)
            if hit:
                noticed = max(noticed, len(own))
                if best is None or (-hit[0], hit[1]) < (-best[0], best[1]):
                    best = hit
        return best and (*best, named or 2 * noticed >= len(found))


def document_counts(files: DataFrame, terms: set[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of those that hold each term: partial counts by task, summed by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in chunks(batches, "text"):
            for text in b.column("text").to_pylist():
                count.update(terms.intersection(words(text or "")))
                count[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    df = {r.term: r.n for r in files.select(F.col("text").cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return df.pop("", 0), df


def scan_files(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(file_id, path, text) -> file_id, path, license, score, is_license_file."""
    scanner = Scanner(*document_counts(files, vocabulary(templates)), templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            paths, texts = b.column("path").to_pylist(), b.column("text").to_pylist()
            found = [scanner.scan(t, bool(p and LICENSE_NAME.search(p))) for p, t in zip(paths, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("file_id"), b.column("path"), pa.array([f and f[1] for f in found], pa.string()), pa.array([f and f[0] for f in found], pa.float64()), pa.array([bool(f and f[2]) for f in found])],
                ["file_id", "path", "license", "score", "is_license_file"],
            )

    files = files.select(F.col("file_id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    return files.mapInArrow(run, "file_id long, path string, license string, score double, is_license_file boolean")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds origin (own, inherited or none) and distance; license and score of files without one come from above."""
    scanned = scanned.withColumn("dir", F.expr("case when path is null then null when instr(path, '/') = 0 then '' else substring_index(path, '/', size(split(path, '/')) - 1) end"))
    given = scanned.filter("is_license_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    given = given.select(F.col("dir").alias("above"), F.col("best.license").alias("from_license"), (-F.col("best.s")).alias("from_score"))
    wanted = scanned.filter("license is null and dir is not null").select("dir").distinct()
    steps = F.expr("transform(sequence(0, size(parts)), i -> struct(array_join(slice(parts, 1, size(parts) - i), '/') as above, i as distance))")
    parts = F.expr("if(dir = '', cast(array() as array<string>), split(dir, '/'))")
    above = wanted.withColumn("parts", parts).select("dir", F.explode(steps).alias("a")).select("dir", "a.above", "a.distance")
    nearest = spread_join(above, given, ["above"], ["dir"]).groupBy("dir").agg(F.min(F.struct("distance", "from_license", "from_score")).alias("near"))
    own, bare = scanned.filter("license is not null"), scanned.filter("license is null")
    bare = spread_join(bare, nearest, ["dir"], ["file_id", "path"], "left").select(
        "file_id", "path", F.col("near.from_license").alias("license"), F.col("near.from_score").alias("score"), "is_license_file",
        F.when(F.col("near").isNull(), "none").otherwise("inherited").alias("origin"), F.col("near.distance").alias("distance"),
    )
    own = own.select("file_id", "path", "license", "score", "is_license_file", F.lit("own").alias("origin"), F.lit(0).alias("distance"))
    return own.unionByName(bare)


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id.txt."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = materialize(scan_files(as_files(table(spark, sf_dir, "documents"))), "scanned")
    return inherit(scanned).withColumnRenamed("file_id", "doc_id")
