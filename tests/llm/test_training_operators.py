"""Each operator against a plain version, on small fixtures."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from millrace.llm import ann, common, decontam, langid, licenses, packing, pii, pretokens, repeats, simhash, tokencount, tokenfile

random.seed(5)
WORDS = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


BASE = [text(random.choice([3, 30, 120, 300])) for _ in range(60)]
PASSAGE = text(90)
TEXTS = [*BASE, *BASE[:10], *(f"{x} {PASSAGE} {text(5)}" for x in BASE[:12]), "ab " * 400, "ab " * 401, "", None, "é" * 500, "é" * 500]
for _x in BASE[20:30]:  # near copies
    _w = _x.split()
    _w[len(_w) // 2] = "changed"
    TEXTS.append(" ".join(_w))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").repartition(5)


# --- 3 ---


def plain_repeats(texts, length):
    raw, seen = [(t or "").encode() for t in texts], {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_repeats(docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.dedup(docs).collect()}
    want = plain_repeats(TEXTS, 200)
    assert [got[i] for i in range(len(TEXTS))] == want
    assert sum(w[1] for w in want) > 0


def test_repeated_suffixes_by_hand():
    x = np.frombuffer(b"abcdefghijklmnop\xffabcdefghijklmnoq\xff", np.uint8)
    assert np.flatnonzero(repeats.repeated_suffixes(x, 12)).tolist() == [0, 1, 2, 3, 17, 18, 19, 20]


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 500)
    data = text(400).encode()
    found = [(int(a), int(b)) for _, _, lo, hi in repeats.contexts([data], 200, 40) for a, b in zip(lo, hi, strict=True)]
    assert [i for a, b in found for i in range(a, b + 1)] == list(range(len(data) - 199))


# --- 6 ---


def test_simhash(docs):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for t in TEXTS]
    root = list(range(len(TEXTS)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], top(i)) for i in range(len(TEXTS))}


def test_vantage_point_trees_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([centres, *(centres ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)) for _ in range(12))]))
    pairs = {(int(a), int(b)) for i, a in enumerate(fp) for b in fp[i + 1 :][np.bitwise_count(fp[i + 1 :] ^ a) <= 2]}
    df = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64)}))
    links = simhash.fingerprint_links(df, sample=256, leaf=200).collect()
    want, got = {int(x): int(x) for x in fp}, {int(x): int(x) for x in fp}

    def top(m, i):
        while m[i] != i:
            i = m[i]
        return i

    for m, some in ((want, pairs), (got, [(r.u % 2**64, r.v % 2**64) for r in links])):
        for a, b in some:
            x, y = top(m, a), top(m, b)
            m[max(x, y)] = min(x, y)
    assert all(top(want, int(x)) == top(got, int(x)) for x in fp)


def test_blocks_that_nothing_divides_give_stars(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    fp = np.arange(2**9, dtype=np.uint64)  # each within reach of 45 others: pairs would be 11,520
    a, b = simhash.local_links(fp, 2)
    root = list(range(len(fp)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (int(fp[x]) ^ int(fp[y])).bit_count() <= 9
        p, q = top(x), top(y)
        root[max(p, q)] = min(p, q)
    assert {top(i) for i in range(len(fp))} == {0} and len(a) < 6000


# --- 2 ---


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[100:400] = v[100]  # a hot vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (704, []), (750, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ok = ann.usable(df)
    assert ok.count() == 701
    got = [tuple(r) for r in ann.nearest(ok.filter("vec_id % 50 = 0"), ok, block=64, query_block=8).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 700, 50):
        s = ann.cosine(np.repeat(v[q : q + 1].astype(float), 700, 0), v.astype(float))
        best = sorted((-x, i) for i, x in enumerate(s) if i != q)[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(best)]
    assert got == want


@pytest.mark.parametrize("own", [2, 7])
def test_a_repeated_query_id_leaves_its_copies_in(spark, own):
    near, far = [1.0, 0.0], [0.9, 0.1]
    rows = [(0, near)] * own + [(i, near) for i in range(1, 8)] + [(3, near)] * 2 + [(50, far)] * 9 + [(9, far)]
    df = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in ann.nearest(df.filter("vec_id % 50 = 0"), df).orderBy("query_id", "rank").collect()]
    want = []
    for q, v in ((0, near), (50, far)):
        best = sorted((-float(ann.cosine(np.array([v]), np.array([x]))[0]), i) for i, x in rows if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 3)) * 10.0 ** rng.choice([-300, -200, 0, 160, 300], 60)[:, None]
    v[7] = [5e-324, 0.0, 0.0]
    df = ann.usable(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df.filter("vec_id in (0, 7, 50)"), df, block=16).collect()}
    unit = [[float(x) / float(np.abs(row).max()) for x in row] for row in v]
    for q in (0, 7, 50):
        def cos(i, q=q):
            return math.fsum(x * y for x, y in zip(unit[q], unit[i], strict=True)) / (math.hypot(*unit[q]) * math.hypot(*unit[i]))

        best = sorted((i for i in range(60) if i != q), key=lambda i: -cos(i))[:5]
        assert [got[q, k + 1][0] for k in range(5)] == best
        assert all(abs(got[q, k + 1][1] - cos(i)) < 1e-12 for k, i in enumerate(best))


# --- 4 ---


def test_languages(spark, sf):
    docs = langid.fold(spark.read.parquet(f"{sf}/documents.parquet"))
    extra = spark.createDataFrame([(900, None, "en"), (901, "123 !!", "de"), (902, "", None)], "doc_id long, text string, lang string")
    learned = langid.prototypes(docs.filter("not held_out"))
    rows = langid.predict(docs.select("doc_id", "text", "lang", "held_out"), learned, ["doc_id", "lang", "held_out"]).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {(r.lang_pred, r.score) for r in langid.predict(extra, learned, ["doc_id"]).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in langid.predict(extra.limit(1), {}, ["doc_id"]).collect()} == {"und"}


# --- tokens: 5, 9, 10 ---

ODD = ["", "  a\n\n b   ", "İstanbul it's WE'LL x²³ ½ ª", "日本 <|endoftext|> x", "don't!'s ''s  'S", "\x85 \x1c a", "Σας ǅ \xad"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pretokens_give_the_librarys_ids(name):
    code = pretokens.PretokenEncoder(name, cache=50)
    for t in [*(x or "" for x in TEXTS), *ODD]:
        assert np.frombuffer(code.encode_one(t), "<u4").tolist() == code.library.encode(t, add_special_tokens=False).ids


def test_token_shards(spark, docs, tmp_path):
    folder = str(tmp_path / "shards")
    manifest = tokenfile.write_shards(docs, folder)
    rows = sorted(tuple(r) for r in tokenfile.read_shards(spark, folder, manifest).collect())
    code, at, want = pretokens.encoder("byte_bpe_50k.json"), 0, []
    for i, t in enumerate(TEXTS):
        ids = code.encode_one(t or "") + b"\0\0\0\0"
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert rows == want
    reader = tokenfile.ShardReader(folder, manifest[0][0])
    assert reader.document(int(reader.index["doc_id"][0])) == reader.at(0)
    assert reader.document(10**9) is None
    broken = tmp_path / "shards" / manifest[0][0]
    broken.write_bytes(broken.read_bytes()[:-5])
    with pytest.raises(ValueError):
        tokenfile.ShardReader(folder, manifest[0][0])


def check_packing(rows, least):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert len(by) <= least


def test_packing(docs):
    rows = packing.packed(docs).collect()
    code = pretokens.encoder("word_bpe_49k.json")
    want, total = [], 0
    for i, t in enumerate(TEXTS):
        ids = code.encode_one(t or "") + b"\1\0\0\0"
        total += len(ids) // 4
        want += [(i, k, a // 4, len(ids[a : a + 16384]) // 4, zlib.crc32(ids[a : a + 16384])) for k, a in enumerate(range(0, len(ids), 16384))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_packing(rows, -(-total // packing.CAPACITY) + 1)


def test_packing_evolves_where_best_fit_falls_short(spark):
    rng = np.random.default_rng(3)
    sizes = []  # bins that can be filled to the brim
    for _ in range(120):
        a, b = sorted(rng.integers(900, 3000, 2))
        sizes += [int(a), int(b - a) + 1, 4096 - int(b) - 1]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "key long, length long")
    rows = packing.pack(items, block=200).collect()
    lengths = dict(enumerate(sizes))
    assert sorted(r.key for r in rows) == list(lengths)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + lengths[r.key]
    assert max(at.values()) <= 4096 and len(at) <= 124


def test_token_trees_follow_edits():
    code = pretokens.encoder("byte_bpe_50k.json")
    parts = ["a", "the ", " of", "'s", "'", "  ", "\n", "12", "!", "É", "日本", " ", "\t\t", "don't", "    z"]
    for _ in range(400):
        tree = tokencount.TokenTree("".join(random.choice(parts) for _ in range(random.choice([0, 3, 30, 600]))), code)
        for _ in range(2):
            cuts = sorted(random.randint(0, len(tree.text)) for _ in range(2 * random.randint(0, 4)))
            edits = [(cuts[i], cuts[i + 1], "".join(random.choice(parts) for _ in range(random.choice([0, 1, 150])))) for i in range(0, len(cuts), 2)]
            new = tree.text
            for a, b, s in reversed(edits):
                new = new[:a] + s + new[b:]
            assert tree.edit(edits) == len(code.library.encode(new, add_special_tokens=False).ids)
            assert tree.text == new
    long = tokencount.TokenTree(" word" * 20_000, code)
    long.edit([(50_000, 50_003, "xyz")])
    assert long.encoded < 3 * tokencount.LEAF
    with pytest.raises(ValueError):
        long.edit([(5, 3, "")])


# --- 7 ---


def test_overlaps_survive_substitutions(spark):
    item = " ".join(f"q{i}" for i in range(40))
    words = item.split()
    swapped = [("zz" if i % 6 == 5 else w) for i, w in enumerate(words)]
    rows = [(1, f"{text(50)} {item} {text(9)}"), (2, text(60)), (3, " ".join(swapped)), (4, " ".join(words[:9])), (5, None), (6, ""), (7, " ".join(words[10:25]) + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.length, r.matched) for r in decontam.overlaps(docs, bench).collect()}
    assert set(got) == {(1, 10), (3, 10), (7, 10)}
    assert got[1, 10] == (40, 40) and got[7, 10] == (15, 15)
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [2, 4, 5, 6]
    assert decontam.overlaps(docs, bench.limit(0)).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == 7


def plain_overlap(equal):
    """Whether a segment has 10 equal words or more, and a share of 0.8 or more of them."""
    return any(10 <= (n := sum(equal[i:j])) and 5 * n >= 4 * (j - i) for i in range(len(equal)) for j in range(i + 10, len(equal) + 1))


def test_any_segment_of_a_hit_diagonal_counts(spark):
    words = [f"q{i}" for i in range(40)]
    pairs = [("zz" if i in (8, 9, 18, 19) else w) for i, w in enumerate(words[:28])]
    fifth = [("zz" if i % 5 == 4 else w) for i, w in enumerate(words)]
    rows = [(1, f"{text(20)} {' '.join(pairs)}"), (2, " ".join(fifth)), (3, " ".join(words[:9]) + " " + text(9))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(28, " ".join(words[:28])), (40, " ".join(words))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.place, r.length, r.matched) for r in decontam.overlaps(docs, bench.filter("item_id = 28")).collect()}
    assert got[1, 28] == (20, 28, 24)
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench.filter("item_id = 40")).collect()} == {(1, 40), (2, 40)}
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [3]


def test_verified_diagonals_against_all_segments():
    rng = random.Random(6)
    seen = [0, 0]
    for _ in range(600):
        item = [f"q{i}" for i in range(rng.randint(15, 59))]
        share = rng.choice([0.1, 0.15, 0.2, 0.3])
        doc = [("zz" if rng.random() < share else w) for w in item]
        known = decontam.Benchmark([(1, " ".join(item))])
        found = known.overlaps(decontam.word_hashes(" ".join(doc)))
        hit = (0, 0) in list(known.hits(decontam.word_hashes(" ".join(doc))))
        equal = [x == y for x, y in zip(item, doc, strict=True)]
        assert bool(found) == (hit and plain_overlap(equal))
        for _, at, n, matched in found:
            assert sum(equal[at : at + n]) == matched >= 10 and 5 * matched >= 4 * n
        seen[bool(found)] += 1
    assert min(seen) > 20


def test_recall_over_all_diagonals():
    """Texts with substituted words: what meets the rule on any diagonal, seeds or none, against what is found."""
    rng = random.Random(12)
    seen = {}
    for _ in range(1500):
        item = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(rng.randint(11, 60))]
        share = rng.choice([0, 0.05, 0.1, 0.15, 0.2])
        begin = rng.randrange(len(item) - 10)
        part = item[begin : begin + rng.randint(11, 60)]
        doc = [f"x{rng.randrange(99)}" for _ in range(rng.randint(0, 30))] + [f"y{rng.randrange(99)}" if rng.random() < share else w for w in part] + [f"x{rng.randrange(99)}" for _ in range(rng.randint(0, 30))]
        known = decontam.Benchmark([(1, " ".join(item))])
        found = bool(known.overlaps(decontam.word_hashes(" ".join(doc))))
        at = [(d, [doc[i + d] == item[i] for i in range(max(0, -d), min(len(item), len(doc) - d))]) for d in range(-len(item) + 1, len(doc))]
        wanted = any(plain_overlap(e) for _, e in at if sum(e) >= 10)
        assert wanted or not found
        if wanted:
            seen.setdefault(share, []).append(found)
    recall = {s: sum(x) / len(x) for s, x in sorted(seen.items())}
    assert all(len(x) > 50 for x in seen.values()) and min(recall.values()) >= 0.95, recall


def test_repeated_seeds_are_multiplied_out_in_lots(monkeypatch):
    line = "one two three four five six seven eight nine ten eleven twelve "
    known, words = decontam.Benchmark([(1, line * 30), (2, line + "end")]), decontam.word_hashes(line * 500)
    whole = sorted(known.hits(words))
    assert known.overlaps(words) == [(1, 0, 360, 360), (2, 0, 12, 12)]
    monkeypatch.setattr(decontam, "PAIRS", 1000)
    assert sorted(known.hits(words)) == whole and len(set(whole)) == len(whole)


def test_groups_of_items_give_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(BASE[i].split()[:25])) for i in range(30)], "item_id long, text string")
    whole = sorted(map(tuple, decontam.overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontam, "PASS_WORDS", 100)
    assert sorted(map(tuple, decontam.overlaps(docs, bench).collect())) == whole and whole


# --- 8 ---


def test_base_spans():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(t):
        out = []
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
                if good:
                    out.append((kind, m.start(), m.end()))
        return out

    bits = ["@", ".", "a", "-", "+", "1", "25", "999", "0", " ", "(", "b.c", "4111 1111", "1111-1111 1111", "5555555555554444", "%", "é"]
    for _ in range(20_000):
        t = "".join(random.choice(bits) for _ in range(random.randint(1, 30)))
        assert pii.base_spans(t) == plain(t)
    assert pii.base_spans("a" * 300_000) == [] and pii.base_spans("1" * 300_000) == []


def test_field():
    field = pii.train()
    assert not field.all_words
    for words, labels in pii.labelled():
        t = " ".join(words)
        (base, added), = pii.all_spans([t], field)
        assert bool(added) == any(labels)
        # decoding every word gives the same as decoding the busy stretches
        field.all_words = True
        assert pii.field_spans([t], field, [base])[0] == added
        field.all_words = False
    (_, added), = pii.all_spans(['x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y'], field)
    assert [k for k, _, _ in added] == ["secret"]


def test_viterbi_against_all_paths():
    field, rng = pii.train(), np.random.default_rng(0)
    e = rng.normal(size=(5, 4, 3)) * 2
    got = field.viterbi(e, np.array([4, 4, 3, 2, 1]))
    import itertools

    for row, n, labels in zip(e, [4, 4, 3, 2, 1], got, strict=True):
        best = max(itertools.product(range(3), repeat=n), key=lambda p: field.start[p[0]] + sum(row[i, x] for i, x in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(labels[:n]) == best


def test_redact(spark):
    rows = [(1, "mail a.b@c.de now", 5), (2, None, 6), (3, "+1 (017) 555-7713", 7)]
    got = sorted(map(tuple, pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()))
    assert got == [(1, "mail [EMAIL] now", 5), (2, None, 6), (3, "[PHONE]", 7)]


# --- 1 ---


def test_licenses(spark):
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c/x.py", "code here"), (3, "a/b/LICENSE", "Released under the MIT License."), (4, "z/y.py", "nothing"),
        (5, "a/q.py", f"# {apache[:90]}\n# {apache[90:]}\n\ncode"), (6, None, "bare"), (7, "a/n.py", None), (8, "top.py", ""), (9, "z/own.txt", "some words of text.\nReleased under the MIT License.\nmore words of the text follow here"),
    ]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = {r.file_id: (r.license, r.origin, r.distance) for r in licenses.inherit(licenses.scan_files(files)).collect()}
    assert got[1] == ("Apache-2.0", "own", 0) and got[3] == ("MIT", "own", 0) and got[5] == ("Apache-2.0", "own", 0) and got[9] == ("MIT", "own", 0)
    assert got[2] == ("MIT", "inherited", 1) and got[7] == ("Apache-2.0", "inherited", 0)
    assert got[4] == got[6] == got[8] == (None, "none", None)


def test_cues_lose_no_notice():
    rng = random.Random(4)
    df = {w: rng.randint(0, 900) for w in licenses.vocabulary()}
    s = licenses.Scanner(1000, df)
    vocabulary = sorted(licenses.vocabulary())
    for _ in range(3000):
        name = rng.choice(sorted(licenses.TEMPLATES))
        w = [x for x in licenses.words(rng.choice(licenses.TEMPLATES[name])) if rng.random() < 0.8] + rng.sample(vocabulary, 2)
        if s.cues.isdisjoint(w):
            assert s.match(w) is None


@pytest.mark.parametrize("parts", [1, 256])
def test_spread_join(spark, monkeypatch, parts):
    monkeypatch.setattr(common, "SPREAD", parts)
    many = spark.createDataFrame([(1, i) for i in range(600)] + [(2, 1), (2, 1), (None, 5), (3, 6)], "k int, at int")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k int, name string")
    for how in ("inner", "left"):
        key = lambda r: str(tuple(r))
        assert sorted(map(key, common.spread_join(many, one, ["k"], ["at"], how).collect())) == sorted(map(key, many.join(one, "k", how).collect()))


def test_equal_contexts_are_dealt_once(spark):
    rows = [(7, b"d%d" % (i % 3), b"x" * 300 if i % 3 else b"y%d" % i * 100, i, 0, 1) for i in (0, *[1, 2, 4, 5] * 300)]
    found = spark.createDataFrame(rows, repeats.CONTEXT).repartition(4)
    runs = {bytes(r.digest): [tuple(x) for x in r.runs] for r in repeats.expand(found.filter("digest <> x'6430'"), 200).collect()}
    assert runs == {b"d1": [(0, 101)], b"d2": [(0, 101)]}
