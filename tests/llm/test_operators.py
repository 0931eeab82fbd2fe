"""The ten operators against brute force, over awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import boosting, decontaminate, jaccard, language_model, licenses, lines, packing, pii, quality, sharding, suffixes

CLASH = ("id", "tag", "rid", "key", "n", "row", "pos", "word", "label", "kept", "size", "shard", "n_lines", "n_dropped", "__line", "length")
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *("x" for _ in CLASH)) for r in rows], SCHEMA)


def made_up(seed=4):
    r = random.Random(seed)
    words = ["".join(r.choice(("an", "der", "tión", "on", "re", "ß", "ou")) for _ in range(r.randint(1, 3))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [prose(r.randint(1, 160)) + "\n" + prose(12) for _ in range(40)]
    rows = list(enumerate(base))
    shared, passage = "A line that several documents hold, really.", prose(60)
    for i in range(40, 90):
        t = r.choice(base).split(" ")
        for _ in range(r.choice((0, 0, 1, 2))):
            t[r.randrange(len(t))] = r.choice(words)
        t = " ".join(t)
        if i % 5 == 0:
            t += f"\n  {shared.upper() if i % 2 else shared} \r\n" + passage
        if i % 7 == 0:
            t += f" write to jo{i}@mail.example.com or +1 (017) 555-77{i} at 97.51.17.{i} All rights reserved."
        rows.append((i, t))
    rows += [(90, None), (91, ""), (92, " \n\t\n"), (93, "one"), (94, "a\x0bb  c\x1cd"), (95, "aaaa " * 4000), (96, "z" * 5000), (97, "one"), (-5, base[0]), (98, "1 " * 3000), (99, "Kelvin CC-BY cc by, cc BY")]
    return rows


REPEATED = [(7, "the same row of text, twice over and over again"), (7, "the same row of text, twice over and over again"), (7, "another text of the same id"), (None, "a row without an id, of some length at least"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, made_up()).repartition(5).cache()


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in made_up()}


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, made_up() + REPEATED)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def test_packing(spark, docs, awkward, nothing, texts):
    got = defaultdict(list)
    for r in packing.pack(docs, capacity=64).collect():
        got[r["sequence_id"]].append(r)
    encoder = packing._Encoder(packing.tokenizer_path())
    pieces = {(r["doc_id"], r["piece"]): r for rs in got.values() for r in rs}
    for i, t in texts.items():
        ids = encoder.tok.encode(t, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            r = pieces.pop((i, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert not pieces
    total = 0
    for rs in got.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
        total += at
    assert len(got) <= 1.03 * -(-total // 64) + 1
    assert packing.pack(awkward).count() == packing.pack(docs).count() + 5 and not packing.pack(nothing).count()


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_each_piece_once(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 2048): r.randint(1, 400) for _ in range(r.choice((1, 3, 40, 400)))}
    used, n = Counter(), 0
    for places in packing.plan(counts, 2048):
        assert sum(p[0] for p in places) <= 2048
        n += places[0][2]
        for length, _, number, _ in places:
            used[length] += number
    assert used == counts
    assert n >= -(-sum(k * v for k, v in counts.items()) // 2048)


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = t.encode().translate(LOWER).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard(docs, texts, k, num, den):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, k, num, den).collect()}
    assert got == brute_components(texts, k, num, den)


def test_jaccard_large_tiles_are_cut_into_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, 1, 50, 100).collect()}
    assert got == brute_components(texts, 1, 50, 100)


def test_jaccard_awkward(awkward, nothing):
    rows = jaccard.jaccard_components(awkward).collect()
    assert len(rows) == len(made_up()) + 5 and not jaccard.jaccard_components(nothing).count()
    assert {r["component_id"] for r in rows if r["doc_id"] == 7} == {7}
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}


@pytest.mark.parametrize("n", [1, 4, 5, 9, 10, 18, 19, 40, 200, 1000])
@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100)])
def test_prefixes_miss_no_link(n, num, den):
    r = np.random.default_rng(n)
    for weights in (None, r.integers(0, 4, 1 << 18).astype(np.uint8)):
        order = jaccard.Order(num, den, weights)
        for _ in range(60):
            a = np.unique(r.integers(0, 2**63, n, np.uint64))
            drop, add = r.integers(0, n + 1), r.integers(0, n + 1)
            b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**63, add, np.uint64)]))
            same = len(np.intersect1d(a, b))
            if same and den * same >= num * (len(a) + len(b) - same):
                (x, top_x), (y, top_y) = order.prefix(a), order.prefix(b)
                met = [(top_x[i], top_y[np.flatnonzero(y == h)[0]]) for i, h in enumerate(x) if h in y]
                assert any(len(b) <= p and len(a) <= q for p, q in met)


def test_near_duplicates_with_null_ids_and_repeated_rows(spark, nothing):
    import corpus_pipeline

    t, u, v = (" ".join(f"{c}{i}" for i in range(60)) for c in "tuv")
    rows = [(4, t), (9, t), (None, t), (None, t), (12, t + " more"), (5, u), (5, u), (8, u + " more"), (None, v), (None, None), (3, None), (3, None), (6, "")]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows).coalesce(1), "")
    assert got.columns == nothing.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(None, t), (5, u), (None, v), (None, None), (3, None), (6, "")])
    assert not corpus_pipeline.near_duplicates(spark, nothing, "").count()


def brute_repeats(texts, length):
    first, out = {}, {}
    for i in sorted(texts):
        t = texts[i].encode()
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if first.setdefault(t[s : s + length], i) < i:
                gone[s : s + length] = True
        out[i] = (len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0, np.frombuffer(t, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("chunk", [1_500_000, 600])
def test_suffixes(docs, texts, chunk, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(docs).collect()}
    assert got == brute_repeats(texts, 50)


def test_suffixes_awkward(awkward, nothing):
    assert suffixes.remove_repeats(awkward).count() == len(made_up()) + 5 and not suffixes.remove_repeats(nothing).count()


def test_suffixes_contexts_alike_in_half_their_hash():
    one = lambda *x: np.array(x, np.uint64)
    ids, tags = np.array([3, 8, 9]), np.array([0, 0, 0])
    blob = suffixes._pack(np.array([0, 1, 2]), ids, tags, np.array([5, 6, 7]), one(11, 11, 11), one(77, 77 + 2**40, 77))
    got = suffixes._settle(8)(pa.table({"blob": [blob]})).to_pylist()
    assert [r["id"] for r in got if r["pos"] is None] == [9]
    assert sorted((r["id"], r["pos"]) for r in got if r["pos"] is not None) == [(3, 5), (8, 6)]


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_and_prefixes(seed):
    r = random.Random(seed)
    pieces = [bytes(r.choice(b"\0ab" if seed % 2 else b"ab") for _ in range(r.randint(1, 40))) for _ in range(6)]
    text = b"".join(pieces)
    buf = np.frombuffer(text, np.uint8)
    order = suffixes.suffix_array(buf)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size) - size
    end = np.repeat(begin + size, size)
    got = suffixes.common_prefixes(buf, order, begin, size, 20)
    for a, b in zip(order[:-1], order[1:], strict=True):
        x, y = text[a : min(end[a], a + 20)], text[b : min(end[b], b + 20)]
        assert got[b] == len(os.path.commonprefix([x, y]))


def brute_leaks(texts, items, k=5):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])
    out = {}
    for i, t in texts.items():
        w = words(t)
        for j, item in items.items():
            v = words(item)
            best = (0, 0)
            if len(v) < k and w != v:  # one shingle: it matches only a text of just these words
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                x, y = runs(w[s : s + len(v)]), runs(v)
                same = sum((x & y).values())
                total = sum(x.values()) + sum(y.values()) - same
                if total and same / total > best[0] + 1e-12:
                    best = (same / total, s)
            if best[0] >= 0.8 - 1e-12:
                out[i, j] = (best[1], round(best[0], 9))
    return out


def test_leaks(spark, texts):
    r = random.Random(8)
    items = {j: " ".join(texts[j].split()[:50]) for j in range(6)} | {6: "short one", 7: "", 8: "rose is a rose is a rose is a rose"}
    some = dict(list(texts.items())[:60])
    for j in range(5):
        w = items[j].split()
        w[r.randrange(len(w))] = "changed"
        some[200 + j] = f"{texts[20]} {' '.join(w).upper()}, {texts[21]}"
    some |= {300: "Short one!", 301: "a short one more", 302: "so: rose is a rose is a rose is a rose."}
    bench = spark.createDataFrame([(j, t, "x") for j, t in items.items()] + [(9, None, "x")], "item_id long, text string, doc_id string")
    got = decontaminate.find_leaks(frame(spark, some.items()), bench)
    assert {(x["doc_id"], x["item_id"]): (x["start"], round(x["similarity"], 9)) for x in got.collect()} == brute_leaks(some, items)


def test_leaks_in_another_order(spark):
    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    items = {n: prose(n) for n in (60, 100, 200)}
    some = {}
    for n, t in items.items():
        w = t.split()
        some[n] = f"{prose(300)} {' '.join(w[n // 2 :] + w[: n // 2])} {prose(300)}"
        some[1000 + n] = " ".join(w[2 * n // 3 :] + w[n // 3 : 2 * n // 3] + w[: n // 3]) + " " + prose(250)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["start"], round(x["similarity"], 9)) for x in decontaminate.find_leaks(frame(spark, some.items()), bench).collect()}
    assert got == brute_leaks(some, items) and len(got) >= 5


def test_leaks_cut_short(spark):
    r = random.Random(13)
    items = {n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)) for n in (50, 100, 200)}
    some = {1000 * n + k: " ".join(t.split()[:k]) for n, t in items.items() for k in range(n * 3 // 4, n, n // 50)}
    some[1] = " ".join(items[100].split()[10:])
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["start"], x["n_words"], round(x["similarity"], 9)) for x in decontaminate.find_leaks(frame(spark, some.items()), bench).collect()}
    want = brute_leaks(some, items)
    assert got == {k: (s, len(some[k[0]].split()), x) for k, (s, x) in want.items()} and len(want) > 20


def test_leaks_awkward(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, REPEATED[3][1] + " and so on and on")], "item_id long, text string")
    assert decontaminate.find_leaks(awkward, bench).count() == decontaminate.find_leaks(nothing, bench).count() == 0
    bench = spark.createDataFrame([(1, REPEATED[3][1]), (2, REPEATED[0][1])], "item_id long, text string")
    assert awkward.count() - decontaminate.decontaminate(awkward, bench).count() == 6  # all rows with id 7 or none
    assert decontaminate.decontaminate(awkward, bench.limit(0)).count() == awkward.count()


def test_licenses(docs, awkward, nothing, texts):
    for r in licenses.scan_licenses(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].encode().translate(LOWER).decode())
        want = [(label, i) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + phrase.count(" ") + 1] == phrase.split()]
        assert r["n_words"] == len(w) and sorted(map(tuple, r["base"])) == sorted(want)
    assert licenses.scan_licenses(awkward).count() == awkward.count() and not licenses.scan_licenses(nothing).count()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("GNU General Public License, version 3 or any later version", {"gpl-3-or-later"}),
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
        ("Creative Commons Attribution-ShareAlike 4.0 International", {"cc-by-sa-4.0"}),
        ("nothing here", set()),
    ],
)
def test_license_rules(spark, text, want):
    got = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["detections"]
    assert want <= {d["label"] for d in got} and (want or not got)
    assert not {"gpl", "apache", "bsd", "cc-by-sa"} & {d["label"] for d in got}  # held by longer detections of higher priority


COMMONS = {"": "by", "-ShareAlike": "by-sa", "-NoDerivatives": "by-nd", "-NonCommercial": "by-nc", "-NonCommercial-ShareAlike": "by-nc-sa", "-NonCommercial-NoDerivatives": "by-nc-nd"}


def test_creative_commons_families(spark):
    rows, want = [], {}
    for name, short in COMMONS.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            for text in (f"Creative Commons Attribution{name} {version} International License", f"under CC {short.upper()} {version}.", f"https://creativecommons.org/licenses/{short}/{version}/"):
                want[len(rows)] = {f"cc-{short}-{version}"}
                rows.append((len(rows), text))
        want[len(rows)] = {f"cc-{short}"}
        rows.append((len(rows), f"a Creative Commons Attribution{name} license"))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: {d["label"] for d in r["detections"]} for r in got} == want


def spelled(tree, last):
    """A text that a parsed pattern matches: each choice by its first or last branch, with what is optional left out or kept."""
    out = ""
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "BRANCH":
            out += spelled(value[1][-1 if last else 0], last)
        elif op == "SUBPATTERN":
            out += spelled(value[3], last)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, sub = value
            out += spelled(sub, last) * (min(int(high), max(low, 1)) if last else low)
        elif op == "IN":
            kind, x = value[-1 if last else 0]
            out += "x" if str(kind) == "CATEGORY" else chr(x if str(kind) == "LITERAL" else x[0])
        elif op == "ANY":
            out += "x"
    return out


def test_license_rules_find_their_own_words(spark):
    """Texts spelled from every rule hold the rule's keyword and are detected."""
    rows, gate_of = [], {k: g for g, ks in licenses._gated(licenses.rules()).items() for k in ks}
    assert len(set(gate_of.values())) < 100
    for _, _, keyword, pattern, _ in licenses.rules():
        for last in (False, True):
            text = spelled(re._parser.parse(pattern), last)
            assert re.search(pattern, f" {text} "), (pattern, text)
            assert keyword in f"{text} " and gate_of[keyword] in f"{text} ", (keyword, text)
            rows.append((len(rows), f"Some words: {text}. More of them"))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(licenses._SIGNATURES) > 200 and all(r["detections"] for r in got)


def test_license_many_detections(spark):
    text = " ".join(f"Copyright 20{i % 90 + 10} someone{i} under the MIT License." for i in range(20_000))
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert Counter(d["label"] for d in r["detections"])["mit"] == 20_000


def test_statistics(texts):
    ids = sorted(texts)
    got = quality.statistics([texts[i].encode() for i in ids])
    for k, i in enumerate(ids):
        t = texts[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {j + m for j in range(len(w) - 7) if runs[tuple(w[j : j + 8])] > 1 for m in range(8)}
        held = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(held) - len(set(held)), len(covered))
        assert tuple(int(got[c][k]) for c in quality.COUNTS) == want


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.judge(d, quality.fit(d, labels)).join(labels, "doc_id").where(~F.col("base_failed"))
    kept = {r["quality"]: r["share"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.4


def test_quality_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    for table in (awkward, nothing):
        model = quality.fit(table, labels)
        assert quality.judge(table, model).count() == table.count()
        kept = quality.keep_good(table, model)
        assert kept.columns == table.columns and kept.count() <= table.count()


def test_language_model(docs, awkward, nothing, texts):
    got = {r["doc_id"]: r for r in language_model.score_documents(docs, frequent=50).collect()}
    words = {i: [*t.encode().translate(LOWER).split(), "END"] for i, t in texts.items()}
    counts = Counter(w for i, ws in words.items() if not language_model.held_out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (language_model.held_out(i), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r["score"] < 0
    assert language_model.score_documents(awkward).count() == awkward.count() and not language_model.score_documents(nothing).count()


def test_language_model_learns_and_depends_on_no_cut(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        word, out = "a", []
        for _ in range(120):  # a chain in which words tell what follows
            word = {"a": "b", "b": r.choice("cd"), "c": "a", "d": "e", "e": r.choice("ac")}[word]
            out.append(word + str(i % 3))
        rows.append((i, " ".join(out)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    one, seven = ({x["doc_id"]: x for x in language_model.score_documents(table.repartition(n)).collect()} for n in (1, 7))
    held = [x for x in one.values() if x["held_out"]]
    assert sum(x["score"] for x in held) > 0.75 * sum(x["base_score"] for x in held)
    assert {i: x["score"] for i, x in one.items()} == pytest.approx({i: x["score"] for i, x in seven.items()})


def test_language_model_beats_the_base_on_held_out_text(spark):
    got = language_model.op7_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.97 * got[1]


def test_language_model_probabilities_add_up():
    v = language_model.Vocabulary([*"abcdefgh", "\n"], [9, 8, 7, 6, 5, 4, 3, 2, 5], {}, 49, 9, lead=2)
    r = np.random.default_rng(5)
    w = {k: r.normal(size=s).astype(np.float32) for k, s in language_model.SHAPES.items()}
    total = 0.0
    for i in range(len(v.words)):
        code = np.array([v.code[i], v.code[v.end]], np.uint16)
        total += 10 ** (language_model.sequence_scores(w, v.prior, code[:1], np.array([1]))[0] + v.within[i])
    rare = sum(10 ** language_model.sequence_scores(w, v.prior, np.array([(language_model.CLASSES + k) * language_model.CODES + language_model.LEAD], np.uint16), np.array([1]))[0] for k in range(1, language_model.RARE_CLASSES + 1))
    empty = sum(10 ** language_model.sequence_scores(w, v.prior, np.array([c * language_model.CODES + j], np.uint16), np.array([1]))[0] for c in range(1, 1 + language_model.CLASSES) for j in range(language_model.CODES) if not np.isin(c * language_model.CODES + j, v.code))
    assert total + rare + empty == pytest.approx(1, abs=1e-4)


def test_language_model_trains_on_all_training_documents(texts):
    v, first = language_model.Vocabulary(["a", "\n"], [3, 2], {}, 5, 2), language_model.first_weights()
    ids = sorted(texts)
    batch = lambda own: pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([texts[i] for i in own])], names=["doc_id", "text"])
    n = {i: len(texts[i].encode().translate(LOWER).split()) + 1 for i in ids if not language_model.held_out(i)}
    coded = pa.Table.from_batches(language_model._coder(v)(iter([batch(ids[:50]), batch(ids[50:])])))
    assert sorted(coded.column("tokens").to_pylist()) == sorted(n.values())
    got = language_model._trainer(v.prior, first)(coded)
    assert got.column("tokens").to_pylist() == [sum(n.values())] and np.isfinite(got.column("weights").combine_chunks().flatten().to_numpy()).all()
    again = language_model._trainer(v.prior, first)(coded.take(pa.array(np.random.default_rng(1).permutation(len(coded)))))
    assert got.equals(again)


def test_gradient():
    r = np.random.default_rng(1)
    w = {k: r.normal(0, 0.25, s) for k, s in language_model.SHAPES.items()}
    x, y = r.integers(0, language_model.SYMBOLS, (5, 3)), r.integers(0, language_model.SYMBOLS, (5, 3))
    y[4, 1] = -1
    y[2:4] = 3  # several words of one class
    sub = r.integers(0, language_model.CODES, (5, 3))
    prior = r.normal(size=(language_model.SYMBOLS, language_model.CODES))
    fresh = r.random((5, 3)) < 0.3
    h = r.normal(size=(3, language_model.HIDDEN))
    run = lambda w: language_model.window_gradient(w, prior, h, x, y, sub, fresh)
    g, _, _ = run(w)
    for k in w:
        at = tuple(r.integers(0, s) for s in w[k].shape)
        if k == "W":
            at = (int(x[2, 0]), at[1])
        if k in ("A", "B"):
            at = (3, *at[1:])
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        slope = (run(up)[2] - run(down)[2]) / 2e-4
        assert g[k][at] == pytest.approx(slope, abs=1e-5)


def brute_lines(texts):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).encode().translate(LOWER).decode()
    holders = defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    out = {}
    for i, t in texts.items():
        rows = t.split("\n")
        kept = [x for x in rows if not (len(holders[key(x)]) > 1 and i > min(holders[key(x)]))]
        out[i] = (len(rows), len(rows) - len(kept), "\n".join(kept))
    return out


def test_lines(docs, awkward, nothing, texts):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.drop_shared_lines(docs).collect()}
    assert got == brute_lines(texts)
    out = lines.drop_shared_lines(awkward)
    assert set(out.columns) == set(awkward.columns) and out.count() == awkward.count() and not lines.drop_shared_lines(nothing).count()


def test_sharding(spark, docs, awkward, nothing, texts, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_RANGE", 3)
    monkeypatch.setattr(sharding, "MOST_RANGES", 64)
    hot = frame(spark, [(1000 + i, "copies of one text") for i in range(400)]).union(docs)
    for table in (docs, awkward, hot):
        rows = sharding.assign_shards(table, 4).collect()
        assert len(rows) == table.count()
        size = Counter()
        for s in range(4):
            own = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert own == list(range(len(own)))
        for r in rows:
            size[r["shard"]] += r["size"]
            if table is docs:
                t = texts[r["doc_id"]].encode()
                assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
        mean = sum(size.values()) / 4
        assert all(abs(x - mean) <= max(r["size"] for r in rows) for x in size.values())
    assert not sharding.assign_shards(nothing).count()


def test_lines_of_a_very_long_document(spark):
    rows = [(1, "the line that both hold"), (2, "\n".join(["the line that both hold"] + [f"line number {i} of many" for i in range(100_000)]))]
    began = time.time()
    got = {r["doc_id"]: r for r in lines.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2]["n_lines"], got[2]["n_dropped"]) == (100_001, 1) and got[2]["text"].startswith("line number 0 of many\nline number 1 ")
    assert time.time() - began < 15


def test_lines_that_all_documents_hold(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_LINES", 20)
    texts = {i: f"the very same line\nown line number {i}\n{'pair of lines ' + str(i // 2)}" for i in range(100)}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.drop_shared_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_lines(texts)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return sorted((k, m.start(), m.end()) for k, m in out)


HARD = ["a@b.c@d.e", "a@b.c_x@d.e é x@y.zz.", "1.2.3.4.5.6.7.8", "0001.2.3.255 1.2.3.256 999.1.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (017) 555-7713 +12 +1((((9", "4111111111111111" * 2, "@", "+", "1" * 9000, "a." * 4000 + "@b.c", "\U0001f600 a@b.co"]


def test_pii(spark, docs, awkward, nothing, texts):
    given = texts | {1000 + i: t for i, t in enumerate(HARD)}
    for r in pii.find_personal(frame(spark, given.items())).collect():
        assert [(s["rank"], s["start"], s["stop"]) for s in sorted(r["base"], key=lambda s: (s["rank"], s["start"]))] == brute_pii(given[r["doc_id"]])
        assert not any(a["start"] < b["stop"] and b["start"] < a["stop"] for a in r["added"] for b in r["base"])
    assert pii.find_personal(awkward).count() == awkward.count() and not pii.find_personal(nothing).count()


def test_pii_adds_and_redacts(spark):
    text = 'Her key: token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", SSN 123-45-6789, and jo@x.org.'
    table = spark.createDataFrame([(1, text), (2, "plain prose and nothing else"), (None, "jo@x.org")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(table).collect()}
    assert got == {1: 'Her key: token = "<secret>", SSN <national_id>, and <email>.', 2: "plain prose and nothing else", None: "<email>"}


def test_pii_redacts_each_row_by_itself(spark):
    rows = [(5, "secret@person.org wrote this"), (5, "this was written to a.b@c.net, and to d@e.org!"), (None, "x@y.zz"), (None, None), (6, ""), (6, "none")]
    got = pii.redact(spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, __spans_ string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(5, "<email> wrote this"), (5, "this was written to <email>, and to <email>!"), (None, "<email>"), (None, None), (6, ""), (6, "none")])


def test_pii_many_spans(spark):
    text = " ".join(f"mail a{i}@b.org or token = {hashlib.sha1(b'%d' % i).hexdigest()}" for i in range(3000))
    r = pii.find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(r["base"]) == 3000 and len(r["added"]) == 3000


def test_pii_long_secrets(spark):
    r = random.Random(6)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    keys = {n: "".join(r.choice(chars) for _ in range(n)) for n in (190, 201, 342, 800)}
    plain = {1: "-" * 400, 2: "/".join(["over", "the", "land"] * 40), 3: "a" * 5000}
    table = spark.createDataFrame([(n, f"The token = {k} ends.") for n, k in keys.items()] + list(plain.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in pii.redact(table).collect()}
    assert got == {n: "The token = <secret> ends." for n in keys} | plain


def test_boosting():
    r = np.random.default_rng(2)
    x = r.integers(0, 20, (600, 4)).astype(float)
    y = ((x[:, 0] > 9) ^ (x[:, 2] > 14)).astype(float)
    trees = boosting.train(x[:400], y[:400])
    assert ((boosting.predict(trees, x[400:]) > 0) == (y[400:] > 0)).mean() > 0.95
    assert hashlib.md5(str(trees).encode()).hexdigest() == hashlib.md5(str(boosting.train(x[:400], y[:400])).encode()).hexdigest()
