import pathlib
import random
import textwrap
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chainloom.llm import decontaminate, embeddings, licences, mixing


def test_tiles_cover_reordered_passages():
    item = "a b c d e f g h i j".split()
    assert sum(t[3] for t in decontaminate.tile(item, ["f g h i j x a b c d e".split()], 3)) == 10
    assert decontaminate.tile(item, ["a b".split(), "c d".split()], 3) == []
    assert decontaminate.tile("a b a b".split(), ["a b".split(), "a b a".split()], 2) == [(0, 1, 0, 3)]


def plain_tiles(item, runs, least):
    """Looks at all pairs of places for the longest free match again and again."""
    taken, found = set(), []
    while True:
        best = None
        for i in range(len(item)):
            for r, row in enumerate(runs):
                for j in range(len(row)):
                    n = 0
                    while i + n < len(item) and j + n < len(row) and item[i + n] == row[j + n] and not {i + n, (r, j + n)} & taken:
                        n += 1
                    if n >= least and (best is None or (-n, i, r, j) < best):
                        best = (-n, i, r, j)
        if best is None:
            return found
        n, i, r, j = -best[0], *best[1:]
        taken |= {i + k for k in range(n)} | {(r, j + k) for k in range(n)}
        found.append((i, r, j, n))


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_tiles_equal_those_of_plain_search(letters, monkeypatch):
    draw = random.Random(letters)
    for case in range(60):
        monkeypatch.setattr(decontaminate, "_MEET", draw.choice([1, 7, 1 << 20]))
        item = draw.choices(letters, k=draw.randrange(14))
        runs = [draw.choices(letters + "x", k=draw.randrange(16)) for _ in range(draw.randrange(3))]
        least = draw.randrange(1, 5)
        assert decontaminate.tile(item, runs, least) == plain_tiles(item, runs, least), (item, runs, least)


def test_repetitive_text_is_tiled_in_seconds():
    began = time.time()
    assert decontaminate.tile(["a"] * 1000, [["a"] * 20_000], 5) == [(0, 0, 0, 1000)]
    assert decontaminate.tile(["a", "b"] * 300, [["a", "b"] * 5000], 5) == [(0, 0, 0, 600)]
    assert time.time() - began < 20  # some 2 s on one core; the plain product of both lengths took 26


def test_contamination_equals_that_of_all_pairs(spark, make):
    """Items that share a template, documents that hold pieces of them in any order."""
    draw = random.Random(8)
    template = "which of the following is the best answer to this question".split()
    items = [(k, " ".join(template + draw.choices([f"w{k}{c}" for c in "abcdefgh"], k=draw.randrange(0, 24)))) for k in range(12)]
    docs = [(900 + d, " ".join(template)) for d in range(3)]
    for d in range(60):
        words = []
        for _ in range(draw.randrange(1, 4)):
            piece = draw.choice(items)[1].split()
            start = draw.randrange(len(piece))
            words += piece[start : start + draw.randrange(3, 30)] + draw.choices("uvxyz", k=draw.randrange(4))
        docs.append((d, " ".join(words)))
    expect = set()
    for d, text in docs:
        for k, item in items:
            n = len(item.split())
            covered = sum(t[3] for t in plain_tiles(item.split(), [text.split()], 5))
            if covered >= 0.6 * n:
                expect.add((d, k, covered))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.covered) for r in decontaminate.contaminated(make(docs), bench).collect()}
    assert found == expect and len(found) > 20


def test_contaminated_pairs(spark, make, prose):
    items = [(1, prose(40, 500)), (2, prose(30, 501)), (3, "tiny item"), (4, None), (4, ""), (None, prose(25, 502))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc string")
    first = items[0][1].split()
    rows = [
        (1, prose(100, 1)),
        (2, prose(50, 2) + " " + items[0][1].upper().replace(" ", ", ") + ". " + prose(50, 3)),
        (3, " ".join(first[20:]) + " between " + " ".join(first[:20])),
        (4, " ".join(first[:15])),
        (5, "a Tiny, item here"),
        (6, None),
        (None, items[1][1]),
        (7, items[5][1]),
        (7, items[5][1]),
    ]
    got = sorted((str(r.doc_id), str(r.item_id), r.coverage) for r in decontaminate.contaminated(make(rows), bench).collect())
    assert got == sorted([("2", "1", 1.0), ("3", "1", 1.0), ("5", "3", 1.0), ("None", "2", 1.0), ("7", "None", 1.0), ("7", "None", 1.0)])
    assert sorted(str(r.doc_id) for r in decontaminate.uncontaminated(make(rows), bench).collect()) == ["1", "4", "6"]
    mixed = [(8, "clean words"), (8, items[0][1]), (None, "clean"), (None, items[1][1])]  # each row by its own text
    assert sorted((str(r.doc_id), r.text) for r in decontaminate.uncontaminated(make(mixed), bench).collect()) == [("8", "clean words"), ("None", "clean")]
    assert decontaminate.contaminated(make([]), bench).count() == 0
    assert decontaminate.contaminated(make(rows), bench.limit(0)).count() == 0


def test_filter_limit_changes_nothing(spark, make, prose, monkeypatch):
    bench = spark.createDataFrame([(1, prose(40, 500))], "item_id long, text string")
    rows = [(1, prose(30, 1) + " " + prose(40, 500)), (2, prose(60, 2))]
    monkeypatch.setattr(decontaminate, "FILTER_SEEDS", 0)
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(make(rows), bench).collect()] == [(1, 1)]


def test_filtered_runs_and_whole_texts_give_the_same_tiles():
    rng = random.Random(4)
    for _ in range(600):
        vocabulary = [bytes([97 + i]) for i in range(rng.randrange(2, 9))]
        item = b" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))
        text = b" ".join(rng.choice(vocabulary + [b"other"]) for _ in range(rng.randrange(1, 120))).decode()
        (entry,) = decontaminate._item_rows({"item_id": [1], "item": [1], "text": [item.decode()]}, 5)
        seen = []
        for known in (None, np.sort(np.array(entry[5], np.int64))):
            runs = [r[2] for r in decontaminate._run_rows({"doc_id": [1], "doc": [1], "text": [text]}, [entry[3]], known)]
            tiles = decontaminate.tile(item.split(), [r.split() for r in runs[0]], entry[3]) if runs else []
            seen.append([(i, n) for i, _, _, n in tiles])
        assert seen[0] == seen[1]


def test_longest_match_comes_first():
    """A remainder of 5 tokens is marked before a match of 4, whatever length the search is at."""
    item = "a b c d e f g h i j k l m n".split()
    tiles = decontaminate.tile(item, ["a b c d e f g h i".split(), "e f g h i j k l m n".split()], 2)
    assert [(i, n) for i, _, _, n in tiles] == [(4, 10), (0, 4)]


def fill(words):
    """Targets by repeated resharing."""
    names = sorted((k for k in words if k is not None), key=lambda s: s.encode()) + [k for k in words if k is None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, done = 1.5 * sum(words.values()), {}
    while True:
        left = [k for k in names if k not in done]
        share = (total - sum(done.values())) / sum(weight[k] for k in left) if left else 0
        over = [k for k in left if share * weight[k] > 2 * words[k]]
        if not over:
            return done | {k: share * weight[k] for k in left}
        done |= {k: 2.0 * words[k] for k in over}


def test_mix_meets_its_targets(make, prose):
    rows = [(i, prose(5 + i % 40, i), f"s{i % 5}") for i in range(120)] + [(500, None, "s1"), (501, "", None), (502, prose(9, 1), None), (502, prose(9, 1), None), (None, prose(7, 2), "é"), (503, None, "empty")]
    sizes = mixing.settle(mixing.sized(make(rows)), "s")
    got = mixing.mix_totals(sizes).collect()
    assert len(got) == len(rows)
    words = {}
    for r in sizes.collect():
        words[r.source] = words.get(r.source, 0) + r["size"]
    expect = fill(words)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
    by_id = {}
    for r in sizes.collect():
        by_id.setdefault(r.doc_id, []).append(r.source)
    for r in got:
        taken[by_id[r.doc_id][0]] = taken.get(by_id[r.doc_id][0], 0) + r.taken
        assert r.target == pytest.approx(expect[by_id[r.doc_id][0]]) and r.source_size == words[by_id[r.doc_id][0]]
    assert all(abs(taken[s] - expect[s]) <= 1 for s in words)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_totals(sizes).collect()))
    slots = mixing.mix(sizes)[0].where("slot <= 2000").groupBy("source").sum("words").collect()
    part = sum(r[1] for r in slots)
    assert all(abs(r[1] / part - expect[r[0]] / sum(expect.values())) < 0.05 for r in slots)
    slots = {r.doc_id: r.first_slot for r in got}
    assert all((r.first_slot is None) == (r.taken == 0) for r in got)
    # in the order of the schedule every beginning of the mix has the weights; in the order of ids it has not
    order = sorted((r for r in got if r.taken), key=lambda r: slots[r.doc_id])
    half = {}
    for r in order[: len(order) // 2]:
        half[by_id[r.doc_id][0]] = half.get(by_id[r.doc_id][0], 0) + r.taken
    total = sum(half.values())
    assert all(abs(half.get(k, 0) / total - v / sum(expect.values())) < 0.12 for k, v in expect.items())
    assert mixing.mix_totals(mixing.sized(make([]))).count() == 0


def test_mixed_documents_get_all_that_the_mix_takes(make, prose):
    rows = [(i, prose(9, i), f"s{i % 3}") for i in range(20)] + [(50, prose(9, 99), "s0")] * 3 + [(51, None, "s1"), (None, prose(5, 7), None)]
    docs = make(rows).withColumn("mix_words", F.lit("old")).withColumn("__size", F.lit(1))
    out = mixing.mixed(docs)
    assert set(out.columns) == {*docs.columns, "mix_slot"}
    got = out.collect()
    want = mixing.mix_totals(mixing.sized(make(rows))).collect()
    assert sum(r.mix_words for r in got) == sum(r.taken for r in want)
    assert sorted(str((r.doc_id, r.mix_words, r.mix_slot)) for r in got) == sorted(str((r.doc_id, r.taken, r.first_slot)) for r in want if r.taken)
    assert mixing.mixed(make([])).count() == 0


def test_licences_whole_texts_and_notices(make):
    mit = licences.KNOWN_TEXTS["MIT"]
    rows = [
        (1, "MIT LICENCE\n\nCopyright (c) 2020 Someone\n" + mit.split("\n\n", 1)[1].upper()),
        (2, mit + " and more"),
        (3, "intro\nReleased under the M.I.T. Licence.\nend"),
        (4, "intro\n  released under the MIT license\nLicensed under CC BY 4.0"),
        (5, None),
        (6, ""),
        (None, licences.KNOWN_TEXTS["ISC"].replace(",", " ;")),
    ]
    got = {r.doc_id: (r.license_id, r.notices) for r in licences.scan_licences(make(rows)).collect()}
    assert got == {1: ("MIT", []), 2: (None, []), 3: (None, []), 4: (None, ["CC-BY-4.0", "MIT"]), 5: (None, []), 6: (None, []), None: ("ISC", [])}
    assert licences.scan_licences(make([])).count() == 0


def test_licences_rewrapped_match_and_additions_do_not(make):
    rows, expect = [], {}
    for name, text in licences.KNOWN_TEXTS.items():
        for width in range(60, 101):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
            title, rest = wrapped.split("\n\n", 1)
            rows.append((len(rows), f"{title}\n\nCopyright (c) 2019, Ann Example and others\nAll rights reserved.\n\n{rest}"))
            expect[len(rows) - 1] = name
    plain = licences.KNOWN_TEXTS["MIT"]
    more = ["\u0414\u043e\u0431\u0440\u044b\u0439 \u0434\u0435\u043d\u044c", "\u6587\u66f8", "one word", "7"]
    rows += [(100_000 + i, plain + "\n" + t) for i, t in enumerate(more)]
    expect |= {100_000 + i: None for i in range(len(more))}
    got = {r.doc_id: r.license_id for r in licences.scan_licences(make(rows)).collect()}
    assert got == expect and len(set(expect.values())) > 9


def test_long_licences_by_their_digests(make):
    """The published files, where the machine has them."""
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(i, (folder / f).read_text()) for i, f in enumerate(names) if (folder / f).exists()]
    got = {r.doc_id: r.license_id for r in licences.scan_licences(make(rows)).collect()}
    assert got == {i: list(names.values())[i] for i, _ in rows}
    assert len(licences.KNOWN_TEXTS) + len(set(licences.KNOWN_DIGESTS.values()) - set(licences.KNOWN_TEXTS)) >= 20


@pytest.mark.parametrize("kind,block,heads", [("float", 4096, 512), ("double", 4096, 512), ("float", 20, 2), ("double", 20, 2)])
def test_embeddings_match_brute_force(spark, kind, block, heads, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "HEADS", heads)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    vectors = [(base[rng.integers(30)] + rng.normal(scale=0.25, size=8)).astype(np.float32).tolist() for _ in range(250)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 8), (902, [None] + [1.0] * 7), (903, [float("nan")] * 8), (904, vectors[0]), (905, [1.0, 0.0]), (905, [2.0, 0.0]), (905, [0.0, 3.0]), (None, vectors[1]), (None, [0.0, -1.0]), (None, [-1.0, 0.0]), (906, [float("inf")] * 8)]
    if kind == "double":
        rows += [(907, [1e300, 1e290]), (908, [1e-60, 1e-70]), (909, [0.9, 0.43588989435406733]), (910, [0.9, 0.4358898943540674])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, cell string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.link_summary(df).collect())
    ok = [v is not None and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v in rows]
    unit = lambda a: a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max())
    cos = lambda a, b: len(a) == len(b) and np.dot(unit(a), unit(b)) >= 0.9
    near = {i: [j for j in range(len(rows)) if j != i and ok[i] and ok[j] and cos(np.array(rows[i][1], float), np.array(rows[j][1], float))] for i in range(len(rows))}
    expect = []
    for i, (vec, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        expect.append((str(vec), len(near[i]), str(min(ids)) if ids else "None"))
    assert got == sorted(expect)
    assert embeddings.link_summary(df.limit(0)).count() == 0


def test_pipeline_stages(spark, make, prose, tmp_path):
    items = [(1, prose(40, 500))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    base = prose(150, 1)
    rows = [(1, base), (2, base), (3, base.replace(" ", "  ", 3) + " end"), (4, prose(150, 2)), (5, "12 34"), (6, prose(60, 3) + " " + items[0][1]), (7, prose(90, 4) + " password = hunter2hunter2"), (8, None), (None, prose(120, 6))]
    docs, kept = make(rows), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)), name)
        kept.append(sorted(str(r.doc_id) for r in docs.select("doc_id").collect()))
    assert kept[0] == ["1", "2", "3", "4", "6", "7", "None"]
    assert kept[1] == kept[0][:1] + ["4", "6", "7", "None"]
    assert kept[2] == kept[3] == ["1", "4", "7", "None"]
    assert set(kept[4]) <= set(kept[3]) and "mix_words" in docs.columns
    assert "hunter2" not in "".join(r.text for r in docs.collect())
