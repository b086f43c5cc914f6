import numpy as np
import pytest

from chainloom.llm import jaccard, simhash


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def roots(n, near):
    parent = np.arange(n)
    simhash.join_roots(parent, *np.nonzero(near))
    return parent.tolist()


def test_forest_matches_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.integers(0, 2**63, (4, 40), dtype=np.uint64)
        sets = [np.unique(rng.choice(base[rng.integers(4)], rng.integers(0, 40), replace=False)) for _ in range(30)]
        near = [[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) > 0 for b in sets] for a in sets]
        parent = jaccard.jaccard_forest(sets)
        simhash.join_roots(top := np.arange(30), np.arange(30), parent)
        assert top.tolist() == roots(30, np.array(near))


def test_bands_miss_few_pairs_at_four_fifths():
    rng = np.random.default_rng(8)
    for n in (4, 36, 400):  # of n + n / 4 shingles n are shared
        met = 0
        for _ in range(300):
            whole = rng.integers(0, 2**63, n + n // 4, dtype=np.uint64)
            met += bool((jaccard.band_keys(whole) == jaccard.band_keys(whole[:n])).any())
        assert met >= 299


@pytest.mark.parametrize("chunk", [1 << 21, 60])  # the second splits components into pairs of chunks
def test_groups_are_those_of_the_exact_similarity(make, prose, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    texts = []
    for seed in range(12):
        words = prose(8, seed).split()
        texts += [" ".join(words), " ".join([*words, "added"]), " ".join([*words, "added", "more", "still"])]  # 0.8, then below
        ten = prose(10, 100 + seed).split()
        texts += [" ".join(ten), " ".join([*ten[:-1], "other"])]  # 5 of 7 shingles: 0.71
        long = prose(150, 200 + seed).split()
        for step in (23, 31, 43, 60):
            texts.append(" ".join(f"x{i}" if i % step == 10 else w for i, w in enumerate(long)))
    near = np.array([[alike(a, b) >= 0.8 for b in texts] for a in texts])
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(make(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), near)
    kept = {r.doc_id for r in simhash.deduplicated(make(list(enumerate(texts)))).collect()}
    assert kept == set(roots(len(texts), near))


def test_filter_holds_every_key(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), jaccard.FILTER_BITS, jaccard.FILTER_BITS + 5, *(jaccard.text_key(str(i)) for i in range(500))]
    found = jaccard.key_filter(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert all(jaccard.in_filter(found, k) for k in keys)
    assert sum(jaccard.in_filter(found, jaccard.text_key(f"x{i}")) for i in range(2000)) < 5


def test_fingerprints_meet_where_sets_are_alike():
    rng = np.random.default_rng(8)
    tables = simhash.sampled_tables(512, jaccard.FUZZY["differing"], 10**6, jaccard.FUZZY["miss"], bucket=jaccard.FUZZY["bucket"])
    for n in (4, 36, 400):  # of n + n / 4 shingles n are shared
        met = 0
        for _ in range(300):
            whole = rng.integers(0, 2**63, n + n // 4, dtype=np.uint64)
            a, b = (np.unpackbits(simhash.set_fingerprint(s, 8).astype(">u8").view(np.uint8)) for s in (whole, whole[:n]))
            met += bool((a != b).sum() <= jaccard.FUZZY["radius"] and any((a[t] == b[t]).all() for t in tables))
        assert met >= 297


def test_candidates_come_from_fingerprints(make, prose, monkeypatch):
    words = prose(150, 1).split()
    docs = make([(1, " ".join(words)), (2, " ".join([*words, "added"])), (3, prose(150, 2))])
    met = []
    monkeypatch.setattr(jaccard, "links", lambda prints, **how: met.append(prints.count()) or simhash.links(prints, **how))
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert met == [3]


def test_near_copies_are_handed_on_once_not_once_a_table(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, 512)
    bits = np.array([*((base ^ (rng.random(512) < 0.06)) for _ in range(200)), *rng.integers(0, 2, (20, 512))], np.uint8)
    prints = spark.createDataFrame([(bytearray(np.packbits(b).tobytes()),) for b in bits], "fingerprint binary").distinct()
    found = simhash.links(prints, **jaccard.FUZZY).collect()
    assert len(found) <= 2 * len(bits)  # one pass over all tables made some 80 times as many
    at = {np.packbits(b).tobytes(): i for i, b in enumerate(bits)}
    parent = np.arange(len(bits))
    simhash.join_roots(parent, np.array([at[bytes(r.a)] for r in found]), np.array([at[bytes(r.b)] for r in found]))
    near = (bits[:, None] != bits[None]).sum(axis=2) <= jaccard.FUZZY["radius"]
    assert parent.tolist() == roots(len(bits), near)
