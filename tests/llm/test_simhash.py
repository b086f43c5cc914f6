import numpy as np
import pytest
import xxhash

from chainloom.llm import simhash


def plain(text):
    """The contract's fingerprint, bit by bit."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("words,radius,n", [(1, 3, 300), (1, 3, 1), (1, 3, 64), (4, 48, 200), (8, 92, 150), (1, 0, 70), (2, 9, 130)])
def test_sliced_links_match_all_pairs(words, radius, n):
    rng = np.random.default_rng(n)
    prints = rng.integers(0, 2**63, (20, words), dtype=np.uint64)[rng.integers(0, 20, n)]
    for i in range(n):
        for b in rng.integers(0, 64 * words, rng.integers(0, 4 * words)):
            prints[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= radius
    expect = np.arange(n)
    simhash.join_roots(expect, *np.nonzero(np.triu(near, 1)))
    assert (simhash.sliced_links(prints, np.full(n, n), radius) == expect).all()


def test_tables_meet_every_pair_within_the_radius():
    rng = np.random.default_rng(2)
    for rows in (10, 10**8, 10**11):
        tables = simhash.exact_tables(64, 3, rows)
        for _ in range(300):
            flipped = set(rng.choice(64, 3, replace=False).tolist())
            assert any(flipped.isdisjoint(t.tolist()) for t in tables)


def brute(rows):
    prints = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted((str(d), f"{p:016x}", str(ids.get(find(i)))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))


def test_components_match_brute_force(make, prose, monkeypatch):
    rows = [(i, prose(60, i // 3) + (" tail" if i % 3 else "")) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "one"), (103, "One"), (104, "  two words\n"), (None, prose(60, 1)), (5, prose(60, 99)), (5, prose(60, 99)), (None, prose(40, 77))]
    for chunk in (1 << 14, 4):  # the second splits buckets into pairs of chunks
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(make(rows)).collect())
        assert got == brute(rows)


def test_one_row_of_each_group_stays(make, prose):
    base = prose(200, 3).split()
    near = base.copy()
    near[50], near[120] = "changed", "again"
    rows = [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (7, prose(200, 8)), (8, prose(200, 9)), (8, prose(200, 9)), (None, prose(200, 10)), (None, prose(200, 10)), (None, " ".join(base))]
    kept = simhash.deduplicated(make(rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "7", "8", "None"]
    assert kept.columns == make(rows).columns
    assert simhash.deduplicated(make([])).count() == 0 and simhash.near_duplicates(make([])).count() == 0


def test_few_pairs_of_similarity_four_fifths_lie_beyond_the_fuzzy_radius():
    rng, beyond = np.random.default_rng(4), 0
    how = {k: simhash.FUZZY[k] for k in ("width", "words")}
    for _ in range(200):
        a = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        b = a.copy()
        for i in range(20, 380, 40):  # nine changed words: 351 of 441 five-word shingles are shared
            b[i] = f"x{rng.integers(5000)}"
        apart = simhash.fingerprint(" ".join(a), **how) ^ simhash.fingerprint(" ".join(b), **how)
        beyond += int(np.bitwise_count(apart).sum()) > simhash.FUZZY["radius"]
    assert beyond <= 20
    other = simhash.fingerprint(" ".join(f"y{x}" for x in rng.integers(0, 5000, 400)), **how)
    assert np.bitwise_count(simhash.fingerprint(" ".join(a), **how) ^ other).sum() > 150
