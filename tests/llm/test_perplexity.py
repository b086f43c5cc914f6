import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chainloom.llm import perplexity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END, START = "end", "start"


def tokens(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [*WORD.findall(raw), END]


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0
        out.append(d if 0 < d < k else k / 2)
    return out


class Brute:
    """The model from plain dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs, self.context = Counter(), Counter(), Counter()
        for t in texts:
            line = [START, *tokens(t)]
            self.words.update(line[1:])
            self.pairs.update(zip(line, line[1:]))
            self.context.update(line[:-1])
        self.before, self.after = Counter(w for _, w in self.pairs), defaultdict(list)
        for (v, _), c in self.pairs.items():
            self.after[v].append(c)
        self.d2, self.d1 = brute_discounts(self.pairs.values()), brute_discounts(self.before.values())
        self.n, self.v = sum(self.words.values()), len(self.words)

    def one(self, w):
        if not self.pairs:
            return 1 / (self.v + 1)
        b, total = self.before[w], len(self.pairs)
        left = sum(self.d1[min(x, 3)] for x in self.before.values()) / total
        return (b - self.d1[min(b, 3)]) / total + left / (self.v + 1)

    def p(self, v, w):
        if not self.context[v]:
            return self.one(w)
        c = self.pairs[v, w]
        left = sum(self.d2[min(x, 3)] for x in self.after[v]) / self.context[v]
        return (c - self.d2[min(c, 3)]) / self.context[v] + left * self.one(w)

    def row(self, text):
        line = [START, *tokens(text)]
        base = sum(math.log10((self.words[w] + 1) / (self.n + 1 * (self.v + 1))) for w in line[1:])
        return len(line) - 1, sum(self.words[w] > 0 for w in line[1:]), self.n, base, sum(math.log10(self.p(*x)) for x in zip(line, line[1:]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["É", "x" * 40]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 20, 62])]) for _ in range(rng.randrange(40))) for _ in range(200)]
    texts += [None, "", " \n", "W1 w1\tW1", "never met before", "w3 " * 30_000, texts[3], texts[3]]
    return [*enumerate(texts), (None, texts[4]), (None, None), (6, "w1 w2")]


def test_equals_brute_force(make, rows, monkeypatch):
    model = Brute(t for d, t in rows if not held_out(d))
    want = sorted(((str(d), held_out(d), *model.row(t)) for d, t in rows), key=lambda r: (r[0], r[5]))
    monkeypatch.setattr(perplexity, "HELD", 5000)  # several rounds per task
    monkeypatch.setattr(perplexity, "AT_ONCE", 700)
    got = perplexity.score_with_folds(make(rows).repartition(6)).collect()
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda r: (r[0], r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-11, atol=1e-9)


def test_probabilities_sum_to_one(make, rows):
    from chainloom.llm.spans import span_hashes

    plain = Brute(t for _, t in rows)
    model = perplexity.fit(make(rows).where("doc_id is not null or text is not null").unionByName(make([(None, None)])), held=3000)
    assert (model.tokens, model.size, len(model.pairs) > 5) == (plain.n, plain.v, True)
    reader = model.opened()
    known = [w for w in plain.words if w != END] + [b"unknown"]
    hashes = np.concatenate([span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in known] + [np.array([perplexity.END])])
    numbers = reader.numbers(hashes)
    for context in (model.start, model.start + 1, *numbers[:5].tolist()):
        keys = np.sort(np.uint64(context) << np.uint64(32) | numbers)
        assert abs((10.0 ** reader.logs(keys)[0]).sum() - 1) < 1e-9


def test_better_than_the_base_on_held_out_rows(make, prose):
    text = "one two three four five six seven eight nine ten".split()
    rows = [(i, " ".join(text[i % 7 : i % 7 + 4] * 3)) for i in range(300)]
    got = [r for r in perplexity.score_with_folds(make(rows)).collect() if r.held_out]
    assert got and all(r.score > r.base_score and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)


def test_nothing_to_learn_from(make):
    assert perplexity.score_with_folds(make([])).count() == 0
    (row,) = perplexity.score_with_folds(make([(None, "a b")])).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_arrays_survive_a_second_run_of_their_task(tmp_path):
    uri = (tmp_path / "a" / "keys-0").as_uri()
    for _ in range(2):
        perplexity.put_array(uri, np.arange(5, dtype=np.uint64))
    assert perplexity.map_array(uri, np.dtype("<u8")).tolist() == list(range(5)) and len(list((tmp_path / "a").iterdir())) == 1
