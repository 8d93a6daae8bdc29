"""Fingerprints, whitening and divergence against brute force and on awkward tables."""

import hashlib
import os
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import divergence, fingerprints, whitening
from tests.llm.test_corpus import docs_of

LONG = "alpha beta gamma é😀 token=abc_12345 mail " * 6_000
TEXTS = st.lists(st.text("ab é😀", max_size=40), min_size=2, max_size=5)


def in_order(rows):
    """Descending ids, null last; of one id by digest, which ties of equal texts do not need."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abc déf😀\n", k=rng.choice([0, 1, 2, 3, 31, 33, 200, 2_000]))), "en", "s") for i in range(-40, 260)]
    rows += [(1_000 + i, rows[i][1], "en", "s") for i in range(20)] + [(5_000, None, "en", "s"), (5_001, LONG, "en", "s")]
    docs = docs_of(spark, rows).repartition(5)
    got = {r.id: r for r in fingerprints.describe(docs, parts=7).collect()}
    order = in_order(rows)
    assert len(got) == len(rows)
    by_print = {}
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.common_edited, r.common_next) == (len(os.path.commonprefix([text, changed])), len(os.path.commonprefix([text, after])))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert r.near_edited == 1 if text == changed else r.near_edited >= 0.4 - 1 / max(1, len(text))
        assert (r.near_next == 1) == (text == after)
        assert by_print.setdefault(r.fingerprint, text) == text
        assert r.edited_fingerprint == str(fingerprints.Prefixes([changed]).fingerprints()[0])
    assert len(by_print) == len({r[1] or "" for r in rows})
    one = fingerprints.describe(docs, parts=1).drop("row").collect()
    assert {r.id: r for r in one} == got


@given(TEXTS)
def test_spans_and_extensions(texts):
    arrays = fingerprints.Prefixes(texts)
    rng = random.Random(str(texts))
    for _ in range(20):
        a, b = rng.randrange(len(texts)), rng.randrange(len(texts))
        i, j = rng.randint(0, len(texts[a])), rng.randint(0, len(texts[b]))
        at = [np.array([x]) for x in (a, i, b, j)]
        want = len(os.path.commonprefix([texts[a][i:], texts[b][j:]]))
        assert arrays.common(*at)[0] == want
        size = rng.randint(0, min(len(texts[a]) - i, len(texts[b]) - j))
        assert arrays.equal(*at, np.array([size]))[0] == (texts[a][i : i + size] == texts[b][j : j + size])
    for p in arrays.fingerprints():
        assert fingerprints.Fingerprint.parse(str(p)) == p


def test_likeness_of_changed_texts():
    rng = random.Random(1)
    base = "".join(rng.choices("abcdefgh ", k=4_000))
    longer, middle, other = base[:1_900] + "something else" + base[1_900:], base[:900] + "#" + base[901:3_000] + "#" + base[3_001:], "".join(rng.choices("abcdefgh ", k=4_000))
    prints = fingerprints.Prefixes([base, longer, middle, other, base * 300, base * 300 + "x"]).fingerprints()
    near = [fingerprints.likeness(prints[0], p) for p in prints]
    assert near[0] == 1 and near[1] > 0.9 and near[2] > 0.85 and near[3] == 0
    assert 0.98 < fingerprints.likeness(prints[4], prints[5]) < 1  # beyond one chunk


def test_arrays_beyond_a_chunk(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab", k=n)) for n in (700, 3, 0, 1_500)] + ["ab" * 20]
    whole = fingerprints.Prefixes(texts).fingerprints()
    monkeypatch.setattr(fingerprints, "CHUNK", 64)
    monkeypatch.setattr(fingerprints, "_powers", {})
    assert fingerprints.Prefixes(texts).fingerprints() == whole


def test_equal_rows_share_parts_and_rows_that_move_are_an_error(spark):
    rows = [(None, "same", "en", "s")] * 60 + [(7, "same", "en", "s")] * 60 + [(9, "x" * 30, "en", "s")]
    got = fingerprints.describe(docs_of(spark, rows), parts=5).collect()
    assert Counter(r.id for r in got) == {None: 60, 7: 60, 9: 1}
    # The last of all is followed by the first: id 9.
    assert Counter(r.near_next for r in got) == {1.0: 119, 0.0: 2}
    assert [r.edited_sha256 for r in fingerprints.describe(docs_of(spark, [(1, "abcd", "en", "s")])).collect()] == [hashlib.sha256(b"abab").hexdigest()]
    assert fingerprints.describe(docs_of(spark, [])).count() == 0
    with pytest.raises(RuntimeError):
        list(fingerprints._met(iter([__import__("pyarrow").RecordBatch.from_pylist([{"guest": False, "id": 1, "data": __import__("zstandard").compress(b"a")}])]), None))


def brute_whitening(vectors, k=16):
    keep = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in keep])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return keep, n, ((n * x - s) ** 2).sum(axis=1), (n * x - s) / n @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n string, component string")


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 20)) * np.geomspace(40, 0.1, 20)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1_000 + i, rows[7][1]) for i in range(150)] + [(None, rows[3][1]), (5, None), (6, [])]
    rows += [(2_000 + i, [*rows[0][1][:-1], c]) for i, c in enumerate((None, float("nan"), float("inf"), -float("inf")))] + [(3_000, [1.0, 2.0])]
    got = whitening.whiten(vectors_of(spark, [(*r, "a", "b", "c") for r in rows]).repartition(3)).collect()
    keep, n, deviation, white, explained = brute_whitening([r for r in rows if r[1] is None or len(r[1]) == 20])
    assert Counter(r.id for r in got) == {i: 16 * c for i, c in Counter(i for i, _ in keep).items()}
    by = {(r.id, r.component): r for r in got}
    mine = np.array([[by[i, c].whitened for c in range(1, 17)] for i, _ in keep])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-8
    assert all(by[i, 1].deviation == d and by[i, 1].n == n for (i, _), d in zip(keep, deviation, strict=True))
    assert all(abs(by[0, c].explained / explained[c - 1] - 1) < 1e-9 for c in range(1, 17))
    assert 0 <= by[0, 1].identity_error < 1e-9


def test_whitening_of_awkward_tables(spark):
    """Missing rank, spreads far apart, one vector, none, entries whose squares need more than a long."""
    rng = np.random.default_rng(5)
    few = np.round(rng.normal(size=(60, 3)) * [1e5, 10, 1] * 64) / 64
    wide = np.hstack([few, few[:, :1] + few[:, 1:2], np.ones((60, 1)), few[:, :1]])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(wide)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(docs).collect()
    assert max(r.component for r in got) == 3 and len(got) == 180 and got[0].identity_error < 1e-7
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(docs.limit(0)).count() == 0
    large = spark.createDataFrame([(0, [1e15, 0.0]), (1, [-1e15, 1.0]), (2, [3.0, 7.0]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    huge = {r.vec_id: r for r in whitening.whiten(large).withColumnRenamed("id", "vec_id").where("component = 1").collect()}
    assert set(huge) == {0, 1, 2} and huge[0].deviation is None
    assert huge[2].deviation == (3 * 1_000_192 - (3_000_192)) ** 2 + (3 * 1_000_448 - 3_000_512) ** 2


def brute_divergence(rows, min_docs=3, top=200):
    def terms(text):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        return "".join(c if not c.isascii() or c.isalpha() else " " for c in low).split(" ")

    docs = [(lang or "", source or "", [w for w in terms(t) if w]) for _, t, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        met = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, n in met.items() if n >= min_docs}
        sources = {d[1] for d in own}
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2] if w in kept) for s in sources}
        total = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p(counts[s], w), p(counts[o], w)) for w in kept), o) for o in sources - {s}]
            over = [(-f(p(c, w), p(total, w)), w) for c in [counts[s]] for w in kept if c[w] and p(c, w) > p(total, w)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                ordered = sorted(items, key=lambda x: (x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, -value, n) for n, (value, item) in enumerate(ordered, 1)}
    return out


def test_divergence_against_plain_counts(spark):
    rng = random.Random(6)
    vocabulary = [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'é' * (k // 100)}" for k in range(300)]
    rows = []
    for i in range(260):
        source = rng.choice(["s", "s", "s", "t", "u", None])
        skew = {"s": 1, "t": 3, "u": 6, None: 2}[source]
        words = [vocabulary[min(299, int(rng.expovariate(1 / (20 * skew))))] for _ in range(rng.randrange(80))]
        rows.append((i % 50, rng.choice(["_", "9", " ", "-"]).join(rng.choice([w, w.upper(), w.title()]) for w in words), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, None, "xx", "a"), (None, "", "xx", "b"), (1, "only once", "yy", "a"), (1, "here", "yy", "b"), (3, "alone", "zz", None), (8, LONG, "en", "t")]
    docs = docs_of(spark, rows).withColumn("term", F.lit("x")).withColumn("n", F.lit(1))
    got = divergence.divergence_report(docs).collect()
    assert {tuple(r) for r in got} == brute_divergence(rows) and len(got) == len({tuple(r) for r in got})
    assert divergence.divergence_report(docs.limit(0)).count() == 0
    assert {tuple(r) for r in divergence.divergence_report(docs.repartition(3), top=2).collect()} == brute_divergence(rows, top=2)


def test_joint_cells_and_shares(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 64)
    rng = np.random.default_rng(7)
    group, bits = np.repeat(np.arange(1, 6), 4), []
    for _ in range(5):  # disjoint levels of each group
        level = rng.integers(0, 5, 64)
        bits += [sum(1 << t for t in range(64) if level[t] == k) for k in range(1, 5)]
    p, zero = rng.integers(2, 10**9, 20), np.repeat(rng.integers(1, 10**6, 5), 4)
    f = lambda a, b: (int(a) - int(b)) ** 2 // int(b)
    want = Counter()
    for i in range(20):
        for j in range(20):
            if group[i] != group[j]:
                n = bin(bits[i] & bits[j]).count("1")
                want[group[i], group[j]] += n * (f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j]))
    a, b, value = divergence._summed([divergence.joint_gains(group, p, zero, np.array(bits, np.uint64))])
    assert dict(zip(zip(a.tolist(), b.tolist()), value.tolist())) == {k: v for k, v in want.items()}
    rows = [(0, 1), (5, 17), (10**10, 10**12 + 7), (9_000_000_000_000, 9_000_000_000_001)]
    got = spark.createDataFrame(rows, "n long, size long").select("n", "size", divergence.share(F.col("n"), F.col("size")).alias("p")).collect()
    assert all(r.p == 1 + Fraction(10**9 * (r.n + 1), r.size).__floor__() for r in got)
