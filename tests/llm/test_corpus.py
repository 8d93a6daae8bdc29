import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, langid, mixing, near_dedup, quality, token_counts
from tessera.llm import textkernel as tk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, class string"


def docs_of(spark, rows):
    """(doc_id, text, lang, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 0, "d", 1, "c") for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_word_hashes_tell_words_apart():
    texts = ["Ab é-cd", "", "ab", "x" * 3000, "CD ab"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashes, length, begins = tk.word_hashes(np.frombuffer(data, np.uint8), offsets)
    plain = [words(t) for t in texts]
    assert list(np.diff(begins)) == [len(w) for w in plain]
    flat = [x for w in plain for x in w]
    assert all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    assert list(length) == [len(w.encode()) for w in flat]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: (F.crc32(t.cast("binary")) % 5).cast("string")])
def test_exact_dedup(spark, digest):
    """Also with a digest that collides all the time: full bytes decide."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None, "", "A", "a "] + [f"t{k}" for k in range(9)]), "en", "s") for i in range(300)]
    rows += [(None, "a", "en", "s"), (299, rows[299][1], "en", "s"), (7, rows[7][1], "en", "s")]
    docs = docs_of(spark, rows)
    got = exact_dedup.exact_groups(docs, digest=digest).collect()
    groups: dict = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want = Counter((i, max(x for x in groups[t or ""] if x is not None), len(groups[t or ""])) for i, t, *_ in rows)
    assert Counter((r.id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.id == r.keep_id for r in got if r.kept)
    left = exact_dedup.drop_exact_copies(docs, digest=digest)
    assert left.columns == docs.columns
    assert sorted(((r.text or ""), r.doc_id) for r in left.collect()) == sorted((t, max(x for x in g if x is not None)) for t, g in groups.items())


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_groups(docs_of(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: (F.crc32(t.cast("binary")) % 5).cast("string")])
@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_dedup_goes_on_from_its_state(spark, tmp_path, digest, broadcast_rows):
    """Three runs under one place; hits between runs are compared by their bytes too, and a run
    that is repeated counts once."""
    rng = random.Random(3)
    place, sofar = f"file://{tmp_path}/place", []
    for run in range(3):
        rows = [(100 * run + i, rng.choice(["a", "b", None, "", "long " * 9_000] + [f"t{k}" for k in range(9)]), "en", "s") for i in range(40)]
        sofar += rows
        groups: dict = {}
        for i, t, *_ in sofar:
            groups.setdefault(t or "", []).append(i)
        want = {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t, *_ in rows}
        for _ in range(1 + (run == 1)):
            got = exact_dedup.exact_groups(docs_of(spark, rows), digest=digest, place=place, run=run, broadcast_rows=broadcast_rows).collect()
            assert {r.id: (r.keep_id, r.group_size, r.kept) for r in got} == want and len(got) == len(rows)


def brute_classes(rows):
    bags = {}
    for i, t, *_ in rows:
        w = words(t)
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    up = {i: i for i in bags}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both, any_ = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if both and both >= 0.8 * any_ - 1e-9:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("small", [8, 2])
def test_near_dedup_against_brute_force(spark, small):
    """With ``small`` at 2 almost every bucket takes the path of crowded ones."""
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(500)]
    rows = [(0, None, "en", "s"), (1, "", "en", "s"), (2, "One", "en", "s"), (3, "one!", "en", "s"), (4, "two words", "en", "s"), (5, "la " * 400, "en", "s"), (6, "la " * 395, "en", "s")]
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randrange(5, 300))
        for _ in range(rng.choice([1, 2, 3, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(own), "en", "s"))
    docs = docs_of(spark, rows)
    got = {r.id: r for r in near_dedup.near_classes(docs, small=small).collect()}
    want = brute_classes(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == set(want.values())
    left = near_dedup.drop_near_copies(docs, small=small)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(want.values())
    twice = near_dedup.drop_near_copies(docs.union(docs))
    assert Counter(r.doc_id for r in twice.collect()) == Counter(set(want.values()))


def test_near_dedup_in_a_family_just_below_the_limit(spark):
    """289 texts of one form with ten words of each text's own: any two are at 0.789 or 0.799, and
    those that have one of these words in common at 0.809."""
    p, filled = 17, 10
    form = [f"w{k}" for k in range(854)]
    places = {(u, v): [i * p + (u * i + v) % p for i in range(filled)] for u in range(p) for v in range(p)}
    texts, pairs, free = {}, [], set(places)
    for at in sorted(places):
        own = texts[at] = list(form)
        for s in places[at]:
            own[5 * s + 4] = f"x{len(texts)}y{s}"
    for at in sorted(places):
        mate = next((o for o in sorted(free - {at}) if set(places[o]) & set(places[at])), None)
        if len(pairs) < 40 and at in free and mate:
            s = (set(places[at]) & set(places[mate])).pop()
            texts[mate][5 * s + 4] = texts[at][5 * s + 4]
            pairs.append((at, mate))
            free -= {at, mate}
    number = {at: n for n, at in enumerate(sorted(places))}
    rows = [(number[at], " ".join(t), "en", "s") for at, t in texts.items()]
    want = {n: n for n in number.values()} | {max(number[a], number[b]): min(number[a], number[b]) for a, b in pairs}
    bags = [{tuple(t[j : j + 5]) for j in range(850)} for t in (texts[at] for at in sorted(places))]
    near = {(b, a) for a in range(len(bags)) for b in range(a) if len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])}
    assert len(pairs) == 40 and near == {tuple(sorted((number[a], number[b]))) for a, b in pairs}
    assert {r.id: r.class_id for r in near_dedup.near_classes(docs_of(spark, rows)).collect()} == want


def test_near_dedup_of_nothing(spark):
    assert near_dedup.near_classes(docs_of(spark, [])).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    for n, same in ((40, 0.8), (900, 0.6)):
        shared = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        extra = int(n * (1 / same - 1) / 2)
        a, b = (np.concatenate((shared, rng.integers(0, 2**63, extra, dtype=np.int64).astype(np.uint64))) for _ in range(2))
        x, y = (near_dedup.signature(near_dedup.units_of(s), 2048) for s in (a, b))
        assert abs((x == y).mean() - n / (n + 2 * extra)) < 0.05


TEXT = {"en": "the quick brown fox jumps over the lazy dog and then some more of that with", "de": "der schnelle braune fuchs springt über den faulen hund und dann noch etwas mit dem", "fr": "le renard brun rapide saute par dessus le chien paresseux et puis encore un peu avec"}


def lang_rows(n=240):
    rng = random.Random(6)
    out = []
    for i in range(n):
        lang = rng.choice(list(TEXT))
        out.append((i, " ".join(rng.choices(TEXT[lang].split(), k=rng.randrange(4, 60))), lang, "s"))
    return out


def test_language_id(spark):
    rows = lang_rows()
    edge = [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "123 !?", None, "s"), (1003, "xq zvk wjqx zzkq vvqx jjkw qqzx kkvj " * 5, None, "s"), (1004, "the dog " * 20_000, None, "s")]
    docs = docs_of(spark, rows + edge)
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert len(got) == len(rows) + len(edge)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 for i in got)
    held = [(i, lang) for i, _, lang, _ in rows if got[i].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (1000, 1001, 1002))
    assert got[1003].rejected and got[1003].lang_pred in TEXT and got[1004].lang_pred == "en" and not got[1004].rejected
    assert not any(got[i].rejected for i, *_ in rows)
    left = langid.drop_rejected(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in got if not got[i].rejected}


def test_language_id_with_nothing_to_learn(spark):
    docs = docs_of(spark, [(1, "some text", None, "s")])
    assert [r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()] == ["und"]
    assert langid.identify(docs_of(spark, []), None).count() == 0


def test_kneser_ney_sums_to_one(spark):
    docs = docs_of(spark, lang_rows())
    model = langid.fit(docs)
    letters = model.grams[2]
    head = langid.pack(np.array([ord("t")]), np.array([ord("h")]))[0]
    probs = np.exp(model._logs(0, (np.full(len(letters), head) << langid.BITS) | letters))
    assert np.all(probs.sum(axis=0) <= 1.0001) and np.all(probs.sum(axis=0) > 0.97)


def test_quality(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        w = rng.choices(TEXT["en"].split(), k=rng.randrange(20, 80))
        rows.append((i, " ".join(w) + "." if good else " ".join(x + rng.choice(["***", "$$$", "###"]) for x in w), "en", "s"))
        labels.append((i, int(good)))
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "a b " * 30_000, "en", "s")]
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, known)).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    none = quality.fit(docs, known.where("false"))
    assert none == 0.5 and quality.score(docs, none).where("score = 0.5").count() == len(rows)
    assert quality.fit(docs, known.where("quality = 1")) == 1.0


def test_factorisation_identity():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.default_rng(1)
    text = "some words *** and SOME more 12\nlines lines".encode()
    own, bucket, value, stats = quality.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    size = quality.BUCKETS + stats.shape[1]
    m = quality.Model(0.1, rng.normal(size=size), rng.normal(size=(size, 3)) * 0.1, np.zeros(stats.shape[1]), np.ones(stats.shape[1]))
    at = [*bucket, *range(quality.BUCKETS, size)]
    x = [*value, *m.standard(stats)[0]]
    z = 0.1 + sum(m.w[i] * a for i, a in zip(at, x, strict=True))
    z += sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert abs(m.score(own, bucket, value, stats)[0] - 1 / (1 + np.exp(-z))) < 1e-9


def fill(sizes, weights, most=3):
    """Targets by sharing again and again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["x"] * rng.choice([0, 1, 3, 50, 400])), "en", rng.choice(["a", "a", "a", "b", "c", None, "d"])) for i in range(400)]
    rows += [(1000, None, "en", "b"), (1001, "  a b", "en", "e"), rows[3], rows[3]]
    docs = docs_of(spark, rows)
    good = spark.createDataFrame([(i, 2.0) for i in range(0, 400, 2)], "id long, weight double")
    got = mixing.mix(docs, quality=good).collect()
    again = mixing.mix(docs.repartition(7), quality=good).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    target = dict(zip(names, fill([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    of = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.taken <= 3 * r.size and abs(r.target - target[of[r.id]]) < 1e-6 and r.source_size == size[of[r.id]]
        assert r.taken >= r.size * int(r.target // max(1, r.source_size))
        taken[of[r.id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_token_rollup(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().count() == 0
    docs = docs_of(spark, [(1, "a b", "en", "s"), (2, None, None, None), (3, "c", "en", "s"), (3, "c", "en", "s")])
    first = token_counts.word_inserts(docs)
    assert rollup.apply("one", first) and not rollup.apply("one", first)
    now = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert now() == {("s", "en", "words-1"): (3, 4), (None, None, "words-1"): (1, 0)}
    kind = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    rollup.apply("two", spark.createDataFrame([("revise", "s", "en", "words-1", 5, 2), ("delete", None, None, "words-1", 0, None)], kind))
    assert now() == {("s", "en", "words-1"): (3, 7)}
    with pytest.raises(Exception):
        rollup.apply("three", spark.createDataFrame([("drop", "s", "en", "words-1", 1, None)], kind))
    assert not rollup.committed("three")  # a failed batch counts for nothing and can be sent again
    rollup.apply("four", first.where("false"))
    assert now() == {("s", "en", "words-1"): (3, 7)}
    assert {tuple(r) for r in rollup.compact(f"file://{tmp_path}/other").totals().collect()} == {("s", "en", "words-1", 3, 7)}


def test_byte_bpe_counts(spark):
    from tessera.llm.queries import TOKENIZER

    texts = ["Hello world, it's 42!", "é😀 x", "", None, "  a\n\nb  "]
    docs = docs_of(spark, [(i, t, "en", str(i)) for i, t in enumerate(texts)])
    got = {r.source: r.tokens for r in token_counts.bpe_inserts(docs, TOKENIZER, "v").collect()}
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    assert got == {str(i): len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_pipeline_keeps_and_drops(spark, tmp_path):
    import corpus_pipeline

    rows = lang_rows(200)
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices(TEXT[lang].split(), k=60)), lang, f"s{i % 4}") for i, _, lang, _ in rows]
    bench = " ".join(rng.choices(TEXT["en"].split(), k=30))
    rows += [(500, rows[0][1], rows[0][2], "s1"), (501, rows[1][1] + " more", rows[1][2], "s1"), (502, "the dog " + bench, "en", "s1"), (503, "!!!", "en", "s2")]
    base = f"{tmp_path}/in"
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, base).collect()}
    assert got == {r[0] for r in rows} - {0, 501, 502, 503}
