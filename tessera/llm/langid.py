"""Language identification with interpolated Kneser-Ney character models.

Each language has a character trigram model with absolute discounting: the highest order uses
counts, lower orders continuation counts, every order is interpolated with the one below and
the lowest with a uniform share.  All languages share sorted arrays of packed n-grams with a
row of log probabilities each, so that one binary search serves every language.  A text gets
the language of the lowest cross-entropy per character.

Rejection is calibrated on the learning rows: a text is rejected if its cross-entropy lies far
above what its language shows there, with an allowance for short texts, or if it has no letter.

Fit: ``DOCS_PER_LANGUAGE`` labelled rows of each language on average, chosen by a hash of the id,
are counted in Spark; the n-gram table of that bounded sample is the model.  More languages than
``MAX_LANGUAGES`` are an error, as the model has a column for each.  Scoring reads whole
texts in Arrow batches and shuffles nothing.

Defined results: null, empty or letterless text is ``und`` with score 0 and is rejected; with
nothing to learn from, every text is; equal entropies go to the first language in code-point
order; rows with the same id are scored apart; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

DOCS_PER_LANGUAGE, MAX_LANGUAGES = 2000, 500
SPREADS, PER_CHARACTER = 8.0, 12.0
SLICE_CHARS = 1 << 19
BITS = np.uint64(21)
_fold: list[np.ndarray] = []


def fold() -> np.ndarray:
    """Lower-case letter of each code point, a space for all that is no letter."""
    if not _fold:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold.append(table)
    return _fold[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts, each between spaces, and the text each belongs to."""
    table = fold()
    code = table[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    again = (code[1:] == 32) & (code[:-1] == 32) & (owner[1:] == owner[:-1])
    keep = np.concatenate(([True], ~again)) if len(code) else np.zeros(0, bool)
    return code[keep], owner[keep]


def pack(*columns: np.ndarray) -> np.ndarray:
    out = columns[0].astype(np.uint64)
    for c in columns[1:]:
        out = (out << BITS) | c.astype(np.uint64)
    return out


def trigrams(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = owner[2:] == owner[:-2]
    return pack(code[:-2], code[1:-1], code[2:])[whole], owner[2:][whole]


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for n, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_CHARS:
            yield first, n + 1
            first, size = n + 1, 0
    if first < len(texts):
        yield first, len(texts)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each batch."""
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for a, b in runs(own):
                gram, n = np.unique(trigrams(*characters(own[a:b]))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


class Model:
    """Log probabilities of packed n-grams, a column for each language."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, size = langs, len(langs)
        low = np.uint64((1 << 42) - 1)
        mask = np.uint64((1 << 21) - 1)
        own = []
        for gram, n in tables:
            pairs, pair_n = np.unique(gram & low, return_counts=True)  # types that stand before a pair
            chars, char_n = np.unique(pairs & mask, return_counts=True)
            own.append(((gram, n), (pairs, pair_n), (chars, char_n)))
        self.grams = [np.unique(np.concatenate([o[k][0] for o in own])) for k in range(3)]  # trigrams, pairs, characters
        contexts = [np.unique(g >> BITS) for g in self.grams[:2]]
        self.heads = contexts
        self.backoff = [np.ones((len(c), size)) for c in contexts]
        self.prob = [np.zeros((len(g), size)) for g in self.grams]
        self.floor = np.zeros(size)
        letters = len(self.grams[2]) + 1
        for i, (three, two, one) in enumerate(own):
            discount, share, left = self._discounted(one[1], np.zeros(len(one[0]), np.int64), 1)
            self.floor[i] = left[0] / letters
            self.prob[2][:, i] = self.floor[i]
            self.prob[2][np.searchsorted(self.grams[2], one[0]), i] += share
            for k, (gram, n) in ((1, two), (0, three)):
                head, at = np.unique(gram >> BITS, return_inverse=True)
                _, share, left = self._discounted(n, at, len(head))
                self.backoff[k][np.searchsorted(contexts[k], head), i] = left
                below = self._lookup(k + 1, self.grams[k] & (low if k == 0 else mask), i)
                head_at = np.searchsorted(contexts[k], self.grams[k] >> BITS)
                self.prob[k][:, i] = self.backoff[k][head_at, i] * below
                self.prob[k][np.searchsorted(self.grams[k], gram), i] += share
        self.log = [np.log(p).astype(np.float32) for p in self.prob]
        self.log_backoff = [np.log(b).astype(np.float32) for b in self.backoff]
        self.log_floor = np.log(self.floor).astype(np.float32)
        self.prob = self.backoff = None
        self.centre = np.zeros(size)
        self.spread = np.zeros(size)

    @staticmethod
    def _discounted(n: np.ndarray, at: np.ndarray, heads: int):
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        total = np.bincount(at, n, heads)
        left = discount * np.bincount(at, minlength=heads) / total
        return discount, (n - discount) / total[at], left

    def _lookup(self, k: int, gram: np.ndarray, i: int) -> np.ndarray:
        """Every lower n-gram of a known one is known."""
        return self.prob[k][np.searchsorted(self.grams[k], gram), i]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return at, keys[at] == wanted

    def _logs(self, k: int, gram: np.ndarray) -> np.ndarray:
        at, known = self._find(self.grams[k], gram)
        out = self.log[k][at]
        if not known.all():
            lost = gram[~known]
            if k == 2:
                out[~known] = self.log_floor
            else:
                below = self._logs(k + 1, lost & np.uint64((1 << (21 * (2 - k))) - 1))
                head, seen = self._find(self.heads[k], lost >> BITS)
                out[~known] = below + np.where(seen[:, None], self.log_backoff[k][head], np.float32(0))
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character (text x language), characters, letters."""
        h, chars, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for a, b in runs(texts):
            code, owner = characters(texts[a:b])
            gram, own = trigrams(code, owner)
            n = np.bincount(own, minlength=b - a)
            chars[a:b] = n
            letters[a:b] = np.bincount(owner[code != 32], minlength=b - a)
            if len(gram):
                begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                h[a + own[begin]] = -np.add.reduceat(self._logs(0, gram), begin, axis=0, dtype=np.float64) / n[own[begin], None]
        return h, chars, letters

    def judged(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        h, chars, letters = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        reach = np.minimum(chars, 50)[:, None]
        score = 1 / np.exp((low[:, None] - h) * reach).sum(axis=1)
        most = self.centre[best] + SPREADS * self.spread[best] + PER_CHARACTER / np.sqrt(np.maximum(chars, 1))
        none = letters == 0
        names = ["und" if x else self.langs[i] for i, x in zip(best, none, strict=True)]
        return names, np.where(none, 0.0, score), low, none | (low > most)


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """Learn from a bounded sample of labelled rows outside the held-out fifth."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}  # a row for each language
    if not sizes:
        return None
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(sizes.items())])
    picked = F.pmod(F.xxhash64(F.col("id"), F.lit("langid")), F.lit(1_000_000)) < share * 1_000_000
    sample = rows.where(picked).select("lang", "text")
    grams = sample.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(grams):
        return None
    tables, langs = [], sorted(grams["lang"].unique())
    for lang in langs:
        own = grams[grams["lang"] == lang]
        gram = own["gram"].to_numpy().view(np.uint64)
        order = np.argsort(gram)
        tables.append((gram[order], own["n"].to_numpy()[order]))
    model = Model(langs, tables)

    def own_entropy(batches):
        for batch in batches:
            h, chars, letters = model.entropies(batch.column("text").to_pylist())
            at = np.array([model.langs.index(x) if x in model.langs else 0 for x in batch.column("lang").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(h[np.arange(len(h)), at]), pa.array((chars >= 100) & (letters > 0))], ["lang", "h", "used"])

    seen = sample.mapInArrow(own_entropy, "lang string, h double, used boolean").where("used").groupBy("lang").agg(F.avg("h").alias("centre"), F.stddev_pop("h").alias("spread"))
    about = {r.lang: r for r in seen.collect()}  # a row for each language
    rest = max((r.centre for r in about.values()), default=3.0)
    model.centre = np.array([about[x].centre if x in about else rest for x in langs])
    model.spread = np.array([max(0.15, about[x].spread) if x in about else 0.3 for x in langs])
    return model


def identify(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row: ``carry`` columns, doc_id, held_out, lang_pred, score,
    entropy, rejected."""
    rows = docs.select(*[F.col(c).alias(f"__{c}") for c in carry], F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    own = [c for c in rows.columns if c != "text" or c in carry]
    kind = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own) + ", lang_pred string, score double, entropy double, rejected boolean"

    def judge(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if model is None:
                names, score, low, out = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                names, score, low, out = model.judged(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64()), pa.array(out, pa.bool_())], [*own, "lang_pred", "score", "entropy", "rejected"])

    out = rows.mapInArrow(judge, kind)
    return out.withColumnsRenamed({f"__{c}": c for c in carry}) if carry else out


def drop_rejected(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", **options) -> DataFrame:
    """The rows of ``docs`` that are in one of the learned languages, with their columns."""
    model = fit(docs, id_col, text_col, lang_col, **options)
    names = [f"c{n}" for n in range(len(docs.columns))]  # columns may clash with the report's
    given = docs.toDF(*names)
    at = dict(zip(docs.columns, names, strict=True))
    judged = identify(given, model, at[id_col], at[text_col], carry=tuple(names))
    return judged.where(~F.col("rejected")).select(*[F.col(n).alias(c) for c, n in at.items()])
