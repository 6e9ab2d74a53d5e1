"""Scores of abusive, hateful or sexually explicit content.

A linear softmax over the average of subword vectors, vectors and weights trained jointly in numpy on the
labelled documents: a word's vector is the mean of those of its character n-grams, so unseen misspellings
share most of them with what was seen. Documents are judged passage by passage (sentences, or windows of
words), as one line of abuse in a long text is enough; since labels are given per document, training
alternates between fitting and choosing which passages of an excluded document carry the label, each fold's
passages being chosen by a model that has not seen them.

The threshold is not set by hand: held-out scores of the labelled documents give the share of excluded ones
that a threshold keeps, the scores of all documents give how many it finds, and the one with the best
expected F1 over the whole collection is taken.

Defined results: a null or blank text has score 0; every row of documents gets the score of its own text;
repeated rows repeat in the scores and count once among the found; labels with null document, label or
text are ignored, votes on a document are averaged per rater and then over raters, ties left out; at most
LABELLED documents with LABELLED_CHARS characters are fitted on, chosen by hash; without labels of both kinds
nothing can be learned: scores are null and nothing is found; long texts are scored whole; an empty table
gives an empty result. Only named columns are read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .mixing import source_name

#: Labelled documents that are fitted on at most, and the characters they may have together.
LABELLED, LABELLED_CHARS = 2_000, 1 << 25
#: Hashed features, length of their vectors, character n-grams, words of a window and of a step.
FEATURES, DIMS, GRAMS, WINDOW, STEP = 1 << 17, 8, (3, 4, 5), 10, 3
#: Passes of training, its step, the pull of vectors to zero, rounds of choosing passages, and folds.
EPOCHS, RATE, DECAY, ROUNDS, FOLDS = 40, 0.3, 3e-5, 2, 3
#: How much a pair of words counts beside one word, and the weight a window is taken to have at least: few words prove little.
PAIR_WEIGHT, LEAST = 3.0, 14.0
#: Share of the whole training weight that goes to passages of excluded documents.
EXCLUDED_PART = 0.35
#: Characters of texts that are scored at a time, and words a worker remembers.
GROUP_CHARS, KNOWN = 1 << 22, 500_000

_LEET = str.maketrans("013457@$!|€", "oieastasiie")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){2,}\w(?!\w)")
_GAP = re.compile(r"[ .\-_*]")
_URL = re.compile(r"https?://\S+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_INVISIBLE = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]")
#: A word (apostrophes and signs that stand for letters inside), or the end of a passage.
_TOKEN = re.compile(r"[^\W_]+(?:['’*@$!€]+[^\W_]+)*|[.!?…;]+(?=\s|$)|\n+|>>|(?<=\s)[-–—](?=\s)|[•|]")
_QUOTES = re.compile(r"['’*]")
_LONG = re.compile(r"(.)\1{2,}")
_MASK = FEATURES - 1
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def tokens(text: str) -> list[str]:
    """Words and ends of passages of a whole text: spaced spellings joined, identifiers taken apart, addresses one word."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = _SPACED.sub(lambda m: _GAP.sub("", m[0]), text)
    if "://" in text:
        text = _URL.sub(" codeword ", text)
    return _TOKEN.findall(_HUMP.sub(" ", text).lower())


def folded(token: str) -> str:
    """A word with leet spellings and stretched letters folded; '' for the end of a passage."""
    if not token[0].isalnum():
        return ""
    if token.isdigit():
        return "0"
    if not token.isalpha():
        token = _QUOTES.sub("", token.translate(_LEET))
    return _LONG.sub(r"\1\1", token)


def word_features(word: str) -> list[int]:
    """The word itself and its character n-grams."""
    marked = f"<{word}>"
    return [xxhash.xxh32_intdigest(marked) & _MASK, *(xxhash.xxh32_intdigest(marked[i : i + n], n) & _MASK for n in GRAMS for i in range(len(marked) - n + 1))]


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """The feature of each word's hash with the next one's."""
    x = (hashes[:-1] * _ODD + hashes[1:]) * _MIX
    return ((x ^ (x >> np.uint64(29))) & np.uint64(_MASK)).astype(np.int64)


class Words:
    """Numbers of words, 0 for the end of a passage; folding and hashing are done once per distinct word."""

    def __init__(self) -> None:
        self.words, self.hashes = [""], [0]
        self._raw: dict[str, int] = {}
        self._folded: dict[str, int] = {"": 0}

    def _new(self, token: str) -> int:
        w = folded(token)
        c = self._folded.get(w)
        if c is None:
            c = self._folded[w] = len(self.words)
            self.words.append(w)
            self.hashes.append(xxhash.xxh3_64_intdigest(w))
        self._raw[token] = c
        return c

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' words on end, a 0 after each text, and where each text begins."""
        out: list[int] = []
        starts = []
        known = self._raw.get
        for t in texts:
            starts.append(len(out))
            for x in tokens(t):
                c = known(x)
                out.append(self._new(x) if c is None else c)
            out.append(0)
        return np.array(out, dtype=np.int64), np.array(starts, dtype=np.int64)


def windows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin and end: each passage, or if it is long windows of it that overlap."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (codes > 0).view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    size = end - begin
    per = np.where(size <= WINDOW, 1, -(-(size - WINDOW) // STEP) + 1)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(begin, per) + k * STEP
    return start, np.minimum(start + WINDOW, np.repeat(end, per))


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _weight_of(size: np.ndarray) -> np.ndarray:
    return np.maximum(size + PAIR_WEIGHT * (size - 1), LEAST)


class Model:
    """weight[f]: what feature f adds to the margin of the excluded class; the average over a window's weights is its margin."""

    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight, bias
        self._words, self._values = Words(), [0.0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The highest probability of each text's windows, 0 without any."""
        out, i = np.zeros(len(texts)), 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j] or "") <= GROUP_CHARS):
                chars += len(texts[j] or "")
                j += 1
            out[i:j] = self._group([t or "" for t in texts[i:j]])
            i = j
        return out

    def _group(self, texts: list[str]) -> np.ndarray:
        if len(self._values) > KNOWN:
            self._words, self._values = Words(), [0.0]
        codes, starts = self._words.codes(texts)
        for w in self._words.words[len(self._values) :]:
            self._values.append(float(self.weight[word_features(w)].mean()))
        begin, end = windows(codes)
        best = np.full(len(texts), -np.inf)
        if len(begin):
            pair = self.weight[pair_features(np.array(self._words.hashes, dtype=np.uint64)[codes])]
            pair[(codes[:-1] == 0) | (codes[1:] == 0)] = 0
            single = np.concatenate([[0.0], np.cumsum(np.array(self._values)[codes])])
            double = np.concatenate([[0.0], np.cumsum(pair, dtype=np.float64), [0.0]])
            margin = (single[end] - single[begin] + PAIR_WEIGHT * (double[end - 1] - double[begin])) / _weight_of(end - begin)
            np.maximum.at(best, np.searchsorted(starts, begin, side="right") - 1, margin + self.bias)
        return np.where(np.isfinite(best), _probability(np.where(np.isfinite(best), best, 0.0)), 0.0)


class _Sums:
    """Sums of rows by a fixed index, as runs of one sorted order."""

    def __init__(self, index: np.ndarray) -> None:
        self.order = np.argsort(index, kind="stable")
        self.keys, self.at = np.unique(index[self.order], return_index=True)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(rows[self.order], self.at, axis=0) if len(self.at) else rows[:0]


class _Table:
    """Windows as rows of distinct words and pairs, and those as bags of features."""

    def __init__(self, codes: np.ndarray, words: Words, begin: np.ndarray, end: np.ndarray) -> None:
        at = begin[:, None] + np.arange(WINDOW)
        inside = at < end[:, None]
        at = np.minimum(at, len(codes) - 1)
        pairs = np.concatenate([pair_features(np.array(words.hashes, dtype=np.uint64)[codes]), [0]])
        w, self.word = np.unique(np.where(inside, codes[at], 0), return_inverse=True)
        p, self.pair = np.unique(np.where(inside[:, 1:], pairs[at[:, :-1]], -1), return_inverse=True)
        self.word, self.pair = self.word.reshape(len(begin), -1), self.pair.reshape(len(begin), -1)
        bags = [word_features(words.words[c]) if c else [] for c in w]
        self.of_word = np.repeat(np.arange(len(w)), [len(b) for b in bags])
        feature = np.array([f for b in bags for f in b], dtype=np.int64)
        self.used = np.unique(np.concatenate([feature, p[p >= 0]]))
        self.feature = np.searchsorted(self.used, feature)
        self.part = np.array([1 / len(b) for b in bags for _ in b], dtype=np.float32)[:, None]
        self.has_pair = (p >= 0)[:, None]
        self.pair_feature = np.searchsorted(self.used, np.maximum(p, 0)).clip(0, max(len(self.used) - 1, 0))
        self.n_words, self.total = len(w), _weight_of(end - begin).astype(np.float32)[:, None]
        self.by_word, self.by_pair = _Sums(self.word.ravel()), _Sums(self.pair.ravel())
        self.by_feature, self.into_word = _Sums(self.feature), _Sums(self.of_word)
        self.by_pair_feature = _Sums(self.pair_feature)

    def average(self, vectors: np.ndarray) -> np.ndarray:
        """Each window's average of its words' and pairs' vectors."""
        word = np.zeros((self.n_words, vectors.shape[1]), dtype=vectors.dtype)
        word[self.into_word.keys] = self.into_word(vectors[self.feature] * self.part)
        pair = vectors[self.pair_feature] * self.has_pair
        return (word[self.word].sum(1) + PAIR_WEIGHT * pair[self.pair].sum(1)) / self.total

    def spread(self, rows: np.ndarray) -> np.ndarray:
        """The gradient of the features' vectors, from that of the averages."""
        rows = rows / self.total
        word = self.by_word(np.repeat(rows, self.word.shape[1], axis=0))
        pair = PAIR_WEIGHT * self.by_pair(np.repeat(rows, self.pair.shape[1], axis=0)) * self.has_pair
        out = np.zeros((len(self.used), rows.shape[1]), dtype=rows.dtype)
        out[self.by_feature.keys] += self.by_feature(word[self.of_word] * self.part)
        out[self.by_pair_feature.keys] += self.by_pair_feature(pair)
        return out


def train(table: _Table, label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = 10) -> tuple[np.ndarray, float]:
    """Vectors of the used features and softmax weights, jointly, by full-batch AdaGrad; folded into one weight per used feature."""
    rng = np.random.default_rng(seed)
    n = len(table.used)
    vec = (rng.standard_normal((n, DIMS)) * 0.05).astype(np.float32)
    out, bias = (rng.standard_normal((DIMS, 2)) * 0.5).astype(np.float32), np.zeros(2, dtype=np.float32)
    gv, go, gb = np.full((n, DIMS), 1e-8, np.float32), np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    scale = (weight / weight.sum()).astype(np.float32)[:, None]
    hot = np.stack([1 - label, label], axis=1).astype(np.float32)
    for _ in range(epochs):
        hidden = table.average(vec)
        z = hidden @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - hot) * scale
        do, db = hidden.T @ error, error.sum(0)
        g = table.spread(error @ out.T) + decay * vec
        gv += g * g
        vec -= rate * g / np.sqrt(gv)
        go += do * do
        gb += db * db
        out -= 0.1 * rate * do / np.sqrt(go)
        bias -= rate * db / np.sqrt(gb)
    return vec @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def fit(texts: list[str], votes: list[float], rounds: int = ROUNDS, folds: int = FOLDS) -> tuple[Model | None, np.ndarray]:
    """votes: share of raters for exclusion, per text. The model, and each text's score by a model that has not seen it.

    At first every window of an excluded document that no fine document has shares its label; then those do
    that stand out most to a model of the other folds.
    """
    y = np.array(votes, dtype=np.float64) > 0.5
    if not y.any() or y.all():
        return None, np.zeros(len(texts))
    words = Words()
    codes, starts = words.codes(texts)
    begin, end = windows(codes)
    doc = np.searchsorted(starts, begin, side="right") - 1
    text_of = [codes[a:b].tobytes() for a, b in zip(begin, end)]
    fine = {t for t, d in zip(text_of, doc) if not y[d]}
    seen: set = set()
    keep = []
    for i, (t, d) in enumerate(zip(text_of, doc)):
        key = (d, t) if y[d] else t
        if not (y[d] and t in fine) and key not in seen:
            seen.add(key)
            keep.append(i)
    begin, end, doc = begin[keep], end[keep], doc[keep]
    if not len(begin) or not y[doc].any():
        return None, np.zeros(len(texts))
    table, excluded = _Table(codes, words, begin, end), y[doc]
    label, share, trust = excluded.astype(np.float32), np.ones(len(doc), np.float32), np.ones(len(doc), np.float32)
    share[excluded] = 1 / np.bincount(doc[excluded], minlength=len(y))[doc[excluded]]
    # Folds by place in the order given, within each class, so that every fold has both.
    fold_of = np.zeros(len(y), dtype=np.int64)
    for c in (y, ~y):
        fold_of[c] = np.arange(c.sum()) % folds
    fold = fold_of[doc]

    def fitted(use: np.ndarray) -> tuple[np.ndarray, float]:
        weight = share * trust * use
        for which, part in ((label > 0, EXCLUDED_PART), (label == 0, 1 - EXCLUDED_PART)):
            if (total := weight[which].sum()) > 0:
                weight[which] *= part / total
        return train(table, label, weight)

    p = np.zeros(len(doc))
    for _ in range(rounds):
        for k in range(folds):
            margin, bias = fitted((fold != k).astype(np.float32))
            z = table.average(margin[:, None])[:, 0] + bias
            p[fold == k] = _probability(z)[fold == k]
        usual = float(np.quantile(p[~excluded], 0.99)) if (~excluded).any() else 0.5
        top = np.zeros(len(y))
        np.maximum.at(top, doc, p)
        chosen = excluded & (p >= 0.8 * top[doc])
        label = chosen.astype(np.float32)
        share = np.where(chosen, 1 / np.maximum(np.bincount(doc[chosen], minlength=len(y))[doc], 1), 1.0).astype(np.float32)
        # Raters err: an excluded document of which nothing looks like it counts little, and so do fine windows that do.
        trust = np.where(chosen & (top[doc] <= max(usual, 0.2)), 0.02, 1.0).astype(np.float32)
        trust[~excluded & (p > max(usual, 0.6))] = 0.2
    held = np.zeros(len(y))
    np.maximum.at(held, doc, p)
    margin, bias = fitted(np.ones(len(doc), dtype=np.float32))
    weight = np.zeros(FEATURES, dtype=np.float32)
    weight[table.used] = margin
    return Model(weight, bias), held


def threshold(held: np.ndarray, votes: np.ndarray, counts: np.ndarray) -> float:
    """The threshold of the best expected F1 over the collection.

    held: scores of labelled documents by models that have not seen them. counts: documents of the collection
    per hundredth of score. A threshold that keeps a share h of the excluded documents finds at least h times as
    many as there are to be excluded, so found / h bounds their rate from above, at every threshold; the least bound is taken for it.
    Reviewers see no fewer such documents than the collection holds: thresholds that find more than the share among
    the labelled are left aside, if any other is there.
    """
    y = votes > 0.5
    if not y.any() or y.all() or not counts.sum():
        return 1.0
    at = np.arange(2, 99) / 100
    hit = np.array([(held[y] >= t).mean() for t in at])
    found = (np.cumsum(counts[::-1])[::-1] / counts.sum())[2:99]
    sure = (hit >= 0.25 * hit.max()) & (hit > 0)
    if not sure.any():
        return 1.0
    rate = max(float((found[sure] / hit[sure]).min()), 1 / counts.sum())
    f1 = 2 * np.minimum(rate * hit, found) / (rate + found)
    few = found <= y.mean()
    if few.any():
        f1 = np.where(few, f1, 0.0)
        if not f1.any():  # the models know nothing of documents they have not seen
            return float(at[few][0])
    return float(np.median(at[f1 >= 0.98 * f1.max()]))


def labelled(documents: DataFrame, labels: DataFrame, most: int = LABELLED, chars: int = LABELLED_CHARS) -> tuple[list[str], list[float]]:
    """Texts and votes of at most `most` labelled documents of `chars` characters, half of them for exclusion if there are as many, chosen by hash of the id."""
    votes = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id", "rater").agg(F.avg("label").alias("vote")).groupBy("doc_id").agg(F.avg("vote").alias("vote"))
    some = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    votes = some(votes.where("vote > 0.5"), most // 2).unionByName(some(votes.where("vote < 0.5"), most - most // 2))
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(votes), "doc_id")  # at most `most` rows
    one = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("vote").alias("vote"))
    before = F.sum(F.length("text").cast("long")).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))  # of at most `most` rows
    rows = one.withColumn("upto", before).where(F.col("upto") <= chars).orderBy("doc_id").select("text", "vote").toPandas()
    return rows["text"].tolist(), rows["vote"].tolist()


def judged(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[DataFrame, float]:
    """doc_id, source, score for every row of documents, and the threshold."""
    texts, votes = labelled(documents, labels, most)
    model, held = fit(texts, votes)
    rows = documents.select("doc_id", "source", "text")
    if model is None:
        blank = F.col("text").isNull() | (F.trim("text") == "")
        return rows.select("doc_id", "source", F.when(blank, F.lit(0.0)).alias("score")), 1.0
    weight, bias = model.weight, model.bias

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(weight, bias)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": m.scores(b["text"].tolist())})

    kind = dict(documents.dtypes)["doc_id"]
    scored = cut(rows.mapInPandas(run, f"doc_id {kind}, source string, score double"), "scores")
    counts = np.zeros(101, dtype=np.int64)
    for r in scored.groupBy(F.floor(F.col("score") * 100).cast("int").alias("at")).agg(F.count(F.lit(1)).alias("n")).collect():  # at most 101 rows
        counts[r["at"]] = r["n"]
    return scored, threshold(held, np.array(votes), counts)


def scores(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, source, score for every row of documents."""
    return judged(documents, labels, most)[0]


def found(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id of each document whose score reaches the threshold."""
    scored, least = judged(documents, labels, most)
    return scored.where((F.col("score") >= least) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """Per source: documents, found, rate, mean score; rows of a document count once."""
    scored, least = judged(documents, labels, most)
    one = scored.where("doc_id is not null").groupBy("doc_id").agg(F.max("score").alias("score"), F.min(source_name(F.col("source"))).alias("source"))
    hit = F.coalesce((F.col("score") >= least).cast("long"), F.lit(0))
    return one.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(hit).alias("found"), F.avg(hit).alias("rate"), F.avg("score").alias("mean_score"))
