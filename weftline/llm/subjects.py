"""Subject areas of texts by classifier chains over term, source and structure features.

Terms: a naive Bayes model over words and word pairs labels each sentence with a subject or none. It is fitted on the
labelled examples, whose labels belong to whole texts: expectation-maximisation hands each sentence of an example to one of
the example's subjects or to none, and the word counts follow. A text's features are then the shares of its words and
sentences on each subject (of all of them, and of those on any subject), its source, and its structure (number of
sentences, how much is on any subject).

Chain: the labels are decided one after the other in a fixed order; each link is a logistic regression over the features and
the labels decided before it, so co-occurrence of subjects is modelled. The links are fitted on features from sentence models
that did not see the example (cross-fitting), and Platt-calibrated on margins of links that did not see it either. A beam search over the chain finds the most
probable combination of labels; a text without any label is ``general``.

Fitting happens on the driver on at most ``most_examples`` labelled examples (the lowest keys, a documented bound), each with
all its labels; with fewer examples than folds each is a fold of its own. The fitted
model (some tens of thousands of numbers at most: see ``most_terms``) is broadcast, and labelling is one narrow pass.

Defined cases: a null text gets no row; a text without a known word is ``general``; repeated rows are labelled each; tags and
markup count as breaks; an empty table gives no rows; extra columns are ignored; without labelled examples everything is ``general``; a single example
gives a model that has seen its own features.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GENERAL = "general"
#: Levels of the four shares around which a subject begins to count; the chain's weights decide, these only place the bend.
OFTEN = np.array([0.22, 0.22, 0.25, 0.25])
LABELLED = "src string, id bigint, subject string"
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BREAK = re.compile(r"<(?=[/!?A-Za-z])[^<>]*>|\[/?\w+\]|\n+|(?<=[.!?;:])\s+|,? and (?=how |what |why |whether |who |the |if |when |which )|, (?=and |also |how |what |why |whether |who |the |if |when |which )")


@dataclass(frozen=True)
class Settings:
    most_examples: int = 50_000
    most_terms: int = 200_000
    #: A sentence of more words is cut into runs of this many: some texts have no punctuation.
    chunk: int = 18
    #: Log odds that a sentence needs to be on a subject.
    margin: float = 1.0
    rounds: int = 3
    folds: int = 5
    beam: int = 6
    ridge: float = 0.3
    #: Characters of texts that are labelled together.
    chars: int = 1_000_000


def _sentences(text: str, chunk: int) -> list[list[str]]:
    out = []
    for part in _BREAK.split(text.lower()):
        words = _WORD.findall(part)
        if len(words) <= chunk * 3 // 2:
            if words:
                out.append(words)
        else:
            out.extend(words[i : i + chunk] for i in range(0, len(words), chunk))
    return out


def _proper(texts: list[str]) -> frozenset[str]:
    """Words that within sentences are mostly written with a capital: names, which say nothing about a subject."""
    seen: Counter = Counter()
    capital: Counter = Counter()
    for text in texts:
        if text == text.lower() or text == text.upper():
            continue
        for m in _WORD.finditer(text):
            before = text[max(0, m.start() - 2) : m.start()]
            if before[-1:] == " " and before[:1] not in ".!?:;>\n":
                word = m.group()
                seen[word.lower()] += 1
                capital[word.lower()] += word[0].isupper() and word[1:].islower()
    return frozenset(w for w, n in capital.items() if n > 0.6 * seen[w])


def _terms(words: list[str]) -> list:
    return [*words, *zip(words, words[1:])]


@dataclass
class SentenceModel:
    """Log odds of each term for each subject against no subject; words and pairs of word numbers are looked up apart."""

    subjects: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_odds: np.ndarray | None = None
    pairs: np.ndarray | None = None
    pair_odds: np.ndarray | None = None
    margin: float = 1.0

    @staticmethod
    def fit(texts: list[list[list[str]]], labels: list[set[str]], subjects: list[str], s: Settings, names: frozenset[str] = frozenset()) -> SentenceModel:
        k = len(subjects)
        number = {x: i for i, x in enumerate(subjects)}
        sentences = [([t for t in dict.fromkeys(_terms(w)) if not (t in names if isinstance(t, str) else t[0] in names or t[1] in names)], [number[x] for x in sorted(ls) if x in number]) for t, ls in zip(texts, labels) for w in t]
        # first guess: every sentence of a text is on the text's subjects alike; then each is handed to one of them, or to none
        counts: dict = defaultdict(lambda: np.zeros(k + 1))
        for ts, ls in sentences:
            for t in ts:
                for x in ls or [k]:
                    counts[t][x] += 1 / len(ls or [k])
        odds = SentenceModel._odds(counts, k, s, 0.5)
        for turn in range(s.rounds):
            counts = defaultdict(lambda: np.zeros(k + 1))
            for ts, ls in sentences:
                at = k
                if ls:
                    score = sum((odds[t] for t in ts if t in odds), np.zeros(k))
                    best = max(ls, key=lambda x: score[x])
                    if score[best] > s.margin:
                        at = best
                for t in ts:
                    counts[t][at] += 1
            odds = SentenceModel._odds(counts, k, s, 0.6)
        model = SentenceModel(subjects, margin=s.margin)
        for t in sorted({w for t in odds for w in ([t] if isinstance(t, str) else t)}):
            model.words[t] = len(model.words)
        none = np.zeros(k)
        model.word_odds = np.array([odds.get(t, none) for t in model.words], np.float32).reshape(len(model.words), k)
        found = sorted((model.words[t[0]] * len(model.words) + model.words[t[1]], t) for t in odds if isinstance(t, tuple))
        model.pairs = np.array([n for n, _ in found], np.int64)
        model.pair_odds = np.array([odds[t] for _, t in found], np.float32).reshape(len(found), k)
        return model

    @staticmethod
    def _odds(counts: dict, k: int, s: Settings, purity: float) -> dict:
        """Log odds of the terms that speak for a subject; all other terms say nothing."""
        size = sum(counts.values(), np.zeros(k + 1)) + 1
        level = size[:k].mean() / size if k else np.ones(1)
        # sentences on no subject count as they come: they are many, and what they share with a subject says little
        level[k] = 1.0
        odds = {}
        for t, v in counts.items():
            rate = v * level
            best = int(rate[:k].argmax())
            if v[best] >= 1.5 and rate[best] >= purity * (rate.sum() + 1e-9):
                smooth = 0.3 + rate[:k]
                weight = np.log(smooth / (0.3 + rate[k] + (rate[:k].sum() - rate[:k]))).clip(-3, 3)
                odds[t] = np.where(np.arange(k) == best, weight, np.minimum(weight, 0) * 0.3) * (0.7 if isinstance(t, tuple) else 1.0)
        if len(odds) > s.most_terms:
            odds = dict(sorted(odds.items(), key=lambda x: -counts[x[0]].sum())[: s.most_terms])
        return odds

    def label(self, texts: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per sentence: its text, its number of words, its subject's number (-1: none)."""
        get, flat, owner, sizes = self.words.get, [], [], []
        for i, sentences in enumerate(texts):
            for words in sentences:
                flat.extend(get(w, -1) for w in words)
                owner.append(i)
                sizes.append(len(words))
        ids, k = np.array(flat, np.int64), len(self.subjects)
        score = np.zeros((len(owner), k), np.float32)
        if len(ids) and len(self.words):
            sentence = np.repeat(np.arange(len(owner)), sizes)
            known = np.flatnonzero(ids >= 0)
            self._add(score, sentence[known], self.word_odds, ids[known])
            left = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (sentence[:-1] == sentence[1:]))
            if len(left) and len(self.pairs):
                code = ids[left] * len(self.words) + ids[left + 1]
                at = np.searchsorted(self.pairs, code).clip(0, len(self.pairs) - 1)
                hit = self.pairs[at] == code
                self._add(score, sentence[left[hit]], self.pair_odds, at[hit])
        best = score.argmax(1) if k else np.zeros(len(owner), np.int64)
        subject = np.where(score[np.arange(len(owner)), best] > self.margin, best, -1) if k else np.full(len(owner), -1)
        return np.array(owner, np.int64), np.array(sizes, np.int64), subject

    @staticmethod
    def _add(score: np.ndarray, rows: np.ndarray, odds: np.ndarray, terms: np.ndarray) -> None:
        """score[rows] += odds[terms]; rows ascend."""
        if len(rows):
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            score[rows[first]] += np.add.reduceat(odds[terms], first, 0)


def features(model: SentenceModel, texts: list[list[list[str]]], question: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text and subject: four shares; per text: source and structure."""
    n, k = len(texts), len(model.subjects)
    owner, sizes, subject = model.label(texts)
    words, sentences = np.zeros((n, k + 1)), np.zeros((n, k + 1))
    np.add.at(words, (owner, subject), sizes)
    np.add.at(sentences, (owner, subject), 1)
    part = lambda x, whole: x / np.maximum(whole, 1)[:, None]
    on_words, on_sentences = words[:, :k], sentences[:, :k]
    shares = np.stack([part(on_words, words.sum(1)), part(on_sentences, sentences.sum(1)), part(on_words, on_words.sum(1)), part(on_sentences, on_sentences.sum(1))], 2)
    count = sentences.sum(1)
    whole = np.stack([question.astype(float), np.log1p(count) / 3, on_words.sum(1) / np.maximum(words.sum(1), 1)], 1)
    return shares, whole


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last column of ``x`` is the constant, unpenalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class Chain:
    """Links in label order: weights over [own shares, best other share, text features, earlier labels, 1], and Platt's two."""

    weights: list[np.ndarray]
    platt: list[tuple[float, float]]

    @staticmethod
    def inputs(shares: np.ndarray, whole: np.ndarray, j: int, earlier: np.ndarray) -> np.ndarray:
        own = shares[:, j]
        others = np.delete(shares[:, :, 2], j, 1)
        other = others.max(1, keepdims=True) if others.shape[1] else np.zeros((len(own), 1))
        # how far the share on any subject is above the level that counts as a subject of the text
        over = np.clip((own - OFTEN) * 8, -1.5, 1.5)
        return np.concatenate([own * 4, over, other, whole, earlier, earlier.sum(1, keepdims=True), np.ones((len(own), 1))], 1)

    @staticmethod
    def fit(shares: np.ndarray, whole: np.ndarray, truth: np.ndarray, fold: np.ndarray, s: Settings) -> Chain:
        k = truth.shape[1]
        weights, platt = [], []
        for j in range(k):
            earlier = np.where(np.arange(k) < j, truth, 0.0)
            x, y = Chain.inputs(shares, whole, j, earlier), truth[:, j]
            w = _logistic(x, y, s.ridge)
            weights.append(w)
            # margins of weights that were fitted without the example
            margin = x @ w
            for f in range(fold.max() + 1 if fold.max() else 0):
                margin[fold == f] = x[fold == f] @ _logistic(x[fold != f], y[fold != f], s.ridge)
            z = np.stack([margin, np.ones(len(y))], 1)
            # Platt's targets keep the calibration finite where classes separate
            up, down = y.sum(), len(y) - y.sum()
            a = _logistic(z, np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2)), 1e-3)
            platt.append((float(a[0]), float(a[1])))
        return Chain(weights, platt)

    def decode(self, shares: np.ndarray, whole: np.ndarray, beam: int) -> np.ndarray:
        """The most probable label combination of each text."""
        n, k = len(shares), len(self.weights)
        labels, logp = np.zeros((n, 1, k)), np.zeros((n, 1))
        for j in range(k):
            width = labels.shape[1]
            rep = lambda a: np.repeat(a, width, 0)
            x = Chain.inputs(rep(shares), rep(whole), j, labels.reshape(n * width, k))
            a, b = self.platt[j]
            z = np.clip(a * (x @ self.weights[j]) + b, -30, 30).reshape(n, width)
            yes, no = logp - np.log1p(np.exp(-z)), logp - np.log1p(np.exp(z))
            on = labels.copy()
            on[:, :, j] = 1
            both, score = np.concatenate([labels, on], 1), np.concatenate([no, yes], 1)
            if score.shape[1] > beam:
                top = np.argpartition(-score, beam, 1)[:, :beam]
                score, both = np.take_along_axis(score, top, 1), np.take_along_axis(both, top[:, :, None], 1)
            labels, logp = both, score
        return labels[np.arange(n), logp.argmax(1)]


@dataclass
class Classifier:
    sentences: SentenceModel
    chain: Chain | None
    settings: Settings

    def label(self, texts: list[str], question: list[bool]) -> list[list[str]]:
        if not texts:
            return []
        subjects = self.sentences.subjects
        if self.chain is None or not subjects:
            return [[GENERAL] for _ in texts]
        shares, whole = features(self.sentences, [_sentences(t, self.settings.chunk) for t in texts], np.array(question))
        # most texts agree with many others in all features: that is left to numpy
        got = self.chain.decode(shares, whole, self.settings.beam)
        return [[subjects[j] for j in np.flatnonzero(row)] or [GENERAL] for row in got]


def train(examples: list[tuple[str, bool, set[str]]], s: Settings = Settings()) -> Classifier:
    """Fit on ``(text, is a question, subjects)``; examples of ``general`` have no other subject."""
    subjects = sorted({x for _, _, ls in examples for x in ls} - {GENERAL})
    texts = [_sentences(t or "", s.chunk) for t, _, _ in examples]
    labels = [ls - {GENERAL} for _, _, ls in examples]
    question = np.array([q for _, q, _ in examples], bool)
    if not subjects:
        return Classifier(SentenceModel(subjects), None, s)
    names = _proper([t or "" for t, _, _ in examples])
    model = SentenceModel.fit(texts, labels, subjects, s, names)
    truth = np.array([[float(x in ls) for x in subjects] for ls in labels])
    folds = min(s.folds, len(examples))
    fold = np.arange(len(examples)) % folds
    shares, whole = np.zeros((len(examples), len(subjects), 4)), np.zeros((len(examples), 3))
    for f in range(folds):
        fit, out = np.flatnonzero((fold != f) | (folds == 1)), np.flatnonzero(fold == f)
        part = SentenceModel.fit([texts[i] for i in fit], [labels[i] for i in fit], subjects, s, names)
        shares[out], whole[out] = features(part, [texts[i] for i in out], question[out])
    return Classifier(model, Chain.fit(shares, whole, truth, fold, s), s)


def examples_of(df: DataFrame, s: Settings = Settings()) -> list[tuple[str, bool, set[str]]]:
    """The labelled examples of a table ``example_id, kind, example_text, subject``; one row per example and subject."""
    rows = df.select("example_id", "kind", "example_text", "subject").where("example_text is not null and subject is not null")
    taken = rows.select("example_id").distinct().orderBy("example_id").limit(s.most_examples)
    rows = rows.join(taken, "example_id", "left_semi").orderBy("example_id", "subject").collect()
    got: dict = {}
    for i, kind, text, subject in rows:
        got.setdefault(i, (text, kind == "question", set()))[2].add(subject)
    return list(got.values())


def label(parts: list[tuple[DataFrame, str, str, str]], classifier: Classifier) -> DataFrame:
    """``src, id, subject`` of the texts of several tables, each given as (table, src, key column, text column)."""
    spark = parts[0][0].sparkSession
    shared = spark.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def out(rows: list[tuple]) -> pa.RecordBatch:
            got = model.label([r[2] for r in rows], [r[0] == "question" for r in rows])
            flat = [(r[0], r[1], x) for r, xs in zip(rows, got) for x in xs]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["src", "id", "subject"])

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.append(row)
                size += len(row[2])
                if size > model.settings.chars:
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)

    texts = None
    for df, src, key, text in parts:
        one = df.select(F.lit(src).alias("src"), F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
        texts = one if texts is None else texts.unionAll(one)
    return texts.mapInArrow(run, LABELLED)
