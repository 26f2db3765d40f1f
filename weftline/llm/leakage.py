"""Passages of held-out test items inside a corpus.

The test items' word n-grams go to every executor as one sorted array of hashes, behind a check of their size: a larger test
set is dealt into blocks by item, and the corpus is scanned once for each block, so no set is too large. Each document's
words are numbered by the test vocabulary, a window of n words is looked up at every position, and every hit is verified on
the words around it.

Phrases that many items and documents share do not multiply: a passage holds several windows close together (how many
follows from the rules), so hits without enough others near them in the document are dropped before they are paired with
items, and a pair goes on to verification only if words continue to agree beyond the run that the hit stands in.

A passage is ``least`` or more successive words of an item of which up to one in ``one_in`` were changed in the document
(replaced, dropped or added). Such a passage always holds a run of six unchanged words (15 words with one change leave
seven, 20 with two leave six, and no longer passage leaves fewer), so the six-word window finds all of them: the search is
exact. Words are runs of letters and digits in lower case; tags and character entities are markup and count as spaces.

Defined cases: null, empty and short texts on either side match nothing; a repeated document row is reported under its own
id, an item once per document; equal items are all reported; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import WORD, mix
from weftline.session import written

TAG = re.compile(r"<(?=[/!?A-Za-z])[^<>]*>|&#?\w{1,8};")
FOUND = "doc_id bigint, item_id bigint, first_word int, last_word int"


@dataclass(frozen=True)
class Rules:
    least: int = 15
    one_in: int = 10
    window: int = 6
    #: Test windows of one block, that is what is broadcast at once: 16 bytes each.
    most_grams: int = 2_000_000
    #: Pairs of a document window and an item window that are looked at together; only memory depends on it.
    most_pairs: int = 1_000_000
    #: Documents are scanned together up to so many characters, so that the arithmetic runs over long arrays.
    chars: int = 2_000_000

    def sizes(self) -> range:
        """Lengths of passages to look for: a longer passage holds one of these."""
        return range(self.least, max(3 * self.one_in, self.least + 1))

    def fewest_windows(self) -> int:
        """A passage of n words with c changed keeps n - c in c + 1 runs: so many whole windows at least."""
        return max(1, min(n - n // self.one_in - (self.window - 1) * (n // self.one_in + 1) for n in self.sizes()))

    def beyond(self, run: int) -> int:
        """How many words in a row go on agreeing beyond a change next to the longest run of a passage, if that has ``run`` words."""
        kept = [(n - n // self.one_in, n // self.one_in) for n in self.sizes()]
        return min(0 if k <= run else max(1, k - run * c) for k, c in kept)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall((TAG.sub(" ", text) if "<" in text or "&" in text else text).lower())


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64) + np.uint64(1))
    return out


class TestSet:
    """The test items as numbered words, and their windows as a sorted hash array that points into them."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str | None]], rules: Rules) -> None:
        self.rules, self.vocabulary = rules, {}
        words = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)] for _, t in items]
        self.item = np.array([i for i, _ in items], np.int64)
        pad = 64
        # items lie end to end, padded so that a look around any hit stays inside the array
        self.starts = np.cumsum([pad] + [len(w) + pad for w in words[:-1]]) if items else np.empty(0, np.int64)
        self.words = np.full(sum(map(len, words)) + pad * (len(words) + 1), -2, np.int32)
        self.owner = np.full(len(self.words), -1, np.int32)
        for k, (s, w) in enumerate(zip(self.starts, words)):
            self.words[s : s + len(w)] = w
            self.owner[s : s + len(w)] = k
        grams = _grams(self.words, rules.window)
        whole = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(self.words >= 0, rules.window).all(1)) if len(grams) else np.empty(0, np.int64)
        order = whole[np.argsort(grams[whole], kind="stable")]
        self.keys, self.places = grams[order], order
        self.distinct = len(np.unique(self.keys))


def _windows(equal: np.ndarray, least: int, one_in: int, whole: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(size, where) of the stretches in rows of ``equal`` in which at most one in ``one_in`` words are False.

    Sizes below three times ``one_in`` are enough: a longer passage holds a shorter one. ``whole`` stretches begin and end
    with an equal word, as a passage does.
    """
    gone = np.cumsum(np.pad(~equal, ((0, 0), (1, 0))), 1, dtype=np.int16)
    for size in Rules(least, one_in).sizes():
        ok = (gone[:, size:] - gone[:, :-size]) <= size // one_in
        if whole:
            ok &= equal[:, : ok.shape[1]] & equal[:, size - 1 :]
        yield size, ok


def _dense(equal: np.ndarray, least: int, one_in: int, whole: bool = True) -> np.ndarray:
    """The rows that hold such a stretch."""
    found = np.zeros(len(equal), bool)
    for _, ok in _windows(equal, least, one_in, whole):
        found |= ok.any(1)
    return found


def aligned(item: np.ndarray, doc: np.ndarray, least: int, one_in: int) -> tuple[int, int] | None:
    """Doc bounds of a stretch of ``item`` of ``least`` words or more found in ``doc`` with at most one in ``one_in`` changed.

    Local alignment where a kept word scores 1 and a change costs ``one_in - 1``: a stretch is within the rule exactly if its
    score is not negative. Every pair of equal words may begin a stretch, and each cell keeps the best score of every length
    up to ``least``, so neither a longer nor a better stretch hides another: the search is exact.
    """
    cost, m, n = one_in - 1, len(item), len(doc)
    nothing = np.full((m + 1, least + 1), -(10**6), np.int32), np.zeros((m + 1, least + 1), np.int32)
    before, last = nothing, nothing
    # all cells of one i + j at a time; rows are i, columns the length so far
    for d in range(2, m + n + 1):
        i = np.arange(max(1, d - n), min(m, d - 1) + 1)
        j = d - i
        same = item[i - 1] == doc[j - 1]
        moves = ((before, i - 1, np.where(same, 1, -cost)[:, None]), (last, i - 1, -cost), (last, i, -cost))
        scores = np.stack([got[0][at] + step for got, at, step in moves])
        pick = scores.argmax(0)[None]
        old = np.take_along_axis(scores, pick, 0)[0], np.take_along_axis(np.stack([got[1][at] for got, at, _ in moves]), pick, 0)[0]
        longer = old[0][:, -1] > old[0][:, -2]
        score, begin = nothing[0].copy(), nothing[1].copy()
        for new, x in ((score, old[0]), (begin, old[1])):
            new[i, 1:] = x[:, :-1]
            new[i[longer], -1] = x[longer, -1]
        fresh = i[same & (score[i, 1] < 1)]
        score[fresh, 1], begin[fresh, 1] = 1, d - fresh - 1
        ends = i[same & (score[i, -1] >= 0)]
        if len(ends):
            return int(begin[ends[0], -1]), int(d - ends[0])
        before, last = last, (score, begin)
    return None


def _scan(ids: list[int], texts: list[str | None], test: TestSet) -> list[tuple]:
    r = test.rules
    get, gap = test.vocabulary.get, [-1] * 64
    flat: list[int] = list(gap)
    bounds = []
    for text in texts:
        words = words_of(text)
        bounds.append(len(flat))
        if len(words) >= r.window:
            flat.extend(get(w, -1) for w in words)
            flat.extend(gap)
    doc = np.array(flat, np.int32)
    known = doc >= 0
    # places where a whole window consists of words that occur in the test items
    run = np.cumsum(np.concatenate(([0], known)))
    at = np.flatnonzero(run[r.window :] - run[: -r.window] == r.window)
    if not len(at) or not len(test.keys):
        return []
    grams = np.zeros(len(at), np.uint64)
    for i in range(r.window):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + doc[at + i].astype(np.uint64) + np.uint64(1))
    low, high = np.searchsorted(test.keys, grams, "left"), np.searchsorted(test.keys, grams, "right")
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return []
    # a passage's windows lie close together; without enough of them there is none
    place, few = at[hit], r.fewest_windows()
    if few > 1:
        together = np.flatnonzero(place[few - 1 :] - place[: -(few - 1)] <= 2 * r.sizes()[-1]) if len(place) >= few else np.empty(0, np.int64)
        near = np.zeros(len(hit) + 1, np.int64)
        np.add.at(near, together, 1)
        np.add.at(near, together + few, -1)
        hit = hit[np.cumsum(near)[:-1] > 0]
    if not len(hit):
        return []
    bounds = np.array(bounds)
    count, out = (high - low)[hit], {}
    # a part ends with a document if it can
    ends, which = np.cumsum(count), np.searchsorted(bounds, at[hit], "right") - 1
    begin = 0
    while begin < len(hit):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - count[begin] + r.most_pairs, "right")))
        if end < len(hit):
            whole = int(np.searchsorted(which, which[end], "left"))
            end = whole if whole > begin else end
        _verify(at[hit[begin:end]], low[hit[begin:end]], count[begin:end], which[begin:end], doc, test, out)
        begin = end
    return [(ids[d], int(test.item[i]), int(s - bounds[d]), int(e - bounds[d])) for (d, i), spans in out.items() for s, e in _merged(spans)]


def _goes_on(p: np.ndarray, q: np.ndarray, run: np.ndarray, doc: np.ndarray, test: TestSet) -> np.ndarray:
    """Which runs of equal words (``run`` words from ``p`` in the document, ``q`` in the items) may be the longest of a passage."""
    r = test.rules
    need = np.array([r.beyond(k) if k >= r.window else 0 for k in range(r.least + 1)])[np.minimum(run, r.least)]
    ok = need == 0
    left = np.flatnonzero(~ok)
    most = r.sizes()[-1] // r.one_in
    same = lambda a, b: (doc[np.clip(a, 0, len(doc) - 1)] == test.words[np.clip(b, 0, len(test.words) - 1)]) & (doc[np.clip(a, 0, len(doc) - 1)] >= 0)
    for way in (1, -1):
        a, b = (p + run, q + run) if way > 0 else (p - 1, q - 1)
        for i in range(most + 1):
            for j in range(most + 1):
                x, y = a[left] + way * i, b[left] + way * j
                hit = same(x, y)
                hit &= (need[left] < 2) | same(x + way, y + way)
                ok[left[hit]] = True
                left = left[~hit]
    return ok


def _verify(at: np.ndarray, low: np.ndarray, count: np.ndarray, of: np.ndarray, doc: np.ndarray, test: TestSet, out: dict) -> None:
    """Add to ``out`` (document, item) -> bounds of the passages around some hits."""
    r = test.rules
    p, which = np.repeat(at, count), np.repeat(of, count)
    q = test.places[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    # one hit of a run of hits on one diagonal is enough: the look around it covers a passage's length on either side
    key = which.astype(np.int64) * len(test.words) * 2 + (p - q + len(test.words))
    order = np.argsort(key, kind="stable")  # places ascend already
    p, q, which, key = p[order], q[order], which[order], key[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (p[1:] - p[:-1] != 1)
    first = np.flatnonzero(fresh)
    run = np.diff(np.append(first, len(p))) + r.window - 1
    ok = np.repeat(_goes_on(p[first], q[first], run, doc, test), np.diff(np.append(first, len(p))))
    # a run longer than the passage itself needs its first place only; the others add what lies to its right
    fresh = (fresh | (np.arange(len(p)) % 16 == 0)) & ok
    p, q, which = p[fresh], q[fresh], which[fresh]

    reach = 2 * r.one_in + r.window
    for lo in range(0, len(p), 20_000):
        P, Q, D = p[lo : lo + 20_000], q[lo : lo + 20_000], which[lo : lo + 20_000]
        offsets = np.arange(-reach, reach + r.window)
        theirs = test.words[np.clip(Q[:, None] + offsets, 0, len(test.words) - 1)]
        mine = np.clip(P[:, None] + offsets, 0, len(doc) - 1)
        straight = doc[mine] == theirs
        sure = _dense(straight, r.least, r.one_in)
        near = straight.copy()
        for shift in (-2, -1, 1, 2):
            near |= doc[np.clip(mine + shift, 0, len(doc) - 1)] == theirs
        maybe = _dense(near, r.least, r.one_in, whole=False) & ~sure
        for k in np.flatnonzero(sure | maybe):
            found = (int(D[k]), int(test.owner[Q[k]]))
            if sure[k]:
                out.setdefault(found, []).append(_extent(straight[k], P[k] - reach, r))
            elif found not in out:
                item = theirs[k].copy()
                item[item < 0] = -3
                begin = max(0, int(P[k]) - reach - 4)
                got = aligned(item, doc[begin : int(P[k]) + reach + r.window + 4], r.least, r.one_in)
                if got:
                    out[found] = [(begin + got[0], begin + got[1])]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _extent(equal: np.ndarray, begin: int, r: Rules) -> tuple[int, int]:
    """Bounds of what the stretches of a row cover."""
    covered = [(at[0], at[-1] + size) for size, ok in _windows(equal[None], r.least, r.one_in, True) if len(at := np.flatnonzero(ok[0]))]
    return int(begin + min(a for a, _ in covered)), int(begin + max(b for _, b in covered))


def _blocks(items: DataFrame, key: str, text: str, rules: Rules) -> Iterator[TestSet]:
    """The test items in blocks of about ``most_grams`` windows; an item that is longer by itself comes in overlapping pieces."""
    rows = items.select(F.col(f"`{key}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    limit = rules.most_grams * 5
    if size <= limit:
        yield TestSet([tuple(x) for x in rows.collect()], rules)
        return
    step, over = max(rules.most_grams // 8, 1), 4 * rules.sizes()[-1]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                cut = [" ".join(words[a : a + step + over]) for a in range(0, max(len(words), 1), step)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(cut), pa.int64()), pa.array(cut, pa.string())], ["item_id", "text"])

    dealt = written(rows.mapInArrow(pieces, "item_id bigint, text string").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-2 * size // limit)))), "leakage-items")
    for block in range(-(-2 * size // limit)):
        yield TestSet([tuple(x) for x in dealt.where(F.col("block") == block).select("item_id", "text").collect()], rules)


def _scanned(docs: DataFrame, test: TestSet, doc_key: str, doc_text: str, made, schema: str) -> DataFrame:
    """``made(ids, texts, found)`` over the documents, many at a time; ``found`` are the rows of ``FOUND`` with a document's place for its id."""
    shared = docs.sparkSession.sparkContext.broadcast(test)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t) if t else 0
                if size > shared.value.rules.chars:
                    yield made(ids, texts, _scan(range(len(ids)), texts, shared.value))
                    ids, texts, size = [], [], 0
        if ids:
            yield made(ids, texts, _scan(range(len(ids)), texts, shared.value))

    return docs.select(F.col(f"`{doc_key}`").cast("bigint").alias("doc_id"), F.col(f"`{doc_text}`").cast("string").alias("text")).mapInArrow(run, schema)


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``doc_id, item_id, first_word, last_word`` of every passage of an item in a document. One scan for each block of items, no shuffle.

    Words are numbered from 0 in the document; the last one is excluded. Passages of one item that overlap are one row,
    unless the item was so long that it came in pieces.
    """

    def made(ids, texts, found):
        return pa.RecordBatch.from_arrays([pa.array([ids[g[0]] for g in found], pa.int64()), *(pa.array([g[i] for g in found], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32())))], ["doc_id", "item_id", "first_word", "last_word"])

    docs = docs.where(F.col(f"`{doc_text}`").isNotNull())
    parts = [_scanned(docs, test, doc_key, doc_text, made, FOUND) for test in _blocks(items, item_key, item_text, rules)]
    return reduce(DataFrame.unionAll, parts)


def scrubbed(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``doc_id, text`` of all documents, the leaked passages cut out where they are found: one scan, no shuffle.

    A test set of several blocks gives the spans of all blocks first, which are then joined to the texts.
    """

    def made(ids, texts, found):
        spans: dict[int, list[dict]] = {}
        for d, _, s, e in found:
            spans.setdefault(d, []).append({"first_word": s, "last_word": e})
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_cut(t, spans.get(i)) for i, t in enumerate(texts)], pa.string())], ["doc_id", "text"])

    blocks = _blocks(items, item_key, item_text, rules)
    first = next(blocks)
    if next(blocks, None) is None:
        return _scanned(docs, first, doc_key, doc_text, made, "doc_id bigint, text string")
    return without_passages(docs, leaks(docs, items, doc_key, doc_text, item_key, item_text, rules), doc_key, doc_text)


def without_leaks(docs: DataFrame, found: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """The documents that hold no passage of a test item."""
    return docs.join(found.select(F.col("doc_id").alias(doc_key)).distinct(), doc_key, "left_anti")


def without_passages(docs: DataFrame, found: DataFrame, doc_key: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """``doc_id, text`` of all documents, the leaked passages cut out; all else, white space and markup included, stays.

    The spans of a document are at most a few per test item, so they travel as one array beside its text.
    """
    spans = found.groupBy(F.col("doc_id")).agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))
    rows = docs.select(F.col(f"`{doc_key}`").cast("bigint").alias("doc_id"), F.col(f"`{doc_text}`").cast("string").alias("text")).join(spans, "doc_id", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_cut(t, x) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id bigint, text string")


def _cut(text: str | None, spans: list[dict] | None) -> str | None:
    if not text or not spans:
        return text
    # markup becomes as many spaces, so that places stay
    words = [m.span() for m in WORD.finditer(TAG.sub(lambda m: " " * len(m.group()), text))]
    out, at = [], 0
    for s, e in _merged([(x["first_word"], x["last_word"]) for x in spans]):
        if s < len(words):
            out.append(text[at : words[s][0]])
            at = words[min(e, len(words)) - 1][1]
    return "".join(out) + text[at:]
