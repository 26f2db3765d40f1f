"""Pages made of keywords, tags, menus, products or links rather than sentences.

A page is cut into units: its lines, and within a line its sentences. A hidden Markov model with the states prose, link
list, tag list and menu labels the units: discrete features of a unit (share of function words by length, of web addresses,
of list separators, of word pairs repeated in the unit or all over the page, sentence shape) are its emissions, and lists are sticky, so a short line takes
the label of its surroundings. A page is flagged when at least ``share`` of its words stand in units that are not prose.

The model's tables below are parameters, set from what the features mean and not fitted to any corpus. Viterbi runs over
all pages of a batch at once, one unit position at a time. The operator is one narrow pass: no shuffle, no state.

Defined cases: a null text, or one without words, is never flagged and has no words; repeated rows are labelled each;
texts of any length are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("prose", "links", "tags", "menu")
PAGES = "doc_id bigint, n_words int, n_prose int, n_links int, n_tags int, n_menu int"
#: Units of one array pass; only memory depends on it.
UNITS_AT_ONCE = 200_000

# fixed values: function words of English, French, German and Irish that do not also serve in advertising phrases
FUNCTION_WORDS = frozenset(
    """
    the a an of to in and for is was were be been by that this it its on at with from as or are has have had i we my they
    he she you your his her their our us them but if than any will would could should can may after before until while per
    which who whom whose when where what why how there here not nor so do does did about into out up over more most such
    because only every both some these those all
    le la les de des du un une et est dans pour que qui en au aux sur pas il elle ils ne a ont avec par se ce cette nous
    vous n'a n'y sans après près
    der die das und ein eine einen ist zu den mit von auf für nicht im dem des sie es hat sind war bei nach aus auch noch
    ohne gibt keine niemand haben oder aber wie
    ar na agus i is go tá bhí do ó mar ach raibh beidh ní leis don ag ina sa tar éis aice ann
    """.split()
)
_URL = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@.])[\w-]+(?:\.[\w-]+)*\.(?:com|net|org|info|biz|shop|store|online|site|test|example|invalid|io|ie|co\.uk|de|fr)(?:/\S*)?(?![\w@])", re.I)
_UNIT = re.compile(r"\n+|(?<=[.!?…])[\"'”’)\]]*\s+(?=[\"'“‘(\[]?[^\W_])")
#: What stands between the items of lists, beside commas and semicolons.
_STRONG = ("|", "»", "›", ">", "•", "·", "#", " / ", " - ", " – ", "](", "<a ", "<li")
_QUOTE = re.compile(r"^[\s>]*>\s*")
#: A word pair is one of the page's keywords if it makes up this much of all its pairs, and occurs four times.
FREQUENT_PAIR = 0.05
_STRIP = ".,;:!?…\"'“”‘’()[]{}<>|#*»"

# model parameters: P(bin | state), states in the order prose, links, tags, menu
_SHORT = np.array([[0.52, 0.03, 0.10, 0.35], [0.88, 0.04, 0.04, 0.04], [0.88, 0.04, 0.04, 0.04], [0.90, 0.03, 0.03, 0.04]])
_MIDDLE = np.array([[0.12, 0.05, 0.20, 0.63], [0.82, 0.06, 0.08, 0.04], [0.82, 0.06, 0.08, 0.04], [0.85, 0.05, 0.06, 0.04]])
_LONG = np.array([[0.01, 0.04, 0.20, 0.75], [0.80, 0.12, 0.06, 0.02], [0.76, 0.15, 0.07, 0.02], [0.80, 0.12, 0.06, 0.02]])
FUNCTION_SHARE = np.stack([_SHORT, _MIDDLE, _LONG])
URL_SHARE = np.array([[0.950, 0.040, 0.008, 0.002], [0.03, 0.10, 0.37, 0.50], [0.970, 0.020, 0.006, 0.004], [0.950, 0.030, 0.012, 0.008]])
SEPARATORS = np.array([[0.60, 0.37, 0.025, 0.005], [0.35, 0.15, 0.30, 0.20], [0.40, 0.10, 0.30, 0.20], [0.30, 0.10, 0.25, 0.35]])
STRONG_SEPARATORS = np.array([[0.93, 0.060, 0.010], [0.55, 0.25, 0.20], [0.70, 0.10, 0.20], [0.30, 0.15, 0.55]])
REPEATED_PAIRS = np.array([[0.970, 0.0270, 0.00299, 0.00001], [0.50, 0.20, 0.20, 0.10], [0.22, 0.13, 0.25, 0.40], [0.50, 0.20, 0.20, 0.10]])
SENTENCE_SHAPE = np.array([[0.14, 0.26, 0.60], [0.65, 0.33, 0.02], [0.70, 0.29, 0.01], [0.70, 0.29, 0.01]])
START = np.array([0.70, 0.10, 0.10, 0.10])
MOVE = np.array([[0.86, 0.05, 0.04, 0.05], [0.08, 0.86, 0.03, 0.03], [0.10, 0.03, 0.84, 0.03], [0.08, 0.03, 0.03, 0.86]])


def _level(value: float, *edges: float) -> int:
    for i, edge in enumerate(edges):
        if value <= edge:
            return i
    return len(edges)


def _units(text: str) -> list[tuple[str, list[str]]]:
    """The units of a page that have words: their text without quote marks, and their bare lower-case words."""
    out = []
    for unit in _UNIT.split(text):
        if ">" in unit[:8]:
            unit = _QUOTE.sub("", unit)
        bare = [x for w in unit.lower().split() if (x := w.strip(_STRIP))]
        if bare:
            out.append((unit, bare))
    return out


def _frequent(units: list[tuple[str, list[str]]]) -> set[tuple[str, str]]:
    """Word pairs that make up a large part of the page: the keywords it repeats. A sentence that is repeated counts once."""
    distinct = {tuple(bare) for _, bare in units}
    words = Counter()
    for bare in distinct:
        words.update(bare)
    least = max(4, FREQUENT_PAIR * (words.total() - len(distinct)))
    # a frequent pair has frequent words, which most pages lack
    common = {w for w, n in words.items() if n >= least and w not in FUNCTION_WORDS}
    if not common:
        return common
    pairs = Counter(p for bare in distinct for p in zip(bare, bare[1:]) if p[0] in common and p[1] in common)
    return {p for p, n in pairs.items() if n >= least}


def _page(text: str) -> list[tuple[int, ...]]:
    units = _units(text)
    frequent = _frequent(units)
    return [_features(*u, frequent) for u in units]


def _features(unit: str, bare: list[str], frequent: set[tuple[str, str]]) -> tuple[int, ...]:
    """Word count and feature bins of a unit."""
    n = len(bare)
    function = sum(map(FUNCTION_WORDS.__contains__, bare)) / n
    urls = len(_URL.findall(unit)) if "." in unit[:-1] else 0
    strong = sum(map(unit.count, _STRONG))
    separators = (strong + unit.count(",") + unit.count(";")) / n
    repeated = 0
    if n >= 6:
        again = n - len(set(bare))
        # no more pairs are repeated than words
        repeated = 1 + (_level(1 - len(set(zip(bare, bare[1:]))) / (n - 1), 0.04, 0.15) if again > 0.04 * (n - 1) else 0)
    if frequent and n > 1:
        repeated = max(repeated, 1 + _level(sum(p in frequent for p in zip(bare, bare[1:])) / (n - 1), 0.05, 0.12, 0.20))
    body = unit.strip()
    shape = (body[:1].isupper() or body[:1].isdigit()) + (body[-1:] in ".!?…")
    return (
        n, _level(n, 3, 8), _level(function, 0.03, 0.10, 0.18), _level(urls / n, 0.0, 0.12, 0.34), _level(separators, 0.0, 0.16, 0.40), _level(strong / n, 0.0, 0.10), repeated, shape,
    )


def emissions(f: np.ndarray) -> np.ndarray:
    """Log P(unit | state) of rows of feature bins."""
    out = np.log(FUNCTION_SHARE)[f[:, 1], :, f[:, 2]]
    out = out + np.log(URL_SHARE).T[f[:, 3]] + np.log(SEPARATORS).T[f[:, 4]] + np.log(STRONG_SEPARATORS).T[f[:, 5]] + np.log(SENTENCE_SHAPE).T[f[:, 7]]
    # short units have no word pairs to speak of
    return out + np.vstack([np.zeros((1, 4)), np.log(REPEATED_PAIRS).T])[f[:, 6]]


def viterbi(scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best state of every unit; ``scores`` holds the sequences end to end."""
    order = np.argsort(-lengths, kind="stable")
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    size = lengths[order]
    move, back = np.log(MOVE), np.zeros(scores.shape, np.int8)
    best = np.log(START) + scores[first]
    final = np.zeros((len(size), 4))
    for t in range(1, int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))
        done = slice(live, len(best))
        final[done] = best[done]
        paths = best[:live, :, None] + move
        at = first[:live] + t
        back[at] = paths.argmax(1)
        best = paths.max(1) + scores[at]
    final[: len(best)] = best
    states = np.zeros(len(scores), np.int8)
    now = final.argmax(1)
    for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        at = first[:live] + t
        states[at] = now[:live]
        now[:live] = back[at, now[:live]]
    return states


def _labelled(ids: list[int], texts: list[str | None]) -> pa.RecordBatch:
    rows, lengths = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        units = _page(text) if text else []
        lengths[k] = len(units)
        rows.extend(units)
    totals = np.zeros((len(texts), 4), np.int64)
    if rows:
        f = np.array(rows, np.int32)
        kept = np.flatnonzero(lengths)
        states = viterbi(emissions(f), lengths[kept])
        np.add.at(totals, (np.repeat(np.arange(len(texts)), lengths), states), f[:, 0])
    columns = [pa.array(ids, pa.int64()), pa.array(totals.sum(1), pa.int32()), *(pa.array(totals[:, i], pa.int32()) for i in range(4))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PAGES.split(", ")])


def page_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of each page by the state of the unit they stand in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "") // 60 + 1
                if size > UNITS_AT_ONCE:
                    yield _labelled(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _labelled(ids, texts)

    return df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, PAGES)


def stuffed(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """``doc_id, non_prose_share`` of the pages of which at least ``share`` of the words stand in lists."""
    words = page_words(df, key, text).where("n_words > 0")
    return words.select("doc_id", (1 - F.col("n_prose") / F.col("n_words")).alias("non_prose_share")).where(F.col("non_prose_share") >= share)
