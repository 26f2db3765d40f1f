"""Text cleaning as column expressions. Null stays null unless said otherwise; nothing leaves the JVM but stemming."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the default patterns of the cleaning steps
URL = r"https?://\S+|www\.\S+"
REPEATED = r"(.)\1{2,}"
PUNCTUATION_RUN = r"([!?.,])\1+"
# fixed values: the 32 ASCII punctuation characters
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2190}-\x{21FF}\x{FE0F}\x{200D}\x{20E3}\x{E0020}-\x{E007F}]"
# fixed values: default stopwords
STOPWORDS = [
    "the", "and", "is", "in", "it", "of", "to", "a", "for", "on", "with", "that", "this", "as", "are", "was", "at", "by", "an", "be", "from", "or",
    "not", "but", "all", "if", "they", "you", "he", "she", "we", "his", "her", "its", "my", "your", "their", "what", "which", "when", "where", "who",
    "how", "there", "so", "no", "yes", "do", "does", "did", "have", "has", "had", "will", "would", "can", "could", "should", "i", "me", "us", "them",
    "our", "yours", "theirs",
]
# fixed values: stopwords of game descriptions
GAME_STOPWORDS = [
    "game", "play", "playing", "plays", "fun", "awesome", "cool", "best", "epic", "new", "update", "updates", "updated", "soon", "like", "likes", "favorite", "favorites",
    "fav", "follow", "join", "visit", "check", "share", "welcome", "enjoy", "thanks", "thank", "please", "plz", "pls", "blox", "roblox", "robux", "good luck", "group", "unlock", "will", "free",
]


def replaced(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def lowercase(c: Column) -> Column:
    """Lower case; null becomes empty."""
    return F.lower(F.coalesce(c, F.lit("")))


def remove_urls(c: Column, pattern: str = URL, replace_with: str = "") -> Column:
    return replaced(c, f"(?i){pattern}", replace_with)


def remove_html_tags(c: Column, br_replace: str = ", ", strip: bool = True) -> Column:
    out = replaced(replaced(c, r"(?i)<br\s*/?>", br_replace), r"<[^>]+>")
    return stripped(out) if strip else out


def stripped(c: Column) -> Column:
    """White space of every kind off both ends."""
    return replaced(c, r"(?U)^\s+|\s+$")


def remove_repeated_characters(c: Column, pattern: str = REPEATED, replace_with: str = "") -> Column:
    return replaced(c, pattern, replace_with)


def remove_punctuation_noise(c: Column, pattern: str = PUNCTUATION_RUN, replace_with: str = "$1") -> Column:
    return replaced(c, pattern, replace_with)


def remove_whitespace(c: Column, pattern: str = r"\s+", replace_with: str = " ") -> Column:
    return stripped(replaced(c, f"(?U){pattern}", replace_with))


def tokens(c: Column) -> Column:
    """Words between white space; none for empty text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def remove_stopwords(c: Column, stopwords: Iterable[str] | None = None, lower: bool = True) -> Column:
    """Lower case, no ASCII punctuation, no stopwords, single spaces."""
    words = sorted(set(stopwords if stopwords is not None else STOPWORDS))
    bare = F.translate(F.lower(c) if lower else c, PUNCTUATION, "")
    return F.array_join(F.filter(tokens(bare), lambda w: ~w.isin(words)), " ")


def remove_emoji(c: Column, regexes: Iterable[str] = (), use_ranges: bool = True) -> Column:
    for pattern in regexes:
        c = replaced(c, pattern)
    return replaced(c, EMOJI) if use_ranges else c


def mask_words(c: Column, words: Iterable[str], mask_token: str = "<MASKED>", case_sensitive: bool = False) -> Column:
    """Mask listed words and words that begin with them, longest first."""
    listed = sorted({w.strip() for w in words if w.strip()}, key=lambda w: (-len(w), w))
    if not listed:
        return c
    return replaced(c, ("" if case_sensitive else "(?i)") + r"\b(?:" + "|".join(rf"\Q{w}\E" for w in listed) + r")\w*\b", mask_token)


def mask_label_words(c: Column, label: Column, mask_token: str = "<MASKED>", case_sensitive: bool = False, split_pattern: str = r"[,/;&|\-]\s*") -> Column:
    """Mask the words of the row's own label cell; a row without label is left as it is. The pattern is built per row, in the JVM."""
    fold = (lambda x: x) if case_sensitive else F.lower
    parts = F.flatten(F.transform(F.split(fold(label), split_pattern), lambda p: F.split(stripped(p), r"\s+")))
    words = F.array_distinct(F.filter(parts, lambda w: w != ""))
    longest = F.transform(F.sort_array(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), lambda s: s["w"])
    quoted = F.array_join(F.transform(longest, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(("" if case_sensitive else "(?i)") + r"\b(?:"), quoted, F.lit(r")\w*\b"))
    return F.when(F.size(words) > 0, F.regexp_replace(c, pattern, F.lit(mask_token))).otherwise(c)


def merge_features(*columns: Column) -> Column:
    """Columns as text joined by single spaces, nulls as empty, ends stripped."""
    return F.trim(F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def truncate_label(c: Column, length: int = 10) -> Column:
    """Labels longer than ``length`` are cut to ``length - 3`` characters and three dots."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length - 3), F.lit("..."))).otherwise(c)


def clean_speaker(c: Column) -> Column:
    return replaced(c, "^#+")


def python_bool(c: Column) -> Column:
    """True, False and null as the words True, False and None."""
    return F.coalesce(F.initcap(c.cast("string")), F.lit("None"))


# -- stemming ---------------------------------------------------------------------------------------------------------

_VOWELS = set("aeiou")


def _measure(stem: str) -> int:
    """Vowel-consonant sequences of a stem (Porter 1980)."""
    kinds = []
    for i, ch in enumerate(stem):
        vowel = ch in _VOWELS or (ch == "y" and i > 0 and kinds[-1] is False)
        kinds.append(vowel)
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(stem: str) -> bool:
    return any(ch in _VOWELS or (ch == "y" and i > 0) for i, ch in enumerate(stem))


def _consonant(word: str, i: int) -> bool:
    if word[i] in _VOWELS:
        return False
    return word[i] != "y" or i == 0 or not _consonant(word, i - 1)


def _short(word: str) -> bool:
    return len(word) >= 3 and _consonant(word, len(word) - 1) and not _consonant(word, len(word) - 2) and _consonant(word, len(word) - 3) and word[-1] not in "wxy"


# fixed values: suffix rules of the published algorithm, steps 2 to 4
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """The Porter (1980) stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for suffix in sorted(rules, key=len, reverse=True):
            if word.endswith(suffix):
                if _measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + rules[suffix]
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


# fixed values: word forms and suffix rules of the published algorithm (Porter's second English stemmer)
_FORMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT_FORMS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_S2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_S3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_S4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_V2 = frozenset("aeiouy")


def _ends(word: str, suffixes) -> str | None:
    """The longest of the suffixes that the word ends with."""
    return max((x for x in suffixes if word.endswith(x)), key=len, default=None)


def _region(word: str, at: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, seen from ``at``."""
    for i in range(at + 1, len(word)):
        if word[i] not in _V2 and word[i - 1] in _V2:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _V2 and word[1] not in _V2
    return len(word) > 2 and word[-1] not in _V2 and word[-1] not in "wxY" and word[-2] in _V2 and word[-3] not in _V2


def snowball(word: str) -> str:
    """The stem of a lower-case English word by Porter's second stemmer. A consonant y is written Y meanwhile."""
    if len(word) <= 2:
        return word
    word = word.replace("’", "'").removeprefix("'")
    if word in _FORMS:
        return _FORMS[word]
    word = "".join("Y" if ch == "y" and (i == 0 or word[i - 1] in "aeiouy" and word[i - 1] != "Y") else ch for i, ch in enumerate(word))
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = start if start is not None else _region(word, 0)
    r2 = _region(word, r1)
    # 0: possessives
    word = word.removesuffix("'s'") if word.endswith("'s'") else word.removesuffix("'s") if word.endswith("'s") else word.removesuffix("'")
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(ch in _V2 for ch in word[:-2]):
        word = word[:-1]
    if word in _KEPT_FORMS:
        return word
    # 1b: past and progressive
    tail = _ends(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if tail in ("eed", "eedly"):
        if len(word) - len(tail) >= r1:
            word = word[: -len(tail)] + "ee"
    elif tail and any(ch in _V2 for ch in word[: -len(tail)]):
        word = word[: -len(tail)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and word[-1] in "bdfgmnprt":
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V2:
        word = word[:-1] + "i"
    # 2 and 3
    tail = _ends(word, _S2)
    if tail and len(word) - len(tail) >= r1 and not (tail == "ogi" and word[-4:-3] != "l") and not (tail == "li" and word[-3:-2] not in tuple("cdeghkmnrt")):
        word = word[: -len(tail)] + _S2[tail]
    tail = _ends(word, _S3)
    if tail and len(word) - len(tail) >= (r2 if tail == "ative" else r1):
        word = word[: -len(tail)] + _S3[tail]
    # 4
    tail = _ends(word, _S4)
    if tail and len(word) - len(tail) >= r2 and not (tail == "ion" and word[-4:-3] not in ("s", "t")):
        word = word[: -len(tail)]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


STEMS: dict[str, Callable[[str], str]] = {"snowball": snowball, "snowballstemmer": snowball, "porter": porter, "porterstemmer": porter}


def stem_text(c: Column, algorithm: str = "snowball", language: str = "english") -> Column:
    """Each token's stem; another language than English, or another algorithm, raises."""
    if (algorithm or "snowball").strip().lower() not in STEMS:
        raise ValueError(f"unknown stemmer {algorithm!r}: {', '.join(sorted(STEMS))}")
    if language != "english":
        raise ValueError(f"there is no {language} stemmer here: english only")
    return stemmer(STEMS[(algorithm or "snowball").strip().lower()])(c)


def stemmer(stem: Callable[[str], str] = snowball) -> Callable[[Column], Column]:
    """A text operator that stems each token; tokens come out joined by single spaces. One Arrow batch at a time, words memoised."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            out = []
            for w in text.lower().split():
                got = seen.get(w)
                if got is None:
                    got = seen[w] = stem(w)
                out.append(got)
            return " ".join(out)

        return texts.map(one, na_action="ignore")

    return run


def lemmatize(c: Column, lemma: Callable[[Column], Column] | None = None) -> Column:
    """Lemmas by a supplied column operator; the identity where no lemmatiser is installed."""
    return lemma(c) if lemma else c


#: Registered text operators and their aliases; each maps a column to a column.
REGISTRY: dict[str, Callable[..., Column]] = {
    "lowercase": lowercase, "lower": lowercase,
    "remove_urls": remove_urls, "removeurls": remove_urls,
    "remove_html_tags": remove_html_tags, "removehtml": remove_html_tags,
    "remove_repeated_characters": remove_repeated_characters, "remove_repeated": remove_repeated_characters,
    "remove_punctuation_noise": remove_punctuation_noise, "punctuation_noise": remove_punctuation_noise,
    "remove_whitespace": remove_whitespace, "whitespace": remove_whitespace,
    "stopword_remover": remove_stopwords, "stopwords": remove_stopwords,
    "stemmer": stem_text, "stem": stem_text,
    "lemmatizer": lemmatize, "lemmatize": lemmatize,
    "emoji_remover": remove_emoji, "emoji": remove_emoji,
}


def chain(c: Column, steps: Iterable[str | dict]) -> Column:
    """Several registered operators as one expression."""
    for step in steps:
        name, params = (step, {}) if isinstance(step, str) else (step["name"], step.get("params", {}))
        if name not in REGISTRY:
            raise KeyError(f"unknown text operator {name!r}")
        c = REGISTRY[name](c, **params)
    return c
