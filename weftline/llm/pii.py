"""Personal data in free text: found by anchor expansion and replaced by typed placeholders.

One Aho-Corasick automaton per executor holds the anchors: at-signs and their spellings, digits, the dots of initials,
courtesy titles, street types, and the given names of a name list. One pass of it finds all anchors of a text; at every
anchor a deterministic local parser expands to the boundaries of the value, character class by character class or word by
word and without a limit on its length, and validates it (domain labels, digit counts and prefixes, number shapes, house
numbers, name shapes). Cues next to a candidate decide where a shape alone is ambiguous: a part number or a barcode is
no identity number, a street or a firm that carries a family name is no person. Where candidates overlap, the kind listed
first in ``KINDS`` wins, then the longer.

Names are recognised against lists given by the caller (small and size-checked); a person is sought from a title, a given
name or an initial, so one written with an unlisted given name and no title is not. With ``affix`` letters (a parameter, 0
for none) a family name also counts if its first and its last so many letters both begin and end listed family names, which
covers names of the same stock that the list lacks.

Defined cases: null and empty texts yield nothing and are masked to themselves; texts of any length are read whole; repeated
values in one field are reported once by :func:`find` and masked everywhere; repeated rows are each reported under their own
id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "address", "id_number", "person")
FOUND = "id bigint, field string, kind string, value string"
#: Names that may be shipped to the executors.
MOST_NAMES = 200_000

# fixed values: courtesy titles, street types, and words that make a family name something else than a person
TITLES = ("mr", "mrs", "ms", "miss", "mx", "dr", "doctor", "prof", "professor", "fr", "father", "sr", "sister", "br", "rev", "reverend", "sir", "lady", "judge", "deputy", "senator", "cllr", "councillor", "garda", "sgt", "capt", "nurse", "minister")
STREETS = ("street", "st", "road", "rd", "avenue", "ave", "av", "lane", "ln", "drive", "dr", "close", "cl", "court", "ct", "park", "pk", "terrace", "terr", "ter", "tce", "place", "pl", "square", "sq", "crescent", "cres", "grove", "gr", "gardens", "gdns", "way", "heights", "hts", "row", "walk", "green", "view", "parade", "quay", "hill", "rise", "mews", "estate", "boulevard", "blvd")
FIRMS = STREETS + ("motors", "&", "and sons", "sons", "ltd", "limited", "plc", "inc", "llc", "cup", "trophy", "shield", "bros", "brothers", "brewery", "hotel", "arms", "bar", "pub", "stores", "solicitors", "stadium", "bridge", "station", "school", "college", "hospital", "castle", "house", "group", "holdings", "foundation", "trust", "institute", "award", "medal", "league", "fc", "gaa")
PREFIXES = ("mac", "mc", "o'", "o’", "ní", "ni", "nic", "ó", "uí", "de", "van", "von", "fitz")

_NOT_AN_ID = re.compile(r"(?:\b(?:part|barcode|bar code|model|ticket|order|ref|reference|item|serial|invoice|build|version|sku|isbn|tracking|batch|lot|catalogue|unit|room|page|post)\b[\s.:#]*+(?:no|number|ref|is|nr)?[\s.:#]*+(?:is)?[\s:#]*+)$", re.I)
_MAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+'-")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_MAIL_DOMAIN = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}(?![A-Za-z0-9-])")
_SPELLED_AT = re.compile(r"\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|<\s*at\s*>)\s*|\s+at\s+", re.I)
_DOT = r"\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}|(?<=\s)dot(?=\s)|\.)\s*"
_SPELLED_DOMAIN = re.compile(rf"({_LABEL})((?:(?:\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{{\s*dot\s*\}})\s*|\s+dot\s+|\.){_LABEL})+)", re.I)
_PHONES = [
    re.compile(r"(?:\+|00)\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\(?\d{1,4}\)?)(?:[ .-]?\d{2,7}){1,4}(?!\d)"),
    re.compile(r"\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,5}){1,2}(?!\d)"),
    re.compile(r"0\d{1,4}(?:[ .-]?\d{2,7}){1,4}(?!\d)"),
    re.compile(r"1[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"),
    re.compile(r"\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"),
]
_IDS = [
    re.compile(r"\d{3}[ -]?\d{4}[ -]?[A-Za-z]{1,2}(?![\w])"),
    re.compile(r"\d{3}[ -]\d{2}[ -]\d{4}(?![\w-])"),
    re.compile(r"\d{3}[ -]\d{3}[ -]\d{3}(?![\w-])"),
    re.compile(r"\d{9}(?![\w])"),
]
_LETTERED_ID = re.compile(r"(?<![\w])([A-Za-z]{2}[ -]?)$")
_SEVEN = re.compile(r"\d{3}[ -]?\d{4}(?![\w])")
_POSTCODE = r"[A-Za-z]\d[\dWw] ?(?:[A-Za-z]\d[A-Za-z]\d|[A-Za-z0-9]{4}(?=\W|$))"
_NAME = r"(?:(?:Mac|Mc|O['’]|Fitz)?[^\W\d_][^\W\d_'’-]+(?:['’-][^\W\d_]+)*)"
_HOUSE = re.compile(
    r"(?<![\w€£$.,-])((?:(?:flat|apt|apartment|unit|suite|room)\.?[ \t]+[A-Za-z]?\d*[A-Za-z]?,?[ \t]+)?(?:no\.?[ \t]*)?\d{1,4}[ \t]?[A-Za-z]?,?[ \t]+)((?:(?:Ní|Nic|Ó|Uí|St\.?|The)\s+)?" + _NAME + r"(?:[ \t]+" + _NAME + r")?)[ \t]+$", re.I
)
_PLACE = re.compile(rf"\.?(,?)\s+({_NAME})(?:(,?)\s+(?:Co\.?|County)\s+{_NAME})?(?:,?\s+{_POSTCODE})?(?![\w])", re.I)
#: The rest of an address written over several lines; the line break is part of the value.
_BREAK = r"(?:,?[ \t]*(?:\r?\n|<br\s*/?>\r?\n?)[ \t]*|,[ \t]*)"
_LINES = re.compile(rf"\.?,[ \t]*(?:\r?\n|<br\s*/?>\r?\n?)[ \t]*{_NAME}(?:{_BREAK}(?:Co\.?|County)\s+{_NAME})?{_BREAK}{_POSTCODE}(?![\w])", re.I)
_PLACE_END = re.compile(rf"(?:Co\.?|County)\s+{_NAME}|{_POSTCODE}$", re.I)
# fixed values: words that follow an address but are no place
_NOT_A_PLACE = frozenset("please if on for and or the and is was last still to in at by from with as which that this next near but so then until since before after every all i we they it he she you".split())


@dataclass(frozen=True)
class Names:
    """Lower-case given names, family names, and the beginnings and ends (``affix`` letters) of family names."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    heads: frozenset[str] = frozenset()
    tails: frozenset[str] = frozenset()
    affix: int = 4

    @staticmethod
    def of(given: Iterable[str], family: Iterable[str], affix: int = 4) -> Names:
        roots = {_root(f.lower()) for f in family if f}
        roots = {r for r in roots if len(r) >= 3}
        long = [r for r in roots if affix and len(r) >= 2 * affix - 1]
        return Names(frozenset(g.lower() for g in given if g), frozenset(roots), frozenset(r[:affix] for r in long), frozenset(r[-affix:] for r in long), affix)

    def is_family(self, word: str) -> bool:
        root = _root(word.lower())
        k = self.affix
        return root in self.family or (k > 0 and len(root) >= 2 * k - 1 and root[:k] in self.heads and root[-k:] in self.tails)


def _root(name: str) -> str:
    for p in ("mac", "mc", "o'", "o’", "ní ", "ni ", "nic ", "ó ", "uí "):
        if name.startswith(p) and len(name) > len(p) + 3:
            return name[len(p) :]
    return name


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


#: A word of a name; the possessive ending is not part of it.
_WORDS = re.compile(r"[^\W\d_](?:(?!['’][sS](?![^\W\d_]))['’]?[^\W\d_])*")


_GAP = re.compile(r"[ \t]+")
_INITIAL = re.compile(r"[^\W\d_]\.[ \t]+")
_FAMILY_FIRST = re.compile(r"((?:(?:ní|nic|ó|uí)[ ])?[^\W\d_](?:['’]?[^\W\d_])+),[ ]$", re.I)
_TITLE_BEFORE = re.compile(r"\b(" + "|".join(TITLES) + r")\.?[ ]$", re.I)
_AFTER_NAME = re.compile(r"[ \t]+(&|[^\W\d_]+)")
#: One to three initials before a name, after a title if there is one.
_INITIALS = re.compile(r"(?<![\w@.'’-])(?:(?:" + "|".join(TITLES) + r")\.?[ ])?(?:[^\W\d_]\.[ ]?){1,3}(?=[^\W\d_]['’]?[^\W\d_])", re.I)


def _back(text: str, at: int, words: int, between: str = "") -> int:
    """Where the ``words``-th word before ``at`` begins; words are parted by white space and the characters ``between``."""
    for _ in range(words):
        while at and (text[at - 1].isspace() or text[at - 1] in between):
            at -= 1
        while at and not (text[at - 1].isspace() or text[at - 1] in between):
            at -= 1
    return at


def _refused(text: str, at: int) -> bool:
    """Whether the words before ``at`` say that the number there is something else."""
    return bool(_NOT_AN_ID.search(text[_back(text, at, 5, ".:#") : at]))


def _apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping spans the one of the first kind, then the longest, then the first; in order of place."""
    kept: list[tuple[int, int, int]] = []
    for s in sorted(found, key=lambda s: (s[2], s[0] - s[1], s[0])):
        i = bisect_left(kept, s)
        if (not i or kept[i - 1][1] <= s[0]) and (i == len(kept) or s[1] <= kept[i][0]):
            kept.insert(i, s)
    return kept


class Finder:
    """The automaton and its parsers; one per executor process."""

    def __init__(self, names: Names) -> None:
        self.names = names
        machine = ahocorasick.Automaton()
        for cue in ("@", "[at]", "(at)", "{at}", "<at>", "[ at ]", "( at )", " at "):
            machine.add_word(cue, ("mail", len(cue)))
        for d in "0123456789":
            machine.add_word(d, ("digit", 1))
        for street in STREETS:
            machine.add_word(f" {street}", ("street", len(street)))
        # a name anchor is the beginning of a family name, or a whole given name or title: the parser looks around it
        for g in names.given:
            machine.add_word(g, ("given", len(g)))
        for t in TITLES:
            machine.add_word(t, ("title", len(t)))
        machine.add_word(".", ("dot", 1))
        machine.make_automaton()
        self.machine = machine

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Non-overlapping ``(start, end, kind)`` in order."""
        low = _lowered(text)
        found: list[tuple[int, int, int]] = []
        n = len(text)
        for end, (what, size) in self.machine.iter(low):
            start, after = end - size + 1, end + 1
            if what == "digit":
                if start and (low[start - 1].isdigit()):
                    continue
                got = self._number(text, start)
            elif what == "mail":
                got = self._mail(text, start, after)
            elif what == "dot":
                # only after a letter that stands alone
                if not start or not low[start - 1].isalpha() or (start > 1 and low[start - 2].isalnum()):
                    continue
                got = self._initials(text, start - 1)
            elif after < n and (low[after].isalnum()) or (start and what != "street" and low[start - 1].isalnum()):
                continue
            elif what == "street":
                got = self._address(text, start, after)
            else:
                got = self._person(text, start, after, what)
            if got:
                found.append(got)
        return [(a, b, KINDS[min(k, 4)]) for a, b, k in _apart(found)]

    @staticmethod
    def _local(text: str, end: int) -> int | None:
        """Where the local part of an address that ends at ``end`` begins."""
        at = end
        while at and text[at - 1] in _MAIL_LOCAL:
            at -= 1
        while at < end and text[at] in "._%+'-":
            at += 1
        return at if at < end and text[end - 1] not in ".%'" else None

    def _mail(self, text: str, start: int, after: int):
        if text[start] == "@":
            # "name @ host.tld" with single spaces is an address too; "meet @ the usual place" has no domain
            spaced = text[start - 1 : start] == " " and text[after : after + 1] == " "
            left, right = start - spaced, after + spaced
            local, domain = self._local(text, left), _MAIL_DOMAIN.match(text, right)
            return (local, domain.end(), 0) if local is not None and domain else None
        # spelled out: the gap around the word belongs to it
        left = start
        while left and text[left - 1] in " \t":
            left -= 1
        joint = _SPELLED_AT.match(text, left)
        if not joint:
            return None
        local, domain = self._local(text, left), _SPELLED_DOMAIN.match(text, joint.end())
        if local is None or not domain:
            return None
        bare = joint.group().strip().lower() == "at"
        spelled = re.search(r"dot", domain.group(2), re.I)
        if bare and not (spelled and re.search(r"\sdot\s", domain.group(2), re.I)):
            return None
        last = re.split(r"[^A-Za-z0-9-]+", domain.group())[-1]
        if len(last) < 2 or not last.isalpha():
            return None
        return local, domain.end(), 0

    def _number(self, text: str, start: int):
        if start and (text[start - 1].isalpha() or text[start - 1] in "€£$.,_" and start > 1 and (text[start - 2].isdigit() or text[start - 1] in "€£$_")):
            # glued to letters: only a lettered number
            return self._lettered(text, start)
        begin = start
        if start and text[start - 1] in "+(":
            begin = start - 1
            if text[begin] == "(" and begin and text[begin - 1] == "+":
                begin -= 1
        if not _refused(text, start):
            for at in dict.fromkeys((begin, start)):
                for i, pattern in enumerate(_PHONES):
                    m = pattern.match(text, at)
                    if m and self._phone(m.group(), text, m.end()):
                        return at, m.end(), 1
            if start and (text[start - 1] in "-/" or text[start - 1] == "+"):
                return None
            for pattern in _IDS:
                m = pattern.match(text, start)
                if m:
                    return start, m.end(), 3
        return self._lettered(text, start)

    @staticmethod
    def _phone(value: str, text: str, end: int) -> bool:
        digits = sum(c.isdigit() for c in value)
        if text[end : end + 1].isalpha() or text[end : end + 2][:1] in "-/" and text[end + 1 : end + 2].isdigit():
            return False
        if value.count("(") != value.count(")"):
            return False
        if value[0] == "+" or value.startswith("00"):
            return 10 <= digits <= 15
        if value[0] == "(" or value[0] == "0":
            return 9 <= digits <= 11
        return digits in (10, 11)

    def _lettered(self, text: str, start: int):
        lead = _LETTERED_ID.search(text[max(0, start - 4) : start])
        if lead and (m := _SEVEN.match(text, start)) and not _refused(text, start - len(lead.group(1))):
            letters = lead.group(1)
            if letters.strip(" -").isupper() or len(letters) == 2:
                return start - len(letters), m.end(), 3
        return None

    def _address(self, text: str, start: int, after: int):
        # flat, its number, "no.", the number, its letter, a particle and two names at most
        house = _HOUSE.search(text, _back(text, start, 8), start)
        if not house:
            return None
        street = house.group(2).lower().split()
        # one word names a street; a second one must not be running text
        if len(street) > 1 and not (street[0] in ("ní", "nic", "ó", "uí", "st", "st.", "the") or all(w[:1].isupper() for w in house.group(2).split())):
            return None
        if street[-1] in _NOT_A_PLACE or not (house.group(2)[0].isupper() or self.names.is_family(street[-1]) or self._ends_like_address(text, after)):
            return None
        end = after
        place = _LINES.match(text, after)
        if place:
            return house.start(1), place.end(), 2
        place = _PLACE.match(text, after)
        if place and place.group(2).lower() not in _NOT_A_PLACE and "\n" not in place.group():
            listed = place.group(1) or _PLACE_END.search(place.group())
            if listed or place.group(2)[0].isupper() or text[house.start(2)].islower():
                end = place.end()
        elif text[after : after + 1] == "." and text[start + 1 : after].lower() in ("rd", "st", "ave", "dr", "pk", "cl", "ln", "sq", "pl", "ct"):
            end = after
        return house.start(1), end, 2

    @staticmethod
    def _ends_like_address(text: str, after: int) -> bool:
        place = _PLACE.match(text, after)
        return bool(place and (place.group(1) or _PLACE_END.search(place.group())))

    def _person(self, text: str, start: int, after: int, what: str):
        names = self.names
        if start and text[start - 1] in "@.-_+#/":
            return None
        begin, at = start, after
        if what == "title":
            if text[at : at + 1] == ".":
                at += 1
            gap = _GAP.match(text, at)
            if not gap:
                return None
            at = gap.end()
            first = _WORDS.match(text, at)
            if not first:
                return None
            if first.group().lower() in names.given:
                tail = self._family(text, first.end())
                if tail:
                    return self._unless_firm(text, begin, tail)
                return None
            initial = _INITIAL.match(text, at)
            tail = self._family(text, initial.end() - 1) if initial else self._family(text, at, gap=False)
            return self._unless_firm(text, begin, tail) if tail else None
        # a given name: "Given [X.] Family", or "Family, Given"
        tail = self._family(text, at)
        if tail:
            return self._unless_firm(text, begin, tail)
        head = _FAMILY_FIRST.search(text, _back(text, start, 2), start)
        if head and names.is_family(head.group(1).lower().split(" ")[-1]):
            title = _TITLE_BEFORE.search(text, _back(text, head.start(), 1), head.start())
            return (title.start() if title else head.start()), after, 4
        return None

    def _initials(self, text: str, start: int):
        """A person written as initials and a family name; what is found from a title or a given name goes first."""
        title = _TITLE_BEFORE.search(text, _back(text, start, 1), start)
        m = _INITIALS.match(text, title.start() if title else start)
        end = self._family(text, m.end(), gap=False) if m else None
        got = self._unless_firm(text, m.start(), end) if end else None
        return (got[0], got[1], 5) if got else None

    def _family(self, text: str, at: int, gap: bool = True) -> int | None:
        """End of a family name that begins at ``at``, after white space, further given names and initials."""
        names = self.names
        for _ in range(3):
            if gap:
                space = _GAP.match(text, at)
                if not space:
                    return None
                at = space.end()
            word = _WORDS.match(text, at)
            if not word:
                return None
            low = word.group().lower()
            if low in ("ní", "ni", "nic", "ó", "uí"):
                gap_after = _GAP.match(text, word.end())
                more = _WORDS.match(text, gap_after.end()) if gap_after else None
                return more.end() if more and names.is_family(more.group()) else None
            if names.is_family(low):
                return word.end()
            if len(low) == 1 or low in names.given:
                at, gap = word.end() + (text[word.end() : word.end() + 1] == "."), True
                continue
            return None
        return None

    @staticmethod
    def _unless_firm(text: str, begin: int, end: int):
        after = _AFTER_NAME.match(text, end)
        if after and after.group(1).lower() in FIRMS and (after.group(1) == "&" or after.group(1)[0].isupper()):
            return None
        return begin, end, 4


def masked(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with every span replaced by its kind in square brackets."""
    if not text or not found:
        return text
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def names_from(people: DataFrame, given: str, full: str, most: int = MOST_NAMES, affix: int = 4) -> Names:
    """The name lists of a table of people: distinct given names, and what full names hold after the given name. See the
    module for ``affix``; more than ``most`` distinct names raise."""
    g = F.trim(F.col(f"`{given}`"))
    family = F.when(F.startswith(F.col(f"`{full}`"), g), F.trim(F.substring(F.col(f"`{full}`"), F.length(g) + 1, F.length(F.col(f"`{full}`")))))
    pairs = people.select(g.alias("given"), family.alias("family"))
    lists = [pairs.select(c).where(f"{c} is not null and {c} != ''").distinct() for c in ("given", "family")]
    got = [[r[0] for r in names.limit(most + 1).collect()] for names in lists]
    if max(map(len, got)) > most:
        raise ValueError(f"more than {most} distinct names: pass a shorter list")
    return Names.of(*got, affix)


def find(df: DataFrame, key: str, fields: list[str], names: Names) -> DataFrame:
    """``id, field, kind, value``: the distinct personal values of each field of each row. One scan, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Finder(shared.value)
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for c, name in enumerate(fields):
                for i, text in zip(ids, batch.column(c + 1).to_pylist()):
                    if text:
                        rows.extend((i, name, k, v) for k, v in dict.fromkeys((k, text[a:b]) for a, b, k in f.spans(text)))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()))], ["id", "field", "kind", "value"])

    return df.select(F.col(f"`{key}`").cast("bigint"), *(F.col(f"`{c}`").cast("string") for c in fields)).mapInArrow(run, FOUND)


def mask(df: DataFrame, key: str, fields: list[str], names: Names) -> DataFrame:
    """``id`` and the fields with their personal values replaced."""
    shared = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Finder(shared.value)
        for batch in batches:
            out = [pa.array([t and masked(t, f.spans(t)) for t in batch.column(c + 1).to_pylist()], pa.string()) for c in range(len(fields))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["id", *fields])

    return df.select(F.col(f"`{key}`").cast("bigint"), *(F.col(f"`{c}`").cast("string") for c in fields)).mapInArrow(run, ", ".join(["id bigint", *(f"`{c}` string" for c in fields)]))
