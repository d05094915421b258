"""Personal items in free text, and texts with typed placeholders or keyed surrogates in their place.

Found are PERSON, EMAIL_ADDRESS, PHONE_NUMBER, ID_NUMBER and STREET_ADDRESS, each exactly as written. Addresses of
mail and identity numbers are looked for first; a later type never overlaps an earlier one. Names are found around
known first names, around first names that the corpus itself tells (words that stand with many surnames after labels
and titles), around initials, and after labels and titles of people; a name found once in a text is found at all its
places there.

Surrogates are of the item's type and keep its format: letters stay letters in their case, digits digits, a
country code, a mail domain's last label, the kind of a street and its order of words stay. They follow from a key
and the parts of the item, so the same name has the same surrogate in every spelling, also inside a mail address.
First names get first names that end as their gender does. Words of other scripts get letters of their script. Two different
items never share one: collisions are found over all items of the table and drawn again.

Null and empty texts have no items and stay as they are. Rows that repeat an id add nothing to the distinct items.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.arrow import map_arrow
from veilspark.functions.columns import has_text
from veilspark.functions.materialize import BROADCAST_ROWS, cut
from veilspark.functions.vectors import vector_total
from veilspark.llm import names

TYPES = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "ID_NUMBER", "STREET_ADDRESS")
_SIGN = r"\s{0,2}[(\[{<]\s?%s\s?[)\]}>]\s{0,2}"
_DOT = rf"(?:\.|{_SIGN % 'dot'}|\sdot\s)"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_AT = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]|\sat\s", re.I)
EMAIL = re.compile(rf"(?<![\w.+-])[^\W_][\w.+-]*(?:(?:\s?@\s?|{_SIGN % 'at'}){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,}}|\sat\s{_LABEL}(?:{_DOT}{_LABEL})*(?:{_SIGN % 'dot'}|\sdot\s)[^\W\d_]{{2,}})(?![\w-])", re.I)
_ID_LABEL = r"(?:reisepass|passport|personalausweis|ausweis|identity\s+card|id\s+card|tax\s+(?:id|number|no)|steuer-?(?:id|nummer|nr)|steuerliche\s+identifikationsnummer|social\s+insurance|insurance|national\s+insurance|sozialversicherungs?|versicherungs?|social\s+security|ssn)(?:\s*-?\s*(?:number|nummer|nr|no|id|ausweis))?\.?\s*(?:no\.|nr\.)?\s*:?\s*"
_ID_VALUE = r"(?:QQ(?:\s?\d\d){3}\s?[A-Z]|\d\d\s?\d{6}\s?[A-Z]\s?\d{3}|\d{3}-\d\d-\d{4}|\d\d\s?\d{3}\s?\d{3}\s?\d{3}|[A-Z]{1,2}[A-Z\d]{6,10}(?<=\d[A-Z\d]{2}|\d\d[A-Z]|[A-Z\d]{2}\d)|\d{8,12})"
ID = re.compile(rf"(?<!\w){_ID_LABEL}({_ID_VALUE})(?![\w-])|(?<!\w)(QQ(?:\s?\d\d){{3}}\s?[A-D])(?!\w)", re.I)
_NO_PHONE = re.compile(r"(?:batch|charge|serial|seriennr\.?|amount|betrag|version|no\.|nr\.|[\w-]/|[A-Z]{2,}[-/])\s*:?\s*$", re.I)
_EXTENSION = r"(?:\s?(?:x|ext\.?|durchwahl|dw\.?)\s?\d{1,5})?"
PHONE = re.compile(
    rf"(?<![\w.,/+-])(?:\+\d{{1,3}}[ /.-]?|00[1-9]\d{{0,2}}[ /.-]?)?"
    rf"(?:(?:\(\d{{2,5}}\)|\d{{2,5}})[ /.-]?(?:\d{{2,}}|\(0\)\d+)(?:[ /.-]\d{{2,}}){{0,3}}|\(0\)[ ]?\d{{2,5}}(?:[ /.-]?\d{{2,}}){{1,4}}|\d{{9,14}}){_EXTENSION}(?![\w/]|[.,]\d|-\d)",
    re.I,
)
_US = re.compile(r"\(?[2-9]\d\d\)?[ .-]\d{3}[ .-]\d{4}(?!\d)")
_NUMBER = r"\d{1,4}\s?(?:[a-z](?![\w]))?(?:\s?[-–/]\s?\d{1,4}[a-z]?)?(?!\w)"
#: Kinds of streets at the end of a name, with the number behind; the name is read backwards from here.
_KINDS = ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "ufer", "damm", "chaussee", "steig", "straat", "laan", "plein", "gracht", "kade")
_KIND_NUMBER = re.compile(rf"\s{{1,2}}{_NUMBER}", re.I)
_NAME_END = re.compile(r"(?<![\w-])[^\W\d_][\w-]*$")
_NAME_BEFORE = re.compile(r"(?<![\w-])[^\W\d_][\w-]*\s$")
_ALONE = frozenset(("straße", "strasse", "str.", "allee", "platz", "ring", "weg"))
STREET = re.compile(
    r"(?<![\w/.,-])\d{1,4}[a-z]?(?:-\d{1,4}[a-z]?)?\s{1,2}(?:[^\W\d_][\w'-]*\s){1,2}?(?:(?:street|road|lane|avenue|close|court|crescent|drive|way|place|square|terrace|gardens|grove|mews)(?!\w)|(?:st|rd|ave|ln|ct|cres|dr|pl|sq)(?:\.|(?=,)))"
    , re.I,
)
_STREET_FR = re.compile(
    r"(?<![\w/.,-])\d{1,4}(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|boulevard|bd|place|chemin|allée|impasse|quai|route)\s(?:(?:de|du|des|la|le|les)\s|[dl]['’])*(?-i:[A-ZÀ-Ý])[\w'’-]*(?:\s(?-i:[A-ZÀ-Ý])[\w'’-]*)*",
    re.I,
)
_STREET_ES = re.compile(r"(?<!\w)(?:[Cc]alle|[Aa]venida|[Aa]vda\.|[Pp]aseo|[Pp]laza|[Cc]amino|[Rr]onda)\s(?:(?:de|del|la|las|los|el)\s)*[A-ZÀ-Ý][\w'-]*(?:\s(?:(?:de|del|la|las|los|el)\s)*[A-ZÀ-Ý][\w'-]*)*,?\s\d{1,4}(?!\w)")


_EN_WORDS = ("street", "road", "lane", "avenue", "close", "court", "crescent", "drive", "way", "place", "square", "terrace", "gardens", "grove", "mews", "st", "rd", "ave", "ln", "ct", "cres", "dr", "pl", "sq")
_FR_WORDS = ("rue", "avenue", "boulevard", "bd", "place", "chemin", "allée", "impasse", "quai", "route")
_ES_WORDS = ("calle", "avenida", "avda.", "paseo", "plaza", "camino", "ronda")


def _streets(text: str, kinds: list[tuple[int, int]], words: int) -> Iterator[tuple[int, int]]:
    for i, j in kinds:
        m = _KIND_NUMBER.match(text, j)
        if m is None:
            continue
        name = _NAME_END.search(text, max(0, i - 80), i)
        if name is None and text[i:j].lower() in _ALONE:
            name = _NAME_BEFORE.search(text, max(0, i - 80), i)
        if name is not None:
            yield name.start(), m.end() - (len(m.group()) - len(m.group().rstrip()))
    for bit, pattern in ((8, STREET), (16, _STREET_FR), (32, _STREET_ES)):
        for m in pattern.finditer(text) if words & bit else ():
            yield m.start(), m.end() - (len(m.group()) - len(m.group().rstrip()))


_FIRST = {n.lower(): gender for gender, group in (("f", names.FEMALE), ("m", names.MALE)) for n in group}
_WORD = re.compile(r"[^\W\d_]+")
#: Words that labels of identity numbers begin with.
_ID_WORDS = ("reisepass", "passport", "personalausweis", "ausweis", "identity", "id", "tax", "steuer", "social", "insurance", "national", "sozialversicherung", "versicherung", "ssn", "qq")


@lru_cache(maxsize=1)
def _triggers() -> ahocorasick.Automaton:
    """All words that the search begins with, found in one pass: kinds of streets, labels and known first names."""
    kinds: dict[str, int] = {}
    for group, words in enumerate((_KINDS, _ID_WORDS, _FIRST, _EN_WORDS, _FR_WORDS, _ES_WORDS)):
        for w in words:
            kinds[w] = kinds.get(w, 0) | 1 << group
    automaton = ahocorasick.Automaton()
    for w, groups in kinds.items():
        automaton.add_word(w, (len(w), groups))
    automaton.make_automaton()
    return automaton


def _folded(text: str) -> str:
    """Lower case, sign for sign."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _starts(low: str) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int]], int]:
    """Places of kinds of streets, of labels of identity numbers and of known first names as whole words, and which
    languages have a word for a street here."""
    streets, labels, people, words = [], [], [], 0
    for last, (size, groups) in _triggers().iter(low):
        i, j = last - size + 1, last + 1
        if groups & 1:
            streets.append((i, j))
        before = low[i - 1] if i else " "
        if groups & 2 and not (before.isalnum() or before == "_"):
            labels.append(i)
        if groups & 60 and not before.isalpha() and not low[j : j + 1].isalpha():
            words |= groups
            if groups & 4:
                people.append((i, j))
    return streets, sorted(set(labels)), people, words
_PART = "|".join(p.replace(" ", r"\s") for p in names.PARTICLES)
_SUR = r"[^\W\d_]{2,}(?:-[^\W\d_]{2,})*"
_RIGHT = re.compile(rf"(?:-[^\W\d_]{{2,}})?(?:(\s{{1,2}})[^\W\d_]\.)?(?:(\s{{1,2}})(?:{_PART})(?=\s))?(\s{{1,2}})({_SUR})", re.I)
_LEFT = re.compile(rf"(?<![\w-])(?:(?:{_PART})\s)?({_SUR}),\s{{1,2}}$", re.I)
_AFTER_FIRST = re.compile(r"(?:\s[^\W\d_]\.)(?!\s{0,2}[^\W\d_]{2,})", re.I)
_INITIAL = re.compile(rf"(?<![\w.&-])[^\W\d_]\.\s{{1,2}}(?:(?:{_PART})\s)?({_SUR})", re.I)
_KNOWN = re.compile(rf"(?<!\w)(?:(?i:{'|'.join(re.escape(x) for x in sorted(names.LABELS, key=len, reverse=True))})\s*:\s*|(?:{'|'.join(re.escape(x) for x in names.TITLES)})\s)((?:[A-ZÄÖÜ][a-zäöüßéèë]+)(?:\s[A-Z]\.)?(?:\s(?:{_PART}))?\s(?:[A-ZÄÖÜ][a-zäöüß]+)(?:-[A-ZÄÖÜ][a-zäöüß]+)*|(?:[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)*),\s[A-ZÄÖÜ][a-zäöüßéèë]+)(?!\w)(?!\s(?:{'|'.join(names.COMPANIES)})\b)(?![\s&]+[A-ZÄÖÜ])")


_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(x) for x in names.TITLES)})\s")
_LABELLED = re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(x) for x in sorted(names.LABELS, key=len, reverse=True))})\s*$", re.I)
_LONGEST = max(map(len, names.LABELS))


def _known(text: str) -> Iterator[re.Match]:
    """The matches of names after labels and titles, looked for behind colons and titles only."""
    starts = [m.start() for m in _TITLED.finditer(text)]
    at = text.find(":")
    while at >= 0:
        low = max(0, at - _LONGEST - 8)
        if (m := _LABELLED.search(text, low, at)) is not None:
            starts.append(m.start())
        at = text.find(":", at + 1)
    done = 0
    for i in sorted(set(starts)):
        if i >= done and (m := _KNOWN.match(text, i)) is not None:
            done = m.end()
            yield m


def _style(word: str) -> str:
    return "l" if word.islower() else "u" if word.isupper() and len(word) > 1 else "t"


def _fits(first: str, surname: str) -> bool:
    """A surname is in the case of its first name and no word that follows names."""
    parts = surname.split("-")
    style = _style(first)
    ok = all(p[0].isupper() for p in parts) if style == "t" else surname.isupper() if style == "u" else surname.islower()
    return ok and parts[0].lower() not in names.AFTER and parts[0].lower() not in names.COMPANIES


def _people(text: str, known: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for i, j in known:
        first = text[i:j]
        if i and text[i - 1] in "-@." or text[j : j + 1] in ("@", "_"):
            continue
        right, left = _RIGHT.match(text, j), _LEFT.search(text, max(0, i - 60), i)
        fits = right is not None and _fits(first, right.group(4))
        lines = fits and any(g and "\n" in g for g in (right.group(1), right.group(2), right.group(3)))
        if lines and re.match(r"[^\n]{0,25}:", text[right.start(4) :]):
            fits = lines = False
        behind = left is not None and _fits(first, left.group(1)) and left.group(1).lower() not in _FIRST
        if behind and (not fits or lines or _style(first) != "t"):
            after = _AFTER_FIRST.match(text, j)
            yield left.start() if _part_is_name(text, left) else left.start(1), after.end() if after else j
        elif fits:
            yield i, right.end()
    for m in _INITIAL.finditer(text):
        letter, surname = m.group()[0], m.group(1)
        if letter.isupper() and surname[0].isupper() and surname.lower() not in names.AFTER and not text[m.end() : m.end() + 1] == "-":
            before = text[max(0, m.start() - 24) : m.start()].rstrip()
            known = re.search(r"([^\W\d_]+)$", before)
            if not (known and known.group(1).lower() in _FIRST) and len(surname) > 2:
                yield m.start(), m.end()
        elif letter.islower() and surname.islower() and len(surname) > 3 and surname not in names.AFTER:
            label = re.search(rf"(?:{'|'.join(re.escape(x.lower()) for x in names.LABELS)})\s*:?\s*$|(?:frau|ms|dr\.)\s$", text[max(0, m.start() - 30) : m.start()])
            if label:
                yield m.start(), m.end()
    for m in _known(text):
        yield m.span(1)


def _part_is_name(text: str, m: re.Match) -> bool:
    """The particle before a surname is part of the name, not a preposition: only "de la", "van der" and the like."""
    return text[m.start() : m.start(1)].strip().lower() in ("van der", "van den", "de la", "von der", "della", "del")


#: Hash buckets of the evidence about first names, and what a learned first name has at least: different surnames
#: behind it next to a label or a title, and the share of these places among all where it stands before such a word.
NAME_BITS, LEAST_SURNAMES, LEAST_SHARE = 19, 3, 0.03
_UP, _SMALL = "[A-ZÀ-ÖØ-Þ]", "[a-zß-öø-ÿ]"
_CAPITAL = re.compile(rf"(?<![\w@])({_UP}[^\W\d_]+)(?!\w)")
#: A middle initial or a particle that isn't a preposition between two capitalised words.
_BETWEEN = re.compile(rf"(?<![\w.@-])({_UP}{_SMALL}+)[ ](?:{_UP}\.|van\sder|van\sden|de\sla|van)[ ]({_UP}{_SMALL}+)(?!\w)")
#: A name right before a mail address, or on its own side of a sign.
_BEFORE_MAIL = re.compile(rf"(?<![\w.@-])({_UP}{_SMALL}+(?:\s{_UP}\.)?[ ]{_UP}{_SMALL}+(?:-{_UP}{_SMALL}+)*|{_UP}{_SMALL}+(?:-{_UP}{_SMALL}+)*,[ ]{_UP}{_SMALL}+)\s?[-–,:(<\[]{{1,2}}\s?$")
_PAIR = re.compile(r"(?<![\w.@-])([A-ZÀ-ÖØ-Þ][^\W\d_]+)[ ][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+")


def _bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower()) >> (64 - NAME_BITS)


_NO_NAMES = names.AFTER | set(names.COMPANIES) | {t.lower().rstrip(".") for t in names.TITLES} | {w.lower() for label in names.LABELS for w in label.split()}


def _plain(word: str) -> str:
    word = word.lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        word = word.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _mailed(text: str, mails: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Names right before mail addresses whose first part holds a part of the name."""
    for i, j in mails:
        m = _BEFORE_MAIL.search(text, max(0, i - 60), i)
        if m is not None:
            local = _plain(re.split(r"\W", text[i:j], maxsplit=1)[0] + text[i : i + 40].split("@")[0])
            if any(len(w) > 2 and _plain(w) in local for w in re.split(r"[\s,-]+", m.group(1))):
                yield m.span(1)


def _locals(text: str) -> Iterator[tuple[int, int]]:
    """Where the first parts of possible mail addresses begin, and where the sign of "at" behind them ends."""
    for sign in _AT.finditer(text):
        i = sign.start()
        for _ in range(2):
            i -= i > 0 and text[i - 1].isspace()
        while i > 0 and (text[i - 1].isalnum() or text[i - 1] in "_.+-"):
            i -= 1
        if text[i].isalnum():
            yield i, sign.end()


def _mails(text: str) -> Iterator[re.Match]:
    """The matches of EMAIL, looked for before signs of "at" only."""
    done = 0
    for i, end in _locals(text):
        if i >= done and (m := EMAIL.match(text, i)) is not None and m.end() >= end:
            done = m.end()
            yield m


def _first_and_last(name: str) -> tuple[str, str]:
    parts = name.split(", ")
    return (parts[1], parts[0]) if len(parts) > 1 else (name.split()[0], name.split()[-1])


def name_evidence(rows: DataFrame) -> np.ndarray:
    """Buckets of learned first names, from all rows (text).

    Two facts are added up for each bucket: how often a word stands as a first name after a label or title, before a
    mail address that holds the name, or before a middle initial or particle, with a bitmap of the surnames; and how
    often it stands before a capitalised word at all. A word that is always followed
    by the same one (a department, a company) isn't a first name.
    """
    size = 1 << NAME_BITS

    def add(vector: np.ndarray, b: pa.RecordBatch) -> None:
        for text in b["text"].to_pylist():
            told = [_first_and_last(m.group(1)) for m in _known(text)] + _BETWEEN.findall(text)
            told += [_first_and_last(text[i:j]) for i, j in _mailed(text, list(_locals(text)))]
            for first, surname in told:
                if first.lower() not in _NO_NAMES and surname.split("-")[0].lower() not in _NO_NAMES:
                    at = _bucket(first)
                    vector[at] |= np.uint32(1 << (xxhash.xxh3_64_intdigest(surname.lower()) & 31))
                    vector[size + at] += 1
            for w, n in Counter(_PAIR.findall(text)).items():
                vector[2 * size + _bucket(w)] += n

    total = vector_total(rows.select("text"), 3 * size, "uint32", add, lambda c: "or" if c < 4 else "cap", chunks=12)
    strong = total[size : 2 * size]
    return (np.bitwise_count(total[:size]) >= LEAST_SURNAMES) & (strong >= LEAST_SHARE * np.maximum(total[2 * size :], 1))


class Learned:
    """Learned first names of a corpus; each word is looked up once."""

    def __init__(self, buckets: np.ndarray):
        self.buckets, self.seen = buckets, {}

    def __contains__(self, word: str) -> bool:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            got = self.seen[word] = bool(self.buckets[_bucket(word)]) and word.lower() not in _NO_NAMES
        return got


def _again(text: str, low: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Further places of the names found, whole and in any case."""
    for name in {low[i:j] for i, j in spans}:
        at = low.find(name)
        while at >= 0:
            end = at + len(name)
            if not (at and (low[at - 1].isalnum() or low[at - 1] in "_@.-")) and not low[end : end + 1].isalnum() and low[end : end + 1] not in ("@", "_", "-"):
                yield at, end
            at = low.find(name, end)


def find(text: str | None, learned: Learned | None = None) -> list[tuple[int, int, str]]:
    """(start, end, type) of all items of a text, in order, without overlaps.

    First names are the known ones and those ``learned`` from the corpus; a name found once is found at all its places.
    """
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def put(i: int, j: int, kind: str) -> None:
        if j > i and not any(taken[i:j]):
            taken[i:j] = b"\1" * (j - i)
            spans.append((i, j, kind))

    low = _folded(text)
    streets, labels, people, words = _starts(low)
    for m in _mails(text):
        put(*m.span(), "EMAIL_ADDRESS")
    at = 0
    for start in labels:
        m = ID.match(text, start) if start >= at else None
        if m is None:
            continue
        at = m.end()
        i, j = m.span(1) if m.group(1) else m.span(2)
        if sum(map(str.isdigit, text[i:j])) >= 5:
            put(i, j, "ID_NUMBER")
    for i, j in sorted(_streets(text, streets, words)):
        put(i, j, "STREET_ADDRESS")
    for m in PHONE.finditer(text):
        t = m.group()
        digits = sum(map(str.isdigit, re.split(r"(?i)x|ext", t)[0]))
        dialled = t.startswith(("+", "0", "(0")) and 9 <= digits <= 16 or _US.match(t)
        if dialled and not re.match(r"\d{1,4}[./-]\d\d[./-]\d{2,4}(?!\d)", t) and not _NO_PHONE.search(text, max(0, m.start() - 20), m.start()):
            put(*m.span(), "PHONE_NUMBER")
    if learned is not None:
        new = {w for w in set(_CAPITAL.findall(text)) if w in learned and w.lower() not in _FIRST}
        if new:
            people = sorted({*people, *(m.span(1) for m in _CAPITAL.finditer(text) if m.group(1) in new)})
    for i, j in sorted({*_people(text, people), *_mailed(text, [(i, j) for i, j, kind in spans if kind == "EMAIL_ADDRESS"])}, key=lambda s: (s[0], -s[1])):
        put(i, j, "PERSON")
    for i, j in _again(text, low, [(i, j) for i, j, kind in spans if kind == "PERSON"]):
        put(i, j, "PERSON")
    return sorted(spans)


ITEMS = "items array<struct<start int, end int, type string, text string>>"


def learn(df: DataFrame, text_col: str):
    """The first names that the texts of ``df`` tell, as a broadcast bit field of fixed size."""
    return df.sparkSession.sparkContext.broadcast(np.packbits(name_evidence(df.where(has_text(text_col)).select(F.col(text_col).alias("text")))))


def _learned(shared) -> Learned | None:
    return None if shared is None else Learned(np.unpackbits(shared.value).view(bool))


def items(df: DataFrame, id_col: str, text_col: str, with_text: bool = False, every: bool = False, learned=None) -> DataFrame:
    """(id, items), and the text where asked for, of every row with an id and a text, or of every row."""

    def start():
        known = _learned(learned)

        def work(b: pa.RecordBatch) -> dict:
            return {"id": b["id"], "text": b["text"], "items": [[{"start": i, "end": j, "type": kind, "text": t[i:j]} for i, j, kind in find(t, known)] for t in b["text"].to_pylist()]}

        return work

    rows = (df if every else df.where(F.col(id_col).isNotNull() & has_text(text_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = ", text string" if with_text else ""
    return map_arrow(rows, f"id {rows.schema['id'].dataType.simpleString()}{kept}, {ITEMS}", start)


def distinct_items(found: DataFrame) -> DataFrame:
    """(id, type, text): each item once per record and spelling."""
    return found.select("id", F.explode("items").alias("i")).select("id", "i.type", "i.text").distinct()


def placeholders(df: DataFrame, id_col: str, text_col: str, learned=None) -> DataFrame:
    """(id, text, replaced) with every item replaced by its type in brackets; ``replaced`` counts them."""

    def start():
        known = _learned(learned)

        def work(b: pa.RecordBatch) -> dict:
            texts, counts = [], []
            for t in b["text"].to_pylist():
                found = find(t, known)
                texts.append(_replaced(t, [(i, j, f"[{kind}]") for i, j, kind in found]))
                counts.append(len(found))
            return {"id": b["id"], "text": texts, "replaced": counts}

        return work

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, f"id {rows.schema['id'].dataType.simpleString()}, text string, replaced int", start)


def _replaced(text: str | None, parts: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for i, j, new in parts:
        out += [text[at:i], new]
        at = j
    return "".join([*out, text[at:]])


_CONSONANTS, _VOWELS = "bdfghklmnprstvwz", "aeiou"
#: First and last letter of the lower-case alphabets, or of the signs, that words of other scripts are made of.
_SCRIPTS = (("а", "я"), ("α", "ω"), ("א", "ת"), ("ا", "ي"), ("अ", "ह"), ("ぁ", "ゖ"), ("ァ", "ヺ"), ("가", "힣"), ("一", "龥"))


@lru_cache(maxsize=None)
def _alphabet(first: str, last: str) -> str:
    return "".join(c for c in map(chr, range(ord(first), ord(last) + 1)) if c.isalpha())


def _script(letter: str) -> str | None:
    """The alphabet of a letter that isn't Latin."""
    return next((_alphabet(a, b) for a, b in _SCRIPTS if a <= letter.lower() <= b), None)


class Surrogates:
    """Keyed replacements; ``attempt`` draws another one."""

    def __init__(self, key: bytes):
        self.key = key

    def draw(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\0".join(map(str, parts)).encode(), hashlib.blake2b).digest()[:16], "big")

    def letter(self, letter: str) -> str:
        """A permutation of the first letters, so an initial and a first name stay together."""
        order = sorted("abcdefghijklmnopqrstuvwxyz", key=lambda c: self.draw("initial", c))
        plain = unicodedata.normalize("NFD", letter.lower())[0]
        if (signs := _script(letter)) is not None:
            return signs[(signs.find(letter.lower()) + 1 + self.draw("initial", signs[0]) % (len(signs) - 1)) % len(signs)]
        return order[ord(plain) - 97] if "a" <= plain <= "z" else "x"

    def word(self, word: str, attempt: int = 0) -> str:
        """A made-up word in the case of ``word``; umlauts and their two-letter spellings give the same word."""
        plain = word.lower()
        for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
            plain = plain.replace(a, b)
        plain = unicodedata.normalize("NFD", plain)
        plain = "".join(c for c in plain if not unicodedata.combining(c))
        if (signs := _script(word[0])) is not None:
            out, n = self.letter(word[0]), self.draw("word", word.lower(), attempt)
            for _ in range(len(word) - 1 + attempt // 8):
                out += signs[n % len(signs)]
                n = n // len(signs) or self.draw("more", word, len(out), attempt)
            return out.upper() if word.isupper() and len(word) > 1 else out.capitalize() if word[0].isupper() else out
        n, gender = self.draw("word", plain, attempt), _FIRST.get(word.lower()) or _FIRST.get(plain)
        first = self.letter(word[0])
        out = first if first in _VOWELS else first + _VOWELS[n % 5]
        for _ in range(max(2, min(4, len(plain) // 3)) + attempt // 4):
            n //= 5
            out += _CONSONANTS[n % 16] + _VOWELS[n // 16 % 5]
            n //= 80
        out += {"f": "", "m": _CONSONANTS[n % 16], None: _CONSONANTS[n % 16] + "er"}[gender]
        if gender == "f":
            out = out[:-1] + "a"
        return out.upper() if word.isupper() and len(word) > 1 else out.capitalize() if word[0].isupper() else out

    def digits(self, text: str, keep: int, attempt: int) -> str:
        """Other digits and letters in the same places; the first ``keep`` signs stay, and a group that begins with
        2 to 9 still does, so area codes stay valid."""
        n, out = self.draw("digits", re.sub(r"\W", "", text).lower(), attempt), list(text[:keep])
        for c in text[keep:]:
            if c.isdigit():
                opens = c in "23456789" and not (out and out[-1].isdigit())
                out.append(str(2 + n % 8 if opens else n % 10))
                n = n // 10 or self.draw("more", text, len(out), attempt)
            elif c.isalpha() and c.isascii():
                letter = chr(97 + n % 26)
                out.append(letter.upper() if c.isupper() else letter)
                n = n // 26 or self.draw("more", text, len(out), attempt)
            else:
                out.append(c)
        return "".join(out)

    def of(self, kind: str, text: str, attempt: int = 0) -> str:
        if kind == "PERSON":
            parts = set(names.PARTICLES) | {w for p in names.PARTICLES for w in p.split()}
            return _WORD.sub(lambda m: m.group() if m.group().lower() in parts else self._initial(m.group(), attempt) if len(m.group()) == 1 else self.word(m.group(), attempt), text)
        if kind == "EMAIL_ADDRESS":
            last = re.search(r"[^\W\d_]+$", text)
            body = re.sub(r"[^\W_]+", lambda m: m.group() if m.group().lower() in ("at", "dot", "mail", "co", "com", "hr", "info", "ext", "group") else self._mixed(m.group(), attempt), text[: last.start()])
            return body + last.group()
        if kind == "PHONE_NUMBER":
            code = re.match(r"(?:\+|00)(?:1|[2-9]\d)[\s.-]?(?:\(0\))?\s?|\(?0", text)
            extension = re.search(r"\s?(?:x|ext\.?|durchwahl|dw\.?)\s?(?=\d{1,5}$)", text, re.I)
            cut_at = extension.start() if extension else len(text)
            head = self.digits(text[:cut_at], code.end() if code else 0, attempt)
            return head + (extension.group() + self.digits(text[extension.end() :], 0, attempt) if extension else "")
        if kind == "ID_NUMBER":
            return self.digits(text, 2 if text[:2].upper() == "QQ" else 0, attempt)
        kinds = r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|ufer|damm|chaussee|steig|street|road|lane|avenue|close|court|crescent|drive|way|place|square|terrace|gardens|grove|mews|st|rd|ave|ln|ct|cres|dr|pl|sq)\.?$"
        number = lambda m: str(1 + self.draw("number", m.group(), attempt) % 199)

        def street(m: re.Match) -> str:
            w = m.group()
            if w.isdigit():
                return number(m)
            if len(w) == 1 or re.fullmatch(kinds, w, re.I):
                return w
            tail = re.search(kinds, w, re.I)
            stem = w[: tail.start()] if tail else w
            return self.word(stem, attempt) + (tail.group() if tail else "")

        return re.sub(r"\d+|[^\W\d_]+", street, text)

    def _initial(self, letter: str, attempt: int) -> str:
        new = self.letter(letter)
        return new.upper() if letter.isupper() else new

    def _mixed(self, token: str, attempt: int) -> str:
        return re.sub(r"[^\W\d_]+|\d+", lambda m: self.digits(m.group(), 0, attempt) if m.group().isdigit() else m.group() if len(m.group()) == 1 else self.word(m.group(), attempt), token)


def _same(text: str) -> str:
    """What two spellings of one item share: its words or digits, in any case and order."""
    return " ".join(sorted(re.findall(r"[^\W\d_]+|\d+", text.lower())))


#: Draws after which the items that still collide are an error: their format has too few values.
MOST_DRAWS = 64


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """(type, text, attempt, surrogate) of all distinct items. Different items never share a surrogate.

    Spellings of one item (the same words or digits) may. Items whose surrogate is taken, or that are a real item
    of the table, draw again until all are distinct; the first of them in order of the text keeps it.
    """

    def start():
        draw = Surrogates(key.encode())

        def work(b: pa.RecordBatch) -> dict:
            kinds, texts, attempts = b["type"].to_pylist(), b["text"].to_pylist(), b["attempt"].to_pylist()
            made = [draw.of(*x) for x in zip(kinds, texts, attempts)]
            return {c: b[c] for c in ("type", "text", "attempt")} | {"surrogate": made, "same": list(map(_same, texts)), "made": list(map(_same, made))}

        return work

    every = cut(found.select(F.explode("items").alias("i")).select("i.type", "i.text").distinct().withColumn("attempt", F.lit(0)))
    schema = "type string, text string, attempt int, surrogate string, same string, made string"
    for _ in range(MOST_DRAWS):
        drawn = map_arrow(every, schema, start)
        # One row for each pair of item and surrogate; the first item keeps a surrogate that several have drawn.
        owner = F.min("same").over(Window.partitionBy("type", "made"))
        real = drawn.select("type", F.col("same").alias("made")).distinct().withColumn("real", F.lit(True))
        judged = cut(drawn.withColumn("owner", owner).join(real, ["type", "made"], "left").withColumn("again", (F.col("owner") != F.col("same")) | F.col("real").isNotNull()))
        if not judged.where("again").limit(1).count():
            return judged.select("type", "text", "attempt", "surrogate")
        every = judged.select("type", "text", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise ValueError(f"items still share surrogates after {MOST_DRAWS} draws")


def surrogates(df: DataFrame, id_col: str, text_col: str, key: str, learned=None) -> DataFrame:
    """(id, text) of every row with every item replaced by its surrogate.

    Surrogates follow from the key, so texts are rewritten where they lie; only the items that had to draw again are
    looked up: sent to the tasks up to BROADCAST_ROWS of them, joined by the item beyond.
    """
    found = items(df, id_col, text_col, every=True, learned=learned)
    odd = cut(surrogate_table(found.select("items"), key).where("attempt > 0").select("type", "text", "attempt"))
    kind = f"id {df.schema[id_col].dataType.simpleString()}, text string"
    if odd.count() <= BROADCAST_ROWS:
        rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("array<struct<type string, text string, attempt int>>").alias("odd"))
        few = df.sparkSession.sparkContext.broadcast({(r["type"], r["text"]): r["attempt"] for r in odd.collect()})
    else:
        rows = cut(items(df, id_col, text_col, with_text=True, every=True, learned=learned).withColumn("row", F.monotonically_increasing_id()))
        mine = rows.select("row", F.explode("items").alias("i")).select("row", "i.type", "i.text").distinct().join(odd, ["type", "text"])
        mine = mine.groupBy("row").agg(F.collect_list(F.struct("type", "text", "attempt")).alias("odd"))
        rows, few = rows.join(mine, "row", "left").select("id", "text", "odd"), None

    def start():
        draw, known = Surrogates(key.encode()), _learned(learned)

        def work(b: pa.RecordBatch) -> dict:
            out = []
            for t, odds in zip(b["text"].to_pylist(), b["odd"].to_pylist()):
                again = few.value if few is not None else {(x["type"], x["text"]): x["attempt"] for x in odds or []}
                out.append(_replaced(t, [(i, j, draw.of(k, t[i:j], again.get((k, t[i:j]), 0))) for i, j, k in find(t, known)]))
            return {"id": b["id"], "text": out}

        return work

    return map_arrow(rows, kind, start)


def invariants(df: DataFrame, id_col: str, text_col: str, key: str, learned=None) -> DataFrame:
    """(type, items, shared, real, kept) of the surrogates of all distinct items: how many share one with another
    item, are an item of the table themselves, or are equal to what they replace. All three are 0."""
    table = surrogate_table(items(df, id_col, text_col, every=True, learned=learned).select("items"), key)
    name = lambda c: F.array_join(F.array_sort(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]+|\d+"), F.lit(0))), " ")
    table = table.select("type", name(F.col("text")).alias("same"), name(F.col("surrogate")).alias("made"))
    used = table.groupBy("type", "made").agg(F.count_distinct("same").alias("owners"))
    real = table.select("type", F.col("same").alias("made")).distinct().withColumn("real", F.lit(1))
    counted = used.join(real, ["type", "made"], "left").groupBy("type").agg(F.count_if(F.col("owners") > 1).alias("shared"), F.count("real").alias("real"))
    return table.groupBy("type").agg(F.count_distinct("same").alias("items"), F.count_if(F.col("same") == F.col("made")).alias("kept")).join(counted, "type").select("type", "items", "shared", "real", "kept")
