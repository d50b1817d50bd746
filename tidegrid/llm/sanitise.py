"""Personal details in free text: found by kind, and replaced by typed placeholders.

Information-theoretic sanitisation: the corpus tells how many bits a term reveals about a protected entity, and terms above a
threshold are removed. Terms of a fixed form (e-mail addresses, telephone and identity numbers, street addresses) stand for
the entities themselves; such a term reveals the more, the fewer of the documents hold it. Names have no form of their own:
pairs of capitalised words are candidates, and a word reveals by how much more often than any word it stands beside an address
that contains it (pointwise mutual information). A pair holding a word above the threshold is a name; a word above it that
stands alone is generalised in the sanitised text. Where a text itself calls words first and last name, they have the form of one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.chunked import lookup
from tidegrid.functions.shared import cut
from tidegrid.llm.leakage import filter_of, passes

#: How the sign and the points of an e-mail address are written.
AT = r"""(?:@|＠|&\#64;|&\#x40;|&commat;|%40|\\u0040|\\x40|[ ]?[\[({<][ ]?(?:at|@)[ ]?[\])}>][ ]?|['"][ ]?\+[ ]?['"]@['"][ ]?\+[ ]?['"])"""
DOT = r"(?:\.|[ ]?[\[({<][ ]?(?:dot|\.)[ ]?[\])}>][ ]?|[ ]dot[ ])"
LOCAL = r"[A-Za-z0-9_][A-Za-z0-9._+'-]*"
EMAIL = re.compile(rf"({LOCAL})(?:{AT}(?:[A-Za-z0-9-]+{DOT})+[A-Za-z]{{2,}}|[ ]at[ ](?:[A-Za-z0-9-]+[ ]dot[ ])+[A-Za-z]{{2,}})(?![A-Za-z0-9@])", re.I | re.X)
#: Places worth trying: the search for addresses looks only around these.
_AT_PLACE = re.compile(r"[@＠]|&(?:#64|#x40|commat);|%40|\\[ux]0{0,2}40|(?<![A-Za-z])at(?![A-Za-z])", re.I)
_AT_SIGN = re.compile(r"[@＠]|&(?:#64|#x40|commat);|%40|\\[ux]0{0,2}40", re.I)
#: How AT begins where it is spelt in brackets.
_AT_WORDS = tuple(f"{b}{s}at" for b in "[({<" for s in ("", " "))
#: What may stand between the local part and such a place, and the letters of a local part.
_BETWEEN_AT, _LOCAL_LETTERS = frozenset(" [({<'\"+"), frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+'-")
_CLONE = re.compile(r":(?!//)[\w.~-]*/")

#: The numbers that identify a person, as they are called.
ID_NUMBER = re.compile(
    r"""(?<![A-Za-z])(?:ssn|nino|ni[ _-]?(?:no|number|nr)|social[ _-]?security|national[ _-]?(?:insurance|identity|identification|id)
    |personal[ _-]?(?:identity|identification|id|no|number|nummer|code)|identity[ _-]?(?:card|number|no)|id[ _-]card|passport
    |tax[ _-]?(?:id|identification|payer|file|number|no)|driv(?:er'?s?|ing)[ _-]?licen[cs]e)(?![a-z])
    (?:[ _-]?(?:card|no\.?|number|num\.?|nr\.?|id|code|is|\#))*["']?[ ]?[:=\#]?[ ]?["']?
    ([A-Z]{0,6}[ ]?\d(?:[ ./-]?[0-9A-Z]){3,16})(?![a-z])""",
    re.I | re.X,
)
#: Of these, one is part of whatever ID_NUMBER accepts.
_ID_WORDS = (*(f"ni{s}{w}" for s in ("", " ", "_", "-") for w in ("no", "nu", "nr")), "ssn", "security", "national", "personal", "identity", "id card", "id-card", "id_card", "passport", "tax", "licen")

PHONE = re.compile(
    r"""(?<![\w.,/+-])(?:
    (?:\+|00[ ]?)[1-9]\d{0,2}[ ./-]?(?:\(0\)[ ]?)?(?:\(\d{1,5}\)[ ./-]?)?\d(?:[ ./-]?\d){5,12}
    |(?:1[ .-])?(?:\([2-9]\d\d\)[ .-]?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4}
    |\(0\d{1,4}\)[ ]?\d{2,5}(?:[ -]?\d{2,5}){1,3}
    |0\d{1,4}[ /-]\d{2,5}(?:[ -]\d{2,5}){0,4}
    )(?![\w/]|[.-]\d)(?:[ ]?(?:ext\.?|x)[ ]?\d{1,6})?""",
    re.X,
)

#: Words for streets.
_KINDS = "Street St Road Rd Lane Ln Avenue Ave Boulevard Blvd Close Way Terrace Quay Court Ct Drive Place Square Row Crescent Gardens Grove Hill Mews Parade Walk Highway Parkway Alley".split()
_KIND = "|".join([*_KINDS, *(k.upper() for k in _KINDS)])
_UP = r"[A-ZÀ-ÖØ-Þ]"
ADDRESS = re.compile(
    rf"""(?<![\w.#$])(?:
    (?:(?:Flat|Apt|Apartment|Unit|Suite|FLAT|APT|UNIT)\.?[ ]\d+[A-Za-z]?,?[ ])?\d{{1,5}}[a-zA-Z]?,?[ ](?:[NSEW]\.?[ ])?(?:{_UP}[\w'’-]+[ ]){{1,3}}?(?:{_KIND})(?![\w])\.?
    )(?!\w)""",
    re.X,
)
#: Places after which German streets without a word for street are called.
_NOUNS = "Markt|Marktplatz|Bahnhof|Rathaus|Graben|Stadtgraben|Anger|Ring|Berg|Park|See|Kirche|Kirchplatz|Mühle|Brücke|Hof|Wall|Tor|Bach|Linden|Hang|Wald|Feld|Garten"
ADDRESS_ABROAD = re.compile(
    rf"""(?<![\w.#$])(?:
    \d{{1,5}}(?:[ ]?(?:bis|ter))?,?[ ](?:[Rr]ue|RUE|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin)[ ](?:(?:des?|du|de[ ]la|de[ ]l'|DES?|DU)[ ]|d')?{_UP}[\w'’-]+
    |(?:Calle|Via|Rua|Avenida|Plaza|Paseo|Ulica|ul\.|CALLE|VIA|RUA)[ ](?:(?:de|del|la|da|do|di)[ ])*{_UP}[\w'’-]+,?[ ]\d{{1,4}}
    |(?:Am|Im|An[ ]der|Auf[ ]de[rm]|Zum|Zur|Unter[ ]den|Hinter[ ]de[rm])[ ](?:{_NOUNS})[ ]\d{{1,4}}(?:[ ]?[a-z])?
    |{_UP}[\w'’-]*(?:straat|gasse|strasse|straße|str\.|weg|laan|gade|gatan|vägen|plein|platz|allee|STRAAT|GASSE|STRASSE)[ ]\d{{1,4}}(?:[ ]?(?:bis|[a-z]))?
    )(?!\w)""",
    re.X,
)
#: One of these, or a German place and a number, is part of whatever ADDRESS_ABROAD accepts.
_ABROAD = "rue avenue boulevard place chemin calle via rua avenida plaza paseo ulica ul. straat gasse strasse straße str. weg laan gade gatan vägen plein platz allee".split()
_GERMAN_PLACE = re.compile(rf"[mnr] (?:{_NOUNS}) \d")
_NUMBER_NAME = re.compile(rf"\d[A-Za-z]?,? {_UP}")
_DIGIT_GAP = re.compile(r"\+\d{9}|\d[ ./()-]{1,2}\d")
#: The rest of an address behind the street: flat, postcode, town.
ADDRESS_REST = re.compile(
    rf"(?:,? (?:Flat|Apt|Apartment|Unit|Suite|FLAT|APT|UNIT)\.? \d+[A-Za-z]?)?(?:,? (?:[A-Z]{{2}} ?)?\d{{4,5}}(?: [A-Z]{{2}})?)?(?:,? {_UP}[\w-]+(?: {_UP}[\w-]+)?)?(?:,? (?:[A-Z]{{2}} )?\d{{4,5}}(?: [A-Z]{{2}})?(?![\w-]))?"
)


def _letters(wanted) -> str:
    """The letters of the kind as a class of ranges, without brackets. Beyond these planes no script has case but rare ones."""
    points = [c for c in [*range(0x41, 0x2E00), *range(0xA640, 0xA800), *range(0xFF21, 0xFF5B), *range(0x10400, 0x10500)] if wanted(chr(c))]
    cuts = [k for k in range(1, len(points)) if points[k] != points[k - 1] + 1]
    return "".join(f"{chr(points[i])}-{chr(points[j - 1])}" for i, j in zip([0, *cuts], [*cuts, len(points)]))


#: Upper-case letters; lower-case letters and the marks that stand for accents.
_CAPITAL = f"[{_letters(lambda c: c.isupper() or c.istitle())}]"
_SMALL = f"[{_letters(str.islower)}\u0300-\u036f]"
#: Dvořák, McDonald, O'Brien, Xxx-Yyy; DVOŘÁK, O'BRIEN, XXX-YYY.
_CAPITALISED = rf"(?:{_CAPITAL}['’])?{_CAPITAL}{_SMALL}+(?:{_CAPITAL}{_SMALL}+)*(?:['’]{_CAPITAL}?{_SMALL}+)*"
_WORD = rf"(?:{_CAPITALISED}(?:-{_CAPITALISED})*|(?:{_CAPITAL}['’])?{_CAPITAL}{{2,}}(?:['’]{_CAPITAL}+)*(?:-{_CAPITAL}{{2,}})*)"
#: Words inside a surname.
_PARTICLES = "van von vom der den de del della di da das dos du la le las los ter ten te zu zum zur bin ibn al el af av".split()
_PARTICLE = "|".join([*_PARTICLES, *(w.capitalize() for w in _PARTICLES), *(w.upper() for w in _PARTICLES)])
_BETWEEN = rf"(?:(?: [A-Z]\.)? |, )(?:(?:{_PARTICLE}) ){{0,3}}"
PAIR = re.compile(rf"(?<![\w@.+%/-])(?:(Dr|Mr|Mrs|Ms|Miss|Prof|DR|MR|MRS|MS|PROF)\.? )?({_WORD})(?=({_BETWEEN})({_WORD})(?![\w@]))")
#: A word in any case and script.
_LETTER = r"[^\W\d_][\u0300-\u036f]*"
_ANY_WORD = rf"(?:{_LETTER}['’])?(?:{_LETTER}){{2,}}(?:['’-](?:{_LETTER})+)*"
#: Such a word outside addresses and paths; what may stand between the two words of a name in any case.
_LOOSE = re.compile(rf"(?<![\w@.+%/-]){_ANY_WORD}(?![\w@]|[.]\w)")
_LOOSE_ASCII = re.compile(r"(?<![\w@.+%/-])(?:[a-z]')?[a-z]{2,}(?:['-][a-z]+)*(?![\w@]|[.]\w)", re.A)
_LOOSE_BETWEEN = re.compile(rf"(?:(?: [^\W\d_]\.)? |, )(?:(?:{'|'.join(_PARTICLES)}) ){{0,3}}", re.I)
_BOTH_CAPITALISED = re.compile(rf"{_WORD}\n{_WORD}")
_NO_NAMES = frozenset(_PARTICLES)
KEYED = re.compile(rf"(?:first|given|fore)_?name[\"']?\s*[:=]\s*[\"']?({_ANY_WORD})[\"']?[,;]?[ \t]*[\"']?(?:last|sur|family)_?name[\"']?\s*[:=]\s*[\"']?({_ANY_WORD})", re.I)
_HAS_KEY = "name"
_TITLES = frozenset("dr mr mrs ms miss prof".split())
#: Words that go to the tasks as they are; of more words a filter goes there.
MOST_WORDS = 1_000_000
#: The evidence of a pair in other than capitalised words.
LOOSE = 3
#: Letters that have no accent to take off.
_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "þ": "th", "ð": "d"})
KINDS = ("email", "phone", "id_number", "address", "name")
#: A lone word that reveals as much as a name; it is generalised, not listed as a name.
PART = "name_part"
SCHEMA = "{id}, line_no bigint, kind string, start int, stop int, first string, second string, evidence int, words bigint"


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def folded(word: str) -> str:
    """The word without case and accents, by which its occurrences are counted together."""
    word = word.lower()
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word.translate(_PLAIN)) if not unicodedata.combining(c))


def _loose_words(text: str) -> Iterator[tuple[str, int, int]]:
    """(folded word, start, stop) of the words of a text that are no part of an address, path or package name."""
    if text.isascii():  # the same words, several times faster
        for m in _LOOSE_ASCII.finditer(text.lower()):
            yield m[0], m.start(), m.end()
        return
    for m in _LOOSE.finditer(text):
        yield folded(m[0]), m.start(), m.end()


def _loose_pairs(text: str, words: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, str, int, int]]:
    """(first, second, start, stop) of neighbours among the words that PAIR doesn't take."""
    before = None
    for w in words:
        if w[0] in _NO_NAMES or w[0] in _TITLES:
            continue
        if before and w[1] - before[2] <= 32 and _LOOSE_BETWEEN.fullmatch(text, before[2], w[1]) and not _BOTH_CAPITALISED.fullmatch(f"{text[before[1]:before[2]]}\n{text[w[1]:w[2]]}"):
            yield before[0], w[0], before[1], w[2]
        before = w


def _made_of(local: str, first: str, second: str) -> bool:
    """Whether an address holds both words, or one of them and the initial of the other."""
    for w, other in ((first, second), (second, first)):
        if len(w) > 2 and w in local and (len(other) > 2 and other in local or local.replace(w, "", 1).strip("._+-0123456789") == other[0]):
            return True
    return False


def details(text: str, quick: bool = True) -> list[tuple[str, int, int, str | None, str | None, int]]:
    """Details of a text as (kind, start, stop, term, None, 0) and candidate names as ("name", start, stop, word, word, evidence).

    evidence: 2 if the text itself names the parts of the name, 1 if an address on the same line contains one of the words or
    a title stands before them, LOOSE if the words aren't both capitalised and an address on the same line is made of them, else 0.
    quick leaves out searches that a plain look at the text shows to be in vain; it never changes the result.
    """
    out: list[tuple[str, int, int, str | None, str | None, int]] = []
    taken: list[tuple[int, int]] = []
    mails: list[tuple[int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    lower = text.lower()
    for a, b, local in _addresses(text, lower, quick):
        line = text[text.rfind("\n", 0, a) + 1 : a]
        address = line[max(line.rfind(" "), line.rfind("\t"), line.rfind('"'), line.rfind("'")) + 1 :]
        clone = local == "git" or _CLONE.match(text, b)
        if clone or "://" in address or (address.endswith(":") and not address.lower().endswith(("mailto:", "mail:", "e-mail:", "contact:"))):
            taken.append((a, b))
            continue
        out.append(("email", a, b, text[a:b].lower(), None, 0))
        taken.append((a, b))
        mails.append((a, local.split("+")[0]))
    if not quick or any(w in lower for w in _ID_WORDS):
        for m in ID_NUMBER.finditer(text):
            if _digits(m[1]) >= 4 and free(*m.span()):
                out.append(("id_number", m.start(1), m.end(1), m[1].upper(), None, 0))
                taken.append(m.span())
    for m in PHONE.finditer(text) if not quick or _DIGIT_GAP.search(text) else ():
        a, b = m.span()
        number = re.split(r" ?(?:ext|x)", m[0])[0]
        n = _digits(number)
        bare = number.isdigit()
        if 9 <= n <= 15 + number.startswith("00") * 2 and not (bare and not number.startswith("+")) and free(a, b):
            out.append(("phone", a, b, "".join(c for c in number if c.isdigit()), None, 0))
            taken.append((a, b))
    streets = [*(ADDRESS.finditer(text) if not quick or _NUMBER_NAME.search(text) else ()), *(ADDRESS_ABROAD.finditer(text) if not quick or any(w in lower for w in _ABROAD) or _GERMAN_PLACE.search(text) else ())]
    for m in streets:
        a, b = m.span()
        if free(a, b):
            rest = ADDRESS_REST.match(text, b)
            b = rest.end() if rest and free(a, rest.end()) else b
            out.append(("address", a, b, text[a:b].lower(), None, 0))
            taken.append((a, b))
    if not quick or _HAS_KEY in lower:
        for m in KEYED.finditer(text):
            if free(*m.span()):
                out.append(("name", m.start(1), m.end(2), folded(m[1]), folded(m[2]), 2))
                taken.append(m.span())
    for m in PAIR.finditer(text):
        first, second = folded(m[2]), folded(m[4])
        a, b = m.start(2), m.end(4)
        if first in _TITLES or second in _TITLES or not free(a, b):
            continue
        evidence = 0
        if mails:
            low, high = text.rfind("\n", 0, a), text.find("\n", b)
            near = [x for p, x in mails if p > low and (high < 0 or p < high)]
            evidence = int(any((len(w) > 2 and w in x) for x in near for w in (first, second, *second.split("-"))))
        # A title before capitalised words is weaker than an address, but of the same kind.
        out.append(("name", a, b, first, second, evidence or int(bool(m[1]))))
    lines: dict[int, list[str]] = {}
    for p, x in mails:
        lines.setdefault(text.rfind("\n", 0, p) + 1, []).append(x)
    for low, near in lines.items():
        high = text.find("\n", low)
        line = text[low : high if high >= 0 else len(text)]
        for first, second, a, b in _loose_pairs(line, _loose_words(line)):
            if free(low + a, low + b) and any(_made_of(x, first, second) for x in near):
                out.append(("name", low + a, low + b, first, second, LOOSE))
    return out


def _addresses(text: str, lower: str, quick: bool = True) -> Iterator[tuple[int, int, str]]:
    """(start, stop, local part) of what looks like an e-mail address, in any spelling and of any length."""
    spelt = not quick or " dot " in lower or any(w in lower for w in _AT_WORDS)
    if not (spelt or "@" in text or "＠" in text or "%40" in text or "&#" in text or "&commat" in lower or "u0040" in lower or "x40" in lower):
        return
    done = 0
    for place in _AT_PLACE.finditer(text) if spelt else _AT_SIGN.finditer(text):
        start = place.start()
        if start < done:
            continue
        # Outwards from the sign: what may stand before it, then the whole local part, wherever it begins.
        while start > done and text[start - 1] in _BETWEEN_AT:
            start -= 1
        while start > done and text[start - 1] in _LOCAL_LETTERS:
            start -= 1
        while start < place.start() and text[start] in "._+'-":
            start += 1
        m = EMAIL.match(text, start)
        if m and m.end() > place.start():
            done = m.end()
            yield m.start(), m.end(), m[1].lower()


def _line_numbers(text: str, starts: list[int]) -> list[int]:
    """Line of each position; lines count from 1 and end at each line feed."""
    ends, at = [], text.find("\n")
    last = max(starts)
    while 0 <= at < last:
        ends.append(at)
        at = text.find("\n", at + 1)
    return [bisect_right(ends, s - 1) + 1 for s in starts]


def scan(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All details and candidate names of all texts, and the words and (in start) the documents of each batch (kind NULL). Whole texts are read."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            words = held = 0
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                words += t.count(" ") + 1
                held += 1
                found = details(t)
                if found:
                    for n, d in zip(_line_numbers(t, [d[1] for d in found]), found):
                        rows.append((i, n, *d, 0))
            rows.append((None, None, None, held, None, None, None, None, words))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64()]
            ids = b.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], names=["id", "line_no", "kind", "start", "stop", "first", "second", "evidence", "words"]
            )

    return documents.select(doc_id, text).mapInArrow(run, SCHEMA.format(id=f"id {kind}"))


def _base(scanned: DataFrame) -> float:
    """Share of the words of the corpus that stand beside evidence."""
    total = scanned.agg(F.sum("words").alias("words"), F.count_if((F.col("evidence") > 0) & (F.col("evidence") != LOOSE)).alias("evidence")).first()
    return max(1, total["evidence"] or 0) / max(1, total["words"] or 0)


def _bits(base: float):
    return F.log2(F.col("e") / (F.col("n") + 1) / F.lit(base))


def _by_word(names: DataFrame) -> DataFrame:
    """word, n pairs that hold it and e of them with evidence."""
    seen = names.select(F.explode(F.array("first", "second")).alias("word"), (F.col("evidence") > 0).cast("int").alias("e"))
    return seen.groupBy("word").agg(F.count("*").alias("n"), F.sum("e").alias("e")).filter("e > 0")


def disclosure(scanned: DataFrame, threshold_bits: float = 9.0) -> DataFrame:
    """The words that reveal protected entities: word, bits. All documents are counted.

    bits = log2(P(evidence | word) / P(evidence)), where P(evidence) is taken over all words of the corpus and a word's own
    share is damped by one more occurrence without evidence.
    """
    names = scanned.filter(f"kind = 'name' and evidence <> {LOOSE}")
    return _by_word(names).select("word", _bits(_base(scanned)).alias("bits")).filter(F.col("bits") >= threshold_bits)


class WordFilter:
    """Words by a Bloom filter of bounded size, for vocabularies too large to send whole; a few others pass too."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __contains__(self, word: str) -> bool:
        return bool(passes(self.words, np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))[0])


def vocabulary(words: DataFrame, rows: int):
    """The `rows` words of a table for a search in tasks: all of them while few, else a filter that lets each of them pass."""
    if rows <= MOST_WORDS:
        return frozenset(r["word"] for r in words.select("word").collect())

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([xxhash.xxh3_64_intdigest(w) for w in b.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values)], names=["code"])

    return WordFilter(filter_of(words.select("word").mapInArrow(codes, "code bigint"), "code", rows))


def loose_names(documents: DataFrame, scanned: DataFrame, doc_id: str, text: str, threshold_bits: float, strong: DataFrame | None = None) -> DataFrame:
    """Names not written in capitalised words: id, line_no, kind, start, stop, bits; one more pass over the texts.

    The words with any evidence, or a filter that lets them pass, go to the tasks; what passes is joined to the words
    themselves. Their disclosure is measured anew, over all their occurrences in any case, since common words are names in
    capitals only. In small letters the neighbour of a disclosing word may be any word: a pair is a name if one word reaches
    the threshold and the other discloses too. With `strong`, the words above the threshold, each of them that stands
    alone is given as PART, if it is above it in any case too.
    """
    known = cut(_by_word(scanned.filter("kind = 'name'")).select("word", "e").filter(~F.col("word").isin(*_NO_NAMES, *_TITLES)))
    rows = known.count()
    context = documents.sparkSession.sparkContext
    shared, alone = context.broadcast(vocabulary(known, rows)), context.broadcast(vocabulary(strong, strong.count()) if strong is not None else frozenset())
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, strong_words = shared.value, alone.value
        for b in batches:
            found: list[tuple] = []
            counts: Counter = Counter()
            for i, t in enumerate(b.column(1).to_pylist()):
                hits = [w for w in _loose_words(t) if w[0] in wanted] if t else []
                counts.update([w[0] for w in hits])
                pairs = [*_loose_pairs(t, hits)] if len(hits) > 1 else []
                lone = [(w, None, a, z) for w, a, z in hits if w in strong_words]
                if pairs or lone:
                    both = [*pairs, *lone]
                    found += [(i, n, a, z, x, y, None) for n, (x, y, a, z) in zip(_line_numbers(t, [p[2] for p in both]), both)]
            found += [(None, None, None, None, w, None, n) for w, n in counts.items()]
            if found:
                columns = list(zip(*found))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
                ids = b.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], names=["id", "line_no", "start", "stop", "first", "second", "n"])

    seen = cut(documents.select(doc_id, text).mapInArrow(run, f"id {kind}, line_no bigint, start int, stop int, first string, second string, n bigint"))
    counted = seen.filter("n is not null").groupBy(F.col("first").alias("word")).agg(F.sum("n").alias("n"))
    measured = cut(known.join(counted, "word").select("word", _bits(_base(scanned)).alias("bits")).filter("bits > 0"))
    few = measured.count()
    pairs = seen.filter("n is null and second is not null")
    for side in ("first", "second"):
        pairs = lookup(pairs, measured.select(F.col("word").alias(side), F.col("bits").alias(f"{side}_bits")), [side], few, "inner")
    pairs = pairs.withColumn("bits", F.greatest("first_bits", "second_bits")).filter(F.col("bits") >= threshold_bits)
    out = pairs.select("id", "line_no", F.lit("name").alias("kind"), "start", "stop", "bits")
    if strong is None:
        return out
    lone = lookup(seen.filter("n is null and second is null"), measured.withColumnRenamed("word", "first"), ["first"], few, "inner").filter(F.col("bits") >= threshold_bits)
    return out.unionByName(lone.select("id", "line_no", F.lit(PART).alias("kind"), "start", "stop", "bits"))


def fixed_terms(scanned: DataFrame, least_bits: float) -> DataFrame:
    """The details of a fixed form with what their term reveals: id, line_no, kind, start, stop, bits.

    bits = log2(documents / documents that hold the term). A term in so many documents that it reveals less than `least_bits`
    is no detail of anyone.
    """
    total = scanned.filter("kind is null").agg(F.sum("start").alias("n")).first()["n"] or 1
    fixed = scanned.filter("kind <> 'name'").select("id", "line_no", "kind", "start", "stop", F.col("first").alias("term"))
    spread = fixed.groupBy("kind", "term").agg(F.count_distinct("id").alias("held"))
    bits = F.log2(F.lit(float(total)) / F.greatest(F.col("held"), F.lit(1)))
    rated = fixed.join(spread, ["kind", "term"]).select("id", "line_no", "kind", "start", "stop", bits.alias("bits"))
    return rated.filter(F.col("bits") >= least_bits) if total > 1 else rated


def personal_details(documents: DataFrame, doc_id: str, text: str, threshold_bits: float = 9.0, least_bits: float = 0.5, parts: bool = False) -> DataFrame:
    """One row (doc_id, line_no, kind, start, stop, bits) per detail; start and stop count code points of the text.

    Kinds: email, phone, id_number, address, name, and with `parts` also PART, lone words as telling as a name. bits is what
    the term reveals by the counts of the whole corpus; details below `least_bits` (fixed forms) or `threshold_bits` (names)
    are left out, but for names whose parts the text itself calls so. One pass over the texts yields the details and the capitalised candidate names; the words' disclosure comes
    from counts of all candidates and is joined back to them. A second pass looks up the words so found in any other case.
    Candidates and details are written to the shared checkpoint folder once. Defined cases: NULL and empty texts hold nothing;
    lines count from 1 and end at each line feed; a detail belongs to the line in which it begins; repeated documents are
    found each; clone addresses, connection strings and package versions are no e-mail addresses; other columns are not read.
    """
    scanned = cut(scan(documents, doc_id, text))
    words = cut(disclosure(scanned, threshold_bits))
    few = words.count()
    pairs = scanned.filter("kind = 'name'")
    for side in ("first", "second"):
        pairs = lookup(pairs, words.select(F.col("word").alias(side), F.col("bits").alias(f"{side}_bits")), [side], few)
    named = F.greatest("first_bits", "second_bits")
    names = pairs.withColumn("bits", named).filter("bits is not null or evidence = 2").select("id", "line_no", "kind", "start", "stop", "bits")
    loose = loose_names(documents, scanned, doc_id, text, threshold_bits, words if parts else None)
    out = fixed_terms(scanned, least_bits).unionByName(names).unionByName(loose)
    return out.groupBy("id", "line_no", "kind", "start", "stop").agg(F.max("bits").alias("bits")).withColumnRenamed("id", doc_id)


def replace_details(documents: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents with placeholders such as [EMAIL] for the details found, and n_details; everything else stays as it is.

    Overlapping details become one placeholder, that of the first, for all that they cover together; a lone telling word is
    generalised to [NAME]. A filter of bounded size made from the ids with details keeps all other texts out of the join, in
    which the details of a document, bounded by its text, meet it. Documents with equal doc_id get the details of each of them.
    """
    kind = F.when(F.col("kind") == PART, "name").otherwise(F.col("kind")).alias("kind")
    spans = cut(found.select(doc_id, "start", "stop", kind).groupBy(doc_id).agg(F.sort_array(F.collect_set(F.struct("start", "stop", "kind"))).alias("__spans")))
    held = documents.sparkSession.sparkContext.broadcast(filter_of(spans.select(F.xxhash64(doc_id).alias("key")), "key", spans.count()))

    @F.pandas_udf("boolean")
    def may_hold(key: pd.Series) -> pd.Series:
        return pd.Series(passes(held.value, key.to_numpy(np.int64).view(np.uint64)))

    columns = [c for c in documents.columns if c not in (text, "n_details")]
    marked = documents.withColumn("__in", may_hold(F.xxhash64(doc_id)))
    right = spans.withColumnRenamed(doc_id, "__doc")
    joined = marked.filter("__in").join(right, F.col(doc_id).eqNullSafe(F.col("__doc")), "left").select(*columns, F.col(text).alias("__text"), "__spans")
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t, own in zip(b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist()):
                n, at, parts = 0, 0, []
                for s in own or [] if t else []:
                    if not n or s["start"] >= at:
                        parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                        n += 1
                    at = max(at, s["stop"])
                texts.append("".join(parts) + t[at:] if t is not None else None)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[*columns, text, "n_details"])

    changed = joined.mapInArrow(run, f"{kinds}, `{text}` string, n_details int")
    return changed.unionByName(marked.filter("not __in").select(*columns, text, F.lit(0).alias("n_details")))
