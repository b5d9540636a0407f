"""Reading organisation names that people typed: brand keys, national markers and how far each reading can be trusted.

A name is folded (case, accents, script, doubled letters), split into words and
stripped of the words that very many names share, which are learned from the
corpus; what is left is the brand.  Codes (AS names, web addresses) write the
same brand without blanks, whole or cut short.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in more than this share of the distinct names (and in at least so many) are generic; the list has at most 12 / share words.
GENERIC_SHARE, GENERIC_LEAST = 0.0005, 8
#: Of a generic word's names so many at most go with each different word it stands with: names have several spellings.
NAMES_A_PARTNER = 4
#: Trust in a reading: a whole code, a brand confirmed by a cut code, a brand from a name alone, a cut or partial brand.
CODE, CONFIRMED, NAMED, PARTIAL = 3, 2, 1, 0

# Legal forms and their parts, folded.
LEGAL = frozenset(
    "a ab ag ao as asn b c co company corp corporation cv d de e eireli epp ev g gmbh gesellschaft haftung mit beschrankter h inc "
    "incorporated jsc k kg l lda limitada limited llc llp ltd ltda me n o oao oo ooo p pao pjsc plc private pte pty public pvt r s sa sarl "
    "sas sl sp spol spolka sro srl sti sirketi t the und v z zoo group trading dba site aktiebolag aktiengesellschaft anonim sociedad "
    "societe spolecnost akciova verein eingetragener joint stock par actions simplifiee".split()
)
# Countries as they stand in the names of national subsidiaries, folded, with the code of each.
COUNTRIES = {
    "americas": "us", "usa": "us", "argentina": "ar", "australia": "au", "brasil": "br", "brazil": "br", "canada": "ca", "china": "cn",
    "cesko": "cz", "deutschland": "de", "germany": "de", "espana": "es", "france": "fr", "uk": "gb", "india": "in", "japan": "jp",
    "mexico": "mx", "nigeria": "ng", "polska": "pl", "portugal": "pt", "russia": "ru", "sverige": "se", "turkiye": "tr", "africa": "za",
    "italia": "it", "nederland": "nl", "norge": "no", "danmark": "dk", "suomi": "fi", "schweiz": "ch", "osterreich": "at", "colombia": "co",
    "chile": "cl", "peru": "pe", "indonesia": "id", "singapore": "sg", "kenya": "ke", "egypt": "eg", "ukraina": "ua", "korea": "kr",
}
_CODES = frozenset(COUNTRIES.values())
_NO_BRAND = LEGAL | COUNTRIES.keys() | {"south"}
# Cyrillic letters in Latin.
_CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i j k l m n o p r s t u f h c ch sh sh _ y _ e ju ja".split()))
_EXTRA = {"ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "đ": "d", "ı": "i", "œ": "oe"}
# What follows the brand in Chinese and Japanese names.
_CJK_TAIL = regex.compile(r"(?:网络|网科|信息|信科|数据|电信|科技|股份|有限|集团|インターネット|データ|通信|ネットワーク|株式|\(株\)|（株）|[.．]).*$")
_CJK = regex.compile(r"[\p{Han}\p{Katakana}\p{Hiragana}ー]")
_WORD = re.compile(r"[a-z0-9?]+")
_ALSO = regex.compile(r"\((?:dba|d/b/a|t/a|aka)\s+([^)]*)\)|\b(?:trading as|doing business as|dba|d/b/a|t/a)\s+(.+)$", regex.I)
_PLACE = regex.compile(r"\([^)]*\)|\s[-–—]\s[^-–—]*$")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})")
_ASCII_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_PLACE_MARKS = frozenset("(-–—")
_HOST = regex.compile(r"^\s*(?:[a-z]+:/*)?(?:[^/@]*@)?([^/?#:\s]+)(?::\d+)?(/[^?#\s]*)?", regex.I)


class _Letters(dict):
    """Letters by their numbers; any other stands for itself, which ``translate`` finds faster listed than lacking."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


_LETTERS = _Letters(str.maketrans({k: v.replace("_", "") for k, v in _CYRILLIC.items()} | _EXTRA | {"\ufffd": "?"}))
_MARKS, _DAMAGE = regex.compile(r"\p{M}+"), regex.compile(r"\?{2,}")


@functools.lru_cache(maxsize=50_000)
def fold(text: str) -> str:
    """Lower case Latin letters without accents; Cyrillic is written in Latin; damaged characters become ``?``."""
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text.translate(_LETTERS))
    text = text if text.isascii() else _MARKS.sub("", text)
    return _DAMAGE.sub("?", text) if "??" in text else text


_GAP = re.compile(r"[^a-z0-9?]+")
_NO_KEY, _TWICE = re.compile(r"[^a-z0-9?]+"), re.compile(r"(.)\1+")


@functools.lru_cache(maxsize=50_000)
def key(text: str) -> str:
    """A folded brand without blanks, two-letter vowels and doubled letters, the commonest ways of typing it differently."""
    text = _NO_KEY.sub("", text).replace("ae", "a").replace("oe", "o").replace("ue", "u")
    return _TWICE.sub(r"\1", text) if _TWICE.search(text) else text


def words_of(name: str) -> list[str]:
    """The folded words of a name; words written in one with inner capitals count apart."""
    if name.islower() or name.isupper():
        return _WORD.findall(fold(name))
    return _WORD.findall(fold((_ASCII_CAMEL if name.isascii() else _CAMEL).sub(" ", name)))


def _cut_countries() -> dict[str, str]:
    """Beginnings of four letters or more that only one country's name has."""
    found: dict[str, set[str]] = {}
    for name, code in COUNTRIES.items():
        for n in range(4, len(name)):
            found.setdefault(name[:n], set()).add(code)
    return {head: codes.pop() for head, codes in found.items() if len(codes) == 1}


_CUT_COUNTRIES = _cut_countries()


def country_of(words: list[str]) -> str:
    """The code of the country that a name carries, also cut short to four letters or more; empty if none."""
    for k, w in enumerate(words):
        if w in COUNTRIES and (w != "africa" or (k and words[k - 1][:4] == "sout")):
            return COUNTRIES[w]
    for w in words[2:]:
        if 4 <= len(w) < 8 and w not in LEGAL:
            if w in _CUT_COUNTRIES:
                return _CUT_COUNTRIES[w]
    return ""


def _may_say_also(name: str) -> bool:
    """Whether ``_ALSO`` may match: cheaper, and so nearly all names are spared it."""
    text = name.lower()
    return not text.isascii() or "(" in text or "dba" in text or "/a" in text or " as" in text


class Reading:
    """What one name says: brand words in order, country, native stem, and the generic words left."""

    __slots__ = ("brand", "country", "native", "rest")

    def __init__(self, name: str, generic: frozenset[str]):
        native = ""
        if not name.isascii() and _CJK.search(name):
            stem = _CJK_TAIL.sub("", name.strip())
            native = "".join(_CJK.findall(stem))
        words = words_of(name)
        self.country = country_of(words)
        self.native = native if len(native) >= 3 else ""
        plain = [w for w in words if w not in _NO_BRAND and w not in generic]
        self.brand = [w for w in plain if not w.isdigit() and w.isascii()][:2] if not native else []
        self.rest = frozenset(w[:3] for w in words if w in generic and w not in LEGAL)


@functools.lru_cache(maxsize=60_000)
def read_name(name: str, generic: frozenset[str]) -> list[Reading]:
    """The readings of a typed name: itself, and what it says it is also known as."""
    also = [a or b for a, b in _ALSO.findall(name)] if _may_say_also(name) else []
    main = _ALSO.sub(" ", name) if also else name
    if not _PLACE_MARKS.isdisjoint(main) and (main.isascii() or not _CJK.search(main)):
        main = _PLACE.sub(" ", main)
    return [Reading(x, generic) for x in [main, *also] if x.strip()]


@functools.lru_cache(maxsize=60_000)
def read_code(code: str) -> tuple[str, bool, str]:
    """(brand key, cut short, country code) of an AS name; a country code at its end means that the brand is cut."""
    parts = [p for p in _GAP.split(fold(code)) if p]
    if parts and parts[0] == "as":
        parts = parts[1:]
    country = ""
    if len(parts) > 1 and parts[-1] in _CODES:
        country = parts.pop()
    while len(parts) > 1 and parts[-1] in ("as", "asn", "net"):
        parts.pop()
    return key("".join(parts)), bool(country), country


def read_website(url: str, shared: frozenset[str]) -> tuple[str, bool, str, str]:
    """(brand key, cut short, country, host) of a web address; on a shared host the path names the brand, cut short."""
    m = _HOST.match(url or "")
    host = (m.group(1) if m else "").lower().rstrip(".")
    labels = [x for x in host.split(".") if x]
    if len(labels) < 2:
        return "", False, "", ""
    if labels[-1] == "example":
        labels = labels[:-1]
    if labels and labels[0] == "www":
        labels = labels[1:]
    if len(labels) < 2:
        return "", False, "", ""
    site = ".".join(labels)
    if site in shared:
        slug = [p for p in _GAP.split(fold((m.group(2) or "").strip("/").split("/")[0])) if p]
        country = slug.pop() if len(slug) > 1 and slug[-1] in _CODES else ""
        return key("".join(slug)), True, country, ""
    country = labels[0] if len(labels) > 2 and labels[0] in _CODES else ""
    label = regex.sub(r"-(?:net|isp|group|online|web)$|(?<=.{8})isp$", "", labels[-2])
    return key(fold(label)), False, country, site


def complete(cut: str, brand: list[str]) -> tuple[str, int]:
    """The whole key that a cut code and the words of a name make together, and its trust; empty if they disagree.

    If the words begin like the code they confirm each other; if only the
    code's end begins one of the words, the code gives the other word.
    """
    forms = [key(w) for w in brand]
    orders = [forms, forms[::-1]] if len(forms) == 2 else [forms]
    for words in orders:
        if "".join(words).startswith(cut):
            return key("".join(words)), CONFIRMED
    for word in forms:
        for k in range(len(word), 1, -1):
            if len(word) >= 4 and cut.endswith(word[:k]) and len(cut) - k >= 3:
                return key(cut[:-k] + word), NAMED
    return "", PARTIAL


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name) -> (word, n): names of a partition with each word."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for name in batch.column(0).to_pylist():
            counts.update(set(words_of(name)))
            if len(counts) > 500_000:
                yield _rows(counts)
                counts = Counter()
    yield _rows(counts)


def _rows(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _cuts(word: str) -> set[str]:
    """The word and what is left of it without one letter; two words one typing error apart have one in common."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


def partners(names: DataFrame, column: str, often: frozenset[str], least: int) -> DataFrame:
    """``word, n``: with how many other words each of the ``often`` stands, without those and their misspellings.

    Counting ends at ``least``.
    """
    near = {cut for w in often for cut in _cuts(w)}
    shared = names.sparkSession.sparkContext.broadcast((often, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, typos = shared.value
        found: dict[str, set[str]] = {w: set() for w in many}
        for batch in batches:
            for name in batch.column(0).to_pylist():
                words = set(words_of(name))
                lacking = [found[w] for w in words & many if len(found[w]) < least]
                if lacking:
                    others = [w for w in words - many - LEGAL if typos.isdisjoint(_cuts(w))]
                    for seen in lacking:
                        seen.update(others)
        pairs = [(w, o) for w, seen in found.items() for o in sorted(seen)[:least]]  # that many say enough
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["word", "other"])

    pairs = names.select(F.col(column)).where(F.col(column).isNotNull()).mapInArrow(run, "word string, other string")
    return pairs.distinct().groupBy("word").agg(F.count("*").alias("n"))


def generic_words(names: DataFrame, column: str) -> frozenset[str]:
    """Words that a fixed share of the distinct ``names`` hold, and that stand with many different others.

    The words of one organisation's many spellings stand with each other and with misspellings of each other alone.
    """
    total = names.count()
    sums = names.select(F.col(column)).where(F.col(column).isNotNull()).mapInArrow(count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    least = max(GENERIC_LEAST, GENERIC_SHARE * total)
    often = frozenset(r.word for r in sums.where(F.col("n") >= least).collect())
    most = max(GENERIC_LEAST, int(least / NAMES_A_PARTNER))
    return frozenset(r.word for r in partners(names, column, often, most).where(F.col("n") >= most).collect())
