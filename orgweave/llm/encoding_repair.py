"""Garbled text from wrong character encoding: detection and repair.

Smoothed character n-gram models are trained on the clean records of the corpus.
For every record with a character above 127 each candidate chain (encode with
one encoding, decode with another, up to several times over) gives a text; the
chain whose text the model finds likeliest is accepted if it beats the record
itself by a margin.  The margin is validated on all clean records: it is where
the records that a smaller one would change by mistake, and the repairs of clean
records garbled by known chains that a greater one would miss, are fewest.
"""

from __future__ import annotations

import codecs
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.session import Scratch

#: n-gram counts are kept in this many hashed cells per order: the model's size is fixed.
CELLS = 1 << 20
ORDER = 3
#: Smoothing: a count so small is given to the lower order.
BACKOFF = 0.4
#: Margins are chosen among multiples of this many natural log units, up to a greatest one (see validate_margin).
BIN, BINS = 0.25, 120
#: Margins where no clean record above ASCII is there to validate them, of chains of UTF-8 steps alone and of others.
DEFAULT_MARGINS = (0.25, 0.25)
#: What a Latin capital above ASCII straight after a small letter costs: of the plain names of sf0.1 only garbled ones have one.
CASE = 6.0
#: Steps of a chain.
DEPTH = 4
#: Texts that are put to the chains at once: what they lead to fits the processor's cache.
AT_ONCE = 250
WAYS_AT_ONCE = 1000
#: Texts that a task puts to the chains; they are few, but each costs about a millisecond.
TEXTS_PER_TASK = 20_000

# Encodings that texts were wrongly decoded with, and encodings they were written in.
LATIN = ["cp1252", "latin-1", "cp1250", "cp1254", "cp437", "cp850", "cp852", "mac_roman"]
WRONG = [*LATIN, "cp1251", "cp866", "koi8_r"]
RIGHT = ["utf-8", "cp1251", "koi8_r", "cp866", "gb18030", "shift_jis", "euc_jp", "cp1250", "cp1252", "cp1254"]


#: Those of several bytes a character but UTF-8.
WIDE = ["gb18030", "shift_jis", "euc_jp"]
#: What a step to another encoding than UTF-8 costs: the log of the number of pairs.
OTHER_COST = float(np.log(len(WRONG) * (len(RIGHT) - 1)))
#: A run of an odd number of characters above ASCII, where no character follows that may end a pair.
_ODD = re.compile(r"(?<![^\x00-\x7f])(?:[^\x00-\x7f]{2})*[^\x00-\x7f](?=[\x00-/]|\Z)")
_HIGH = re.compile(r"[^\x00-\x7f]+")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_INNER = regex.compile(r"(?<=\p{Ll})(?![A-Z])\p{Latin}(?<=\p{Lu})")
_PART_CAPITALS = regex.compile(r"[A-Z]{2}\p{Ll}|\p{Ll}[A-Z]")
_MIXED = regex.compile(r"\p{Latin}\p{Cyrillic}|\p{Cyrillic}\p{Latin}")


def _lowbyte(error: UnicodeError) -> tuple[bytes, int]:
    """Characters below 256 that an encoding lacks stand for the byte of their number."""
    part = error.object[error.start : error.end]
    if not isinstance(error, UnicodeEncodeError) or max(part) > "\xff":
        raise error
    return part.encode("latin-1"), error.end


codecs.register_error("lowbyte", _lowbyte)


@functools.lru_cache(maxsize=None)
def byte_map(encoding: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; where a byte has no character, the control character stands for it."""
    out: dict[str, int] = {}
    for b in range(255, -1, -1):
        out.setdefault(chr(b), b) if b < 160 else None
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@functools.lru_cache(maxsize=None)
def high_bytes(encoding: str, folded: bool) -> dict[str, tuple[int, ...]]:
    """Character -> the bytes above 127 it stands for; folded: also those of its capital, for text put to lower case since."""
    plain = {ch: b for ch, b in byte_map(encoding).items() if b >= 128}
    out: dict[str, tuple[int, ...]] = {ch: (b,) for ch, b in plain.items()}
    if folded:
        for ch, b in plain.items():
            low = ch.lower()
            if low != ch and len(low) == 1:
                out[low] = (*out.get(low, ()), b)
    return out


@functools.lru_cache(maxsize=None)
def _sequence(encoding: str, folded: bool) -> re.Pattern:
    """What ``repair_utf8`` may replace: nothing changes where this doesn't match."""
    table = high_bytes(encoding, folded)
    among = lambda low, high: "".join(re.escape(c) for c, bs in table.items() if any(low <= b < high for b in bs))
    # Leads, the tails that may follow them at once, and how many more; others write no character, or one that has a shorter sequence.
    parts = [
        (0xC2, 0xE0, 0x80, 0xC0, 0), (0xE0, 0xE1, 0xA0, 0xC0, 1), (0xE1, 0xED, 0x80, 0xC0, 1), (0xED, 0xEE, 0x80, 0xA0, 1), (0xEE, 0xF0, 0x80, 0xC0, 1),
        (0xF0, 0xF1, 0x90, 0xC0, 2), (0xF1, 0xF4, 0x80, 0xC0, 2), (0xF4, 0xF5, 0x80, 0x90, 2),
    ]
    told = [(among(low, high), among(first, end), more) for low, high, first, end, more in parts]
    return re.compile("|".join(f"[{lead}][{tail}][{among(0x80, 0xC0)}]{{{more}}}" for lead, tail, more in told if lead and tail))


@functools.lru_cache(maxsize=None)
def _twofold(encoding: str, folded: bool) -> frozenset[str]:
    """The characters that stand for several bytes."""
    return frozenset(ch for ch, bs in high_bytes(encoding, folded).items() if len(bs) > 1)


@functools.lru_cache(maxsize=None)
def _folded_alone(encoding: str) -> frozenset[str]:
    """The characters that stand for more bytes where text may have been put to lower case."""
    plain = high_bytes(encoding, False)
    return frozenset(ch for ch, bs in high_bytes(encoding, True).items() if plain.get(ch) != bs)


class _Decoded(dict):
    """A multi-byte UTF-8 sequence read in an encoding -> its character."""

    def __init__(self, table: dict[str, tuple[int, ...]]):
        super().__init__()
        self.table = table

    def __missing__(self, part: str) -> str:
        fixed = bytes([self.table[c][0] for c in part]).decode("utf-8")
        if len(self) >= 100_000:
            self.clear()
        self[part] = fixed
        return fixed


@functools.lru_cache(maxsize=None)
def _decoded(encoding: str, folded: bool) -> _Decoded:
    return _Decoded(high_bytes(encoding, folded))


def repair_utf8(text: str, encoding: str, folded: bool) -> str:
    """Replace every part that is a multi-byte UTF-8 sequence read in ``encoding``; leave everything else."""
    if not _sequence(encoding, folded).search(text):
        return text
    table = high_bytes(encoding, folded)
    if _twofold(encoding, folded).isdisjoint(text):
        known = _decoded(encoding, folded)
        return _sequence(encoding, folded).sub(lambda m: known[m[0]], text)
    out, k, n = [], 0, len(text)
    while k < n:
        ch = text[k]
        if ch < "\x80":
            out.append(ch)
            k += 1
            continue
        for lead in table.get(ch, ()):
            size = 4 if 0xF0 <= lead <= 0xF4 else 3 if 0xE0 <= lead < 0xF0 else 2 if 0xC2 <= lead < 0xE0 else 0
            if not size or k + size > n:
                continue
            tails = [[b for b in table.get(c, ()) if 0x80 <= b < 0xC0] for c in text[k + 1 : k + size]]
            if all(tails):
                try:
                    out.append(bytes([lead, *(t[0] for t in tails)]).decode("utf-8"))
                except UnicodeDecodeError:
                    continue
                k += size
                break
        else:
            out.append(ch)
            k += 1
    return "".join(out)


def recode(text: str, wrong: str, right: str) -> list[str]:
    """The texts that encoding with ``wrong`` and decoding with ``right`` give, if they differ from the text."""
    if right == "utf-8":
        fixed = {repair_utf8(text, wrong, folded) for folded in ([False, True] if wrong in LATIN else [False])}
        return sorted(fixed - {text})
    try:
        fixed = text.encode(wrong, "lowbyte").decode(right)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return []
    return [fixed] if _plausible(text, fixed) else []


def _plausible(text: str, fixed: str) -> bool:
    """Whether a text is another and may be written so: no one writes capitals with a small letter among them, or one word in two scripts.

    ASCII letters keep their case in every encoding; others needn't (KOI8-R read as cp1251 inverts it).
    """
    return not (fixed == text or (text.isupper() and _PART_CAPITALS.search(fixed)) or _MIXED.search(fixed))


@functools.lru_cache(maxsize=1)
def sequence_pairs() -> dict[str, int]:
    """Two characters that may begin a UTF-8 sequence -> the encodings of WRONG, a bit each, in which they do."""
    out: dict[str, int] = {}
    for k, wrong in enumerate(WRONG):
        table = high_bytes(wrong, wrong in LATIN)
        tails = [c for c, bs in table.items() if any(0x80 <= b < 0xC0 for b in bs)]
        for lead in (c for c, bs in table.items() if any(0xC2 <= b < 0xF5 for b in bs)):
            for tail in tails:
                out[lead + tail] = out.get(lead + tail, 0) | 1 << k
    return out


@functools.lru_cache(maxsize=100_000)
def run_pairs(run: str) -> tuple[int, ...]:
    """``sequence_pairs`` of every character of a run with the next one."""
    return tuple(map(sequence_pairs().get, map(str.__add__, run, run[1:]), [0] * len(run)))


def utf8_steps(text: str, among: int = -1) -> dict[str, str]:
    """Text -> step of every text that a step to UTF-8 gives; a sequence has two characters above ASCII at least, all in one run.

    ``among`` has a bit for every encoding of WRONG that is tried.
    """
    bits = among if among >= 0 else functools.reduce(int.__or__, (b for r in _RUN.findall(text) for b in run_pairs(r)), 0)
    found: dict[str, str] = {}
    while bits:
        wrong = WRONG[(bits & -bits).bit_length() - 1]
        fixed = {repair_utf8(text, wrong, False)}
        if wrong in LATIN and not _folded_alone(wrong).isdisjoint(text):
            fixed.add(repair_utf8(text, wrong, True))
        fixed.discard(text)
        for f in sorted(fixed) if len(fixed) > 1 else fixed:
            found.setdefault(f, f"{wrong}>utf-8")
        bits &= bits - 1
    return found


@functools.lru_cache(maxsize=None)
def lowbyte_table(encoding: str) -> tuple[dict[int, int], frozenset[str]]:
    """Number of a character -> byte as an encoding with ``lowbyte`` writes it; and the characters that it can write."""
    chars = {chr(n) for n in range(256)} | {bytes([b]).decode(encoding, "replace") for b in range(256)} - {"\ufffd"}
    table = {ord(ch): ch.encode(encoding, "lowbyte")[0] for ch in chars}
    return table, frozenset(chars)


class _Writers(dict):
    """Character -> the encodings of WRONG, a bit each, that write it."""

    def __missing__(self, ch: str) -> int:
        self[ch] = sum((ch in lowbyte_table(wrong)[1]) << k for k, wrong in enumerate(WRONG))
        return self[ch]


_WRITERS = _Writers()


@functools.lru_cache(maxsize=1)
def writer_bytes() -> np.ndarray:
    """By encoding of WRONG and number of a character the byte that it is written as, 0 for those that aren't."""
    out = np.zeros((len(WRONG), 0x10000), np.uint8)
    for k, wrong in enumerate(WRONG):
        for number, byte in lowbyte_table(wrong)[0].items():
            out[k, number] = byte
    return out


@functools.lru_cache(maxsize=1)
def writer_bits() -> np.ndarray:
    """By number of a character the encodings of WRONG, a bit each, that write it."""
    out = np.zeros(0x10000, np.int16)
    for ch in set().union(*(lowbyte_table(wrong)[1] for wrong in WRONG)):
        out[ord(ch)] = _WRITERS[ch]
    return out


def written(text: str, bits: int | None = None) -> dict[bytes, str]:
    """Bytes -> the first encoding of WRONG that writes the text so; ``bits`` are those that write all its characters, if they are known."""
    out: dict[bytes, str] = {}
    if bits is None:
        bits = functools.reduce(int.__and__, map(_WRITERS.__getitem__, set(text)), -1 % (1 << len(WRONG)))
    while bits:
        wrong = WRONG[(bits & -bits).bit_length() - 1]
        out.setdefault(codecs.charmap_encode(text, "strict", lowbyte_table(wrong)[0])[0], wrong)
        bits &= bits - 1
    return out


def other_steps(text: str) -> dict[str, str]:
    """Text -> step of every text that a step to another encoding gives; encodings that write a text alike are read once."""
    return read_otherwise(text, written(text), -1, {}, 0.0)


def read_otherwise(text: str, bytes_of: dict[bytes, str], bits: int, known: dict[str, float], whole: float) -> dict[str, str]:
    """Text -> step of every text that reading the bytes in another encoding gives, but those ``known`` at the cost ``whole`` or less.

    Encodings of one byte a character are used only where ``bits`` has the bit of the step (see ``seen_images``).
    """
    odd, bit_of = _ODD.search(text) is not None, _bit_of()
    made: dict[str, str] = {}
    for data, wrong in bytes_of.items():
        for right in RIGHT[1:]:
            if odd and (right == "gb18030" or (right == "euc_jp" and b"\x8f" not in data)):
                continue  # these write characters above ASCII in pairs
            if bits >= 0 and (wrong, right) in bit_of and not bits >> bit_of[wrong, right] & 1:
                continue
            try:
                made.setdefault(data.decode(right), f"{wrong}>{right}")
            except UnicodeDecodeError:
                continue
    return {fixed: step for fixed, step in made.items() if known.get(fixed, np.inf) > whole and _plausible(text, fixed)}


@functools.lru_cache(maxsize=1)
def char_maps() -> list[tuple[str, str, dict[str, str]]]:
    """(wrong, right, character -> character) of every step between two encodings of one byte a character."""
    out = []
    for wrong in WRONG:
        table, known = lowbyte_table(wrong)
        for right in RIGHT:
            if right in WRONG and right != wrong:
                read = {b: bytes([b]).decode(right, "replace") for b in range(128, 256)}
                out.append((wrong, right, {ch: read[table[ord(ch)]] for ch in known if ch > "\x7f" and read[table[ord(ch)]] != "\ufffd"}))
    return out


@functools.lru_cache(maxsize=1)
def sequence_parts() -> tuple[np.ndarray, ...]:
    """By number of a character the encodings of WRONG, a bit each, in which it may begin a sequence of 2, 3 or 4, and in which it may go on with one."""
    out = np.zeros((4, 0x10000), np.uint16)
    for k, wrong in enumerate(WRONG):
        for ch, bs in high_bytes(wrong, wrong in LATIN).items():
            for part, (low, high) in enumerate(((0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5), (0x80, 0xC0))):
                out[part, ord(ch)] |= any(low <= b < high for b in bs) << k
    return tuple(out)


@functools.lru_cache(maxsize=1)
def _bit_of() -> dict[tuple[str, str], int]:
    return {(wrong, right): k for k, (wrong, right, _) in enumerate(char_maps())}


@functools.lru_cache(maxsize=1)
def _patterns() -> tuple[regex.Pattern, regex.Pattern]:
    """Texts of plain characters; and the start of a UTF-8 sequence read in one of the Latin encodings."""
    plain = regex.compile(r"[\p{L}\p{M}\p{Nd}\x20-\x7e（）・＆–—’]*")
    pairs = []
    for wrong in LATIN:
        by = high_bytes(wrong, False)
        among = lambda low, high: "".join(regex.escape(c) for c, b in by.items() if low <= b[0] < high)
        tail = f"[{among(0x80, 0xC0)}]"
        pairs += [f"[{among(0xC2, 0xE0)}]{tail}", f"[{among(0xE0, 0xF0)}]{tail}{{2}}", f"[{among(0xF0, 0xF5)}]{tail}{{3}}"]
    pairs.append("[âãäåðñ][ÿžšœƒ]")  # such a sequence put to lower case since
    return plain, regex.compile("|".join(pairs))


def is_clean(text: str) -> bool:
    """Whether a record may train the model: plain characters, and no run that reads as garbled UTF-8."""
    if text.isascii():
        return True
    plain, garbled = _patterns()
    return plain.fullmatch(text) is not None and garbled.search(text) is None


def cells_of(grams: list[np.ndarray]) -> np.ndarray:
    """The hashed cells of n-grams, given as the numbers of their first, second ... characters."""
    with np.errstate(over="ignore"):
        h = np.uint64(14695981039346656037) + np.uint64(len(grams))
        for codes in grams:
            h = (h ^ codes) * np.uint64(1099511628211)
            h = h ^ (h >> np.uint64(31))
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def joined_cells(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order the hashed cells of the n-grams that end at each place of all padded texts, and where each text starts.

    A text has three pads before and one mark after it, so no n-gram reaches into a neighbour.
    """
    padded = ["\x02\x02\x02" + t.lower() + "\x03" for t in texts]
    codes = np.frombuffer(("\x02\x02" + "".join(padded)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in padded])])
    out = []
    for order in range(1, ORDER + 1):
        out.append(cells_of([codes[2 - back : len(codes) - back] for back in range(order - 1, -1, -1)]))
    return out, starts


def log_terms(texts: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each place of all padded texts adds to their natural log likelihoods under the counts (a row per order), and where each starts.

    Lower orders stand in for n-grams that aren't known.  An n-gram counts as seen only if its shorter ends are, so clashes of cells
    hardly matter.  No term is above 0.
    """
    by_order, starts = joined_cells(texts)
    seen = counts[0][by_order[0]].astype(np.float64)
    logs = np.log((seen + 0.01) / (counts[0].sum() + 1e4))
    for order in range(1, ORDER):
        n = np.where(seen > 0, counts[order][by_order[order]], 0)
        context = np.concatenate([[0.0], seen[:-1]])
        known = (n > 0) & (context > 0)
        logs = np.where(known, np.log(np.where(known, n, 1) / np.maximum(np.maximum(context, n), 1)), logs + np.log(BACKOFF))
        seen = n
    for pad in range(3):
        logs[starts[:-1] + pad] = 0
    return logs, starts


def log_likelihoods(texts: list[str], counts: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each text under the counts."""
    if not texts:
        return np.empty(0)
    logs, starts = log_terms(texts, counts)
    return np.add.reduceat(logs, starts[:-1])


def case_costs(texts: list[str]) -> np.ndarray:
    """What the inner capitals of plain texts cost (those of others a step may be left to take); the likelihood is blind to case."""
    return CASE * np.array([len(_INNER.findall(t)) if _INNER.search(t) and is_clean(t) else 0 for t in texts], dtype=float)


def scored(texts: list[str], counts: np.ndarray) -> np.ndarray:
    """Log likelihood of each text, less the cost of its inner capitals."""
    return log_likelihoods(texts, counts) - case_costs(texts)


class Ceilings:
    """What no text that steps make of another can score above, under the counts."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        codes = np.arange(128, 0x110000, dtype=np.uint64)
        held = counts[0][cells_of([codes])] > 0
        # Of two capitals above ASCII the lower case begins with a letter of ASCII.
        self.above = np.concatenate([codes[held], codes[~held][:1], np.array([ord("i"), ord("k")], np.uint64)])
        self.lacking_at = int(held.sum())
        self.total = counts[0].sum() + 1e4
        self.firsts: dict[tuple[int, int], float] = {}
        self.singles: dict[tuple[int, int, int, int], float] = {}
        self.beside: dict[tuple[int, int, int], np.ndarray] = {}
        self.known: dict[str, bool] = {}
        self.windows: dict[str, tuple[int, ...]] = {}
        # Character -> the steps of ``char_maps``, a bit each, that make it one that the clean texts hold.
        self.images: dict[str, int] = {}
        for bit, (_, _, images) in enumerate(char_maps()):
            for x, y in images.items():
                self.images[x] = self.images.get(x, 0) | self.held(y) << bit
        self.image_bits = np.zeros(0x10000, np.int64)
        self.image_bits[:128] = -1
        for ch, bits in self.images.items():
            self.image_bits[ord(ch)] = bits
        lowered = [chr(n).lower() for n in range(0x10000)]
        self.lacks = counts[0][cells_of([np.array([ord(low[0]) for low in lowered], np.uint64)])] == 0
        self.lacks[:128] = self.lacks[-1] = False  # the last number stands for greater ones
        # What a character that the clean texts lack adds at most, and the place after it, where it breaks all longer n-grams.
        often = counts[0].copy()
        often[cells_of([np.array([2], np.uint64)])] = 0  # the pad stands after no character
        self.lack = float(np.log(0.01 / self.total) + 2 * np.log(BACKOFF))
        self.beyond = float(np.log((often.max() + 0.01) / self.total) + 2 * np.log(BACKOFF))

    def held(self, ch: str) -> bool:
        """Whether the clean texts hold a character."""
        if ch not in self.known:
            self.known[ch] = bool((self.counts[0][cells_of([np.array([ord(c) for c in ch.lower()], np.uint64)])] > 0).all())
        return self.known[ch]

    def most_lacking(self, top: float, used: float) -> int:
        """How many characters that the clean texts lack a text may have to score above ``used`` yet, if it scores ``top`` at most; 2 if more."""
        return (top + self.lack + self.beyond > used) + (top + 2 * self.lack + self.beyond > used)

    def lacking(self, run: str) -> tuple[int, ...]:
        """For each character of a run that the clean texts lack the encodings of WRONG, a bit each, in which a sequence may hold it."""
        if run not in self.windows:
            if len(self.windows) >= 100_000:
                self.windows.clear()
            pairs = run_pairs(run)
            self.windows[run] = tuple(functools.reduce(int.__or__, pairs[max(0, k - 3) : k + 1], 0) for k, ch in enumerate(run) if not self.held(ch))
        return self.windows[run]

    def mending(self, text: str, most: int) -> int:
        """The encodings of WRONG, a bit each, whose step to UTF-8 may leave no more than ``most`` (0 or 1) characters that the clean texts lack."""
        # The encodings that leave none so far, and one at most.
        none = one = -1
        for run in _HIGH.findall(text):
            for held in self.lacking(run):
                one &= none | held
                none &= held
                if not (one if most else none):
                    return 0
        return one if most else none

    def ways(self, texts: list[str], used: np.ndarray | None = None, most: list[int] | None = None) -> Iterator[tuple[int, int, int, bool]]:
        """For each text the encodings of WRONG, a bit each, in which a part of it is a UTF-8 sequence; ``images`` of all its characters; ``writer_bits``; and ``wide``.

        With ``used`` only sequences whose step may make a text that scores above it.  What isn't part of one stays as it is, so places
        that none comes near add what they do now, characters that the clean texts lack do so anywhere, and other places add 0 at most.
        """
        if not texts:
            return iter(())
        # What these letters are in lower case has another length, or follows from their neighbours.
        special = [k for k, t in enumerate(texts) if "\u0130" in t or "\u03a3" in t] if used is not None else []
        plain = texts if not special else ["" if k in set(special) else t for k, t in enumerate(texts)]
        slim, starts, held = self.sequences(plain)
        among = np.bitwise_or.reduceat(held, starts).astype(np.int64)
        if used is not None:
            among &= self.mended(plain, held, used)
        of_all = (np.bitwise_and.reduceat(table[slim], starts).tolist() for table in (self.image_bits, writer_bits()))
        among, images, writers = among.tolist(), *of_all
        for k in special:
            t, left = texts[k], self.most_lacking(0.0, float(used[k]))
            among[k] = self.mending(t, left) if left < 2 else -1
            images[k], writers[k] = (functools.reduce(int.__and__, (int(table[min(ord(ch), 0xFFFF)]) for ch in t)) for table in (self.image_bits, writer_bits()))
        return zip(among, images, writers, self.wide(plain, slim, starts, writers, most) if most is not None else [True] * len(texts))

    @staticmethod
    def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The characters of all padded texts, where each text begins, and the encodings of WRONG, a bit each, in which a sequence may hold a place."""
        codes = np.frombuffer("".join(["\x02\x02\x02" + t + "\x03" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum([0, *(len(t) + 4 for t in texts)])[:-1]
        slim = np.minimum(codes, 0xFFFF)
        *leads, tails = (part[slim] for part in sequence_parts())
        held = np.zeros_like(tails)
        for size, lead in enumerate(leads, 2):
            for far in range(1, size):
                lead[:-far] &= tails[far:]  # the last place is a mark
            for far in range(size):
                held[far:] |= lead[: len(lead) - far]
        return slim, starts, held

    def leads_on(self, texts: list[str], used: list[float]) -> list[bool]:
        """Whether each text, or one that a single step more may make of it, may score above ``used``, by the characters alone that the clean texts lack.

        A text that has more of them than it may does so only if a step to UTF-8 takes them, or one to another encoding makes them others.
        """
        if not texts:
            return []
        slim, starts, held = self.sequences(texts)
        most = np.array([self.most_lacking(0.0, u) for u in used])
        other = [self.most_lacking(-OTHER_COST, u) for u in used]
        lacks = self.lacks[slim]
        out = (most > 1) | (np.add.reduceat(lacks, starts, dtype=np.int64) <= most)
        # Where none may be left each must be in a sequence of one encoding; where one may be, that many are counted.
        inside = np.where(lacks, held, np.iinfo(held.dtype).max)
        out |= np.bitwise_and.reduceat(inside, starts) != 0
        some = np.flatnonzero(~out & (most == 1) & (np.bitwise_or.reduceat(held, starts) != 0))
        if len(some):
            lengths = np.diff(starts, append=len(slim))
            of = np.zeros(len(texts), bool)
            of[some] = True
            places = np.repeat(of, lengths)
            begins = np.cumsum([0, *lengths[some]])[:-1]
            for k in range(len(WRONG)):
                left = np.add.reduceat((lacks[places] & ~(held[places] >> k & 1).astype(bool)), begins, dtype=np.int64)
                out[some] |= left <= 1
        writers = np.bitwise_and.reduceat(writer_bits()[slim], starts)
        out |= (writers != 0) & ((np.bitwise_and.reduceat(self.image_bits[slim], starts) != 0) | (np.array(other) > 0))
        out |= np.array(["\u0130" in t or "\u03a3" in t for t in texts])
        rest = np.flatnonzero(~out & (writers != 0)).tolist()
        if rest:
            left = [texts[k] for k in rest]
            lengths = np.diff(starts, append=len(slim))
            of = np.zeros(len(texts), bool)
            of[rest] = True
            begins = np.cumsum([0, *lengths[rest]])[:-1]
            out[rest] = self.wide(left, slim[np.repeat(of, lengths)], begins, writers[rest].tolist(), [other[k] for k in rest])
        return out.tolist()

    def wide(self, texts: list[str], slim: np.ndarray, starts: np.ndarray, writers: list[int], most: list[int]) -> list[bool]:
        """Whether reading a text in an encoding of several bytes a character may leave no more than ``most`` characters that the clean texts lack (2: any number).

        ``slim`` are the characters of all padded texts, ``starts`` where each begins.  All texts are decoded as one, each with its mark.
        """
        out, writers, most = np.array(["\x03" in t for t in texts]), np.array(writers), np.array(most)
        most[most > 1] = np.iinfo(most.dtype).max
        lengths = np.diff(starts, append=len(slim))
        for k, wrong in enumerate(WRONG):
            of = np.flatnonzero(writers >> k & 1 & ~out)
            if not len(of):
                continue
            data = writer_bytes()[k][slim[np.repeat(writers >> k & 1 & ~out, lengths).astype(bool)]].tobytes()
            for right in WIDE:
                codes = np.frombuffer(data.decode(right, "replace").encode("utf-32-le"), np.uint32)
                ends = np.flatnonzero(codes == 3)
                if len(ends) != len(of):
                    out[of] = True
                    continue
                lacks = self.lacks[np.minimum(codes, 0xFFFF)].cumsum()[ends]
                broken = (codes == 0xFFFD).cumsum()[ends]
                out[of] |= (np.diff(broken, prepend=0) == 0) & (np.diff(lacks, prepend=0) <= most[of])
        return out.tolist()

    def mended(self, texts: list[str], held: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Of the sequences at places of the padded texts those whose step may make a text that scores above ``used`` (see ``ways``)."""
        logs, starts = log_terms(texts, self.counts)
        lacking = logs < self.lack + 1e-6
        among = np.zeros(len(texts), np.int64)
        for k in range(len(WRONG)):
            inside = (held >> k & 1).astype(bool)
            if not inside.any():
                continue
            near = inside.copy()
            for back in range(1, ORDER):
                near[back:] |= inside[:-back]
            apart = lacking & ~inside
            most = np.where(near & ~apart, 0.0, logs)
            most[1:] = np.where(apart[:-1], np.minimum(most[1:], self.beyond), most[1:])
            among |= (np.add.reduceat(most, starts[:-1]) + 1e-6 > used).astype(np.int64) << k
        return among

    def following(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The log probability of ``y`` after ``w`` and ``x``, all given as numbers of characters (see ``log_terms``)."""
        counts = self.counts
        one, before = counts[0][cells_of([y])].astype(np.float64), counts[0][cells_of([x])]
        logs = np.log((one + 0.01) / self.total)
        two = np.where(one > 0, counts[1][cells_of([x, y])], 0)
        three = np.where(two > 0, counts[2][cells_of([w, x, y])], 0)
        for n, context in ((two, before), (three, np.where(before > 0, counts[1][cells_of([w, x])], 0))):
            known = (n > 0) & (context > 0)
            logs = np.where(known, np.log(np.where(known, n, 1) / np.maximum(np.maximum(context, n), 1)), logs + np.log(BACKOFF))
        return logs

    def around(self, place: int, one: int, two: int) -> np.ndarray:
        """``following`` of each character above ASCII in a place of three, with two characters in the others, in order."""
        key = place, one, two
        if key not in self.beside:
            if len(self.beside) >= 10_000:
                self.beside.clear()
            fixed = [np.array([one], np.uint64), np.array([two], np.uint64)]
            logs = self.following(*fixed[: 2 - place], self.above, *fixed[2 - place :])
            if place == 2:
                logs[self.lacking_at] = 0.0  # those that the clean texts lack clash with other cells each
            self.beside[key] = logs
        return self.beside[key]

    def first(self, a: int, b: int) -> float:
        """The greatest log probability that a character above ASCII has after two others."""
        if (a, b) not in self.firsts:
            self.firsts[a, b] = float(self.around(0, a, b).max())
        return self.firsts[a, b]

    def single(self, a: int, b: int, c: int, d: int) -> float:
        """The most that a character above ASCII adds between a, b and c, d, with what c and d add after it; a pad as ``d`` adds nothing."""
        key = a, b, c, d
        if key not in self.singles:
            if len(self.singles) >= 200_000:
                self.singles.clear()
            logs = self.around(0, a, b) + self.around(1, b, c)
            # A dotted capital I is two characters in lower case.
            w, x, y = np.array([[a, b, 0x69], [b, 0x69, 0x307], [0x69, 0x307, c], [0x307, c, d]], np.uint64).T
            dotted = self.following(w, x, y)
            if d != 2:
                logs = logs + self.around(2, c, d)
            self.singles[key] = max(float(logs.max()), float(dotted[: 3 if d == 2 else 4].sum()))
        return self.singles[key]

    def lone(self, codes: list[int], terms: list[float], end: int) -> list[float]:
        """The most that a character above ASCII between plain ones may add with those after it, where none, one, two ... steps may each take one of these.

        ``codes`` begin two places before it, ``terms``, what the places add now, at it; its text ends ``end`` places further on.
        """
        out, best, ends = [], -np.inf, False
        for taken in range(len(terms) - 2):
            best += terms[taken + 2] if taken + 2 < end else 0.0
            if not ends:
                c = codes[3 + taken]
                best = max(best, self.single(codes[0], codes[1], c, codes[4 + taken] if taken + 2 < end else 2))
                ends = c < 0x30  # no encoding has it in a pair
            out.append(best)
        return out

    def of(self, texts: list[str], steps: int) -> tuple[list[float], ...]:
        """The log likelihood of each text, and the ceilings of what UTF-8 steps make of it, and of what up to ``steps`` others make, less their cost.

        Then those of UTF-8 steps and of one other where characters above ASCII may be any.

        Steps keep ASCII characters, but one to a multi-byte encoding may take the one after a character above ASCII.  So the n-grams of
        those out of reach stay as they are; after two of them a character above ASCII stays one, and alone among them it is one in one
        place (see ``lone``); every other place adds 0 at most.
        """
        if not texts:
            return ([],) * 5
        logs, starts = log_terms(texts, self.counts)
        likely = np.add.reduceat(logs, starts[:-1]).tolist()
        if not steps:
            return (likely,) * 5
        lowered = "\x02\x02" + "".join("\x02\x02\x02" + t.lower() + "\x03" for t in texts)
        codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)[2:]
        high = codes > 127
        high[:-1] |= codes[1:] == 0x307  # a dotted capital I is two characters in lower case, the first of them ASCII
        tops, loose = [], []
        # How many steps leave a character above ASCII out of reach of the next one and the one before, -1 if none does.
        at = np.flatnonzero(high)
        gap = np.diff(at, prepend=-steps - 3, append=len(codes) + steps + 3)
        room = np.full(len(codes), -1)
        room[at] = np.clip(np.minimum(gap[:-1], gap[1:]) - 3, -1, steps)
        places = at[room[at] >= 0]
        wide, padded = (np.concatenate([x, np.zeros(steps + 3, x.dtype)]) for x in (codes, logs))
        told = wide[places[:, None] + np.arange(-2, steps + 3)].tolist(), padded[places[:, None] + np.arange(steps + 3)].tolist()
        ends = (starts[np.searchsorted(starts, places, "right")] - places).tolist()
        lone = {p: self.lone(c[: r + 5], t[: r + 3], e) for p, r, c, t, e in zip(places.tolist(), room[places].tolist(), *told, ends)}
        for others in range(steps + 1):
            within = high.copy()
            for back in range(1, others + 1):
                within[back:] |= high[:-back]
            near = within.copy()
            for back in range(1, ORDER):
                near[back:] |= within[:-back]
            most = np.where(near, 0.0, logs)
            if others < 2:
                loose.append(np.add.reduceat(most, starts[:-1]) - others * OTHER_COST)
            begins = np.flatnonzero(high[2:] & ~within[1:-1] & ~within[:-2]) + 2
            alone = room[begins] >= others
            most[begins[~alone]] = [self.first(a, b) for a, b in codes[begins[~alone, None] + [-2, -1]].tolist()]
            most[begins[alone]] = [lone[p][others] for p in begins[alone].tolist()]
            tops.append(np.add.reduceat(most, starts[:-1]) - others * OTHER_COST)
        return likely, *(x.tolist() for x in (tops[0], np.max(tops[1:], axis=0), *loose))


#: A text that chains give: (text, cost, chain, steps), and (number of the record, text, cost, chain, by UTF-8 steps alone, its ceilings).
Reached = tuple[str, float, str, int]
Going = tuple[int, str, float, str, bool, float, float, float, float]


def utf8_reach(text: str, depth: int) -> list[Reached]:
    """(text, cost, chain, steps) of every text that UTF-8 steps alone give, the text itself first; again where more steps cost less.

    A step costs the log of how many there are to choose from, and only few find a valid sequence.
    """
    out: list[Reached] = [(text, 0.0, "", 0)]
    least = {text: 0.0}
    for t, cost, path, done in out:
        made = utf8_steps(t) if done < depth else {}
        for fixed, step in made.items():
            whole = cost + float(np.log(len(made)))
            if whole < least.get(fixed, np.inf):
                least[fixed] = whole
                out.append((fixed, whole, f"{path} {step}".strip(), done + 1))
    return out


_CEILINGS: list[Ceilings] = []


def ceilings_of(counts: np.ndarray) -> Ceilings:
    """The ceilings under the counts, those of the last counts being kept."""
    if not _CEILINGS or _CEILINGS[0].counts is not counts:
        _CEILINGS[:] = [Ceilings(counts)]
    return _CEILINGS[0]


def best_chains(
    texts: list[str], counts: np.ndarray, depth: int = DEPTH, beam: int | None = None, slack: float | None = None, margins: tuple[float, float] | None = None
) -> list[tuple[Found | None, Found | None]]:
    """Of each text the likeliest (restored text, gain over the record, chain) of those that UTF-8 steps alone give, and of all others.

    Each step takes from the gain what it costs to name it.  Every chain up to ``depth`` steps counts, whatever its steps gain: one is
    left only where no text that it may lead to can gain more than the best so far (see ``Ceilings``).  None where no chain
    gains anything.  With ``margins`` the second is looked for only as far as ``accept`` may take it.  ``beam`` and ``slack`` bound nothing
    any more.
    """
    if len(texts) > AT_ONCE:
        parts = [texts[at : at + AT_ONCE] for at in range(0, len(texts), AT_ONCE)]
        return [found for part in parts for found in best_chains(part, counts, depth, beam, slack, margins)]
    if not texts:
        return []
    ceilings = ceilings_of(counts)
    plain = [(k, r) for k, t in enumerate(texts) for r in utf8_reach(t, depth)]
    alone = [set() for _ in texts]
    likely, *tops = ceilings.of([r[0] for _, r in plain], depth)
    scores = (np.array(likely) - case_costs([r[0] for _, r in plain])).tolist()
    start = [score for (_, r), score in zip(plain, scores) if not r[3]]
    best: list[list[Found | None]] = [[None, None] for _ in texts]
    by_steps: list[list[Going]] = [[] for _ in range(depth + 1)]
    for (k, (t, cost, path, steps)), score, *top in zip(plain, scores, *tops):
        alone[k].add(t)
        by_steps[steps].append((k, t, cost, path, True, *top))
        gain = score - start[k] - cost
        if path and gain > (best[k][0][1] if best[k][0] else 0.0):
            best[k][0] = t, gain, path
    floor = [0.0 if not margins else margins[1] + max(0.0, b[0][1] - margins[0] if b[0] else 0.0) for b in best]
    least: list[dict[str, float]] = [{} for _ in texts]
    # What bytes cost that were read in all encodings; whether a text is all capitals decides what is plausible.
    spent: list[dict[tuple[bytes, bool], float]] = [{} for _ in texts]
    others: list[Going] = []
    for done in range(depth + 1):
        for k, t, cost, *_ in by_steps[done]:
            least[k][t] = min(cost, least[k].get(t, np.inf))
        if done == depth:
            break
        made: dict[tuple[int, str], tuple[float, str]] = {}
        last = done == depth - 1

        def ways_of(going: list[Going]) -> Iterator[tuple[int, int, int, bool]]:
            for at in range(0, len(going), WAYS_AT_ONCE):
                part = going[at : at + WAYS_AT_ONCE]
                texts, used = [g[1] for g in part], [start[g[0]] + g[2] + floor[g[0]] for g in part]
                yield from ceilings.ways(texts, np.array(used), [ceilings.most_lacking(g[8], u) for g, u in zip(part, used)]) if last else ceilings.ways(texts)  # noqa: B023

        going = [g for g in by_steps[done] + others if g[2] <= least[g[0]][g[1]] and max(g[5:7]) > start[g[0]] + g[2] + floor[g[0]]]
        for (k, t, cost, path, only, top, other_top, loose, other_loose), (among, images, writers, wide) in zip(going, ways_of(going)):
            used = start[k] + cost + floor[k]
            steps: dict[str, tuple[str, float]] = {}
            # Of the last step's texts those with a character that the clean texts lack may be too unlikely.
            scarce = last and not ceilings.most_lacking(other_loose, used)
            if other_top > used and (wide or images or not scarce):
                bytes_of = {data: wrong for data, wrong in written(t, writers).items() if cost < spent[k].get((data, t.isupper()), np.inf)}
                spent[k].update(((data, t.isupper()), cost) for data in bytes_of)
                bits = images if scarce else -1
                if bytes_of:
                    steps = {fixed: (step, OTHER_COST) for fixed, step in read_otherwise(t, bytes_of, bits, least[k], cost + OTHER_COST).items()}
            if not only and max(top, other_top) > used:
                if utf8 := utf8_steps(t, among) if among else {}:
                    price = float(np.log(len(utf8_steps(t) if last else utf8)))
                    steps |= {fixed: (step, price) for fixed, step in utf8.items()}
            for fixed, (step, price) in steps.items():
                if cost + price < least[k].get(fixed, np.inf):
                    least[k][fixed] = cost + price
                    made[k, fixed] = cost + price, f"{path} {step}".strip()
        if done == depth - 2:
            going, kept = list(made.items()), []
            for at in range(0, len(going), WAYS_AT_ONCE):
                part = going[at : at + WAYS_AT_ONCE]
                kept += ceilings.leads_on([t for (_, t), _ in part], [start[k] + cost + floor[k] for (k, _), (cost, _) in part])
            made = {key: way for (key, way), keep in zip(going, kept) if keep}
        likely, *tops = ceilings.of([t for _, t in made], depth - done - 1)
        others = []
        for ((k, t), (cost, path)), score, *top in zip(made.items(), likely, *tops):
            if not last:
                others.append((k, t, cost, path, False, *top))
            # Inner capitals only take, so they are looked for where the text would be the best without.
            if score - start[k] - cost > floor[k] and t not in alone[k]:
                gain = score - float(case_costs([t])[0]) - start[k] - cost
                if gain > floor[k]:
                    floor[k], best[k][1] = gain, (t, gain, path)
    return [(u, o) for u, o in best]


def only_utf8(path: str) -> bool:
    """Whether all steps of a chain decode UTF-8: plain text hardly ever holds valid sequences, so these need a margin of their own."""
    return all(step.endswith(">utf-8") for step in path.split())


def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (cell, n) over the clean texts of a partition; a row per cell at most."""
    counts = np.zeros(ORDER * CELLS, np.int64)
    for batch in batches:
        clean = [t for t in batch.column(0).to_pylist() if is_clean(t)]
        if clean:
            for order, found in enumerate(joined_cells(clean)[0]):
                np.add.at(counts, found + order * CELLS, 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["cell", "n"])


def broken(text: str) -> bool:
    """Whether a text is garbled beyond doubt: it holds U+FFFD or a C1 control."""
    return "\ufffd" in text or any("\x7f" <= c <= "\x9f" for c in text)


def accept(text: str, found: tuple[Found | None, Found | None], margins: tuple[float, float]) -> tuple[bool, str | None, str]:
    """(garbled, restored or None, chain) of a text whose likeliest chains are ``found``; the one furthest above its margin counts."""
    above = [(f[1] - m, f) for f, m in zip(found, margins) if f and f[1] > m]
    if not above:
        return broken(text), None, ""
    _, (fixed, _, chain) = max(above)
    return True, fixed if is_clean(fixed) else None, chain


def judge(texts: list[str], counts: np.ndarray, margins: tuple[float, float] = DEFAULT_MARGINS) -> list[tuple[bool, str | None, str]]:
    """(garbled, restored or None, chain) of each text.

    U+FFFD and C1 controls are garbled whether or not a chain restores them.
    Every other text above ASCII is put to the chains, however likely it reads:
    one wrong letter hardly lowers a long name.
    """
    asked = [t for t in texts if not t.isascii() and "\ufffd" not in t]
    chains = iter(best_chains(asked, counts, margins=margins))
    return [(broken(t), None, "") if t.isascii() or "\ufffd" in t else accept(t, next(chains), margins) for t in texts]


def planted(text: str) -> tuple[str, str] | None:
    """A clean text garbled by a known step, chosen by the text, and the step that restores it; None if no step garbles it."""
    pairs = [(w, r) for w in WRONG for r in RIGHT if w != r]
    first = zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(pairs)
    for wrong, right in pairs[first:] + pairs[:first]:
        try:
            bad = text.encode(right).decode(wrong)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if bad != text and not bad.isascii() and text in recode(bad, wrong, right):
            return bad, f"{wrong}>{right}"
    return None


def validate_margin(changed: np.ndarray, missed: np.ndarray, garbled_share: float) -> float:
    """The least margin of a kind of chain whose errors are within two standard errors of the fewest.

    ``changed`` counts the gains of chains over clean records by BIN, the first
    bin holding those that gain nothing, ``missed`` the gains that restoring
    planted damage has; damage is as frequent as ``garbled_share`` of records.
    """
    clean, damage = changed.sum(), missed.sum()
    if not clean or not damage:
        return float("nan")
    # With margin k * BIN the bins from k on are changed, and those below are missed.
    false = changed[::-1].cumsum()[::-1] / clean
    lost = np.concatenate([[0], missed.cumsum()[:-1]]) / damage
    cost = (1 - garbled_share) * false[1:] + garbled_share * lost[1:]
    error = np.sqrt(false[1:][cost.argmin()] * clean + 1) / clean
    return float(BIN * (1 + np.flatnonzero(cost <= cost.min() + 2 * error)[0]))


class Trained:
    """The model of one corpus: its counts."""

    def __init__(self, texts: DataFrame, column: str):
        slim = texts.select(F.col(column)).where(F.col(column).isNotNull())
        sums = slim.mapInArrow(count_cells, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
        rows = sums.toPandas()  # at most ORDER * CELLS rows
        counts = np.zeros(ORDER * CELLS, np.int64)
        counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()
        self.counts = np.minimum(counts, 2**31 - 1).astype(np.int32).reshape(ORDER, CELLS)


def not_ascii(column: str) -> F.Column:
    """Whether a text has a character above 127; null for null."""
    return F.octet_length(column) > F.char_length(column)


def chains_of(texts: DataFrame, column: str, model: Trained) -> DataFrame:
    """``text, utf, other, planted, kind, clean`` of every text above ASCII: of a clean one the likeliest chains, and what restoring planted damage gains."""
    counts = texts.sparkSession.sparkContext.broadcast(model.counts)
    found = "struct<fixed:string,gain:double,chain:string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("fixed", pa.string()), ("gain", pa.float64()), ("chain", pa.string())])
        named = lambda f: dict(zip(("fixed", "gain", "chain"), f)) if f else None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.column(0).slice(at, 2000).to_pylist()
                clean = [is_clean(t) for t in part]
                asked = iter(best_chains([t for t, c in zip(part, clean) if c], counts.value))
                chains = [next(asked) if c else (None, None) for c in clean]
                bad = [planted(t) if c else None for t, c in zip(part, clean)]
                cost = np.array([np.log(len(utf8_steps(b[0]))) if only_utf8(b[1]) else OTHER_COST for b in bad if b])
                gains = iter(scored([t for t, b in zip(part, bad) if b], counts.value) - scored([b[0] for b in bad if b], counts.value) - cost)
                columns = [
                    pa.array(part, pa.string()), *(pa.array([named(c[k]) for c in chains], kind) for k in (0, 1)),
                    pa.array([float(next(gains)) if b else None for b in bad], pa.float64()), pa.array([1 - only_utf8(b[1]) if b else None for b in bad], pa.int32()), pa.array(clean, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["text", "utf", "other", "planted", "kind", "clean"])

    return spread(texts.select(F.col(column)).where(not_ascii(column))).mapInArrow(run, f"text string, utf {found}, other {found}, planted double, kind int, clean boolean")


def spread(texts: DataFrame) -> DataFrame:
    """The texts dealt to tasks for the chains."""
    return texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, -(-texts.count() // TEXTS_PER_TASK)))


def margins_of(chains: DataFrame) -> tuple[float, float]:
    """The validated margins of both kinds of chains over all clean texts above ASCII; what comes to the driver has at most 4 * BINS rows."""
    binned = lambda gain: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(gain / BIN) + F.when(gain > 0, 1).otherwise(0))).cast("int")
    told = lambda kind, gain, what: F.struct(F.lit(kind).alias("kind"), F.lit(what).alias("what"), binned(F.coalesce(gain, F.lit(0.0))).alias("bin"))
    gain = F.col("planted")
    sown = F.when(gain.isNotNull(), F.struct(F.col("kind").alias("kind"), F.lit("planted").alias("what"), binned(gain).alias("bin")))
    rows = chains.where("clean").select(F.explode(F.array_compact(F.array(told(0, F.col("utf.gain"), "clean"), told(1, F.col("other.gain"), "clean"), sown))).alias("e"))
    table = np.zeros((2, 2, BINS))
    for r in rows.groupBy("e.kind", "e.what", "e.bin").count().collect():
        table[r["kind"], 0 if r["what"] == "clean" else 1, r["bin"]] = r["count"]
    n, clean = chains.agg(F.count("*"), F.count(F.when(F.col("clean"), 1))).first()
    share = (n - clean) / n if n else 0.0
    found = [validate_margin(*table[k], share) for k in (0, 1)]
    return tuple(d if np.isnan(m) else m for m, d in zip(found, DEFAULT_MARGINS))


def repair(texts: DataFrame, column: str, model: Trained, scratch: Scratch) -> DataFrame:
    """``text, restored, chain`` of every garbled text among the distinct ``texts``.

    ``restored`` is null where the original can't be had.  Null, empty and ASCII
    texts are never garbled.  Repeated texts give a row each.
    """
    chains = scratch.cut(chains_of(texts, column, model))
    margins = margins_of(chains)
    counts = texts.sparkSession.sparkContext.broadcast(model.counts)

    def told(found: list[tuple[str, tuple[bool, str | None, str]]]) -> pa.RecordBatch:
        rows = [(t, fixed, chain) for t, (bad, fixed, chain) in found if bad]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["text", "restored", "chain"])

    def of_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_found = lambda f: (f["fixed"], f["gain"], f["chain"]) if f else None
        for batch in batches:
            yield told([(t, accept(t, (as_found(u), as_found(o)), margins)) for t, u, o in zip(*(c.to_pylist() for c in batch.columns))])

    def of_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_pylist()
            yield told(list(zip(part, judge(part, counts.value, margins))))

    # The margins say how far the chains of texts that aren't clean need to be followed.
    kinds = "text string, restored string, chain string"
    others = spread(chains.where("not clean").select("text")).mapInArrow(of_others, kinds)
    return chains.where("clean").select("text", "utf", "other").mapInArrow(of_clean, kinds).unionByName(others)


@functools.lru_cache(maxsize=60_000)
def quick_repair(text: str | None, depth: int = DEPTH) -> str | None:
    """The text with garbled UTF-8 restored if that alone makes it plain; no model is asked.  Null and damaged texts stay."""
    if not text or text.isascii() or "\ufffd" in text or is_clean(text):
        return text
    at, seen = [text], {text}
    for _ in range(depth):
        deeper: list[str] = []
        for t in at:
            for fixed in utf8_steps(t):
                if is_clean(fixed):
                    return fixed
                if fixed not in seen:
                    seen.add(fixed)
                    deeper.append(fixed)
        at = deeper
    return text
