"""Keyword-stuffed and link-list pages: extreme redundancy of blocks, confirmed by few sentences.

Every text is cut into blocks and each block's canonical form (lower case, web
addresses and digits alike) is compressed.  The ratio is compared with that of
all blocks of like length and language in the corpus.  Blocks far below it are
extremely redundant; they are confirmed if they hold few sentences for their
redundancy.  An exact check follows, which spares honest listings with a fact in
every line: what repeats must be phrases, tags or links, or the block must be
redundant beyond any listing and say nothing in numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 2000
#: A block is redundant if its log ratio is so many robust deviations below the usual one of its class.
DEVIATIONS = 2.0
#: Classes of a language with fewer blocks take the deviations of all languages.
LEAST_BLOCKS = 50
#: Sentences for each word that prose exceeds, for a block so many deviations below; the more redundant, the more sentences confirm it.
SENTENCES_PER_WORD, SENTENCE_DEVIATIONS = 0.045, 3.0
#: A mark ends a sentence if so many words stand before it (two letters of Chinese or Japanese count as one).
LEAST_SENTENCE = 5
#: Redundant beyond any listing: so many deviations, and a smaller share of the bytes than this is what digits add to the compressed size.
NO_LISTING, NUMBERS = 6.0, 0.02
#: Share of a block's (and of a text's) letters in repeated phrases, tags and links that makes it spam.
BLOCK_SHARE, TEXT_SHARE = 0.55, 0.5
#: A phrase counts as repeated from so many times on.
REPEATED = 3

# Languages with classes of their own; anything else shares one.
LANGUAGES = ["de", "en", "es", "fr", "ja", "pt", "ru"]
_URL = regex.compile(r"(?:https?://|www\.)[^\s\])>\"'|]+", regex.I)
_DIGITS = regex.compile(r"\d+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
_END = regex.compile(r"[.!?](?=\s|$)|[。！？]")
_CJK = regex.compile(r"[\p{Han}\p{Katakana}\p{Hiragana}ー]")
_TAG = regex.compile(r"#[\p{L}\p{N}_]+")
_MARKUP = regex.compile(r"</?[a-z][^>]*>|\[/?url[^\]]*\]", regex.I)
_SPLIT = regex.compile(r"[,|/;·•\n\t、，]|\s[-–—]\s|[.!?。！？](?:\s|$)")


def language(name: str | None) -> str:
    """The class of a language label; null, odd and unknown labels share one."""
    name = (name or "").strip().lower()
    return name if name in LANGUAGES else "xx"


def blocks(text: str, size: int = BLOCK_CHARS) -> list[str]:
    """Pieces of about ``size`` characters, cut at a line end or blank near it."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if len(text) - end < size // 4:
            end = len(text)
        else:
            cut = max(text.rfind("\n", at + size // 2, end), text.rfind(" ", at + size // 2, end) if text.rfind("\n", at + size // 2, end) < 0 else -1)
            end = cut + 1 if cut > 0 else end
        out.append(text[at:end])
        at = end
    return out


def canonical(block: str) -> str:
    """The form that is compressed: web addresses and numbers carry no information."""
    return regex.sub(r"\s+", " ", _DIGITS.sub("0", _URL.sub("@", block))).strip().lower()


def compression(block: str) -> tuple[int, float]:
    """(length class, log ratio of compressed to plain bytes) of a block's canonical form, and of its web addresses alike."""
    raw = max(len(block.encode()), 1)
    return int(np.log2(raw + 1)), float(np.log((len(zlib.compress(canonical(block).encode(), 6)) + 1) / (raw + 1)))


def numbers_share(block: str, log_ratio: float) -> float:
    """What the block's digits add to its compressed size, as a share of its bytes."""
    told = regex.sub(r"\s+", " ", _URL.sub("@", block)).strip().lower().encode()
    return (len(zlib.compress(told, 6)) + 1) / (max(len(block.encode()), 1) + 1) - float(np.exp(log_ratio))


def sentence_density(block: str) -> float:
    """Sentences for each word, web addresses left out."""
    found = total = 0.0
    pieces = _END.split(_URL.sub(" ", block))
    for k, piece in enumerate(pieces):
        words = _WORD.findall(piece)
        n = len(words) if piece.isascii() else sum(max(1, len(_CJK.findall(w)) / 2) for w in words)
        total += n
        found += k < len(pieces) - 1 and n >= LEAST_SENTENCE
    return found / max(1.0, total)


def stuffed_share(block: str) -> float:
    """Share of the letters that stand in web addresses and their labels, tags, and phrases that repeat."""
    letters = lambda x: sum(len(w) for w in _WORD.findall(x) if not any(c.isdigit() for c in w))
    total = letters(block)
    if not total:
        return 0.0
    listed = 0
    lines = []
    for line in block.split("\n"):
        urls = _URL.findall(line)
        if urls:
            rest = _MARKUP.sub(" ", _URL.sub(" ", line))
            words = len(_WORD.findall(rest))
            numbered = regex.match(r"\s*\[?\d+[\].)]", line)
            if words <= 6 * len(urls) and not numbered:
                listed += letters(line)
                continue
        lines.append(_MARKUP.sub(" ", _URL.sub(" ", line)))
    text = "\n".join(lines).lower()
    tags = _TAG.findall(text)
    if len(tags) >= 3:
        listed += sum(len(t) - 1 for t in tags)
        text = _TAG.sub(" ", text)
    phrases = []
    for part in _SPLIT.split(text):
        words = _WORD.findall(part)
        if words and not any(c.isdigit() for c in part):
            phrases.append(words)
    pairs: Counter[tuple[str, ...]] = Counter()
    for words in phrases:
        pairs.update(zip(words, words[1:]))
        if len(words) == 1 and (len(words[0]) >= 5 or ord(words[0][0]) > 0x3000):
            pairs[(words[0], "")] += 1
    for words in phrases:
        hit = [False] * len(words)
        for k, pair in enumerate(zip(words, words[1:])):
            if pairs[pair] >= REPEATED:
                hit[k] = hit[k + 1] = True
        if len(words) == 1 and pairs[(words[0], "")] >= REPEATED:
            hit[0] = True
        if hit and sum(map(len, (w for w, h in zip(words, hit) if h))) >= 0.4 * sum(map(len, words)):
            listed += sum(map(len, words))
    return min(1.0, listed / total)


def block_ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, size_class, log_ratio) of each block."""
    for batch in batches:
        rows = [(language(lang), *compression(block)) for lang, text in zip(*(c.to_pylist() for c in batch.columns)) for block in blocks(text)]
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int32(), pa.float64()])], ["lang", "size_class", "log_ratio"])


Usual = dict[tuple[str, int], tuple[float, float]]


def below(usual: Usual, lang: str, size: int, ratio: float) -> float:
    """Deviations of a block's log ratio from the usual one of its length, or of its length and language if that says less; below is negative."""
    told = [usual[key] for key in (("", size), (lang, size)) if key in usual]
    return min(((ratio - middle) / spread for middle, spread in told), default=0.0)


def judge_block(block: str, z: float, ratio: float) -> tuple[bool, float]:
    """(spam, share of its letters in repeated phrases, tags and links) of a block ``z`` deviations from the usual."""
    if z >= -DEVIATIONS or sentence_density(block) >= SENTENCES_PER_WORD * max(1.0, -z / SENTENCE_DEVIATIONS):
        return False, 0.0
    share = stuffed_share(block)
    return share >= BLOCK_SHARE or (z < -NO_LISTING and numbers_share(block, ratio) < NUMBERS), share


def usual_ratios(slim: DataFrame) -> Usual:
    """(language, or "" for all, and length class) -> (middle, deviation) of all blocks' log ratios; a row per language and power of two."""
    found = slim.select("lang", "text").mapInArrow(block_ratios, "lang string, size_class int, log_ratio double")
    # Spam lies below, so the upper side gives the deviation.
    q = F.percentile_approx("log_ratio", [0.5, 0.84], 2000).alias("q")
    # Both kinds of classes in one pass: the blocks are cut and compressed once.
    classes = found.groupingSets([["size_class", "lang"], ["size_class"]], "size_class", "lang").agg(q, F.count("*").alias("n"), F.grouping("lang").alias("every"))
    rows = classes.where((F.col("every") == 1) | (F.col("n") >= LEAST_BLOCKS)).select(F.coalesce("lang", F.lit("")).alias("lang"), "size_class", "q")
    return {(r.lang, r.size_class): (r.q[0], max(r.q[1] - r.q[0], 0.02)) for r in rows.collect()}


def find_spam(documents: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, spam_share, redundancy, stuffed`` of the texts that are spam, wholly or mostly.

    Null, empty and blank texts never are.  Null and unknown languages share a
    class.  Rows that share a key are judged as one text.  Other columns aren't
    read.  The usual ratios are taken over all blocks of the corpus; ``stuffed``
    is the greatest share of a spam block in repeated phrases, tags and links.
    """
    slim = documents.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("trim(text) <> ''")
    usual = slim.sparkSession.sparkContext.broadcast(usual_ratios(slim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                bad = total = 0
                least = most = 0.0
                for block in blocks(content):
                    size, ratio = compression(block)
                    z = below(usual.value, language(name), size, ratio)
                    spam, share = judge_block(block, z, ratio)
                    bad, total, least = bad + len(block) * spam, total + len(block), min(least, z)
                    most = max(most, share if spam else 0.0)
                rows.append((bad, total, least, most))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["key", "bad", "n", "z", "stuffed"])

    judged = slim.mapInArrow(run, f"key {dict(slim.dtypes)['key']}, bad bigint, n bigint, z double, stuffed double")
    total = judged.groupBy("key").agg((F.sum("bad") / F.sum("n")).alias("spam_share"), F.min("z").alias("redundancy"), F.max("stuffed").alias("stuffed"))
    return total.where(F.col("spam_share") >= TEXT_SHARE).withColumnRenamed("key", key)
