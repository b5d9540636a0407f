"""The main body of a page: maximum-scoring regions of its lines.

A labelled page carries semantic containers (its article, and navigation,
sidebars and footer), which say for every line inside them whether it belongs to
the main body.  Counts over all labelled pages give each word, word pair, tag and
line shape a weight: positive if it is found in main bodies, negative if not
(tags are never more than neutral).  On any page, whatever its markup, a linear scan
finds the contiguous regions with the greatest total score, where opening and
closing a region costs something, and less where a block of the page ends.
"""

from __future__ import annotations

import functools
import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights are kept for this many hashed features: the model's size is fixed.
FEATURES = 1 << 18
#: Add-so-many smoothing of the counts, and the most that one feature may weigh.
SMOOTHING, WEIGHT_CAP = 0.5, 4.0
#: The most that all words of a line may weigh; words occur together, so their sum says more than they know.
WORDS_CAP = 7.0
#: Cost of a switch between main body and boilerplate inside a block, and at its edge.
SWITCH_INSIDE, SWITCH_AT_EDGE = 12.0, 4.0

_TAG = regex.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>")
_ANY_TAG = regex.compile(r"<[^<>]*>|<!--.*?-->")
_BULLET = regex.compile(r"^\s*[*•·-]\s+")
_WORD = regex.compile(r"\w+|[|©/›»>…]")
_DIGITS = regex.compile(r"\d+")
_DATE = regex.compile(r"^\d{1,2}[./]\d{1,2}[./]\d{4}|^\d{4}-\d\d-\d\d")
_CONTAINER = frozenset(["article", "aside", "nav", "footer", "header", "section", "div", "main", "list", "ul", "ol", "table", "body", "html", "doc"])
_MAIN = frozenset(["article"])
_REST = frozenset(["nav", "aside", "footer"])
_ITEM, _HEAD, _CELL = frozenset(["li", "item"]), frozenset(["h1", "h2", "h3", "h4", "head"]), frozenset(["td", "tr", "row", "cell"])


def read_lines(content: str) -> list[tuple[str, str, bool, str]]:
    """(visible text, shape, whether a block begins here, tags) of each line of a page, split at the line feed."""
    out, edge = [], True
    for raw in content.split("\n"):
        tags = _TAG.findall(raw) if "<" in raw else []
        names = [name.lower() for _, name in tags]
        text = html.unescape(_ANY_TAG.sub(" ", raw)).strip() if tags or "&" in raw or "<" in raw else raw.strip()
        bullet = bool(_BULLET.match(text))
        if bullet:
            text = _BULLET.sub("", text)
        kind = "p"
        if bullet or any(n in _ITEM for n in names):
            kind = "li"
        elif any(n in _HEAD for n in names):
            kind = "h"
        elif any(n in _CELL for n in names) or "\t" in text:
            kind = "td"
        if any(n in _CONTAINER for n in names) or not text:
            edge = True
        out.append((text, kind, edge, " ".join(sorted(set(names) - _CONTAINER))))
        if text:
            edge = any(n in _CONTAINER for n in names)
    return out


def labels(content: str) -> list[int]:
    """Of each line 1 in an article, 0 in navigation, sidebar or footer, -1 elsewhere; all -1 if the page has no article."""
    if "<article" not in content:
        return []
    stack: list[str] = []
    out = []
    for raw in content.split("\n"):
        before = list(stack)
        for closing, name in _TAG.findall(raw) if "<" in raw else []:
            name = name.lower()
            if name in _MAIN or name in _REST:
                if not closing:
                    stack.append(name)
                elif name in stack:
                    while stack.pop() != name:
                        pass
        inside = before + stack
        out.append(0 if any(n in _REST for n in inside) else 1 if any(n in _MAIN for n in inside) else -1)
    return out


def own_names(org_name: str | None) -> list[str]:
    """The forms under which a page's own organisation is written: the whole name and its first two words."""
    words = (org_name or "").split()
    return [x for x in dict.fromkeys([" ".join(words), " ".join(words[:2])]) if len(x) >= 3]


def features(text: str, kind: str, tags: str, own: list[str] = ()) -> tuple[tuple[int, ...], ...]:
    """Hashed words and word pairs, shape, and tags of one line; digits are alike, and so are all pages' own names.

    Lines without an own name read alike on every page, and most boilerplate is such, so these are remembered.
    """
    held = [name for name in own if name in text]
    return _own_features(text, kind, tags, held) if held else _features(text, kind, tags, False)


def _own_features(text: str, kind: str, tags: str, held: list[str]) -> tuple[tuple[int, ...], ...]:
    for name in held:
        text = text.replace(name, " ownname ")
    return _features.__wrapped__(text, kind, tags, True)


@functools.lru_cache(maxsize=100_000)
def _features(text: str, kind: str, tags: str, mine: bool) -> tuple[tuple[int, ...], ...]:
    capitals = regex.findall(r"\b\p{L}", text)
    words = [_DIGITS.sub("0", w) for w in _WORD.findall(text.lower())]
    n = len(words)
    size = 1 if n <= 1 else 2 if n <= 3 else 3 if n <= 6 else 4 if n <= 12 else 5
    end = "." if text[-1:] in ".!?。" else "…" if text[-1:] == "…" else ":" if text[-1:] == ":" else "-"
    said = {f"w {w}" for w in words} | {f"b {a} {b}" for a, b in zip(words, words[1:])}
    found = {f"s {size} {end}", f"e {end}", f"l {' '.join(words[:6])}", f"f {words[0] if words else ''}", f"k {kind} {size}"}
    titled = sum(c.isupper() for c in capitals) >= 0.7 * len(capitals) if capitals else False
    found |= {f"o {mine} {size} {end}", f"t {titled} {mine} {size} {kind}", f"u {titled} {mine} {':' in text}"}
    if _DATE.match(text):
        found.add("date")
    if "|" in text or "·" in text:
        found.add("bars")
    marks = {f"g {tag}" for tag in tags.split()}
    return tuple(tuple(xxhash.xxh64_intdigest(x) % FEATURES for x in sorted(part)) for part in (said, found, marks))


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, org_name) -> (feature, main, rest) summed over the partition; at most one row per feature, the last two rows are line counts."""
    counts = np.zeros((2, FEATURES + 1), np.int64)
    for batch in batches:
        held: list[list[int]] = [[], []]
        for content, org_name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            marks, own = labels(content), own_names(org_name)
            if marks:
                for (text, kind, _, tags), mark in zip(read_lines(content), marks):
                    if mark >= 0 and text:
                        held[1 - mark] += sum(features(text, kind, tags, own), ())
                        counts[1 - mark][FEATURES] += 1
        for k in (0, 1):
            counts[k][:FEATURES] += np.bincount(np.array(held[k], np.int64), minlength=FEATURES)
    at = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], ["feature", "main", "rest"])


def weights(feature: np.ndarray, main: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Log odds of each feature between main and other lines, capped."""
    table = np.zeros((2, FEATURES + 1))
    table[0][feature], table[1][feature] = main, rest
    total = table[:, FEATURES] + 2 * SMOOTHING
    odds = np.log((table[0][:FEATURES] + SMOOTHING) / total[0]) - np.log((table[1][:FEATURES] + SMOOTHING) / total[1])
    odds[table[:, :FEATURES].sum(axis=0) == 0] = 0
    return np.clip(odds, -WEIGHT_CAP, WEIGHT_CAP).astype(np.float32)


def best_regions(scores: list[float], edges: list[bool]) -> list[bool]:
    """The lines in the regions with the greatest total score, a switch costing what its place says: one linear scan."""
    inside, outside = -SWITCH_AT_EDGE, 0.0
    back: list[tuple[bool, bool]] = []
    for k, (score, edge) in enumerate(zip(scores, edges)):
        cost = SWITCH_AT_EDGE if edge else SWITCH_INSIDE
        if k == 0:
            inside, outside = score, 0.0
            back.append((True, False))
            continue
        stay_in, enter = inside, outside - cost
        stay_out, leave = outside, inside - cost
        back.append((stay_in >= enter, leave > stay_out))
        inside, outside = max(stay_in, enter) + score, max(stay_out, leave)
    out = [False] * len(scores)
    state = inside > outside
    for k in range(len(scores) - 1, -1, -1):
        out[k] = state
        if k:
            state = back[k][0] if state else back[k][1]
    return out


def main_lines(content: str, table: np.ndarray, org_name: str | None = None) -> list[int]:
    """The numbers of the visible lines in the page's main body."""
    own = own_names(org_name)
    lines = read_lines(content)
    at = [k for k, (text, *_) in enumerate(lines) if text]
    scores, edges = [], []
    for k in at:
        text, kind, edge, tags = lines[k]
        said, shape, marks = features(text, kind, tags, own)
        words = float(table[list(said)].sum()) / max(1.0, len(said) ** 0.5)
        scores.append(max(-WORDS_CAP, min(WORDS_CAP, words)) + float(table[list(shape)].sum()) + float(np.minimum(table[list(marks)], 0).sum()))  # tags only take
        edges.append(edge)
    return [k for k, keep in zip(at, best_regions(scores, edges)) if keep] if at else []


def learn_weights(pages: DataFrame, content: str, org_name: str) -> np.ndarray:
    """The weights from all labelled pages; what comes to the driver has at most FEATURES + 1 rows.

    Without a labelled page every weight is 0, and no line is main body.
    """
    slim = pages.select(F.col(content), F.col(org_name)).where(F.col(content).contains("<article"))
    counts = slim.mapInArrow(count_features, "feature int, main bigint, rest bigint")
    rows = counts.groupBy("feature").agg(F.sum("main").alias("main"), F.sum("rest").alias("rest")).toPandas()
    return weights(*(rows[c].to_numpy() for c in ("feature", "main", "rest")))


def extract_main(pages: DataFrame, key: str, content: str, org_name: str, table: np.ndarray) -> DataFrame:
    """``key, line_no`` of the main body's visible lines of every page.

    Pages with null or empty content, or without a visible line, have none.
    Repeated rows give their lines once.  A null name only leaves out the hints
    that own names give.  Other columns aren't read.
    """
    model = pages.sparkSession.sparkContext.broadcast(table)
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_lines(c, model.value, o) if c else [] for c, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            n = np.fromiter(map(len, found), np.int64, len(found))
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), n)))
            yield pa.RecordBatch.from_arrays([keys, pa.array([k for f in found for k in f], pa.int32())], ["key", "line_no"])

    slim = pages.select(F.col(key).alias("key"), F.col(content).alias("content"), F.col(org_name).alias("org_name"))
    # Rows that differ in their name alone are read apart; what both find counts once.
    lines = slim.where("content <> ''").mapInArrow(run, f"key {kind}, line_no int")
    return lines.distinct().withColumnRenamed("key", key)


def extract_bodies(pages: DataFrame, key: str, content: str, org_name: str, table: np.ndarray) -> DataFrame:
    """``key, body``: the main body's lines as text, without markup and with entities as characters.

    Pages without a main body give no row; of rows that share a key but differ the greatest body counts.
    """
    model = pages.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for page, name in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = read_lines(page)
                bodies.append("\n".join(lines[k][0] for k in main_lines(page, model.value, name)) or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], ["key", "body"])

    slim = pages.select(F.col(key).alias("key"), F.col(content).alias("content"), F.col(org_name).alias("org_name")).where("content <> ''")
    bodies = slim.mapInArrow(run, f"key {dict(pages.dtypes)[key]}, body string").where("body is not null")
    return bodies.groupBy("key").agg(F.max("body").alias("body")).withColumnRenamed("key", key)
