"""Encoding of whole texts with a public byte-pair tokenizer.

Texts are cut only where the tokenizer's own splitting pattern always cuts:
between a character that isn't white space and one that is.  A stretch without
such a place can be of any length; it is encoded by tree concatenation: its
halves are encoded in parallel and then joined by encoding a growing window
around the join again until its first and last token agree with those already
there.  For byte-pair merges this is exact, since a sequence of tokens is the
encoding of its text if and only if every two neighbours are.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.settings import SPLIT_PATTERN, tokenizer_file

#: Texts above this many characters are cut into segments that are encoded in parallel.
SEGMENT_CHARS = 200_000
#: Unsplit stretches above this many bytes are encoded by tree concatenation.
PIECE_BYTES = 20_000
#: Leaves of a stretch that a task joins, and the most characters that a text can have.
FAN, MOST_CHARS = 16, 2**31
_PLACE = regex.compile(r"(?<=\S)(?=\s)")
_SPLIT = regex.compile(SPLIT_PATTERN)


@functools.lru_cache(maxsize=4)
def encoding(name: str):
    """The tokenizer of that name; read once per Python worker."""
    import tiktoken

    with open(tokenizer_file(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def pieces(name: str) -> Callable[[bytes], list[int]]:
    """Byte-pair merges of one unsplit stretch, without the splitting pattern."""
    return encoding(name)._encode_single_piece


def join_tokens(left: list[int], right: list[int], text: Callable[[list[int]], bytes], encode: Callable[[bytes], list[int]]) -> list[int]:
    """The encoding of the joined texts of two encoded neighbours of one unsplit stretch.

    The window starts with a token on either side and doubles until the first
    and last token of its new encoding are the ones that stood there, or a side
    is used up.
    """
    if not left or not right:
        return left + right
    i = j = 2
    while True:
        i, j = min(i, len(left)), min(j, len(right))
        fresh = encode(text(left[len(left) - i :]) + text(right[:j]))
        left_ok = i == len(left) or fresh[0] == left[len(left) - i]
        right_ok = j == len(right) or fresh[-1] == right[j - 1]
        if left_ok and right_ok:
            return left[: len(left) - i] + fresh + right[j:]
        i, j = (i if left_ok else i * 2), (j if right_ok else j * 2)


def tree_encode(data: bytes, encode: Callable[[bytes], list[int]], text: Callable[[list[int]], bytes], piece_bytes: int = PIECE_BYTES) -> list[int]:
    """Encode one unsplit stretch: leaves of at most ``piece_bytes``, then joins level by level."""
    row = [encode(data[at : at + piece_bytes]) for at in range(0, len(data), piece_bytes)]
    while len(row) > 1:
        row = [join_tokens(row[k], row[k + 1], text, encode) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
    return row[0] if row else []


def segments(text: str, size: int) -> Iterator[str]:
    """Cut ``text`` at always-cut places, the first at or after each ``size`` characters."""
    start = 0
    while start < len(text):
        place = _PLACE.search(text, start + size) if start + size < len(text) else None
        end = place.start() if place else len(text)
        yield text[start:end]
        start = end


def encode_text(text: str, name: str, piece_bytes: int = PIECE_BYTES) -> list[int]:
    """The ids of one text of any length; long unsplit stretches go through the tree."""
    enc = encoding(name)
    if len(text) * 4 <= piece_bytes or not any(len(run) * 4 > piece_bytes for run in text.split()):
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in _SPLIT.findall(text):
        data = piece.encode()
        out += tree_encode(data, pieces(name), enc.decode_bytes, piece_bytes) if len(data) > piece_bytes else pieces(name)(data)
    return out


def _texts(batch: pa.RecordBatch, at: int) -> list[str]:
    return batch.column(at).to_pylist()


def encode_short(name: str, count_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, text) -> (key, ids) or (key, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ids = [encode_text(t, name) if t else [] for t in _texts(batch, 1)]
            n = np.fromiter(map(len, ids), np.int32, len(ids))
            if count_only:
                value = pa.array(n)
            else:
                flat = np.fromiter((i for row in ids for i in row), np.int32, int(n.sum()))
                value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), value], ["key", "value"])

    return run


def _runs(part: str, size: int) -> Iterator[list[list[str]]]:
    """The leaves of a segment, each a list of pieces that are encoded one by one.

    A short segment is one leaf.  Of a longer one every piece of the splitting
    pattern stays whole, since the pattern looks ahead and would split a group
    of pieces otherwise; pieces above ``2 * size`` are leaves of their own.
    """
    if len(part) <= 2 * size:
        yield [[part]]
        return
    held: list[str] = []
    n = 0
    for m in _SPLIT.finditer(part):
        piece = m.group()
        if len(piece) > 2 * size:
            if held:
                yield [held]
            held, n = [], 0
            yield [[piece[a : a + size]] for a in range(0, len(piece), size)]
            continue
        held.append(piece)
        n += len(piece)
        if n >= size:
            yield [held]
            held, n = [], 0
    if held:
        yield [held]


def cut_long(segment_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, sha, text) -> (key, sha, seg, leaf, pieces, leaves): segments, and the leaves of those that can't be cut.

    ``leaves`` is 0 for a whole segment, which the splitting pattern cuts as ever.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32()]
            for key, sha, text in zip(*(c.to_pylist() for c in batch.columns)):
                seg = -1
                for part in segments(text, segment_chars):
                    whole = len(part) <= 2 * segment_chars
                    for leaves in _runs(part, segment_chars):
                        seg += 1
                        for leaf, held in enumerate(leaves):
                            row = [[key], [sha], [seg], [leaf], [held], [0 if whole else len(leaves)]]
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], ["key", "sha", "seg", "leaf", "pieces", "leaves"])

    return run


def encode_leaves(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, sha, seg, leaf, pieces, leaves) -> (key, sha, seg, leaf, ids, leaves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name)
        for batch in batches:
            ids = [
                encode_text(held[0], name) if n == 0 else [i for piece in held for i in tree_encode(piece.encode(), pieces(name), enc.decode_bytes)]
                for held, n in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ]
            columns = [*(batch.column(k) for k in range(4)), pa.array(ids, pa.list_(pa.int32())), batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "sha", "seg", "leaf", "ids", "leaves"])

    return run


def join_leaves(name: str) -> Callable:
    """Up to FAN neighbouring leaves of a stretch -> one, joined as a tree."""

    def run(key, group):
        import pandas as pd

        row = [list(map(int, r)) for r in group.sort_values("leaf")["ids"]]
        while len(row) > 1:
            row = [
                join_tokens(row[k], row[k + 1], encoding(name).decode_bytes, pieces(name)) if k + 1 < len(row) else row[k]
                for k in range(0, len(row), 2)
            ]
        return pd.DataFrame({"key": [key[0]], "sha": [key[1]], "seg": [key[2]], "leaf": [key[3]], "ids": [row[0]], "leaves": [2]})

    return run


def joined(coded: DataFrame, name: str, segment_chars: int, schema: str) -> DataFrame:
    """The leaves of each stretch joined level by level, FAN neighbours a task, until the longest possible text has one."""
    out = coded.where("leaves <= 1").select("key", "sha", "seg", "ids")
    level, most = coded.where("leaves > 1"), -(-MOST_CHARS // segment_chars)
    while most > 1:
        level = level.groupBy("key", "sha", "seg", F.floor(F.col("leaf") / FAN).cast("int").alias("block")).applyInPandas(join_leaves(name), schema)
        most = -(-most // FAN)
    return out.unionByName(level.select("key", "sha", "seg", "ids"))


def encode_column(df: DataFrame, key: str, text: str, name: str, count_only: bool = False, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """``key, ids`` (or ``key, n_tokens``): every text encoded whole, without special tokens.

    Null and empty texts give the empty list (0 tokens).  Blank texts are
    encoded like any other, and special tokens' strings are ordinary text.
    Repeated rows give a row each, and rows that share a key theirs, at every
    length.  Other columns aren't read; an empty table gives no rows.

    Texts above ``segment_chars`` are taken apart and told from others under
    their key by their SHA-256; repeats of one are encoded once.
    """
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["key"]
    is_long = F.coalesce(F.length("text") > segment_chars, F.lit(False))
    value = "int" if count_only else "array<int>"
    short = slim.where(~is_long).mapInArrow(encode_short(name, count_only), f"key {kind}, value {value}")
    long_rows = slim.where(is_long).select("key", F.sha2("text", 256).alias("sha"), "text")
    cut = long_rows.mapInArrow(cut_long(segment_chars), f"key {kind}, sha string, seg int, leaf int, pieces array<string>, leaves int")
    parts = f"key {kind}, sha string, seg int, leaf int, ids array<int>, leaves int"
    coded = cut.dropDuplicates(["key", "sha", "seg", "leaf"]).mapInArrow(encode_leaves(name), parts)
    ordered = F.array_sort(F.collect_list(F.struct("seg", "ids")))
    whole = joined(coded, name, segment_chars, parts).groupBy("key", "sha").agg(F.flatten(F.transform(ordered, lambda x: x.ids)).alias("ids"))
    times = long_rows.groupBy("key", "sha").agg(F.count("*").alias("times")).withColumnsRenamed({"key": "k", "sha": "s"})
    rows = whole.join(times, F.col("key").eqNullSafe(F.col("k")) & (F.col("sha") == F.col("s")))
    rows = rows.select("key", F.size("ids").cast("int").alias("value") if count_only else F.col("ids").alias("value"), F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    long_ = rows.select("key", "value")
    return short.unionByName(long_).select(F.col("key").alias(key), F.col("value").alias("n_tokens" if count_only else "ids"))
