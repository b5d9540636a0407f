"""Text side: page flattening, chunking, mention tagging, snippet rows and lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions.text import aka_snippet, mention_key

CHUNK, OVERLAP = 300, 30
LIST_ITEMS, TABLE_ROWS, LEAST_WORDS = 2, 2, 15


class _Flattener(HTMLParser):
    """Collects paragraphs, headings, list items and table rows of either page dialect, in order."""

    KINDS = {"p": "text", "head": "head", "h1": "head", "h2": "head", "h3": "head", "item": "item", "li": "item", "row": "row", "tr": "row"}
    GROUPS = {"list", "ul", "ol", "table"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, object]] = []
        self.kind, self.text, self.cells = "", [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.GROUPS:
            self.events.append(("open", tag))
        elif tag in self.KINDS:
            self.kind, self.text, self.cells = self.KINDS[tag], [], []
        elif tag in ("cell", "td", "th"):
            self.text = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("cell", "td", "th"):
            self.cells.append(" ".join("".join(self.text).split()))
            self.text = []
        elif tag in self.KINDS and self.kind == self.KINDS[tag]:
            words = " ".join("".join(self.text).split())
            self.events.append((self.kind, list(self.cells) if self.kind == "row" else words))
            self.kind = ""
        elif tag in self.GROUPS:
            self.events.append(("close", tag))

    def handle_data(self, data: str) -> None:
        if self.kind:
            self.text.append(data)


def flatten_page(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) parts of a page: ``text`` paragraphs, ``listing`` parts of two items, ``table`` parts of two rows.

    List and table parts start with the heading before them, or the last
    sentence of the paragraph before.  A table's first row names its columns if
    every cell has a letter; else they are ``Column 1`` and so on.  Null, empty
    and unparsable pages give nothing.
    """
    if not page:
        return []
    parser = _Flattener()
    try:
        parser.feed(page)
        parser.close()
    except Exception:  # noqa: BLE001 - damaged markup
        return []
    out: list[tuple[str, str]] = []
    header, items, rows = "", [], []
    for kind, value in parser.events:
        if kind == "text":
            out.append(("text", value))
            sentences = [s for s in value.replace("! ", ". ").replace("? ", ". ").split(". ") if s.strip()]
            header = sentences[-1] if sentences else header
        elif kind == "head":
            header = value
        elif kind == "item" and value:
            items.append(value)
        elif kind == "row" and value:
            rows.append(value)
        elif kind == "close":
            for at in range(0, len(items), LIST_ITEMS):
                out.append(("listing", "\n".join([header, *items[at : at + LIST_ITEMS]]).strip()))
            if rows:
                named = all(any(ch.isalpha() for ch in c) for c in rows[0])
                columns = rows[0] if named else [f"Column {k + 1}" for k in range(len(rows[0]))]
                body = rows[1:] if named else rows
                for at in range(0, len(body), TABLE_ROWS):
                    lines = ["; ".join(f"{c}: {v}" for c, v in zip(columns, r)) for r in body[at : at + TABLE_ROWS]]
                    out.append(("table", "\n".join([header, *lines]).strip()))
            items, rows = [], []
    return [(k, t) for k, t in out if t]


def page_parts(pages: DataFrame, key: str, content: str) -> DataFrame:
    """``key, part_no, kind, text`` of every page."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, *part) for k, c in zip(b["key"], b["content"]) for n, part in enumerate(flatten_page(c))]
            yield pd.DataFrame(rows, columns=["key", "part_no", "kind", "text"])

    slim = pages.select(F.col(key).alias("key"), F.col(content).alias("content")).where("content is not null")
    return slim.mapInPandas(run, f"key {kind}, part_no int, kind string, text string").withColumnRenamed("key", key)


def org_texts(parts: DataFrame, org: str) -> DataFrame:
    """Per organisation and kind the distinct parts of all its pages."""
    return parts.select(org, "kind", "text").distinct()


def split_text(text: str | None, size: int = CHUNK, overlap: int = OVERLAP, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest mark that fits, neighbours sharing up to ``overlap``."""
    if not text or not text.strip():
        return []
    mark = next(m for m in marks if m == "" or m in text)
    finer = marks[marks.index(mark) + 1 :]
    pieces = list(text) if mark == "" else [p for p in text.split(mark) if p]
    out: list[str] = []
    held: list[str] = []

    def length(parts: list[str]) -> int:
        return sum(map(len, parts)) + len(mark) * max(0, len(parts) - 1)

    def flush() -> None:
        joined = mark.join(held).strip()
        if joined:
            out.append(joined)

    for piece in pieces:
        if len(piece) > size:
            if held:
                flush()
                held = []
            out += split_text(piece, size, overlap, finer)
            continue
        if held and length([*held, piece]) > size:
            flush()
            while held and (length(held) > overlap or length([*held, piece]) > size):
                held.pop(0)
        held.append(piece)
    if held:
        flush()
    return out


def recursive_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key, chunk_no, chunk`` of every text by ``split_text``."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, c) for k, t in zip(b["key"], b["text"]) for n, c in enumerate(split_text(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["key", "chunk_no", "chunk"])

    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return slim.mapInPandas(run, f"key {kind}, chunk_no int, chunk string").withColumnRenamed("key", key)


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key, chunk_no, chunk`` of overlapping windows; the last one ends with the text."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)) - 1
    rows = df.where(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_no"))
    return rows.select(key, "chunk_no", F.substring("_t", F.col("chunk_no").cast("int") * step + 1, F.lit(size)).alias("chunk"))


Tagger = Callable[[list[str]], list[list[str]]]


def dictionary_tagger(names: list[str]) -> Tagger:
    """Offline tagger: finds known names in a text, longest first, whatever the case."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for n in {n.lower(): n for n in names if n and len(n) > 2}.items():
        automaton.add_word(*n)
    automaton.make_automaton() if len(automaton) else None

    def tag(texts: list[str]) -> list[list[str]]:
        if not len(automaton):
            return [[] for _ in texts]
        return [sorted({name for _, name in automaton.iter_long(t.lower())}) for t in texts]

    return tag


def tag_mentions(chunks: DataFrame, text: str, tagger: Tagger) -> DataFrame:
    """The chunks with a list ``mentions``; the tagger (a model or the offline one) sees whole Arrow batches."""
    schema = chunks.schema.simpleString()[7:-1] + ",mentions:array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(mentions=tagger(b[text].fillna("").tolist()))

    return chunks.mapInPandas(run, schema)


def snippet_rows(tagged: DataFrame, text: str, source: str, kind: str) -> DataFrame:
    """``mention, text, source_org, kind``: a row for each mention of a chunk that has at least two."""
    rows = tagged.where(F.size("mentions") >= 2).select(F.explode("mentions").alias("m"), F.col(text).alias("text"), F.col(source).alias("source_org"))
    return rows.select(mention_key(F.col("m")).alias("mention"), "text", "source_org", F.lit(kind).alias("kind")).distinct()


def aka_rows(orgs: DataFrame, name: str, aka: str) -> DataFrame:
    """Snippet rows made of an organisation's other names: one sentence, mentioning both."""
    flat = orgs.select(F.col(name).alias("o"), F.explode(aka).alias("a")).where("trim(a) <> '' and o is not null")
    sentence = aka_snippet(F.col("o"), F.col("a"))
    rows = flat.select(F.explode(F.array("o", "a")).alias("m"), sentence.alias("text"), F.col("o").alias("source_org"))
    return rows.select(mention_key(F.col("m")).alias("mention"), "text", "source_org", F.lit("peering").alias("kind")).distinct()
