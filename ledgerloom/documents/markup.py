"""HTML to blocks and text units. One pass per document; everything after it is column logic."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.documents.opinion import KNOWN_HEADINGS
from ledgerloom.functions.batches import by_piece
from ledgerloom.functions.text import as_column, collapse, strip_markup

# Tags that make a block, tags that carry text units, tags without text, empty tags.
BLOCK_TAGS = frozenset("p div td th li h1 h2 h3 h4 h5 h6 title tu te".split())
UNIT_TAGS = frozenset("p div td th li h1 h2 h3 h4 h5 h6 tu te".split())
SILENT_TAGS = frozenset("script style noscript".split())
CODE_TAGS = frozenset("script style".split())
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset("span b strong".split())

# Tags without attributes, most of a report; none of these elements holds raw text, so nothing else depends on them.
_PLAIN_TAGS = UNIT_TAGS | INLINE_TAGS
_PLAIN_START = re.compile(r"<([a-z][a-z0-9]*)>")
_PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")

# Fixed value: the word that every bold inline heading holds.
INLINE_WORD = "계속기업"

BLOCKS = "array<struct<tag: string, text: string, bold: boolean, leaf: boolean>>"
UNITS = "array<struct<text: string, block: int, bold: boolean, block_text: string>>"
INLINE = "array<struct<text: string, rest: array<struct<text: string, bold: boolean>>>>"
PARSED = f"struct<text: string, blocks: {BLOCKS}, units: {UNITS}, inline: {INLINE}>"


def _css_bold(attributes: dict) -> bool:
    style = (attributes.get("style") or "").lower().replace(" ", "")
    return "font-weight:bold" in style or "font-weight:700" in style


class _Open:
    """An element that is not closed yet."""

    __slots__ = ("tag", "start", "block", "bolds", "tag_bold", "unit_bold", "unit_owner", "unit_id", "watchers")

    def __init__(self, tag, start, tag_bold, marked, parent):
        self.tag, self.start, self.tag_bold = tag, start, tag_bold
        self.block, self.bolds, self.unit_id, self.watchers = None, 0, None, ()
        if tag in SILENT_TAGS:
            self.unit_owner = None
        elif tag in UNIT_TAGS or parent is None:
            self.unit_owner = self if tag in UNIT_TAGS else None
        else:
            self.unit_owner = parent.unit_owner
        inherited = parent is not None and self.unit_owner is not self and parent.unit_bold
        self.unit_bold = tag_bold or marked or inherited


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces, self.blocks, self.units, self.inline = [], [], [], []
        self.unit_texts: list[list[str]] = []
        self.first_unit: list[int] = []
        self.bolds = 0
        self.data: list[str] = []
        self.stack = [_Open("", 0, False, False, None)]
        self.open_tags: dict[str, int] = {}

    # -- what the standard parser does in general, for plain tags at once ----------------------------
    def updatepos(self, i, j):
        return j  # no line numbers

    def parse_starttag(self, i):
        plain = _PLAIN_START.match(self.rawdata, i)
        if plain is None or plain[1] not in _PLAIN_TAGS:
            return super().parse_starttag(i)
        self.handle_starttag(plain[1], ())
        return plain.end()

    def parse_endtag(self, i):
        plain = _PLAIN_END.match(self.rawdata, i)
        if plain is None or self.cdata_elem is not None or plain[1] not in _PLAIN_TAGS:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    # -- text ------------------------------------------------------------------------------------
    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self._flush()
        self._unit(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self._flush()
            self.data.append(data.removeprefix("CDATA["))
            self._flush()

    def _flush(self):
        if not self.data:
            return
        raw = "".join(self.data)
        self.data = []
        text = raw.strip()
        if not text:
            return
        top = self.stack[-1]
        if top.tag not in CODE_TAGS:
            self.pieces.append(text)
            for watcher in top.watchers:
                watcher.append((text, False))
        self._unit(raw)

    def _unit(self, raw):
        owner = self.stack[-1].unit_owner
        text = " ".join(raw.split())
        if owner is None or not text:
            return
        if owner.unit_id is None:
            owner.unit_id = len(self.unit_texts)
            self.unit_texts.append([])
            self.first_unit.append(len(self.units))
        self.unit_texts[owner.unit_id].append(text)
        self.units.append([text, owner.unit_id, self.stack[-1].unit_bold, None])

    # -- elements --------------------------------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._flush()
        tag_bold, marked = tag in ("b", "strong"), False
        if attrs:
            attributes = dict(attrs)
            tag_bold = tag_bold or _css_bold(attributes)
            marked = (attributes.get("usermark") or "").upper() == "B"
        element = _Open(tag, len(self.pieces), tag_bold, marked, self.stack[-1])
        self.bolds += tag_bold or marked
        element.bolds = self.bolds
        if tag in BLOCK_TAGS:
            element.block = len(self.blocks)
            self.blocks.append(None)
        self.stack.append(element)
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        if tag in EMPTY_TAGS:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if not self.open_tags.get(tag):
            return
        while self.stack[-1].tag != tag:
            self._close()
        self._close()

    def _close(self):
        element = self.stack.pop()
        self.open_tags[element.tag] -= 1
        end = len(self.pieces)
        parent = self.stack[-1]
        if element.block is not None and end > element.start:
            outer = next((e for e in reversed(self.stack) if e.block is not None), None)
            self.blocks[element.block] = [
                element.tag, element.start, end, self.bolds > element.bolds, outer.block if outer else None,
            ]
        if parent.watchers or (element.tag in INLINE_TAGS and element.tag_bold):
            text = " ".join(self.pieces[element.start : end])
            if text:
                for watcher in parent.watchers:
                    watcher.append((text, element.tag_bold))
            if element.tag in INLINE_TAGS and element.tag_bold and INLINE_WORD in text:
                rest: list = []
                self.inline.append((text, rest))
                parent.watchers = (*parent.watchers, rest)

    def result(self):
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._close()
        spans = {i: b for i, b in enumerate(self.blocks) if b is not None}
        parents = {b[4] for b in spans.values()}
        blocks = []
        for i, (tag, start, end, bold, outer) in spans.items():
            if outer in spans and spans[outer][1:3] == [start, end]:
                continue
            blocks.append((tag, " ".join(self.pieces[start:end]), bold, i not in parents))
        for unit_id, first in enumerate(self.first_unit):
            texts = self.unit_texts[unit_id]
            if len(texts) > 1:
                joined = " ".join(texts)
                if joined in KNOWN_HEADINGS:
                    self.units[first][3] = joined
        return " ".join(self.pieces), blocks, self.units, self.inline


def read_markup(html: str) -> tuple[str, list, list, list]:
    """Visible text, blocks, text units and bold inline headings of one document."""
    reader = _Reader()
    reader.feed(html)
    return reader.result()


def _listed(rows: list[list], kind: pa.ListType) -> pa.Array:
    """Lists of tuples as an array of lists of structs, built column by column; a field that is a list is treated alike."""
    offsets = np.concatenate(([0], np.cumsum([len(row) for row in rows]))).astype(np.int32)
    flat = [item for row in rows for item in row]
    fields = []
    for at, field in enumerate(kind.value_type):
        values = [item[at] for item in flat]
        fields.append(_listed(values, field.type) if pa.types.is_list(field.type) else pa.array(values, field.type))
    items = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), items, type=kind)


def _parsed(htmls: list[str | None], kind: pa.StructType) -> pa.Array:
    rows = [read_markup(html) if html is not None else ("", [], [], []) for html in htmls]
    text, *lists = zip(*rows)
    columns = [pa.array(text, pa.string())] + [_listed(found, field.type) for found, field in zip(lists, list(kind)[1:])]
    return pa.StructArray.from_arrays(columns, fields=list(kind))


def _unescape_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(html_lib.unescape, na_action="ignore")


def _decode(content, declared):
    if content is None:
        return None
    names = ([declared] if declared else []) + ["utf-8", "cp949", "euc-kr"]
    for name in dict.fromkeys(names):
        try:
            return bytes(content).decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return bytes(content).decode("utf-8", errors="replace")


def _decode_batch(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for contents, declared in batches:
        yield pd.Series([_decode(c, d) for c, d in zip(contents, declared)], dtype=object)


def parse_markup(html: Column | str) -> Column:
    """``struct(text, blocks, units, inline)`` of a document."""
    return by_piece(_parsed, PARSED, as_column(html))


def unescape(text: Column | str) -> Column:
    """Character references to characters."""
    decode = F.pandas_udf(_unescape_batch, "string")
    return decode(as_column(text))


def html_text(html: Column | str) -> Column:
    """Visible text: scripts and tags dropped, references decoded, blanks collapsed."""
    return collapse(unescape(strip_markup(html)))


def charset_of(content_type: Column | str) -> Column:
    found = F.regexp_extract(as_column(content_type), r"""(?i)charset\s*=\s*['"]?([^;\s'"]+)""", 1)
    return F.nullif(found, F.lit(""))


def decode_bytes(content: Column | str, content_type: Column | str) -> Column:
    """Text of downloaded bytes: declared charset, utf-8, the Korean code pages, then utf-8 with marks.

    Valid UTF-8 and Latin-1 are decoded by Spark; only other bytes go to Python.
    """
    content, declared = as_column(content).cast("binary"), charset_of(content_type)
    name = F.lower(declared)
    utf8 = (declared.isNull() | name.isin("utf-8", "utf8")) & F.is_valid_utf8(content.cast("string"))
    latin = name.isin("iso-8859-1", "latin-1", "latin1")
    rest = F.pandas_udf(_decode_batch, "string")(F.when(~F.coalesce(utf8 | latin, F.lit(False)), content), declared)
    return F.when(utf8, content.cast("string")).when(latin, F.decode(content, "ISO-8859-1")).otherwise(rest)
