"""Reading units of HTML sections, by the standard library's parser, in document order."""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = ("p", "li", "blockquote", "table", *HEADINGS)
DROPPED = ("script", "style")
FURNITURE_TAGS = ("nav", "aside", *DROPPED)
VOID = ("br", "hr", "img", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr")
_FURNITURE = re.compile(r"(?:^|[\s_-])(?:nav(?:igation)?|toc|breadcrumbs?|sidebar|footer|header|banner|pagebreak|page-?number|menu|contentinfo)(?:$|[\s_-])", re.I)
_NOTE = re.compile(r"^[\s\[(]*(?:\d{1,3}|[*†‡§¶]|[a-z])[\s\])]*$")
MOST_TAGS = 50_000


class _Reader(HTMLParser):
    """Collects blocks with their text, kind and element path; inline runs outside blocks are blocks of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, int]] = []
        self.counts: list[dict[str, int]] = [{}]
        self.skip = 0  # depth of furniture
        self.furniture = self.tags = 0
        self.blocks: list[dict] = []
        self.open: dict | None = None
        self.anchor: str | None = None
        self.note: list[str] | None = None
        self.cell: list[str] | None = None
        self.rows: list[list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.tags > MOST_TAGS:
            return
        a = {k: v or "" for k, v in attrs}
        if self.skip:
            if tag not in VOID:
                self.skip += 1
            return
        if tag == "br":
            self._add("\n")
            return
        if tag in VOID:
            return
        n = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        named = " ".join(a.get(k, "") for k in ("class", "id", "role", "epub:type"))
        if tag in FURNITURE_TAGS or _FURNITURE.search(named):
            self.furniture += tag not in FURNITURE_TAGS
            self.skip = 1
            return
        self.path.append((tag, n))
        self.counts.append({})
        if a.get("id"):
            self.anchor = a["id"]
        if tag == "a" and "#" in a.get("href", "") and self.open is not None:
            self.note = []
        if tag == "table":
            self._close()
            self._begin("table")
            self.rows = []
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.cell = []
        elif tag in BLOCKS:
            self._close()
            self._begin(tag)
        elif tag in ("div", "section", "article", "body", "ul", "ol", "dl"):
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.skip -= 1
            return
        if all(t != tag for t, _ in self.path):
            return
        if tag == "a" and self.note is not None:
            text = "".join(self.note)
            self.note = None
            if not (_NOTE.match(text) and self.open and self.open["text"] and "".join(self.open["text"]).strip()):
                self._add(text)
        if self.rows is not None and tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        if tag == "table" and self.rows is not None and self.open:
            self.open["text"] = ["\n".join(" | ".join(r) for r in self.rows if any(r))]
            self.rows = None
            self._close()
        elif self.rows is None and tag in (*BLOCKS, "div", "section", "article", "body", "ul", "ol", "dl"):
            self._close()
        while self.path:
            self.counts.pop()
            if self.path.pop()[0] == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self._add(data)

    def _begin(self, kind: str) -> None:
        self.open = {"kind": kind, "text": [], "path": "/".join(f"{t}[{n}]" for t, n in self.path), "fragment": self.anchor}

    def _add(self, text: str) -> None:
        if self.note is not None:
            self.note.append(text)
        elif self.rows is not None:
            if self.cell is not None:
                self.cell.append(text)
        else:
            if self.open is None and text.strip():
                self._begin("p")
            if self.open is not None:
                self.open["text"].append(text)

    def _close(self) -> None:
        if self.open is not None:
            lines = [" ".join(x.split()) for x in "".join(self.open["text"]).split("\n")]
            text = "\n".join(x for x in lines if x)
            if text:
                self.blocks.append(self.open | {"text": text})
        self.open = None


def html_units(html: str) -> list[tuple[str, str, str, str | None]]:
    """``(contents, content_kind, element_path, fragment)`` in reading order.

    Navigation, scripts and elements named as furniture are dropped; headings are carried to the next
    prose block, or stand alone before a table and at the end; table cells are joined by a bar, rows by
    a line; links that are only note marks after text are removed.
    """
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._close()
    out: list[tuple[str, str, str, str | None]] = []
    pending: list[dict] = []
    for b in reader.blocks:
        if b["kind"] in HEADINGS:
            pending.append(b)
        elif b["kind"] == "table":
            out += [(h["text"], "prose", h["path"], h["fragment"]) for h in pending]
            pending = []
            out.append((b["text"], "table", b["path"], b["fragment"]))
        else:
            text = "\n\n".join([*(h["text"] for h in pending), b["text"]])
            pending = []
            out.append((text, "list" if b["kind"] == "li" else "prose", b["path"], b["fragment"]))
    return out + [(h["text"], "prose", h["path"], h["fragment"]) for h in pending]


_UNITS = pa.schema([("section_id", pa.string()), ("unit_ordinal", pa.int32()), ("contents", pa.string()), ("content_kind", pa.string()), ("element_path", pa.string()), ("fragment", pa.string())])


def extracted(sections: DataFrame) -> DataFrame:
    """The units of rows ``(section_id, html)``; null ids and texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, i, *u) for s, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, u in enumerate(html_units(h))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _UNITS, strict=True)], schema=_UNITS)

    return sections.select("section_id", "html").where("section_id IS NOT NULL AND html IS NOT NULL").mapInArrow(run, "section_id string, unit_ordinal int, contents string, content_kind string, element_path string, fragment string")
