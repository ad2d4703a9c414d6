"""Web pages to element rows.

One page stays one row: its nodes form an array in document order. A subtree is then a contiguous slice,
so every page-local question (selectors, cards, text) is a narrow expression without a shuffle. Reading a page takes time and
memory in proportion to its nodes, however deep they nest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from listing_lake.operators.nodes import FIXED_SELECTORS, HIDDEN_CLASS_HINTS, MAX_CARD_DEPTH
from listing_lake.operators.selectors import compiled, parse

# `near`: the closest ancestors, nearest first. `veil`: the closest hidden element around or at the node, else -1. `hits`: the
# selectors that pick the node, see `selectors`.
NODES = (
    "array<struct<id:int,parent:int,last:int,depth:int,tag:string,attrs:map<string,string>,"
    "text:string,link:string,near:array<int>,veil:int,hits:array<struct<css:string,at:array<int>>>>>"
)
_VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
))
# Text inside these is code, not content.
_CODE = frozenset(("script", "style", "template"))
# A batch of pages closes at either bound.
BATCH_ROWS, BATCH_BYTES = 64, 4 << 20


def hides(attrs: dict[str, str]) -> bool:
    """Whether an element's class or style hides what it holds."""
    classes, style = attrs.get("class", "").lower(), attrs.get("style", "").lower().replace(" ", "")
    return "display:none" in style or any(hint in classes for hint in HIDDEN_CLASS_HINTS)


class _Nodes(HTMLParser):
    """Numbers elements and text runs in document order."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.rows, self.open, self.run = base, [], [], []
        self.names: Counter = Counter()

    def _add(self, tag: str, attrs: dict, text: str | None, link: str | None) -> dict:
        up, at = self.open[-1] if self.open else None, len(self.rows)
        veil = at if text is None and hides(attrs) else up["veil"] if up else -1
        row = {
            "id": at, "parent": up["id"] if up else None, "last": at, "depth": len(self.open), "tag": tag, "attrs": attrs,
            "text": text, "link": link, "near": [r["id"] for r in reversed(self.open[-MAX_CARD_DEPTH:])], "veil": veil, "hits": None,
        }
        self.rows.append(row)
        return row

    def _flush(self) -> None:
        text = "".join(self.run).strip()
        self.run = []
        if text:
            code = bool(self.open) and self.open[-1]["tag"] in _CODE
            self._add("#code" if code else "#text", {}, text, None)

    def handle_data(self, data: str) -> None:
        self.run.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    handle_decl = unknown_decl = handle_pi = handle_comment

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        values = {name: value or "" for name, value in attrs}
        href = values.get("href")
        try:
            link = urljoin(self.base, href.strip()) if href else None
        except ValueError:
            link = None
        row = self._add(tag, values, None, link)
        if tag not in _VOID:
            self.open.append(row)
            self.names[tag] += 1

    def _close(self) -> str:
        row = self.open.pop()
        row["last"] = len(self.rows) - 1
        self.names[row["tag"]] -= 1
        return row["tag"]

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if self.names[tag]:
            while self._close() != tag:
                pass

    def finish(self) -> list[dict]:
        self.close()
        self._flush()
        while self.open:
            self._close()
        return self.rows


def _page_nodes(html: str | None, base: str | None, parts: tuple[str, ...]) -> list[dict]:
    parser = _Nodes(base or "")
    parser.feed(html or "")
    rows = parser.finish()
    if parts:
        compiled(parts).match(rows)
    for row in rows:
        row["attrs"] = list(row["attrs"].items())
    return rows


def _asked(pages: DataFrame, fixed: Sequence[str]) -> Column:
    """The alternatives of all selectors a page may be asked about: those of its source and the fixed ones."""
    known = F.array(*[F.lit(row["css"]) for css in fixed for row in parse(css)]).cast("array<string>")
    if "src" not in pages.columns or not isinstance(pages.schema["src"].dataType, StructType):
        return known
    none, lists = F.array().cast("array<string>"), [known]
    css = lambda sel: F.coalesce(F.transform(sel, lambda alt: alt["css"]), none)
    for option in pages.schema["src"].dataType.fields:
        if not isinstance(option.dataType, ArrayType) or not isinstance(option.dataType.elementType, StructType):
            continue
        names = option.dataType.elementType.names
        if "css" in names:
            lists.append(css(F.col("src")[option.name]))
        elif "sel" in names:
            lists.append(F.coalesce(F.flatten(F.transform(F.col("src")[option.name], lambda rule: css(rule["sel"]))), none))
    return F.array_sort(F.array_distinct(F.concat(*lists)))


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of pages within the batch bounds; a larger page is alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > BATCH_BYTES or i - start == BATCH_ROWS):
            yield start, i - start
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def shred_pages(
    pages: DataFrame, html: str = "html", url: str = "url", keep_html: bool = False, selectors: Sequence[str] = (),
) -> DataFrame:
    """Adds `nodes` to every page row and drops the raw text.

    Selectors are matched while a page is read: those of its source struct `src`, the library's own, and `selectors`. Others pick
    nothing afterwards.
    """
    kept = [c for c in pages.columns if keep_html or c != html]
    fields = [pages.schema[c] for c in kept]
    nodes = StructType.fromDDL(f"nodes {NODES}").fields[0]
    schema = StructType(fields + [StructField("nodes", nodes.dataType)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = [len(h or "") for h in whole.column(html).to_pylist()]
            for start, n in _slices(sizes):
                batch = whole.slice(start, n)
                rows = zip(*[batch.column(c).to_pylist() for c in (html, url, "_asked")])
                shredded = pa.array([_page_nodes(h, u, tuple(a)) for h, u, a in rows], type=arrow.field("nodes").type)
                columns = [batch.column(c).cast(arrow.field(c).type) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, shredded], schema=arrow)

    asked = _asked(pages, [*FIXED_SELECTORS, *selectors])
    return pages.withColumn("_asked", asked).mapInArrow(run, schema)


def elements(shredded: DataFrame) -> DataFrame:
    """Long form: one row per element or text run of a page."""
    others = [c for c in shredded.columns if c != "nodes"]
    return shredded.select(*others, F.explode("nodes").alias("_n")).select(
        *others, F.col("_n.id").alias("node_id"), F.col("_n.parent").alias("parent_id"),
        F.col("_n.last").alias("last_id"), F.col("_n.depth").alias("depth"), F.col("_n.id").alias("pos"),
        F.col("_n.tag").alias("tag"), F.col("_n.attrs").alias("attrs"), F.col("_n.text").alias("text"),
    )
