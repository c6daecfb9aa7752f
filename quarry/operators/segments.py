"""Chunking: fixed windows, structure-aware ranges, block parsers."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.identity import digest
from quarry.functions.text import cut, words


def _starts(n: Column, size: int, overlap: int) -> Column:
    """Window starts from 0; the last window is the first that reaches the end."""
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / float(step))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def word_windows(docs: DataFrame, size: int = 24, overlap: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(seg, n, word_start, word_end, text) for each window."""
    rows = docs.select(F.col(key).alias("seg"), words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    rows = rows.select("seg", "w", F.posexplode(_starts(F.size("w"), size, overlap)).alias("n", "a"))
    end = F.least(F.col("a") + size, F.size("w"))
    return rows.select("seg", "n", F.col("a").alias("word_start"), end.alias("word_end"), F.array_join(F.slice("w", F.col("a") + 1, size), " ").alias("text"))


def char_windows(docs: DataFrame, size: int = 128, overlap: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(key).alias("seg"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("seg", "t", F.posexplode(_starts(F.length("t"), size, overlap)).alias("n", "a"))
    return rows.select("seg", "n", F.col("a").alias("start"), F.least(F.col("a") + size, F.length("t")).alias("end"), F.substring("t", F.col("a") + 1, F.lit(size)).alias("text"))


def chunk_ids(chunks: DataFrame, mode: str) -> DataFrame:
    """A deterministic id for each window of a mode."""
    a, b = ("word_start", "word_end") if "word_start" in chunks.columns else ("start", "end")
    return chunks.withColumn("chunk_id", digest(F.col("seg"), F.lit(mode), F.col(a), F.col(b), F.col("text")))


MODES = {"char128": (char_windows, 128, 0), "word24": (word_windows, 24, 0), "word24-o8": (word_windows, 24, 8), "word48": (word_windows, 48, 0), "word96": (word_windows, 96, 0)}


def chunks(docs: DataFrame, mode: str, **names) -> DataFrame:
    make, size, overlap = MODES[mode]
    return chunk_ids(make(docs, size, overlap, **names), mode)


def structure_ranges(blocks: DataFrame, size: int = 48) -> DataFrame:
    """Greedy ranges over ordered blocks (seg, n, kind, text).

    A heading opens a range, code and table rows stand alone, prose joins the open range
    while the words fit; prose of more words than a range holds is cut by word windows
    of its own.  The fold runs inside each segment.
    """
    rows = blocks.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("n", "kind", F.size(words(F.col("text"))).alias("w"), "text"))).alias("b"))
    kind = "array<struct<first:int,last:int,w:int,alone:boolean>>"
    start = F.array().cast(kind)

    def step(ranges: Column, b: Column) -> Column:
        alone = b["kind"].isin("code", "table_row") | (b["w"] > size)
        last = F.try_element_at(ranges, F.lit(-1))
        fresh = last.isNull() | alone | (b["kind"] == "heading") | last["alone"] | (last["w"] + b["w"] > size)
        new = F.struct(b["n"].cast("int").alias("first"), b["n"].cast("int").alias("last"), b["w"].alias("w"), alone.alias("alone"))
        grown = F.struct(last["first"].alias("first"), b["n"].cast("int").alias("last"), (last["w"] + b["w"]).alias("w"), F.lit(False).alias("alone"))
        return F.when(fresh, F.concat(ranges, F.array(new))).otherwise(F.concat(F.slice(ranges, 1, F.greatest(F.size(ranges) - 1, F.lit(0))), F.array(grown)))

    out = rows.select("seg", "b", F.posexplode(F.aggregate("b", start, step)).alias("k", "r"))
    inside = F.filter("b", lambda x: x["n"].between(F.col("r.first"), F.col("r.last")))
    return out.select("seg", "k", "r.first", "r.last", F.col("r.w").alias("n_words"), F.array_join(F.transform(inside, lambda x: x["text"]), "\n\n").alias("text"))


class _Blocks(HTMLParser):
    """Headings, paragraphs, code and table rows of a page; hidden regions are left out."""

    HIDDEN = ("script", "style", "nav", "footer", "aside", "template", "noscript", "head")
    KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "p": "prose", "li": "prose", "pre": "code", "blockquote": "prose"}

    VOID = ("br", "img", "meta", "link", "input", "hr", "wbr", "source", "area", "base", "embed", "param", "track", "col")

    def __init__(self, strict: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.strict = strict
        self.out: list[tuple[str, str]] = []
        self.open: list[tuple[str, bool]] = []  # element, and whether it is in a hidden region
        self.kind, self.parts = None, []
        self.cells: list[tuple[str, str]] | None = None
        self.headers: list[str] = []

    def _refuse(self, why: str) -> None:
        if self.strict:
            raise ValueError(why)

    def _hidden(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        out = self._hidden() or tag in self.HIDDEN or "hidden" in given or given.get("aria-hidden") == "true"
        if tag in self.VOID:
            if tag == "br" and not out:
                self.handle_data("\n")
            return
        self.open.append((tag, out))
        if out:
            return
        if tag in self.KINDS and self.cells is None:
            if self.kind in ("heading", "prose", "code"):
                self._refuse("a block within a block")
            self._close()
            self.kind = self.KINDS[tag]
        elif tag == "tr":
            self._close()
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            if (given.get("rowspan") or "1", given.get("colspan") or "1") != ("1", "1"):
                self._refuse("a cell over several rows or columns")
            self.cells.append((tag, ""))

    def handle_data(self, data: str) -> None:
        if self._hidden():
            return
        if self.cells:
            tag, text = self.cells[-1]
            self.cells[-1] = (tag, text + data)
        elif self.kind:
            self.parts.append(data)
        elif data.strip() and self.cells is None:  # text in no block is a block of its own
            self._refuse("text outside of all blocks")
            self.kind = "loose"
            self.parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.VOID:
            return
        if not self.open or self.open[-1][0] != tag:
            self._refuse("an end tag that closes nothing")
        if tag not in (t for t, _ in self.open):
            return
        while True:  # elements that were left open end here as well
            name, out = self.open.pop()
            if not out:
                self._ended(name)
            if name == tag:
                return

    def _ended(self, tag: str) -> None:
        if tag in self.KINDS and self.cells is None:
            self._close()
        elif tag == "tr" and self.cells is not None:
            texts = [" ".join(t.split()) for _, t in self.cells]
            if self.cells and all(k == "th" for k, _ in self.cells):
                self.headers = texts
                self.out.append(("table_header", " | ".join(texts)))
            elif texts:
                fits = len(self.headers) == len(texts)
                if not fits:
                    self._refuse("cells without headers of their own")
                named = self.headers if fits else [""] * len(texts)
                self.out.append(("table_row", "; ".join(f"{h}={t}" if h else t for h, t in zip(named, texts))))
            else:
                self._refuse("an empty row")
            self.cells = None
        elif tag == "table":
            self.headers = []

    def _close(self) -> None:
        text = "".join(self.parts)
        text = text.strip("\n") if self.kind == "code" else " ".join(text.split())
        if self.kind and text:
            self.out.append(("prose" if self.kind == "loose" else self.kind, text))
        self.kind, self.parts = None, []

    def finish(self) -> list[tuple[str, str]]:
        self.close()
        self._close()
        return self.out


def parse_html(page: str | None, strict: bool = False) -> list[tuple[str, str]]:
    """Blocks (kind, text) of a page; strict refuses what has no clear place, else it is kept as prose."""
    parser = _Blocks(strict)
    parser.feed(page or "")
    return parser.finish()


def parse_markdown(text: str | None, strict: bool = False) -> list[tuple[str, str]]:
    """Headings (one to six signs and a space), fenced code and paragraphs; strict refuses a fence that is left open."""
    out, held, fence = [], [], None

    def paragraph() -> None:
        if held:
            out.append(("prose", " ".join(" ".join(held).split())))
            held.clear()

    for line in (text or "").split("\n"):
        if fence is not None:
            if line.strip().startswith(fence):
                out.append(("code", "\n".join(held)))
                fence = None
                held.clear()
            else:
                held.append(line)
            continue
        signs = len(line) - len(line.lstrip("#"))
        heading = 1 <= signs <= 6 and line[signs : signs + 1] == " "
        opens = line.strip()[:3] in ("```", "~~~")
        if heading or opens or not line.strip():
            paragraph()
            if opens:
                fence = line.strip()[:3]
            elif heading:
                out.append(("heading", line[signs:].strip()))
        else:
            held.append(line)
    if fence is not None:
        if strict:
            raise ValueError("a fence is left open")
        out.append(("code", "\n".join(held)))
        held.clear()
    paragraph()
    return out


def blocks(pages: DataFrame, key: str, text: str, parser: str = "html") -> DataFrame:
    """(seg, n, kind, text, start, end): blocks with half-open places in the joined body."""
    parse = parse_html if parser == "html" else parse_markdown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in cut(batch, "page"):
                rows = []
                for seg, page in zip(b["seg"].to_pylist(), b["page"].to_pylist()):
                    at = 0
                    for n, (kind, body) in enumerate(parse(page)):
                        rows.append((seg, n, kind, body, at, at + len(body)))
                        at += len(body) + 2  # blocks are joined by an empty line
                columns = zip(*rows) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["seg", "n", "kind", "text", "start", "end"])

    return pages.select(F.col(key).cast("long").alias("seg"), F.col(text).alias("page")).mapInArrow(run, "seg long, n int, kind string, text string, start long, end long")


def locate(blocks_: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks that a span (seg, a, z) overlaps: an equi-join on the segment, then the overlap."""
    return spans.join(blocks_, "seg").filter(F.greatest("a", "start") < F.least("z", "end"))
