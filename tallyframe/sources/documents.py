"""Documents that no Spark reader knows: text rows of HTML pages, facts of tagged accounts, verdicts in model answers.

These are Arrow functions over standard-library parsers; each document is parsed by itself.
"""

from __future__ import annotations

import ast
import datetime as dt
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..session import ship

ROW_TAGS = ("tr", "p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6")
FACT_SCHEMA = "doc_id string, name string, value double, shown string, scale int, unit string, instant date, startdate date, enddate date, members array<string>"
_TOP = re.compile(r"(?:^|;)\s*top\s*:\s*([^;]+)")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """A page as a list of elements, each with its tag, its parent's place in the list and its height, and the pieces of visible text with the element that each is in."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.height = [""], [0], [None]
        self.pieces: list[tuple[int, str]] = []
        self.at = 0
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            found = _TOP.search(dict(attrs).get("style") or "")
            self.tag.append(tag)
            self.parent.append(self.at)
            self.height.append(found and found[1].strip())
            self.at = len(self.tag) - 1

    def handle_endtag(self, tag):
        ended = next((k for k in self.upward(self.at) if self.tag[k] == tag), None)
        if ended is not None:
            self.at = self.parent[ended]

    def handle_data(self, data):
        if not any(self.tag[k] in ("script", "style") for k in self.upward(self.at)):
            self.pieces.append((self.at, data))

    def upward(self, k: int) -> Iterator[int]:
        """An element and what it lies in, the page itself left out."""
        while k:
            yield k
            k = self.parent[k]

    def owner(self, k: int) -> int | None:
        """The row that an element's text belongs to: the nearest table row, else the nearest block."""
        blocks = [j for j in self.upward(k) if self.tag[j] in ROW_TAGS]
        return next((j for j in blocks if self.tag[j] == "tr"), blocks[0] if blocks else None)

    def rows(self) -> list[str]:
        """A table row without a further one in it, or a block outside table rows without a further block, is a row; neighbours in one element at one height are one."""
        own = [k for k in range(1, len(self.tag)) if self.tag[k] in ROW_TAGS]
        outer = {j for k in own for j in self.upward(self.parent[k]) if self.tag[j] != "tr" or self.tag[k] == "tr"}
        texts: dict[int, list[str]] = {k: [] for k in own if k not in outer and self.owner(k) == k}
        for k, piece in self.pieces:
            texts.get(self.owner(k), []).append(piece)
        line = lambda k: (self.parent[k], self.height[k]) if self.height[k] else k
        words = [" ".join(" ".join(t for k in same for t in texts[k]).split()) for _, same in groupby(texts, key=line)]
        return [w for w in words if w]


def rows_of_html(text: str | None) -> list[str]:
    """Visible rows of a page in order; a null page has none."""
    return _Page(text or "").rows()


@F.pandas_udf(ArrayType(StringType()))
def _text_rows(pages: pd.Series) -> pd.Series:
    return pages.map(rows_of_html)


def text_rows(df: DataFrame, html_col: str, out: str = "rows") -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn(out, _text_rows(F.col(html_col)))


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def _day(text: str | None) -> dt.date | None:
    try:
        return dt.date.fromisoformat((text or "").strip()[:10])
    except ValueError:
        return None


def _contexts(root) -> dict[str, dict]:
    out = {}
    for c in root.iter():
        if isinstance(c.tag, str) and _local(c.tag) == "context":
            period = {_local(e.tag): e.text for e in c.iter() if isinstance(e.tag, str) and _local(e.tag) in ("instant", "startDate", "endDate")}
            members = [_local((e.text or "").strip()) for e in c.iter() if isinstance(e.tag, str) and _local(e.tag) == "explicitMember"]
            out[c.get("id", "")] = {"instant": _day(period.get("instant")), "startdate": _day(period.get("startDate")), "enddate": _day(period.get("endDate")), "members": members}
    return out


def number_of(shown: str, scale: int = 0, negative: bool = False) -> float | None:
    """Displayed number times its scale; brackets or a sign make it negative, a lone dash is zero."""
    t = re.sub(r"[\s,£$€]", "", shown)
    if t in ("-", "–", "—"):
        return 0.0
    bracketed = t.startswith("(") and t.endswith(")")
    try:
        value = float(t.strip("()")) * 10.0**scale
    except ValueError:
        return None
    return -value if bracketed or negative else value


def facts_of_document(raw: bytes) -> list[tuple]:
    """(name, value, shown, scale, unit, instant, start, end, members) of each numeric fact; a document that isn't well-formed has none."""
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return []
    contexts = _contexts(root)
    out = []
    for e in root.iter():
        if isinstance(e.tag, str) and _local(e.tag) == "nonFraction":
            shown = "".join(e.itertext()).strip()
            scale = int(e.get("scale") or 0)
            c = contexts.get(e.get("contextRef", ""), {"instant": None, "startdate": None, "enddate": None, "members": []})
            out.append((_local(e.get("name", "")), number_of(shown, scale, e.get("sign") == "-"), shown, scale, e.get("unitRef"), c["instant"], c["startdate"], c["enddate"], c["members"]))
    return out


def tagged_facts(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """Fact rows of a binaryFile frame, as `operators.facts` takes them."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in FACT_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, raw in zip(batch[id_col], batch[content_col]):
                rows = [(str(key), *f) for f in facts_of_document(bytes(raw))] if raw is not None else []
                for k in range(0, len(rows), 4096):
                    yield pd.DataFrame(rows[k : k + 4096], columns=names)

    return files.select(id_col, content_col).mapInPandas(parse, FACT_SCHEMA)


def _objects(text: str) -> Iterator[object]:
    """JSON values that begin at a brace, from left to right, none inside another; then a Python literal that runs to the end."""
    decoder, at = json.JSONDecoder(), 0
    while (at := text.find("{", at)) >= 0:
        try:
            value, at = decoder.raw_decode(text, at)
            yield value
        except ValueError:
            at += 1
    tail = text.rstrip()
    if tail.endswith("}"):
        for m in re.finditer(r"\{", tail):
            try:
                yield ast.literal_eval(tail[m.start() :])
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue


def salvaged_answer(text: str | None) -> str | None:
    """The first object with a verdict in a model's answer, as JSON; null if there is none."""
    found = next((o for o in _objects(text or "") if isinstance(o, dict) and "verdict" in o), None)
    return None if found is None else json.dumps(found, sort_keys=True, default=str)


@F.pandas_udf(StringType())
def _salvaged(texts: pd.Series) -> pd.Series:
    return texts.map(salvaged_answer)


def salvaged(df: DataFrame, text_col: str, out: str = "answer") -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn(out, _salvaged(F.col(text_col)))
