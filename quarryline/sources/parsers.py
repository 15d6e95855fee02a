"""Parsers of binary files by name, run where the file's bytes are.

A parser is a function from (path, bytes, first page, end page) to text. Documents of many
pages are parsed range by range, each range a row of its own, and joined in order.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.sources.files import PLAIN, mime_type, page_ranges, parse_route, suffix


class Registry:
    """Makers by name, letter case and spaces aside; an unknown name is an error. A shared one is made once a process."""

    def __init__(self, kind: str):
        self.kind, self.makers, self.made = kind, {}, {}

    @staticmethod
    def _name(name: str) -> str:
        return name.strip().lower().replace(" ", "_")

    def register(self, name: str, maker: Callable, shared: bool = False) -> None:
        self.makers[self._name(name)] = (maker, shared)
        self.made.pop(self._name(name), None)

    def make(self, name: str, **options):
        """What the maker gives for the options that are not None."""
        name = self._name(name)
        if name not in self.makers:
            raise ValueError(f"unknown {self.kind}: {name}")
        maker, shared = self.makers[name]
        options = {k: v for k, v in options.items() if v is not None}
        if not shared:
            return maker(**options)
        key = (name, tuple(sorted(options.items())))
        if key not in self.made:
            self.made[key] = maker(**options)
        return self.made[key]


PARSERS = Registry("parser")


def plain_text(path: str, content: bytes, first: int, end: int) -> str:
    """Form feeds part pages."""
    pages = content.decode("utf-8", "replace").split("\f")
    return "\f".join(pages[first:end])


def count_pages(content: bytes) -> int:
    return content.count(b"\f") + 1


def html_text(path: str, content: bytes, first: int, end: int) -> str:
    """Headings, blocks and tables of a page in order; a page is one page of its file."""
    from quarryline.operators.parsing import parse_html

    return "\n\n".join(n["text"] for n in parse_html(content.decode("utf-8", "replace"))) if first == 0 else ""


PARSERS.register("plain", lambda: plain_text, shared=True)
PARSERS.register("html", lambda: html_text, shared=True)
#: Which parser takes a kind of file; a kind without one is set apart. Others are added by ``PARSERS.register`` and here.
ROUTES = {"text": "plain", "html": "html"}


def with_mime(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with their MIME type; one without is set apart as ``route`` 'quarantine', not sent to a parser."""
    kind = mime_type(F.col(path))
    return files.withColumns({"mime_type": kind, "route": F.when(kind.isNull(), "quarantine").otherwise(parse_route(F.col(path)))})


def page_work(files: DataFrame, pages: Column, most: int = 20) -> DataFrame:
    """One row for each page range of each file: the columns given, with first and end."""
    ranges = files.withColumn("__ql_range", F.explode(page_ranges(pages, most)))
    return ranges.withColumns({"first": F.col("__ql_range")["first"], "end": F.col("__ql_range")["end"]}).drop("__ql_range")


def parse_files(files: DataFrame, parser: str = "plain", *, pages: Column | None = None, most: int = 20, **options) -> DataFrame:
    """(path, text, error) of binary files (path, content): page ranges parsed apart, joined in order, a line feed after each.

    Ranges are made where the file's bytes are, so these are not copied. A range that fails leaves its message in
    ``error`` and no text; it doesn't fail the job.
    """
    call = PARSERS.make(parser, **options)
    work = files.select("path", "content", (F.lit(None) if pages is None else pages).cast("int").alias("pages"))

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content, known in zip(pdf["path"], pdf["content"], pdf["pages"], strict=True):
                content = bytes(content)
                for first in range(0, count_pages(content) if pd.isna(known) else int(known), most):
                    try:
                        rows.append((path, first, call(path, content, first, min(first + most, int(known) if not pd.isna(known) else first + most)) + "\n", None))
                    except Exception as e:
                        rows.append((path, first, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "first", "text", "error"])

    parts = work.mapInPandas(run, "path string, first int, text string, error string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return parts.groupBy("path").agg(F.array_join(ordered, "").alias("text"), F.max("error").alias("error"))


def parse_by_type(files: DataFrame, **how) -> DataFrame:
    """(path, text, error): each file by the parser of its kind; one whose kind has no parser is set apart with an error and no text."""
    kind = F.when(mime_type(F.col("path")).startswith("text/") & (parse_route(F.col("path")) != "html"), "text").otherwise(parse_route(F.col("path")))
    routed = files.withColumn("__ql_kind", F.when(suffix(F.col("path")).isin(*PLAIN), "text").otherwise(kind))
    out = routed.where(~F.col("__ql_kind").isin(*ROUTES)).select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("quarantined: no parser for "), F.coalesce(F.nullif(suffix(F.col("path")), F.lit("")), F.lit("a file without extension"))).alias("error"))
    for name, parser in ROUTES.items():
        out = out.unionByName(parse_files(routed.where(F.col("__ql_kind") == name), parser, **how))
    return out


def file_status(parsed: DataFrame) -> DataFrame:
    """(path, ok, error) of each file of a batch."""
    return parsed.select("path", F.col("error").isNull().alias("ok"), "error")
