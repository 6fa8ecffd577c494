"""The few functions that Spark's own cannot express (U-01 to U-03): Arrow batches, no shared state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from waystone.functions.text import COMPATIBILITY, clean


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(rows: DataFrame, column: str) -> DataFrame:
    """U-01: the column normalised. Only rows with compatibility characters that translate() cannot fold go to Python."""
    odd = F.coalesce(F.rlike(F.col(column), F.lit(COMPATIBILITY)), F.lit(False))
    plain = rows.filter(~odd).withColumn(column, clean(F.col(column)))
    return plain.unionByName(rows.filter(odd).withColumn(column, clean(_nfkc(column))))


#: Rows that a task of U-02 holds before it hands them on, but for those of one page more.
MOST_ROWS = 5000
TOKENS = "page_id bigint, pos int, kind string, tag string, text string, href string"


def html_tokens(pages: DataFrame) -> DataFrame:
    """U-02: (page_id, pos, kind, tag, text, href) rows of HTML: starts of elements and their texts, in order.

    Null and empty pages give no rows; malformed HTML is read as far as the parser goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def __init__(self) -> None:
                super().__init__(convert_charrefs=True)
                self.rows, self.open = [], []

            def handle_starttag(self, tag, attrs):
                self.rows.append(("start", tag, None, dict(attrs).get("href")))
                self.open.append(tag)

            def handle_endtag(self, tag):
                if tag in self.open:
                    while self.open.pop() != tag:
                        pass

            def handle_data(self, data):
                text = " ".join(data.split())
                if text and not {"script", "style"} & set(self.open):
                    self.rows.append(("text", self.open[-1] if self.open else None, text, None))

        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

        def packed(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "pos", "kind", "tag", "text", "href"])

        out = []
        for batch in batches:
            for page, html in zip(batch.column("page_id"), batch.column("html"), strict=True):
                reader = Reader()
                reader.feed(html.as_py() or "")
                out += [(page.as_py(), i, *r) for i, r in enumerate(reader.rows)]
                if len(out) >= MOST_ROWS:
                    yield packed(out)
                    out = []
        yield packed(out)

    return pages.select("page_id", "html").mapInArrow(run, TOKENS)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def ratcliff(a: Column, b: Column) -> Column:
    """U-03: the Ratcliff-Obershelp ratio; to be used after blocking."""
    return _ratio(a, b)
