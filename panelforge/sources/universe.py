"""Index constituents: normalised tickers, merged sources, sector maps, and tables out of HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from panelforge.session import for_workers
from panelforge.sources.schemas import CONSTITUENTS, RANKED_CONSTITUENTS


def normal_ticker(c: Column) -> Column:
    """Trimmed and upper-cased; class separators - and / become a dot."""
    return F.translate(F.upper(F.trim(c)), "-/", "..")


def merge_constituents(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    """A full outer join of (ticker, company, rank, weight) with (ticker, sector, sub_industry); ``found``: both, weights or sectors."""
    a, b = (d.withColumn("ticker", normal_ticker(F.col("ticker"))).withColumn(f"_{k}", F.lit(True)) for k, d in (("a", weights), ("b", sectors)))
    found = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "weights").otherwise("sectors")
    return a.join(b, "ticker", "full_outer").withColumn("found", found).drop("_a", "_b")


def by_weight(constituents: DataFrame) -> DataFrame:
    return constituents.orderBy(F.desc_nulls_last("weight"), "ticker")


def only_in_one(merged: DataFrame) -> DataFrame:
    """ticker, found of the constituents that one source alone lists."""
    return merged.where("found != 'both'").select("ticker", "found")


def save_constituents(constituents: DataFrame, path: str) -> None:
    """Constituents as a folder of CSV with headers, by weight within the files and from each to the next; the columns that a loader knows come in its order."""
    named = [c for c in RANKED_CONSTITUENTS.names if c in constituents.columns]
    order = [F.desc_nulls_last("weight")] if "weight" in named else []
    # sorted by all tasks; an index of hundreds of rows is one file
    constituents.select(*named).orderBy(*order, "ticker").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def prepare(constituents: DataFrame, held: DataFrame, market: str = "SPY", twins: dict[str, str] | None = None) -> DataFrame:
    """ticker of the constituents whose bars are held, without the market; of a dual listing (``twins``: other class -> class to keep) the other class goes where both are held."""
    known = constituents.select("ticker").join(held.select("ticker"), "ticker", "left_semi").where(F.col("ticker") != market).distinct()
    pairs = list((twins or {}).items())
    if not pairs:
        return known
    other = known.sparkSession.createDataFrame(pairs, "ticker string, _kept string")
    gone = other.join(known.select(F.col("ticker").alias("_kept")), "_kept", "left_semi").select("ticker")
    return known.join(gone, "ticker", "left_anti")


def not_held(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of ``wanted`` whose ticker isn't held, in their order: what is still to be fetched. A null ticker is none."""
    return wanted.where("ticker is not null").join(held.select("ticker").distinct(), "ticker", "left_anti").select(*wanted.columns)


def sector_map(constituents: DataFrame, tickers: list[str] | None = None, order: str | None = None) -> DataFrame:
    """(ticker, sector) without nulls. Of a ticker's rows the last by ``order`` wins; without an order, the greatest sector."""
    known = constituents.dropna(subset=["ticker", "sector"])
    known = known if tickers is None else known.where(F.col("ticker").isin(tickers))
    return known.groupBy("ticker").agg((F.max_by("sector", F.struct(order, "sector")) if order else F.max("sector")).alias("sector"))


def load_constituents(spark: SparkSession, path: str, ranked: bool = False) -> DataFrame:
    """A CSV of constituents; company names may be quoted and hold commas."""
    return spark.read.csv(path, header=True, schema=RANKED_CONSTITUENTS if ranked else CONSTITUENTS, quote='"', escape='"')


class _Grids(HTMLParser):
    """Every table of a page as rows of cells; an unclosed cell, row or table ends where the next begins or the page does."""

    #: The most columns and rows that a cell may span, by the HTML standard: fixed values.
    COLSPAN, ROWSPAN = 1000, 65534

    def __init__(self):
        super().__init__()
        self.tables, self.open, self.silent = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.open.append({"rows": [], "cell": None, "ended": False})
            self.tables.append(self.open[-1])
        elif self.open:
            table = self.open[-1]
            if tag == "tr":
                self._close_cell(table)
                table["rows"].append([])
            elif tag in ("td", "th"):
                self._close_cell(table)
                if not table["rows"]:
                    table["rows"].append([])
                spans = {k: int(v) for k, v in attrs if k in ("rowspan", "colspan") and v and v.strip().isdigit()}
                table["cell"] = ([], spans.get("rowspan", 1), spans.get("colspan", 1))
            elif tag == "br" and table["cell"]:
                table["cell"][0].append(" ")

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] and not self.silent:
            self.open[-1]["cell"][0].append(data)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.open and tag in ("td", "th", "tr", "table"):
            self._close_cell(self.open[-1])
            if tag == "table":
                self.open.pop()["ended"] = True

    def close(self):
        super().close()
        while self.open:
            self._close_cell(self.open[-1])
            self.open.pop()["ended"] = True

    def _close_cell(self, table):
        if table["cell"]:
            text, down, across = table["cell"]
            table["rows"][-1].append((" ".join("".join(text).split()), down, min(max(across, 1), self.COLSPAN)))
            table["cell"] = None


def _lines(rows: list[list[tuple]], hanging: dict[int, tuple]) -> Iterator[list[str]]:
    """Rows of cells as rows of a grid. ``hanging`` has the cells that still span rows, column -> (text, rows left), and is kept up to date."""
    for row in rows:
        line, cells = [], iter(row)
        pending = next(cells, None)
        while pending is not None or any(c >= len(line) for c in hanging):
            at = len(line)
            if at in hanging:
                text, left = hanging.pop(at)
                line.append(text)
                if left > 1:
                    hanging[at] = (text, left - 1)
            elif pending is not None:
                text, down, across = pending
                # 0: down to the table's end
                down = inf if down == 0 else min(down, _Grids.ROWSPAN)
                for at in range(len(line), len(line) + across):
                    if at in hanging:  # two spans meet: the one from above keeps its place
                        break
                    line.append(text)
                    if down > 1:
                        hanging[at] = (text, down - 1)
                # columns that hang from this very row begin with the next one
                pending = next(cells, None)
            else:
                line.append("")
        yield line


def grids(html: str) -> list[list[list[str]]]:
    """The tables of a page, each as a grid: a cell that spans rows or columns is repeated in all of them."""
    parser = _Grids()
    parser.feed(html)
    parser.close()
    return [list(_lines(t["rows"], {})) for t in parser.tables if t["rows"]]


def _names(heading: list[str]) -> list[str]:
    names, seen = [], {}
    for name in heading:
        names.append(f"{name}.{seen[name]}" if name in seen else name)
        seen[name] = seen.get(name, 0) + 1
    return names


def headed(grid: list[list[str]]) -> list[dict[str, str]]:
    """The rows below the first one as records; a heading that is repeated gets a number, as in ``Chg`` and ``Chg.1``."""
    names = _names(grid[0])
    return [dict(zip(names, row, strict=False)) for row in grid[1:]]


#: Characters of a page that are parsed at a time, and records that are handed on at a time.
CHUNK, RECORDS = 1 << 18, 2_000


def records(html: str, must_have: str | None) -> Iterator[dict[str, str]]:
    """``headed`` of the first of a page's ``grids`` whose first row has ``must_have``, while the page is parsed.

    Rows of other tables go as soon as they are whole, unless the first table in
    question can't be told yet: one of tables that hold one another comes before what it holds.
    """
    parser, turned_down, chosen, names, hanging = _Grids(), 0, None, None, {}
    whole = lambda t: len(t["rows"]) - (not t["ended"])
    for at in range(0, len(html) + CHUNK, CHUNK):
        if at < len(html):
            parser.feed(html[at : at + CHUNK])
        else:
            parser.close()
        while chosen is None and turned_down < len(parser.tables):
            table = parser.tables[turned_down]
            if whole(table) > 0 and (must_have is None or must_have in next(_lines(table["rows"][:1], {}))):
                chosen = table
            elif whole(table) > 0 or table["ended"]:
                turned_down += 1
            else:
                break
        for k, table in enumerate(parser.tables):
            if table is chosen:
                done = table["rows"][: whole(table)]
                for line in _lines(done, hanging):
                    if names is None:
                        names = _names(line)
                    else:
                        yield dict(zip(names, line, strict=False))
            elif k >= turned_down and chosen is None:
                continue
            del table["rows"][: max(whole(table), 0)]
        if chosen is not None and chosen["ended"]:
            return


def html_tables(pages: DataFrame, html_col: str = "html", must_have: str | None = "Symbol") -> DataFrame:
    """The records of the first table of each page that has a column ``must_have`` (of the first table at all without one): the page's columns with record (map of heading to cell).

    A worker holds the texts of a batch of pages (``spark.sql.execution.arrow.maxBytesPerBatch``) and some records, whatever the tables' length.
    """
    keep = [c for c in pages.columns if c != html_col]
    schema = StructType([*(pages.schema[c] for c in keep), StructField("record", MapType(StringType(), StringType()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = records(batch[html_col][k].as_py() or "", must_have)
                while some := list(islice(found, RECORDS)):
                    row = batch.select(keep).take(pa.array([k] * len(some)))
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([list(r.items()) for r in some], pa.map_(pa.string(), pa.string()))], [*keep, "record"])

    return for_workers(pages).mapInArrow(parse, schema)


#: A table's heading -> column: fixed values.
SECTOR_HEADINGS = {"Symbol": "ticker", "GICS Sector": "sector", "GICS Sub-Industry": "sub_industry"}
COMPONENT_HEADINGS = {"Symbol": "ticker", "Name": "company", "Sector": "sector"}


def renamed(records: DataFrame, headings: dict[str, str]) -> DataFrame:
    """The columns of records by their headings, tickers normalised; a heading that isn't there gives null."""
    cells = [normal_ticker(F.col("record")[k]).alias(v) if v == "ticker" else F.col("record")[k].alias(v) for k, v in headings.items()]
    return records.select(*cells)


def parse_sectors(records: DataFrame) -> DataFrame:
    """ticker, sector, sub_industry out of records of a sector table."""
    return renamed(records, SECTOR_HEADINGS)


def parse_components(records: DataFrame) -> DataFrame:
    """ticker, company, sector out of records of an index's table of components."""
    return renamed(records, COMPONENT_HEADINGS)


def parse_weights(records: DataFrame) -> DataFrame:
    """rank, company, ticker, weight out of records of a weights table; numbers that don't parse are null."""
    cell = lambda k: F.col("record")[k]
    return records.select(
        F.expr("try_cast(record['#'] as int)").alias("rank"),
        cell("Company").alias("company"),
        normal_ticker(cell("Symbol")).alias("ticker"),
        F.expr("try_cast(rtrim('%', trim(record['Weight'])) as double)").alias("weight"),
    )
