"""Pages of query results as a Spark data source: one input partition for each page.

``register(spark)``, then ``spark.read.format("result_pages").load(FOLDER)``: columns page, file, binding_idx, country, b.
A page is a JSON document of bindings in a folder (or below it), numbered by the last number in its path.

Options: ``countries`` (codes joined by semicolons; others aren't decoded further), ``tries`` (how often a page is read
before its error counts, 3), ``wait`` (seconds before the second try, doubled for each further one, 1). With ``pushdown``
set to true, comparisons of page and country with values are applied by the source; Spark asks it only if
``spark.sql.python.filterPushdown.enabled`` is set.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.decode import COUNTRY_PREFIXES
from .files import TERM

NAME = "result_pages"
SCHEMA = f"page bigint, file string, binding_idx int, country string, b map<string, {TERM}>"
_PARTS = ("type", "datatype", "xml:lang", "value")
_TERM = pa.struct([(p, pa.string()) for p in _PARTS])
_ARROW = pa.schema([("page", pa.int64()), ("file", pa.string()), ("binding_idx", pa.int32()), ("country", pa.string()), ("b", pa.map_(pa.string(), _TERM))])
#: bindings of one Arrow batch
BATCH = 2000


class Page(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


def page_number(path: str) -> int:
    numbers = re.findall("[0-9]+", path)
    return int(numbers[-1]) if numbers else 0


def tried(read: Callable[[], bytes], tries: int, wait: float) -> bytes:
    """What ``read`` gives, after as many tries as needed and allowed."""
    for left in range(tries - 1, -1, -1):
        try:
            return read()
        except OSError:
            if not left:
                raise
            time.sleep(wait)
            wait *= 2
    raise ValueError("tries must be 1 or more")


def country_of(binding: dict) -> str | None:
    uri = binding.get("country", {}).get("value") or ""
    return next((uri[len(p) :] for p in COUNTRY_PREFIXES if uri.startswith(p)), None)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, at.rstrip("/")


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 1))
        chosen = options.get("countries")
        self.countries = None if not chosen else set(chosen.split(";"))
        self.pages: set[int] | None = None

    def partitions(self) -> list[Page]:
        system, at = opened(self.path)
        found = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
        # the number counts from below the folder: a page is part of its own path only
        pages = sorted(((self._number(p, at), p) for p in found))
        return [Page(n, p) for n, p in pages if self.pages is None or n in self.pages]

    @staticmethod
    def _number(path: str, folder: str) -> int:
        inner = path[len(folder) + 1 :]
        # a partitioned folder (page=7/part-0000.txt) names the page, else the file does
        named = re.search("page=([0-9]+)/", inner)
        return int(named[1]) if named else page_number(inner)

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)

        def load() -> bytes:
            with system.open_input_stream(partition.path) as stream:
                return stream.read()

        # a text file may hold several documents, one on each line
        text = tried(load, self.tries, self.wait).decode()
        decoder, at, number = json.JSONDecoder(), 0, 0
        rows: list[tuple] = []
        while at < len(text):
            document, at = decoder.raw_decode(text, at)
            while at < len(text) and text[at].isspace():
                at += 1
            for binding in document["results"]["bindings"]:
                country = country_of(binding)
                if self.countries is None or country in self.countries:
                    b = [(name, {p: term.get(p) for p in _PARTS}) for name, term in binding.items()]
                    rows.append((partition.number, partition.path, number, country, b))
                number += 1
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class PushedReader(PagesReader):
    """Takes equality and membership of page and country itself and leaves other filters to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("page",), ("country",)):
                yield f
            elif f.attribute == ("page",):
                self.pages = values if self.pages is None else self.pages & values
            else:
                self.countries = values if self.countries is None else self.countries & values


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PushedReader if options.get("pushdown", "").lower() == "true" else PagesReader)(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)


def read_pages(spark: SparkSession, folder: str, countries: list[str] | None = None) -> DataFrame:
    """Bindings of all pages below a folder, or those of the countries."""
    register(spark)
    reader = spark.read.format(NAME)
    return (reader if countries is None else reader.option("countries", ";".join(countries))).load(folder)
