"""A Python data source over stored answers of scholarly search services.

``spark.read.format("search_payloads").load(dir)`` reads ``<source>/*.json``, one
answer a file, as hits. Each file is a partition; an equality filter on source
prunes files before any is opened."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "query_id string, source string, rank0 int, doi string, title string, year int, authors array<string>, first_author_family string, cited_by_count int, publication_type string"


class _File(InputPartition):
    def __init__(self, source: str, path: str):
        super().__init__(path)
        self.source, self.path = source, path


def _person(family: str, given: str) -> str:
    initials = " ".join(f"{w[0].upper()}." for w in given.replace("-", " ").split() if w)
    return f"{family}, {initials}".strip(", ") if initials else family


def _works(item: dict) -> tuple:
    """A record of a works service: title and authors in parts, dates nested."""
    dates = [((item.get(k) or {}).get("date-parts") or [[None]])[0] for k in ("issued", "published-print", "published-online", "created")]
    year = next((d[0] for d in dates if d and isinstance(d[0], int)), None)
    people = [(a.get("family") or a.get("name") or "", a.get("given") or "") for a in item.get("author") or []]
    title = (item.get("title") or [""])[0] if isinstance(item.get("title"), list) else item.get("title") or ""
    return item.get("DOI") or "", title, year, [_person(*p) for p in people if p[0]], people[0][0] if people else "", item.get("is-referenced-by-count"), item.get("type")


def _papers(item: dict) -> tuple:
    """A record of a papers service: names in one string."""
    names = [a.get("name") or "" for a in item.get("authors") or []]
    split = [(n.split()[-1], " ".join(n.split()[:-1])) for n in names if n.split()]
    return (item.get("externalIds") or {}).get("DOI") or "", item.get("title") or "", item.get("year"), [_person(*p) for p in split], split[0][0] if split else "", item.get("citationCount"), (item.get("publicationTypes") or [None])[0]


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.only = root, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = []
        for source in sorted(os.listdir(self.root)):
            if self.only in (None, source) and os.path.isdir(f"{self.root}/{source}"):
                found += [_File(source, f"{self.root}/{source}/{n}") for n in sorted(os.listdir(f"{self.root}/{source}")) if n.endswith(".json")]
        return found or [_File("", "")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        query = os.path.basename(partition.path)[:-5]
        try:
            with open(partition.path, encoding="utf-8") as f:
                answer = json.load(f)
        except (OSError, ValueError):
            return  # a source that failed gives no hits
        works = (answer.get("message") or {}).get("items")
        items = works if works is not None else answer.get("data") or []
        for rank, item in enumerate(items):
            doi, title, year, authors, family, cited, kind = (_works if works is not None else _papers)(item)
            yield query, partition.source, rank, doi.lower(), title, year, authors, family, cited, kind


class SearchPayloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchPayloads)
