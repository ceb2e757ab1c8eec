"""A source of parsed pages that several tasks read: ``spark.read.format("pages").load(folder)``.

A ``.pages`` file is one document: a first line of JSON with ``doc_id`` and ``pages``, the [offset, length] of each page's JSON
counted from the end of that line, then the pages. A page is a list of blocks: ``kind`` (text, table, image), ``box`` (x0, y0, x1, y1), ``lines``
(spans of each line) of a text block, ``header`` and ``rows`` of a table. A document of ``split_from`` pages or more is read in tasks of ``task_pages``
pages (20 and 5 by default), each of which reads its own bytes alone.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages of a task, and of a document that is worth splitting.
TASK_PAGES, SPLIT_FROM = 5, 20
SCHEMA = "doc_id long, page int, block_no int, kind string, x0 double, y0 double, x1 double, y1 double, lines array<array<string>>, header array<string>, rows array<array<string>>"


def page_file(doc_id: int, pages: list[list[dict]]) -> bytes:
    """A document in the format above."""
    bodies, places, at = [json.dumps(p).encode() for p in pages], [], 0
    for b in bodies:
        places.append([at, len(b)])
        at += len(b)
    return json.dumps({"doc_id": doc_id, "pages": places}).encode() + b"\n" + b"".join(bodies)


@dataclass
class PageRange(InputPartition):
    """Pages ``first`` to ``last`` of a file, and where their bytes are."""

    path: str
    doc_id: int
    first: int
    places: list[list[int]]


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size, self.split = int(options.get("task_pages", TASK_PAGES)), int(options.get("split_from", SPLIT_FROM))

    def partitions(self) -> list[PageRange]:
        """Only first lines are read here."""
        out = []
        for path in sorted(glob.glob(os.path.join(self.path, "*.pages"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path)):
            with open(path, "rb") as f:
                head = f.readline()
            told, start = json.loads(head), len(head)
            places = [[start + at, n] for at, n in told["pages"]]
            size = self.size if len(places) >= self.split else max(1, len(places))
            out += [PageRange(path, told["doc_id"], i + 1, places[i : i + size]) for i in range(0, len(places), size)]
        return out

    def read(self, partition: PageRange) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for page, (at, n) in enumerate(partition.places, partition.first):
                f.seek(at)
                for no, b in enumerate(json.loads(f.read(n))):
                    x = [float(v) for v in b.get("box", (0, 0, 0, 0))]
                    yield (partition.doc_id, page, no, b.get("kind", "text"), *x, b.get("lines"), b.get("header"), b.get("rows"))


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))
