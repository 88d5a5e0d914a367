"""HTML pages as files, one for each set: a data source that is written, and appears whole or not at all."""

from __future__ import annotations

import html as escape
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from abridge.sources.word2vec import open_store

NAME = "html_pages"


@dataclass
class Written(WriterCommitMessage):
    pages: list[tuple[int, str, str]]  # place, file, title


class Writer(DataSourceArrowWriter):
    """Tasks write into a folder of the job. When all have ended well the pages move to their places, and an index names them; a job
    that fails leaves what was there before. A task that runs twice writes files of its own each time, and only those it reports count."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"_temporary-{uuid.uuid4().hex}"
        store, at = open_store(self.path)
        store.create_dir(f"{at}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = open_store(self.path)
        pages = []
        for batch in iterator:
            for place, title, html in zip(*(batch.column(c).to_pylist() for c in ("place", "title", "html"))):
                if place is None or html is None:
                    raise ValueError("a page has a place and text")
                name = f"{at}/{self.job}/{uuid.uuid4().hex}.html"
                with store.open_output_stream(name) as out:
                    out.write(html.encode())
                pages.append((place, name, title or ""))
        return Written(pages)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = open_store(self.path)
        pages = sorted(p for m in messages if m for p in m.pages)
        lines = []
        for place, name, title in pages:
            store.move(name, f"{at}/page-{place:06d}.html")
            lines.append(f'<li><a href="page-{place:06d}.html">{escape.escape(title)}</a></li>\n')
        with store.open_output_stream(f"{at}/index.html") as out:
            out.write(("<ol>\n" + "".join(lines) + "</ol>\n").encode())
        store.delete_dir(f"{at}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = open_store(self.path)
        store.delete_dir(f"{at}/{self.job}")


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "place long, title string, html string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write_pages(pages: DataFrame, path: str) -> None:
    """Write (place, title, html) as page-<place>.html below `path`, and index.html with links in order of place: titles, not pages, pass the driver."""
    pages.sparkSession.dataSource.register(Pages)
    rows = pages.select(F.col("place").cast("long").alias("place"), F.col("title").cast("string").alias("title"), F.col("html").cast("string").alias("html"))
    rows.write.format(NAME).mode("append").save(path)
