"""A data source of documents by page: `spark.read.format("lodestar_pages").option("path", ...)`.

Files are listed once and dealt to partitions of about equal bytes; a partition reads its files one after another and gives a
row a page. What opens a file is a back end, named by the option `backend` as `module:function`: from a file's bytes to
(pages, encrypted), a page being a text or a list of blocks (x, y, text), which are put in reading order here. Without one,
files are texts whose pages a form feed parts; `lodestar.sources.pages:pymupdf` opens PDFs where that library is installed.
"""

from __future__ import annotations

import importlib
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, page int, page_count int, text string, encrypted boolean, image_only boolean"


def texts(content: bytes) -> tuple[list, bool]:
    return content.decode("utf-8", "replace").split("\f"), False


def pymupdf(content: bytes) -> tuple[list, bool]:
    """Pages of a PDF as blocks, by an optional library; one that needs a password has none."""
    import pymupdf as library

    with library.open(stream=content, filetype="pdf") as pdf:
        if pdf.needs_pass:
            return [], True
        return [[(b[0], b[1], b[4].strip()) for b in page.get_text("blocks") if b[6] == 0] for page in pdf], False


def in_reading_order(blocks: list[tuple[float, float, str]]) -> str:
    """Blocks as one text: where the median of x parts them in two columns, the left one first; each from top to bottom."""
    if not blocks:
        return ""
    middle = median(x for x, _, _ in blocks)
    two = any(x > middle for x, _, _ in blocks)
    return "\n".join(t for *_, t in sorted((int(two and x > middle), y, x, t) for x, y, t in blocks))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.most = int(options.get("partitionbytes", 64 << 20))
        module, _, name = options.get("backend", "lodestar.sources.pages:texts").partition(":")
        self.backend = (module, name)

    def _files(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return system, root

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._files()
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [[]], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)), key=lambda f: f.path):
            if out[-1] and size + f.size > self.most:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Files(p) for p in out if p]

    def read(self, partition: Files):
        open_ = getattr(importlib.import_module(self.backend[0]), self.backend[1])
        system, _ = self._files()
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                pages, encrypted = open_(stream.read())
            made = [p if isinstance(p, str) else in_reading_order(p) for p in pages]
            empty = not encrypted and not any(p.strip() for p in made)
            for k, text in enumerate(made or [""]):
                yield path, k + 1, len(made), text, encrypted, empty


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestar_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


def pages(spark: SparkSession, path: str, suffix: str = "", backend: str | None = None, partition_bytes: int = 64 << 20) -> DataFrame:
    """(path, page, page_count, text, encrypted, image_only) of the files below a path; a file without pages has one empty row."""
    spark.dataSource.register(PageSource)
    reader = spark.read.format("lodestar_pages").option("path", path).option("suffix", suffix).option("partitionBytes", str(partition_bytes))
    return (reader.option("backend", backend) if backend else reader).load()


def documents(rows: DataFrame) -> DataFrame:
    """Pages put together, as readers.documents gives them."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return rows.groupBy("path").agg(F.array_join(listed, "\n").alias("text"), F.max("page_count").alias("page_count"), F.max("encrypted").alias("encrypted"), F.max("image_only").alias("image_only"))
