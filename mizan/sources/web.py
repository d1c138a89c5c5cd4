"""List pages as Python data sources: one partition a page, failures as rows; and as a stream of what has changed.

spark.dataSource.register(ListPages); spark.read.format("list_pages")
    .option("template", "https://host/list/{}").option("ids", "49,50").load()

Only server errors, 429 and transport errors are tried again, after 2**n
seconds and a random part; other client errors end at once.
"""

from __future__ import annotations

import hashlib
import random
import time
import urllib.error
import urllib.request

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def fetch(url: str, retries: int = 3, opener=urllib.request.urlopen, sleep=time.sleep) -> bytes:
    for attempt in range(retries):
        try:
            with opener(url) as response:
                return response.read()
        except urllib.error.HTTPError as error:
            if (error.code < 500 and error.code != 429) or attempt == retries - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == retries - 1:
                raise
        sleep(2**attempt + random.random())
    raise ValueError("no attempt")


class Page(InputPartition):
    def __init__(self, page_id: int, url: str):
        super().__init__(page_id)
        self.page_id, self.url = page_id, url


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.template = options["template"]
        self.ids = [int(x) for x in options["ids"].split(",") if x.strip()]
        self.retries = int(options.get("retries", "3"))

    def partitions(self):
        return [Page(i, self.template.format(i)) for i in self.ids]

    def read(self, partition):
        try:
            yield partition.page_id, partition.url, fetch(partition.url, self.retries), None
        except (OSError, ValueError) as error:
            yield partition.page_id, partition.url, None, f"{type(error).__name__}: {error}"


class ListPages(DataSource):
    @classmethod
    def name(cls):
        return "list_pages"

    def schema(self):
        return "page_id int, url string, content binary, error string"

    def reader(self, schema):
        return _Reader(self.options)


class Changed(InputPartition):
    def __init__(self, page_id: str, url: str, old: str | None, new: str):
        super().__init__(page_id)
        self.page_id, self.url, self.old, self.new = page_id, url, old, new


class _Poller(DataSourceStreamReader):
    """Offsets name the content of each page by its SHA-256; contents are archived before an offset that names them is told.

    So a batch that runs again reads what it read the first time, whatever the
    page says by then. A page that can't be fetched keeps its last content.
    """

    def __init__(self, options):
        self.template, self.archive = options["template"], options["archive"].rstrip("/")
        self.ids = [x.strip() for x in options["ids"].split(",") if x.strip()]
        self.retries = int(options.get("retries", "3"))

    def _file(self, name: str):
        fs, path = pafs.FileSystem.from_uri(self.archive if "://" in self.archive else f"file://{self.archive}")
        fs.create_dir(path, recursive=True)
        return fs, f"{path}/{name}"

    def _write(self, name: str, data: bytes) -> None:
        fs, path = self._file(name)
        with fs.open_output_stream(path, compression=None) as out:
            out.write(data)

    def _read(self, name: str) -> bytes | None:
        fs, path = self._file(name)
        if fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with fs.open_input_file(path) as f:
            return f.read()

    def initialOffset(self):
        return {}

    def latestOffset(self, *_):
        found = {}
        for i in self.ids:
            try:
                content = fetch(self.template.format(i), self.retries)
                digest = hashlib.sha256(content).hexdigest()
                self._write(digest, content)
                self._write(f"last-{i}", digest.encode())
            except (OSError, ValueError):
                digest = (self._read(f"last-{i}") or b"").decode()
            if digest:
                found[i] = digest
        return found

    def partitions(self, start, end):
        return [Changed(i, self.template.format(i), start.get(i), digest) for i, digest in sorted(end.items()) if start.get(i) != digest]

    def read(self, partition):
        yield int(partition.page_id), partition.url, self._read(partition.new), self._read(partition.old) if partition.old else None


class ListPageStream(DataSource):
    """Changed list pages as a stream: each page's new content and the one seen before it (null the first time).

    spark.dataSource.register(ListPageStream); spark.readStream.format("list_page_stream")
        .option("template", "https://host/list/{}").option("ids", "49,50").option("archive", "a shared folder").load()

    The driver fetches the pages, a few of them, once a trigger.
    """

    @classmethod
    def name(cls):
        return "list_page_stream"

    def schema(self):
        return "page_id int, url string, content binary, seen binary"

    def streamReader(self, schema):
        return _Poller(self.options)
