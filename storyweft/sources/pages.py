"""Pages and images over the network, bounded in size, by a transport that is an option."""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_BYTES, IMAGE_BYTES = 3 * 1024 * 1024, 12 * 1024 * 1024


class PageSource(DataSource):
    """``spark.read.format("storyweft_page")``: one partition a host, requests of a host one after another.

    Options: ``targets`` (JSON list of {id, url}), ``kind`` (``page``: HTML only; ``image``: images but SVG), ``limit`` in bytes,
    ``transport`` (``module:function`` of address and limit giving status, final address, content type and body, the body cut one byte over
    the limit), ``pause`` in seconds. A row holds the body, or why there is none.
    """

    @classmethod
    def name(cls) -> str:
        return "storyweft_page"

    def schema(self) -> str:
        return "id string, status int, url string, content_type string, body binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Host(InputPartition):
    def __init__(self, targets: list[dict]):
        super().__init__(0)
        self.targets = targets


def fetch(url: str, limit: int) -> tuple[int, str, str, bytes]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "*/*"}), timeout=20) as r:
            return r.status, r.geturl(), r.headers.get("content-type", ""), r.read(limit + 1)
    except urllib.error.HTTPError as e:
        return e.code, url, "", b""


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[dict]] = {}
        for t in json.loads(self.options.get("targets", "[]")):
            hosts.setdefault(re.sub(r"^https?://([^/]+).*", r"\1", t["url"]), []).append(t)
        return [_Host(h) for h in hosts.values()]

    def read(self, partition) -> Iterator[tuple]:
        get = fetch
        if self.options.get("transport"):
            module, _, name = self.options["transport"].partition(":")
            get = getattr(importlib.import_module(module), name)
        image = self.options.get("kind", "page") == "image"
        limit = int(self.options.get("limit", IMAGE_BYTES if image else PAGE_BYTES))
        for i, t in enumerate(partition.targets):
            if i:
                time.sleep(float(self.options.get("pause", 1.0)))
            try:
                status, final, kind, body = get(t["url"], limit)
            except OSError as e:
                yield t["id"], 0, t["url"], None, None, str(e)
                continue
            wanted = kind.startswith("image/") and "svg" not in kind if image else "html" in kind
            error = f"HTTP {status}" if not 200 <= status < 300 else "wrong type" if not wanted else "too large" if len(body) > limit else None
            yield t["id"], status, final, kind, None if error else body, error
