"""``spark.readStream.format("revised_files")``: files by revision, of a folder or of a remote store, as a stream that goes on.

The offset is the map from uri to revision, so a run reads the files whose revision isn't the one of the last run, and gives a
row with ``deleted`` for those that are gone; what is unchanged is neither fetched nor read. Options:

- folder: a folder that the driver and all executors see. A file's revision is its size and time of change. ``settle`` (seconds, 0):
  files changed more recently wait for a later run, as they may still be being written.
- store: ``module:name`` of a class that is called with the options and has ``listing() -> dict[uri, revision]`` and ``fetch(uri, revision) -> bytes``:
  a repository host or a drive. Nothing here knows one, as there is no network.
- per_task (64): files that a task reads.

Names that begin with a dot or an underscore are left out. Content is text in UTF-8, with what isn't replaced.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "uri string, revision string, text string, deleted boolean"


class Folder:
    """The files below a local or mounted folder."""

    def __init__(self, options: dict[str, str]):
        named = options["folder"]
        self.root = unquote(urlparse(named).path) if named.startswith("file:") else named
        self.settle = float(options.get("settle", "0"))

    def listing(self) -> dict[str, str]:
        latest, found = time.time() - self.settle, {}
        for at, folders, names in os.walk(self.root):
            folders[:] = [f for f in folders if f[0] not in "._"]
            for n in names:
                path = os.path.join(at, n)
                if n[0] not in "._" and (s := os.stat(path)).st_mtime <= latest:
                    found[os.path.relpath(path, self.root)] = f"{s.st_size}-{s.st_mtime_ns}"
        return found

    def fetch(self, uri: str, revision: str) -> bytes:
        with open(os.path.join(self.root, uri), "rb") as f:
            return f.read()


def store_of(options: dict[str, str]):
    if "store" in options:
        module, _, name = options["store"].partition(":")
        return getattr(importlib.import_module(module), name)(options)
    return Folder(options)


class Changed(InputPartition):
    """Files to read, as (uri, revision), and uris that are gone."""

    def __init__(self, files: list[tuple[str, str]], gone: list[str]):
        self.files, self.gone = files, gone


class RevisedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "revised_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return Reader(dict(self.options))


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.size = options, int(options.get("per_task", "64"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps(store_of(self.options).listing(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        new = [(u, r) for u, r in sorted(now.items()) if before.get(u) != r]
        gone = sorted(set(before) - set(now))
        parts: list[InputPartition] = [Changed(new[i : i + self.size], []) for i in range(0, len(new), self.size)]
        return [*parts, Changed([], gone)] if gone or not parts else parts

    def read(self, partition: Changed) -> Iterator[tuple]:
        store = store_of(self.options) if partition.files else None
        for uri, revision in partition.files:
            try:
                yield uri, revision, store.fetch(uri, revision).decode("utf-8", "replace"), False
            except FileNotFoundError:  # it went after the listing; the next run says so
                yield uri, revision, None, True
        for uri in partition.gone:
            yield uri, None, None, True
