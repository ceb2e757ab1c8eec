"""A sink for uploads that leaves nothing of what it rejects: files are staged, then moved to their digest's name, or deleted.

``rows.write.format("uploads").option("path", folder).mode("append").save()`` takes rows (name string, content binary). ``path`` is a folder that
the driver and all executors reach by one name. A row is checked (right first bytes, not empty, not too large) before
a byte of it is written. With ``rejects`` set to ``fail`` (the default) one bad upload fails the write and nothing of the whole write stays;
with ``skip`` the others are stored. Files are named by SHA-256, so equal contents are stored once.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from citeline.streaming.intake import MAGIC, MAX_BYTES


class InvalidUpload(ValueError):
    """An upload that is not taken; the message says why."""


@dataclass
class Staged(WriterCommitMessage):
    digests: list[str]
    attempt: str


def problem(content: bytes | None, magic: bytes = MAGIC, max_bytes: int = MAX_BYTES) -> str | None:
    if not content:
        return "empty"
    if not bytes(content[: len(magic)]) == magic:
        return "wrong type"
    return "too large" if len(content) > max_bytes else None


class UploadWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.rejects = options["path"], options.get("rejects", "fail")
        self.magic, self.most = options.get("magic", MAGIC.decode()).encode(), int(options.get("max_bytes", MAX_BYTES))
        self.suffix, self.job = options.get("suffix", ".pdf"), f"_staged-{uuid.uuid4().hex}"
        os.makedirs(os.path.join(self.path, self.job))  # by the driver alone: tasks can not make it anew once it is gone

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        attempt, digests = uuid.uuid4().hex, []
        folder = os.path.join(self.path, self.job, attempt)
        for row in iterator:
            why = problem(row["content"], self.magic, self.most)
            if why and self.rejects == "fail":
                raise InvalidUpload(f"{row['name']}: {why}")
            if not why:
                digest = hashlib.sha256(row["content"]).hexdigest()
                if not digests:
                    os.mkdir(folder)
                with open(os.path.join(folder, digest), "wb") as f:
                    f.write(row["content"])
                digests.append(digest)
        return Staged(digests, attempt)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Only what successful attempts staged is moved; leftovers of failed ones go with the staging folder."""
        for m in messages:
            for digest in dict.fromkeys(m.digests if m else ()):
                final = os.path.join(self.path, digest + self.suffix)
                if not os.path.exists(final):
                    os.replace(os.path.join(self.path, self.job, m.attempt, digest), final)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """The staging folder goes under another name first, so that tasks that still run find none to write into."""
        job = os.path.join(self.path, self.job)
        os.rename(job, gone := f"{job}-gone")
        shutil.rmtree(gone)


class Uploads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "uploads"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("uploads are only ever added: use mode append")
        return UploadWriter(dict(self.options))
