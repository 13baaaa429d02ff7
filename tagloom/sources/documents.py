"""Text files written a document each, whatever its length: all of a job's files appear after its last task, or none.

A row is a line. Rows are dealt by document and sorted, so that a task writes
its documents one after another, a line at a time, and no row or task ever holds
a document. Each attempt of a task writes into a folder of its own; when all
have ended, the driver moves the files that the successful ones name to their
places, each by one rename, and what other attempts left goes. If the job fails,
nothing is moved.

The folder must be reachable by the same path from all executors, as a mount is.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """The files of a task that succeeded: where they are, and where they go."""

    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, at: str):
        self.at = at.rstrip("/")
        self.staging = f"{self.at}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        own, files, name, out = f"{self.staging}/{uuid.uuid4().hex}", [], None, None
        try:
            for row in iterator:
                if row.document != name:
                    if out:
                        out.close()
                    name = row.document
                    if name.startswith("/") or ".." in name.split("/"):
                        raise ValueError(f"{name} lies outside the folder")
                    staged = f"{own}/{len(files)}"
                    os.makedirs(own, exist_ok=True)
                    out = open(staged, "w", encoding="utf-8", newline="\n")  # noqa: SIM115
                    files.append((staged, f"{self.at}/{name}"))
                out.write(f"{row.line}\n")
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        for m in messages:
            for staged, place in m.files if m else []:
                os.makedirs(os.path.dirname(place), exist_ok=True)
                os.replace(staged, place)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Documents(DataSource):
    """Format `documents`: rows of document and line, sorted by document within each partition."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "document string, line string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write_documents(lines: DataFrame, at: str) -> None:
    """Writes the files that `lines` (document, nth, line) make below `at`; `nth` may be of any type that has an order. Files of these names are replaced, others stay."""
    spark = lines.sparkSession
    spark.dataSource.register(Documents)
    dealt = lines.where("document IS NOT NULL").repartition("document").sortWithinPartitions("document", "nth")
    dealt.select("document", F.coalesce("line", F.lit("")).alias("line")).write.format("documents").mode("append").save(at)
