"""Commits of a git repository as a Python data source.

    spark.dataSource.register(GitSource)
    spark.read.format("gitlog").load("/path/to/repo")

One row per commit and file, oldest first.  The history is read in ranges of
commits, one partition each, so no task holds it all.  Options: ``since`` (a commit
to go on from), ``before`` (a commit whose ancestors are wanted, itself left out),
``per_task``.

The format ``gitdiff`` gives (commit, file, patch) against the first parent instead;
patches of over ``most_bytes`` (in UTF-8) are cut and say so within that bound.
"""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Range(InputPartition):
    def __init__(self, commits: list[str]):
        self.commits = commits


def git(repo: str, *args: str, given: str | None = None) -> str:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True, text=True, input=given).stdout


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo = options.get("path")
        self.since = options.get("since")
        self.before = options.get("before")
        self.per_task = int(options.get("per_task", "500"))

    def partitions(self):
        tip = git(self.repo, "rev-parse", "--verify", self.before + "^{commit}").strip() if self.before else "HEAD"
        span = f"{self.since}..{tip}" if self.since else tip
        commits = [c for c in git(self.repo, "rev-list", "--topo-order", "--reverse", span).split() if c != tip]
        return [Range(commits[i : i + self.per_task]) for i in range(0, len(commits), self.per_task)] or [Range([])]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.commits:
            return
        out = git(self.repo, "log", "--no-walk=unsorted", "--stdin", "-M", "--name-status", "--format=%x1e%H%x1f%P%x1f%T%x1f%an%x1f%at%x1f%B%x1d", given="\n".join(partition.commits))
        for block in out.split("\x1e")[1:]:
            head, _, names = block.partition("\x1d")
            commit, parents, tree, author, at, message = head.split("\x1f")
            rows = [x.split("\t") for x in names.strip().splitlines() if "\t" in x] or [[None, None]]
            for r in rows:
                yield commit, parents.split(" ")[0] or None, tree, author, int(at), message.strip(), r[0][:1] if r[0] else None, r[-1]


class GitSource(DataSource):
    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return "commit string, parent string, tree string, author string, time long, message string, status string, file string"

    def reader(self, schema):
        return GitReader(self.options)


#: What ends a patch that was cut (fixed value).
TRUNCATED = "\n[diff truncated]\n"


def cut_patch(body: bytes, most: int) -> str:
    """At most ``most`` bytes, cut between characters; what is cut says so."""
    if len(body) <= most:
        return body.decode("utf-8", "replace")
    mark = TRUNCATED[:most]
    return body[: most - len(mark)].decode("utf-8", "ignore") + mark


class GitDiffReader(GitReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options.get("most_bytes", "262144"))
        self.per_task = int(options.get("per_task", "50"))

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.commits:
            return
        args = ["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-C", self.repo, "log", "--no-walk=unsorted", "--stdin", "-p", "-m", "--first-parent", "--no-renames", "--no-color", "--no-ext-diff", "--format=%x1e%H"]
        with tempfile.TemporaryFile() as asked:
            asked.write("\n".join(partition.commits).encode())
            asked.seek(0)
            with subprocess.Popen(args, stdin=asked, stdout=subprocess.PIPE) as run:
                yield from self.patches(run.stdout)
        if run.returncode:
            raise RuntimeError(f"git log ended with {run.returncode}")

    def patches(self, lines: Iterable[bytes]) -> Iterator[tuple]:
        """Lines are read as they come; of a file only its bound and one byte are held."""
        commit = name = None
        held: list[bytes] = []
        size, head = 0, False

        def done():
            return commit, name, cut_patch(b"".join(held), self.most)

        for line in lines:
            if line.startswith(b"\x1e"):  # a line of a patch starts otherwise
                if name is not None:
                    yield done()
                commit, name = line[1:].strip().decode(), None
                continue
            if line.startswith(b"diff --git "):
                if name is not None:
                    yield done()
                held, size, head = [], 0, True
                name = line.rstrip(b"\n").rsplit(b" b/", 1)[-1].decode("utf-8", "replace")
            elif name is None:
                continue
            if head and line.startswith((b"--- a/", b"+++ b/")):  # the new name, or the old one of a removed file
                name = line[6:].rstrip(b"\t\n").decode("utf-8", "replace")
            head = head and not line.startswith(b"@@")
            if size <= self.most:
                held.append(line[: self.most + 1 - size])
                size += len(held[-1])
        if name is not None:
            yield done()


class GitDiffSource(GitSource):
    @classmethod
    def name(cls):
        return "gitdiff"

    def schema(self):
        return "commit string, file string, patch string"

    def reader(self, schema):
        return GitDiffReader(self.options)


def merged_requests(commits):
    """First-parent merges as requests: number, branch and kind of work from the message."""
    from pyspark.sql import functions as F

    m = F.col("message")
    number = F.coalesce(F.nullif(F.regexp_extract(m, r"(?i)pull request #(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(m, r"\(#(\d+)\)", 1), F.lit("")))
    low = F.lower(m)
    kind = (
        F.when(low.rlike(r"\b(?:fix|bug|hotfix)"), "fix")
        .when(low.rlike(r"\b(?:feat|feature|add)"), "feature")
        .when(low.rlike(r"\b(?:refactor|cleanup)"), "refactor")
        .when(low.rlike(r"\b(?:doc|docs|readme)\b"), "documentation")
        .otherwise("other")
    )
    return commits.withColumn("number", number.cast("long")).filter("number IS NOT NULL").groupBy("number").agg(
        F.min("time").alias("time"), F.first("message").alias("message"), F.first(kind).alias("kind"), F.sort_array(F.collect_set("file")).alias("files")
    )
