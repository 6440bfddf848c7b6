"""Git snapshots as tables: a data source for the listing, and blob contents joined back by object id.

``spark.read.format("git_snapshot").option("root", ...).option("revision", ...)`` lists a commit's files, or with
``snapshot`` = ``worktree`` the index. The repository must lie where executors can read it. Stages other than zero
(unmerged paths), revisions that are no commit and repeated paths are errors.
"""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SAMPLE_BYTES = 8192
#: Tasks that a listing is dealt out to at most, ids that are asked for at once, and bytes of a batch of results.
PARTS, ASKED, BATCH_BYTES = 256, 256, 8 << 20
LISTING = "path string, mode string, object_id string, object_type string"


def git(root: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", root, *args], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {args[0]} failed: {done.stderr.decode(errors='replace')[:300]}")
    return done.stdout


def entries(root: str, snapshot: str, revision: str, names: list[str] | None = None) -> list[tuple[str, str, str, str]]:
    out = []
    if snapshot == "worktree":
        for record in filter(None, git(root, "ls-files", "--stage", "-z").split(b"\0")):
            head, _, path = record.partition(b"\t")
            mode, object_id, stage = head.decode().split(" ")
            if stage != "0":
                raise ValueError("the index holds unmerged paths")
            out.append((path.decode(), mode, object_id, "commit" if mode == "160000" else "blob"))
    elif snapshot == "tree":
        if git(root, "cat-file", "-t", revision).strip() != b"commit":
            raise ValueError("the revision is no commit")
        for record in filter(None, git(root, "--literal-pathspecs", "ls-tree", "--full-tree", "-r", "-z", revision, *(names or [])).split(b"\0")):
            head, _, path = record.partition(b"\t")
            mode, kind, object_id = head.decode().split(" ")
            out.append((path.decode(), mode, object_id, kind))
    else:
        raise ValueError("snapshot is worktree or tree")
    if len({p for p, *_ in out}) < len(out):
        raise ValueError("a path is listed twice")
    return sorted(out)


def context(root: str) -> dict[str, str | bool]:
    """Root of the repository, the path of ``root`` below it, the commit, and whether tracked files below ``root`` differ from it."""
    top, prefix, revision = (git(root, "rev-parse", x).decode().rstrip("\n") for x in ("--show-toplevel", "--show-prefix", "HEAD"))
    prefix = prefix.rstrip("/")
    fields = iter([x for x in git(top, "status", "--porcelain=v1", "-z", "--untracked-files=no").decode().split("\0") if x])
    touched = []
    for field in fields:
        touched.append(field[3:])
        if field[0] in "RC":  # the path that it was moved or copied from follows
            touched.append(next(fields, ""))
    below = [p for p in touched if not prefix or p == prefix or p.startswith(prefix + "/")]
    return {"root": top, "prefix": prefix, "revision": revision, "dirty": bool(below)}


def tops(root: str, revision: str) -> list[str]:
    """Names at the top of a commit's tree."""
    return [x.partition(b"\t")[2].decode() for x in git(root, "ls-tree", "--full-tree", "-z", revision).split(b"\0") if x]


class _Part(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.snapshot, self.revision = options["root"], options.get("snapshot", "tree"), options.get("revision", "HEAD")

    def partitions(self):
        """Names at the top of the tree, dealt out; an index is one list."""
        if self.snapshot != "tree":
            return [_Part([])]
        names = tops(self.root, self.revision) if git(self.root, "cat-file", "-t", self.revision).strip() == b"commit" else []
        step = -(-len(names) // PARTS) or 1
        return [_Part(names[lo : lo + step]) for lo in range(0, len(names), step)] or [_Part([])]

    def read(self, partition):
        yield from entries(self.root, self.snapshot, self.revision, partition.names)


class GitSnapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_snapshot"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema):
        return _Reader(dict(self.options))


def snapshot(spark: SparkSession, root: str, revision: str = "HEAD", kind: str = "tree") -> DataFrame:
    spark.dataSource.register(GitSnapshot)
    return spark.read.format("git_snapshot").options(root=root, revision=revision, snapshot=kind).load()


def blobs(ids: DataFrame, root: str, keep_content: bool = False) -> DataFrame:
    """(object_id, byte_count, sha256, sample, content) of the different ids; nulls for objects that are missing.

    Each task asks one ``git cat-file --batch`` process for its ids, many at a time; contents are kept only if asked for,
    and results leave in batches of bounded size.
    """
    types = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary())

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["object_id", "byte_count", "sha256", "sample", "content"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = subprocess.Popen(["git", "-c", "safe.directory=*", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for batch in batches:
                rows, held, asked = [], 0, batch.column("object_id").to_pylist()
                for lo in range(0, len(asked), ASKED):
                    some = asked[lo : lo + ASKED]
                    process.stdin.write(b"".join(x.encode() + b"\n" for x in some))  # far less than a pipe holds
                    process.stdin.flush()
                    for object_id in some:
                        head = process.stdout.readline().split()
                        if head[-1] == b"missing":
                            rows.append((object_id, None, None, None, None))
                            continue
                        data = process.stdout.read(int(head[2]))
                        if process.stdout.read(1) != b"\n":
                            raise ValueError("a batch record does not end where its header says")
                        rows.append((object_id, len(data), hashlib.sha256(data).hexdigest(), data[:SAMPLE_BYTES], data if keep_content else None))
                        held += min(len(data), SAMPLE_BYTES) + keep_content * len(data)
                        if held > BATCH_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
                yield packed(rows)
        finally:
            process.stdin.close()
            process.wait()

    return ids.select("object_id").distinct().mapInArrow(read, "object_id string, byte_count bigint, sha256 string, sample binary, content binary")


def inventory(spark: SparkSession, root: str, revision: str = "HEAD") -> DataFrame:
    """Files of a commit with size, digest and kind; every blob is read once and joined back to its paths."""
    listed = snapshot(spark, root, revision)
    joined = listed.join(blobs(listed.filter("object_type = 'blob'"), root), "object_id", "left")
    kind = F.when(F.col("mode") == "160000", "gitlink").when(F.col("mode") == "120000", "symlink").when(F.position(F.lit(b"\x00"), F.col("sample")) > 0, "binary").otherwise("text")
    own = F.when(F.col("mode") == "160000", F.sha2("object_id", 256)).otherwise(F.col("sha256"))
    return joined.select("path", "mode", "object_id", F.when(F.col("mode") == "160000", F.length("object_id")).otherwise(F.col("byte_count")).cast("long").alias("byte_count"), own.alias("sha256"), kind.alias("content_kind"))


def worktree(spark: SparkSession, root: str) -> DataFrame:
    """Tracked files as they lie in the working folder: path, mode, byte_count, sha256, sample, problem.

    A link's content is its target, a submodule's its commit. A file is read only if no folder above it is a link and it
    lies below ``root``; ``problem`` tells what kept it from being read (UNSAFE_PATH, MISSING, NOT_A_FILE).
    """
    import os
    import stat

    listed = spark.createDataFrame([], LISTING) if not os.path.isdir(root) else snapshot(spark, root, kind="worktree")

    def payload(path: str, mode: str, object_id: str):
        if mode == "160000":
            return [object_id.encode()], None
        full, at = os.path.join(root, path), root
        if os.path.isabs(path) or ".." in path.split("/"):
            return None, "UNSAFE_PATH"
        for part in path.split("/")[:-1]:
            at = os.path.join(at, part)
            if os.path.islink(at):
                return None, "UNSAFE_PATH"
        try:
            kind = os.lstat(full).st_mode
        except OSError:
            return None, "MISSING"
        if mode == "120000":
            return ([os.fsencode(os.readlink(full))], None) if stat.S_ISLNK(kind) else (None, "NOT_A_FILE")
        if not stat.S_ISREG(kind):
            return None, "NOT_A_FILE"
        return iter(lambda f=open(full, "rb"): f.read(65536), b""), None  # noqa: SIM115

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"path": [], "mode": [], "byte_count": [], "sha256": [], "sample": [], "problem": []}
            for path, mode, object_id in zip(*(batch.column(c).to_pylist() for c in ("path", "mode", "object_id")), strict=True):
                chunks, problem = payload(path, mode, object_id)
                size, sample, sha = 0, b"", hashlib.sha256()
                for chunk in chunks or ():
                    size, sample = size + len(chunk), sample + chunk[: SAMPLE_BYTES - len(sample)]
                    sha.update(chunk)
                for name, value in (("path", path), ("mode", mode), ("byte_count", None if problem else size), ("sha256", None if problem else sha.hexdigest()), ("sample", None if problem else sample), ("problem", problem)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("path", pa.string()), ("mode", pa.string()), ("byte_count", pa.int64()), ("sha256", pa.string()), ("sample", pa.binary()), ("problem", pa.string())]))

    return listed.mapInArrow(read, "path string, mode string, byte_count bigint, sha256 string, sample binary, problem string")


def revisions(root: str, span: str = "HEAD") -> list[str]:
    """The commits of a range along first parents, oldest first."""
    return git(root, "rev-list", "--first-parent", "--reverse", span).decode().split()


def history(spark: SparkSession, root: str, commits: list[str]) -> DataFrame:
    """(path, object_id, mode, since, until): which blob a path has from commit number ``since`` to before ``until`` (null: to the last).

    The first commit is listed in full; of every further one only what ``git diff-tree`` tells against the one before is
    read, in tasks of their own. A moved file is one path that ends and one that begins.
    """
    if not commits:
        return spark.createDataFrame([], "path string, object_id string, mode string, since bigint, until bigint")
    first = snapshot(spark, root, commits[0]).filter("object_type = 'blob'").select(F.lit(0).cast("long").alias("since"), "path", "object_id", "mode")
    steps = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(commits, commits[1:], strict=False), 1)], "since bigint, before string, after string").repartition(min(PARTS, len(commits)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("since", pa.int64()), ("path", pa.string()), ("object_id", pa.string()), ("mode", pa.string())])
        for batch in batches:
            for step in batch.to_pylist():
                fields = iter(git(root, "diff-tree", "-r", "-z", "--no-renames", step["before"], step["after"]).split(b"\0"))
                rows = []
                for head in filter(None, fields):
                    _, mode, _, object_id, status = head.decode().split(" ")
                    kept = status != "D" and mode != "160000"
                    rows.append({"since": step["since"], "path": next(fields).decode(), "object_id": object_id if kept else None, "mode": mode if kept else None})
                yield pa.RecordBatch.from_pylist(rows, schema)

    changes = first.unionByName(steps.mapInArrow(read, "since bigint, path string, object_id string, mode string"))
    following = F.lead("since").over(Window.partitionBy("path").orderBy("since"))
    return changes.withColumn("until", following).filter("object_id IS NOT NULL").select("path", "object_id", "mode", "since", "until")


def at(told: DataFrame, number: int) -> DataFrame:
    """The files of commit ``number`` of a history: path, object_id, mode."""
    return told.filter((F.col("since") <= number) & (F.col("until").isNull() | (F.col("until") > number))).select("path", "object_id", "mode")


def snapshot_lines(told: DataFrame, root: str, suffix: str, numbers: list[int] | None = None) -> DataFrame:
    """(number, line): the different code lines of the files that end in ``suffix``, of the commits ``numbers`` (null: of all, as number null).

    A blob is read once, however many commits and paths have it; bytes that are no UTF-8 become replacement marks.
    """
    from fathomline.operators.fidelity import code_lines

    files = told.filter(F.endswith("path", F.lit(suffix)) & F.col("mode").isin("100644", "100755"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    read = blobs(files, root, keep_content=True).filter("content IS NOT NULL").select("object_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = code_lines(read, "object_id").select("object_id", "line").distinct()
    if numbers is None:
        return lines.select(F.lit(None).cast("bigint").alias("number"), "line").distinct()
    wanted = files.select("object_id", "since", "until").join(F.broadcast(told.sparkSession.createDataFrame([(n,) for n in numbers], "number bigint")), F.expr("since <= number AND (until IS NULL OR until > number)"))
    return wanted.select("number", "object_id").distinct().join(lines, "object_id").select("number", "line").distinct()


def tree_payload(spark: SparkSession, root: str, revision: str = "HEAD") -> DataFrame:
    """(path, byte_count, sha256, problem) of a commit's files; a submodule's payload is its commit, a blob that is not there a problem."""
    listed = snapshot(spark, root, revision)
    joined = listed.join(blobs(listed.filter("object_type = 'blob'"), root), "object_id", "left")
    link = F.col("mode") == "160000"
    return joined.select("path", F.when(link, F.length("object_id")).otherwise(F.col("byte_count")).cast("long").alias("byte_count"), F.when(link, F.sha2("object_id", 256)).otherwise(F.col("sha256")).alias("sha256"), F.when(~link & F.col("sha256").isNull(), "MISSING").alias("problem"))
