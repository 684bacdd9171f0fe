"""Data sources: repositories of source files and the scenarios of tasks, as spark.read.format("repository") and ("scenarios")."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from quarrylens.functions.paths import EXCLUDED, GENERATED

FILES = "path string, text string, size_bytes long, mtime timestamp"
SCENARIOS = "slug string, name string, description string, language string, max_steps int, graders map<string,struct<weight:double,target_coverage:double>>, invariants array<map<string,string>>, test_paths array<string>, path string, error string"


@dataclass
class Folder(InputPartition):
    """A folder below the root, with the patterns of the ignore files above it. whole: with all that is in it; otherwise its own files."""

    path: str
    ignored: tuple[str, ...]
    whole: bool


@dataclass
class Wanted:
    """What filters on path leave: some paths, or those that start so; None where there is no filter."""

    paths: frozenset[str] | None = None
    start: str = ""

    def file(self, path: str) -> bool:
        return (self.paths is None or path in self.paths) and path.startswith(self.start)

    def folder(self, path: str) -> bool:
        """Whether a folder may hold a wanted file."""
        inside = f"{path}/" if path else ""
        return (inside.startswith(self.start) or self.start.startswith(inside)) and (self.paths is None or any(p.startswith(inside) for p in self.paths))


class Tree:
    """Folders and files below a root that pyarrow's file systems can open: a local or shared folder, or a URI of a store."""

    def __init__(self, root: str, names: str, exclude: tuple[str, ...]):
        self.root, self.names, self.exclude = root.rstrip("/"), names, (*EXCLUDED, *exclude)

    def __enter__(self) -> Tree:
        self.fs, self.base = pafs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pafs.LocalFileSystem(), self.root)
        return self

    def __exit__(self, *_: object) -> None:
        self.fs = None

    def bytes_of(self, path: str) -> bytes:
        with self.fs.open_input_stream(f"{self.base}/{path}") as f:
            return f.read()

    def entries(self, folder: str) -> list[pafs.FileInfo]:
        return sorted(self.fs.get_file_info(pafs.FileSelector(f"{self.base}/{folder}" if folder else self.base)), key=lambda x: x.base_name)

    def level(self, folder: str, ignored: tuple[str, ...]) -> tuple[list[pafs.FileInfo], list[pafs.FileInfo], tuple[str, ...]]:
        """The files and folders that stand in a folder and aren't left out, and the patterns that hold below it: those from
        above and those of its own ignore file."""
        found = self.entries(folder)
        if any(x.base_name == ".gitignore" and x.is_file for x in found):
            said = self.bytes_of(f"{folder}/.gitignore" if folder else ".gitignore").decode("utf-8", "replace").splitlines()
            ignored = (*ignored, *(p.strip().rstrip("/") for p in said if p.strip() and not p.strip().startswith(("#", "!"))))
        kept = [x for x in found if x.base_name != ".git" and not any(fnmatch.fnmatchcase(x.base_name, p) for p in ignored)]
        files = [x for x in kept if x.type != pafs.FileType.Directory and fnmatch.fnmatchcase(x.base_name, self.names) and x.base_name not in self.exclude and not x.base_name.endswith(GENERATED)]
        return files, [x for x in kept if x.type == pafs.FileType.Directory and x.base_name not in self.exclude], ignored


def _under(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


class RepositoryReader(DataSourceReader):
    """Partitions are folders: the driver lists levels levels of them, and each task walks what is below its own."""

    def __init__(self, tree: Tree, levels: int):
        self.tree, self.levels, self.wanted = tree, levels, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("path",):
                self._only(set(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and (f.value.startswith(self.wanted.start) or self.wanted.start.startswith(f.value)):
                self.wanted = Wanted(self.wanted.paths, max(f.value, self.wanted.start, key=len))
            else:
                yield f

    def _only(self, paths: set[str]) -> None:
        self.wanted = Wanted(frozenset(paths if self.wanted.paths is None else paths & self.wanted.paths), self.wanted.start)

    def partitions(self) -> list[InputPartition]:
        out, todo = [], [("", (), 0)]
        with self.tree as tree:
            while todo:
                folder, ignored, depth = todo.pop()
                if depth == self.levels:
                    out.append(Folder(folder, ignored, True))
                    continue
                _, folders, below = tree.level(folder, ignored)
                out.append(Folder(folder, ignored, False))
                todo += [(path, below, depth + 1) for x in folders if self.wanted.folder(path := _under(folder, x.base_name))]
        return out

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        names = ["path", "text", "size_bytes", "mtime"]
        with self.tree as tree:
            todo = [(partition.path, partition.ignored)]
            while todo:
                folder, ignored = todo.pop()
                files, folders, below = tree.level(folder, ignored)
                for x in files:
                    path = _under(folder, x.base_name)
                    if self.wanted.file(path):
                        data = tree.bytes_of(path)
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data.decode("utf-8", "replace")]), pa.array([len(data)], pa.int64()), pa.array([x.mtime], pa.timestamp("us", "UTC"))], names)
                if partition.whole:
                    todo += [(path, below) for x in folders if self.wanted.folder(path := _under(folder, x.base_name))]


class Repository(DataSource):
    """path (below the root), text, size_bytes, mtime of the files of a repository.

    Options: path; names, a glob of file names (*.py); exclude, more names to leave out, with commas between; levels, how
    many levels of folders are dealt to tasks (1). Folders that are always left out, generated files and .git go. An
    ignore file holds for its folder and what is below: a name that fits one of its patterns goes with all in it; comments
    and negations don't count. Bad bytes are replaced. Filters on path (equal to, one of, starting with; with
    spark.sql.python.filterPushdown.enabled) are taken before folders are listed and files opened.
    """

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> RepositoryReader:
        exclude = tuple(x for x in self.options.get("exclude", "").split(",") if x)
        return RepositoryReader(Tree(self.options["path"], self.options.get("names", "*.py"), exclude), int(self.options.get("levels", "1")))


def scenario_row(text: str, folder: str) -> dict:
    """A scenario's settings with defaults, and what is wrong with it where it can't be used."""
    import yaml

    out = {"slug": folder, "name": "", "description": "", "language": "python", "max_steps": 20, "graders": {}, "invariants": [], "test_paths": [], "error": None}
    try:
        raw = yaml.safe_load(text) or {}
        if not isinstance(raw, dict):
            raise ValueError("a scenario must be a mapping")
        for key, kind in (("graders", dict), ("invariants", list), ("test_paths", list)):
            if not isinstance(raw.get(key, kind()), kind):
                raise ValueError(f"{key} must be a {kind.__name__}")
        out |= {k: str(raw[k]) for k in ("slug", "name", "description", "language") if raw.get(k) is not None}
        out["max_steps"] = int(raw.get("max_steps", 20))
        for grader, v in raw.get("graders", {}).items():
            v = {"weight": v} if isinstance(v, (int, float)) else v or {}
            out["graders"][str(grader)] = {"weight": float(v.get("weight", 0.0)), "target_coverage": None if v.get("target_coverage") is None else float(v["target_coverage"])}
        out["invariants"] = [{str(k): None if v is None else str(v) for k, v in x.items()} for x in raw.get("invariants", [])]
        out["test_paths"] = [str(x) for x in raw.get("test_paths", [])]
    except (ValueError, TypeError, AttributeError, yaml.YAMLError) as e:
        out["error"] = str(e).split("\n")[0]
    return out


class ScenarioReader(DataSourceReader):
    def __init__(self, root: str, name: str):
        self.tree, self.file = Tree(root, name, ()), name

    def partitions(self) -> list[InputPartition]:
        with self.tree as tree:
            return [Folder(x.base_name, (), False) for x in tree.entries("") if x.type == pafs.FileType.Directory]

    def read(self, partition: Folder) -> Iterator[tuple]:
        with self.tree as tree:
            if any(x.base_name == self.file for x in tree.entries(partition.path)):
                path = f"{partition.path}/{self.file}"
                row = scenario_row(tree.bytes_of(path).decode("utf-8", "replace"), partition.path)
                yield tuple({**row, "graders": {k: (v["weight"], v["target_coverage"]) for k, v in row["graders"].items()}, "path": path}[c.split()[0]] for c in ("slug", "name", "description", "language", "max_steps", "graders", "invariants", "test_paths", "path", "error"))


class Scenarios(DataSource):
    """A row for each task folder below path that has a scenario (option names: scenario.yaml), one task a folder. error says
    what is wrong with one that can't be used, which then has defaults."""

    @classmethod
    def name(cls) -> str:
        return "scenarios"

    def schema(self) -> str:
        return SCENARIOS

    def reader(self, schema) -> ScenarioReader:
        return ScenarioReader(self.options["path"], self.options.get("names", "scenario.yaml"))


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets Spark hand filters to them."""
    spark.dataSource.register(Repository)
    spark.dataSource.register(Scenarios)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
