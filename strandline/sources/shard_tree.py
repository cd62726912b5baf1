"""A tree of small text files as a source that opens only the folders its filters allow.

A row is a file: ``rel`` (path under the root), ``key`` (rel without its slashes, as shards of a number or a hash
spell it) and ``raw`` (its text). ``depth`` keeps files that many levels down and no others (0: any), ``names`` a
shell pattern for their names. Names that begin with ``_`` or ``.`` are hidden. A root that is not there has no rows;
a file that is no UTF-8 fails.

The driver lists one level, a task the tree below one of its folders. Where the session allows it
(``spark.sql.python.filterPushdown.enabled``), equality, ``IN`` and prefixes of key and rel are taken from the query:
a folder whose path can begin no wanted value is never listed, and its files are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Wanted:
    """Conditions on one column, all of which must hold; each is a list of values, whole or prefixes."""

    def __init__(self):
        self.conditions: list[tuple[tuple[str, ...], bool]] = []

    def add(self, values: Iterable[str], prefix: bool) -> None:
        self.conditions.append((tuple(v for v in values if v is not None), prefix))

    def below(self, start: str) -> bool:
        """Whether a value that begins with start may be wanted."""
        return all(any(v.startswith(start) or (prefix and start.startswith(v)) for v in values) for values, prefix in self.conditions)

    def has(self, value: str) -> bool:
        return all(value.startswith(values) if prefix else value in values for values, prefix in self.conditions)


class _Top(InputPartition):
    """A folder of the first level with all below it, or the files of the root ('')."""

    def __init__(self, name: str):
        self.name = name


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.depth, self.names = options["path"].rstrip("/"), int(options.get("depth", 0)), options.get("names", "*")
        self.wanted = {"key": Wanted(), "rel": Wanted()}

    def listed(self, rel: str) -> list[tuple[str, bool]]:
        """Name and whether it is a folder of everything in a folder, hidden names left out."""
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        found = store.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/"), allow_not_found=True))
        return sorted((x.base_name, x.type == fs.FileType.Directory) for x in found if x.base_name[0] not in "_.")

    def text(self, rel: str) -> str:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        with store.open_input_stream(f"{base}/{rel}") as file:
            return file.read().decode("utf-8")

    def opens(self, rel: str) -> bool:
        return (not self.depth or rel.count("/") + 1 < self.depth) and self.wanted["rel"].below(f"{rel}/") and self.wanted["key"].below(rel.replace("/", ""))

    def partitions(self) -> list[InputPartition]:
        return [_Top(""), *(_Top(name) for name, folder in self.listed("") if folder and self.opens(name))]

    def read(self, partition: _Top) -> Iterator[tuple[str, str, str]]:
        todo = [partition.name]
        while todo:
            at = todo.pop()
            for name, folder in self.listed(at):
                rel = f"{at}/{name}" if at else name
                if folder:
                    if at and self.opens(rel):
                        todo.append(rel)
                elif self.takes(rel, name):
                    yield rel, rel.replace("/", ""), self.text(rel)

    def takes(self, rel: str, name: str) -> bool:
        levels = rel.count("/") + 1
        return (not self.depth or levels == self.depth) and fnmatchcase(name, self.names) and self.wanted["rel"].has(rel) and self.wanted["key"].has(rel.replace("/", ""))


class PruningReader(TreeReader):
    """Takes filters from the query; Spark asks for none where the session does not allow it, and then this class fails."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = self.wanted.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if column is None:
                yield f
            elif isinstance(f, EqualTo):
                column.add([f.value], False)
            elif isinstance(f, In):
                column.add(f.value, False)
            elif isinstance(f, StringStartsWith):
                column.add([f.value], True)
            else:
                yield f


class ShardTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shard_tree"

    def schema(self) -> str:
        return "rel string, key string, raw string"

    def reader(self, schema) -> DataSourceReader:
        return (PruningReader if self.options.get("prune") == "true" else TreeReader)(dict(self.options))


def shard_tree(spark: SparkSession, root: str, depth: int = 0, names: str = "*") -> DataFrame:
    """rel, key and raw of the files under root, a URI or an absolute path that all executors reach."""
    spark.dataSource.register(ShardTree)
    prune = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format("shard_tree").option("path", root).option("depth", depth).option("names", names).option("prune", prune).load()
