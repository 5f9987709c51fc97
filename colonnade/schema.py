"""Column ids as ORC numbers them: pre-order positions in the schema tree, the root being 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

KINDS = {
    "boolean": "boolean", "tinyint": "byte", "smallint": "short", "int": "int", "bigint": "long", "float": "float", "double": "double",
    "string": "string", "binary": "binary", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}


@dataclass(frozen=True)
class Column:
    """One node of a schema: its id, dotted path, kind, parent and the last id below it."""

    id: int
    path: str
    kind: str
    parent: int | None
    last: int


def _kind(kind: DataType) -> str:
    name = kind.simpleString()
    if isinstance(kind, StructType):
        return "struct"
    if isinstance(kind, ArrayType):
        return "list"
    if isinstance(kind, MapType):
        return "map"
    base = name.split("(")[0]
    if base in ("decimal", "char", "varchar"):
        return base
    if base not in KINDS:
        raise ValueError(f"ORC has no type for {name}")
    return KINDS[base]


def _children(kind: DataType) -> list[tuple[str, DataType]]:
    if isinstance(kind, StructType):
        return [(f.name, f.dataType) for f in kind.fields]
    if isinstance(kind, ArrayType):
        return [("element", kind.elementType)]
    if isinstance(kind, MapType):
        return [("key", kind.keyType), ("value", kind.valueType)]
    return []


def flatten(schema: StructType) -> list[Column]:
    """All nodes of the schema in the order of their ids."""
    out: list[Column] = []

    def walk(path: str, kind: DataType, parent: int | None) -> int:
        own = len(out)
        out.append(Column(own, path, _kind(kind), parent, own))
        last = own
        for name, child in _children(kind):
            last = walk(f"{path}.{name}" if path else name, child, own)
        out[own] = Column(own, path, out[own].kind, parent, last)
        return last

    walk("", schema, None)
    return out


def schema_table(spark: SparkSession, schema: StructType) -> DataFrame:
    """The flat schema as rows: column_id, path, kind, parent_id."""
    return spark.createDataFrame([(c.id, c.path, c.kind, c.parent) for c in flatten(schema)], "column_id int, path string, kind string, parent_id int")


def names_of(schema: StructType, ids: list[int]) -> list[str]:
    """Dotted paths to select for a list of column ids; no ids select all columns.

    As in the file format's own projection an id doesn't pull in what is below it, and its parents must
    be listed. Ids inside lists and maps select the whole column they belong to.
    """
    columns = flatten(schema)
    if not ids:
        return [c.path for c in columns if c.parent == 0]
    wanted = set(ids)
    for i in wanted:
        if not 0 <= i < len(columns):
            raise ValueError(f"column id {i} is not in the schema of {len(columns)} columns")
        parent = columns[i].parent
        if parent is not None and parent not in wanted:
            raise ValueError(f"column id {i} ({columns[i].path}) is listed without its parent {parent}")
    out: list[str] = []

    def visit(c: Column) -> None:
        if c.kind != "struct":
            out.append(c.path)
            return
        for child in columns[c.id + 1 : c.last + 1]:
            if child.parent == c.id and child.id in wanted:
                visit(child)

    visit(columns[0])
    return out
