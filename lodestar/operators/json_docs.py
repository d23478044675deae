"""JSON documents: fields by dotted path, and leaves of any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import checked


def _parts(field: str) -> list[str]:
    """The names of a dotted field; a backslash makes the next dot, or backslash, part of a name."""
    return [re.sub(r"\\(.)", r"\1", p) for p in re.findall(r"(?:^|\.)((?:\\.|[^.\\])*)", field)]


def _at(doc: Column, field: str, kind: str) -> Column:
    """What stands at a field, as ``kind``. Names may hold any characters: quotes of one sort go into a path, of both into a map."""
    way = ""
    for name in _parts(field):
        if "'" not in name or '"' not in name:
            quote = '"' if "'" in name else "'"
            way += f"[{quote}{name}{quote}]"
        else:
            within = F.try_variant_get(doc, "$" + way, "map<string,variant>")
            doc, way = F.try_element_at(within, F.lit(name)), ""
    return F.try_variant_get(doc, "$" + way, kind)


def leaf(doc: Column, field: str) -> Column:
    """The text of a leaf, by dotted path; null where there is none or an object or array stands there."""
    parsed = F.try_parse_json(doc)
    inner = F.schema_of_variant(_at(parsed, field, "variant"))
    return F.when(~(inner.startswith("OBJECT") | inner.startswith("ARRAY")), _at(parsed, field, "string"))


def filter_field(docs: DataFrame, field: str, value: str, doc: str = "doc") -> DataFrame:
    """The documents whose leaf has this text; numbers and booleans compare by their text."""
    return docs.filter(F.coalesce(leaf(F.col(doc), field) == F.lit(value), F.lit(False)))


def flatten(text: str | None, strict: bool = False) -> dict[str, str]:
    """Dotted paths to the text of leaves; array members count as leaves under the array's path, or raise if ``strict``."""
    out: dict[str, str] = {}

    def said(v: object) -> str:
        return v if isinstance(v, str) else json.dumps(v)

    def walk(node: object, path: str) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, f"{path}.{k}" if path else k)
        elif isinstance(node, list):
            if strict:
                raise ValueError(f"an array at {path!r}")
            for i, v in enumerate(node):
                walk(v, f"{path}[{i}]")
        elif node is None:
            if strict:
                raise ValueError(f"a null at {path!r}")
        else:
            out[path] = said(node)

    try:
        node = json.loads(text) if text else {}
    except ValueError:
        return out
    walk(node, "")
    return out


def nest(flat: dict[str, str]) -> dict:
    """The object of dotted paths; paths of array members stay keys, and so does what follows a path that is a leaf itself.

    ``flatten`` of the object gives the same paths again.
    """
    out: dict = {}
    for path, v in sorted(flat.items(), key=lambda x: (x[0].count("."), x[0])):
        names, at = path.split("."), out
        while len(names) > 1 and isinstance(at.setdefault(names[0], {}), dict):
            at = at[names.pop(0)]
        at[".".join(names)] = v
    return out


def leaves(docs: DataFrame, keys: list[str], doc: str = "doc", strict: bool = False) -> DataFrame:
    """A row for each leaf: ``keys``, ``path``, ``leaf``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, p, v) for i, d in enumerate(batch.column("__doc").to_pylist()) for p, v in flatten(d, strict).items()]
            took = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(took) for k in keys), *(pa.array([x[c] for x in found], pa.string()) for c in (1, 2))], [*keys, "path", "leaf"])

    made = docs.select(*keys).withColumns({"path": F.lit(""), "leaf": F.lit("")})
    return docs.select(*keys, F.col(doc).alias("__doc")).mapInArrow(walk, made.schema)


def search(docs: DataFrame, query: str, key: str = "id", doc: str = "doc") -> DataFrame:
    """``key`` of documents in which a leaf contains the literal; names of fields aren't searched, nor across leaves."""
    # escapes may hide a literal in the JSON text, so only a text without them can be told apart before parsing
    maybe = F.col(doc).contains(checked(query)) | F.col(doc).contains("\\")
    return leaves(docs.filter(maybe), [key], doc).filter(F.col("leaf").contains(query)).select(key).distinct()


def with_id(docs: DataFrame, key: str = "id", doc: str = "doc") -> DataFrame:
    """``key`` and ``doc`` with the id as a field of the document, in place of any of that name."""
    fields = F.from_json(F.to_json(F.try_parse_json(F.col(doc))), "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: k != "id")
    full = F.map_concat(kept, F.create_map(F.lit("id"), F.parse_json(F.col(key).cast("string"))))
    return docs.select(F.col(key), F.to_json(full).alias("doc"))


def widened_schema(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row, ``schema``: the types of all fields over all documents, widened where they differ."""
    return docs.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(doc))).alias("schema"))
