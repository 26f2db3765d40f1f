"""Shredding of irregular nested records into linked flat tables, one typed table per shape variant.

A bottom-up tree automaton reads each parsed record. Its states are shapes: a scalar's state is its type, a list's state is
the union of its items' states, and an object's state follows from the states of its fields by one transition; lists of
child entities collapse to the state ``[]``, so the number of states depends on the fields that occur, never on how many
items a record holds or how deep it goes. An object's state is written as a schema string, which makes states equal on
every executor without any exchange, and which :func:`variant_table` turns into the typed schema of that variant's table.

:func:`shred` emits one row per object with the common supertype keys (record id, entity, path, parent path, position,
label, text) and the variant its state names. :func:`route` writes each variant's rows to that variant's own part of the
shared folder, in one job; :class:`Routed` then gives the common supertype over all of them, the typed subtype table of any
variant, reading nothing but its part, and the typed table over all variants of an entity. Parent links are the pair (id,
parent_path); a root has no parent, in the common table its parent path is the empty path.

Defined cases: a null, empty or unparsable text, or one whose root is no object, gives no rows; a text that holds another
JSON text (encoded twice) is decoded again, also for child lists; a single object or a wrapper object stands for a list;
nulls in a list take a position and give no row; scalars in a list give a row of variant ``scalar``; an absent, null or
empty list gives no rows; repeated records give their rows once per record; extra columns are ignored. Child lists may nest as deep as the parser
reads; an object whose other fields nest beyond the interpreter's depth gets the variant ``deep`` and no typed fields.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import shared_dir

NODE = "id bigint, entity string, path string, parent_path string, pos int, variant string, label string, text string, attributes string"
_TYPES = [pa.int64(), *[pa.string()] * 3, pa.int32(), *[pa.string()] * 4]
_NAMES = [c.split()[0] for c in NODE.split(", ")]


@dataclass(frozen=True)
class Grammar:
    """Which fields hold child entities. ``lists``: plural field -> (singular wrapper, entity)."""

    root: str = "section"
    root_wrappers: tuple[str, ...] = ("debateSection",)
    lists: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "debateSections": ("debateSection", "subsection"),
            "contributions": ("contribution", "contribution"),
            "paragraphs": ("paragraph", "paragraph"),
            "references": ("reference", "reference"),
            "divisions": ("division", "division"),
            "votes": ("vote", "vote"),
        }
    )
    labels: tuple[str, ...] = ("debateSectionId", "divisionId", "uri", "num", "side")
    texts: tuple[str, ...] = ("text", "showAs")


DEBATES = Grammar()


def _decode(value):
    """A string that holds a JSON object or list is read as that, however often it was encoded; anything unreadable is None."""
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def _unwrap(value, wrapper: str):
    while isinstance(value, dict) and len(value) == 1 and wrapper in value:
        value = _decode(value[wrapper]) if isinstance(value[wrapper], str) else value[wrapper]
    return value


def _items(value, wrapper: str) -> list:
    """The items of a child list in whatever form it came; None for a position without an object."""
    value = _unwrap(_decode(value), wrapper)
    if isinstance(value, list):
        out = []
        for item in value:
            inner = _unwrap(item, wrapper)
            out.extend(inner) if isinstance(inner, list) and isinstance(item, dict) else out.append(inner)
        return out
    return [] if value is None else [value]


class ShapeAutomaton:
    """Deterministic bottom-up automaton; :meth:`state` is the state of any value, transitions are kept once made."""

    def __init__(self, grammar: Grammar) -> None:
        self.children = grammar.lists
        self.moves: dict[tuple, str] = {}

    def state(self, value) -> str:
        if value is None:
            return "void"
        if isinstance(value, str):
            return "string"
        if isinstance(value, bool):
            return "boolean"
        if isinstance(value, int):
            return "bigint" if -(2**63) <= value < 2**63 else "double"
        if isinstance(value, float):
            return "double"
        if isinstance(value, list):
            return self._move(("list", *sorted({self.state(x) for x in value})))
        return self._move(("object", *((k, "[]" if k in self.children else self.state(value[k])) for k in sorted(value))))

    def _move(self, read: tuple) -> str:
        to = self.moves.get(read)
        if to is None:
            kind, *rest = read
            if kind == "list":
                kinds = [s for s in rest if s != "void"]
                to = f"array<{kinds[0] if len(kinds) == 1 else 'string'}>"
            else:
                to = "struct<" + ",".join(f"`{k.replace('`', '``')}`:{s}" for k, s in rest) + ">"
            self.moves[read] = to
        return to


class _Shredder:
    def __init__(self, grammar: Grammar, attributes: bool) -> None:
        self.grammar, self.attributes, self.automaton = grammar, attributes, ShapeAutomaton(grammar)

    def record(self, key: int, text: str | None) -> Iterator[tuple]:
        root = _decode(text) if text is not None else None
        for wrapper in self.grammar.root_wrappers:
            root = _unwrap(root, wrapper)
        if not isinstance(root, dict):
            return
        # a stack of our own: depth is bounded by the data, not by the interpreter
        stack = [(root, self.grammar.root, "", None, 0)]
        while stack:
            node, entity, path, parent, pos = stack.pop()
            yield self._row(key, node, entity, path, parent, pos)
            if not isinstance(node, dict):
                continue
            for plural, (wrapper, kind) in self.grammar.lists.items():
                if plural in node:
                    base = f"{path}/{plural}" if path else plural
                    stack.extend((item, kind, f"{base}/{i}", path, i) for i, item in enumerate(_items(node[plural], wrapper)) if item is not None)

    def _row(self, key, node, entity, path, parent, pos) -> tuple:
        if not isinstance(node, dict):
            return key, entity, path, parent, pos, "scalar", None, node if isinstance(node, str) else json.dumps(node), None
        first = lambda names: next((node[n] for n in names if isinstance(node.get(n), (str, int))), None)
        label, text = first(self.grammar.labels), first(self.grammar.texts)
        try:
            variant = self.automaton.state(node)
            own = json.dumps({k: v for k, v in node.items() if k not in self.grammar.lists}, ensure_ascii=False) if self.attributes else None
        except RecursionError:
            variant, own = "deep", None
        return key, entity, path, parent, pos, variant, None if label is None else str(label), None if text is None else str(text), own


def shred(df: DataFrame, key: str, payload: str, grammar: Grammar = DEBATES, attributes: bool = True) -> DataFrame:
    """One row per object of each record's tree. Narrow: a scan and one pass, no shuffle; hot keys do not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder = _Shredder(grammar, attributes)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

        for batch in batches:
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.extend(shredder.record(record, text))
                if len(rows) >= 8192:
                    yield out()
                    rows = []
        if rows:
            yield out()

    return df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{payload}`").cast("string").alias("payload")).mapInArrow(run, NODE)


def variants(nodes: DataFrame) -> DataFrame:
    """How many rows were routed to each variant: ``entity, variant, n``."""
    return nodes.groupBy("entity", "variant").agg(F.count(F.lit(1)).alias("n"))


def _schema(variant: str) -> T.StructType:
    return T._parse_datatype_string(variant.replace(":[]", ":string").replace(":void", ":string"))


_COMMON = ["id", "path", "parent_path", "pos", "label", "text"]


def variant_table(nodes: DataFrame, entity: str, variant: str) -> DataFrame:
    """The typed table of one variant: the common keys, and the variant's own fields as one typed struct ``own``."""
    rows = nodes.where((F.col("entity") == entity) & (F.col("variant") == variant))
    if variant in ("scalar", "deep"):
        return rows.select(*_COMMON)
    return rows.select(*_COMMON, F.from_json("attributes", _schema(variant)).alias("own"))


def entity_table(nodes: DataFrame, entity: str, fields: dict[str, str]) -> DataFrame:
    """The table over all variants of an entity: the common keys and ``fields`` (column -> JSON path), null where a variant lacks them."""
    return nodes.where(F.col("entity") == entity).select(*_COMMON, "variant", *(F.get_json_object("attributes", p).alias(c) for c, p in fields.items()))


class Routed:
    """Variant tables in the shared folder: one part per entity and variant, all with the common keys and parent links."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = spark.read.schema(f"{NODE}, variant_id string").parquet(path)

    def common(self) -> DataFrame:
        """The supertype: ``id, entity, path, parent_path, pos, label, text`` of every object, whatever its variant."""
        parent = F.coalesce("parent_path", F.lit(""))
        return self.rows.select("id", "entity", "path", parent.alias("parent_path"), "pos", "label", "text")

    def variants(self) -> DataFrame:
        return variants(self.rows)

    def table(self, entity: str, variant: str) -> DataFrame:
        """The typed table of one variant; only that variant's part is read."""
        part = F.hex(F.xxhash64(F.lit(variant)))
        return variant_table(self.rows.where(F.col("variant_id") == part), entity, variant)

    def entity(self, entity: str, fields: dict[str, str]) -> DataFrame:
        return entity_table(self.rows, entity, fields)


def route(nodes: DataFrame) -> Routed:
    """Every row of :func:`shred` to its variant's part. The rebalancing shuffle gathers a small variant into one file and
    splits a large one over many tasks, so neither a common shape nor thousands of rare ones weigh on one task."""
    path = f"{shared_dir(nodes.sparkSession).rstrip('/')}/variants-{uuid.uuid4().hex}"
    named = nodes.withColumn("variant_id", F.hex(F.xxhash64("variant")))
    named.hint("rebalance", "entity", "variant_id").write.partitionBy("entity", "variant_id").parquet(path)
    return Routed(nodes.sparkSession, path)
