"""Adjacency-table shredding of nested JSON payloads (problem 1).

A payload becomes an ordered, labelled tree: each object member is a child whose label is
the member's name; the elements of an array are children of the array's owner that share
the member's label and differ in `ordinal`. A lone object or scalar where others hold an
array is therefore the child with ordinal 0, without special treatment. A null element
gives no node but uses up its ordinal.

`shred` stores the tree as an adjacency table (node, parent, label, ordinal, scalar);
`entities` joins object nodes with their scalar children and pivots the scalars into one
row per entity. A tree never leaves its input row, so both run where the payload was read:
parent pointers are positions inside the Arrow batch, the join is a gather on them, and
nothing is shuffled however many rows one source or record has.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_OBJECT, _SCALAR = 0, 1


def parse_payload(text: str | None) -> dict | None:
    """The payload as a dict; None if it is null, cannot be parsed, or holds no object.

    A JSON text that itself holds the payload counts as that payload, at any depth.
    """
    value: object = text
    try:
        while isinstance(value, str):
            value = json.loads(value)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def scalar_text(value: object) -> str:
    """A scalar as text; lone surrogates, which no column can hold, become '?'."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-8", "replace").decode("utf-8")
    return json.dumps(value)


class Adjacency:
    """The adjacency table of a batch of payloads, column by column."""

    def __init__(self) -> None:
        self.record: list[int] = []
        self.node: list[int] = []
        self.parent_row: list[int] = []
        self.label: list[str] = []
        self.ordinal: list[int] = []
        self.kind: list[int] = []
        self.scalar: list[str | None] = []

    def add(self, record: int, payload: dict) -> None:
        """Append one tree in depth-first order; node ids count from 0 within the record."""
        first = len(self.node)
        stack: list[tuple[int, str, int, object]] = [(-1, "", 0, payload)]
        while stack:
            parent, label, ordinal, value = stack.pop()
            row = len(self.node)
            self.record.append(record)
            self.node.append(row - first)
            self.parent_row.append(parent)
            self.label.append(label)
            self.ordinal.append(ordinal)
            if isinstance(value, dict):
                self.kind.append(_OBJECT)
                self.scalar.append(None)
                for name, child in reversed(value.items()):
                    if isinstance(child, list):
                        for i in range(len(child) - 1, -1, -1):
                            if child[i] is not None:
                                stack.append((row, name, i, child[i]))
                    elif child is not None:
                        stack.append((row, name, 0, child))
            elif isinstance(value, list):  # an array directly inside an array
                self.kind.append(_OBJECT)
                self.scalar.append(None)
                for i in range(len(value) - 1, -1, -1):
                    if value[i] is not None:
                        stack.append((row, label, i, value[i]))
            else:
                self.kind.append(_SCALAR)
                self.scalar.append(scalar_text(value))


def shred(df: DataFrame, key: str, payload: str) -> DataFrame:
    """The adjacency table of df[payload]: one row per node of every readable payload.

    Columns: `key` as in df, node int (0 is the root), parent int (-1 for the root), label
    string, ordinal int, is_object boolean, scalar string (null for objects). Payloads that
    are null or unreadable give no rows; `{}` gives its root alone; an empty table gives none.
    Other columns of df are not read. Rows with a null key keep the null.
    """
    from pyspark.sql import functions as F

    source = df.select(F.col(key).alias("rec"), F.col(payload).cast("string").alias("payload"))
    kind = source.schema["rec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                table = Adjacency()
                for i, text in enumerate(part.column(1).to_pylist()):
                    if (tree := parse_payload(text)) is not None:
                        table.add(i, tree)
                parent_row = np.asarray(table.parent_row, np.int64)
                node = np.asarray(table.node, np.int32)
                parent = np.where(parent_row < 0, -1, node[parent_row]) if len(node) else node
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(table.record, pa.int32())),
                        pa.array(node),
                        pa.array(parent.astype(np.int32)),
                        pa.array(table.label, pa.string()),
                        pa.array(table.ordinal, pa.int32()),
                        pa.array(np.asarray(table.kind, np.int8) == _OBJECT),
                        pa.array(table.scalar, pa.string()),
                    ],
                    names=["rec", "node", "parent", "label", "ordinal", "is_object", "scalar"],
                )

    return source.mapInArrow(run, f"rec {kind}, node int, parent int, label string, ordinal int, is_object boolean, scalar string").withColumnRenamed("rec", key)


class Entity:
    """One entity table: where its nodes hang, and which scalar names it.

    path: labels from the root, e.g. ("authorships", "institutions").
    text: alternatives for item_text, each a label path below the node; () is the node's own
    scalar. The first that exists wins, '' if none does.
    """

    def __init__(self, kind: str, path: tuple[str, ...], text: Iterable[tuple[str, ...]]) -> None:
        self.kind, self.path, self.text = kind, path, tuple(text)


#: The entities of the three providers' payloads.
PAPER_ENTITIES = (
    Entity("author", ("authorships",), [("author", "display_name"), ("author",), ()]),
    Entity("author", ("authors",), [("name",), ()]),
    Entity("affiliation", ("authorships", "institutions"), [("display_name",), ()]),
    Entity("affiliation", ("authors", "affiliations"), [("display_name",), ("name",), ()]),
    Entity("affiliation", ("authors", "affiliation"), [("display_name",), ("name",), ()]),
    Entity("location", ("locations",), [("landing_page_url",)]),
    Entity("reference", ("referenced_works",), [()]),
    Entity("reference", ("references",), [("paperId",), ()]),
    Entity("ref_author", ("references", "authors"), [("name",), ()]),
)


def _pivot(table: Adjacency, specs: Iterable[Entity]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, row of the entity's node, row of its parent entity or -1, text) of each entity table of a batch."""
    parent_row = np.asarray(table.parent_row, np.int64)
    code: dict[str, int] = {}
    label = np.asarray([code.setdefault(name, len(code)) for name in table.label], np.int32)
    is_scalar = np.asarray(table.kind, np.int8) == _SCALAR
    ordinal = np.asarray(table.ordinal, np.int32)
    scalar = np.asarray(table.scalar, dtype=object)
    rows = np.arange(len(parent_row))

    def children(of: np.ndarray, name: str) -> np.ndarray:
        """Rows labelled name whose parent is in the mask."""
        if name not in code:
            return rows[:0]
        at = rows[label == code[name]]
        return at[of[parent_row[at]]]

    for spec in specs:
        mask = parent_row < 0
        for name in spec.path:
            nodes = children(mask, name)
            mask = np.zeros(len(rows), bool)
            mask[nodes] = True
        if not len(nodes):
            continue
        text = np.full(len(rows), None, dtype=object)
        for way in reversed(spec.text):  # the join of object nodes with their scalar children, best last
            owner, at = rows[mask], rows[mask]
            for name in way:
                below = np.zeros(len(rows), bool)
                below[at] = True
                top = np.full(len(rows), -1, np.int64)
                top[at] = owner
                found = children(below, name)
                found = found[ordinal[found] == 0]
                owner, at = top[parent_row[found]], found
            keep = is_scalar[at]
            text[owner[keep]] = scalar[at[keep]]
        yield spec.kind, nodes, parent_row[nodes] if len(spec.path) > 1 else np.full(len(nodes), -1), text[nodes]


def _scalars_below(table: Adjacency, nodes: np.ndarray) -> dict[int, list[tuple[str, str]]]:
    """The scalars below each entity node, by their label paths, those of further entities below it left out.

    A label of several scalars carries their ordinals from the second on: lineage, lineage[1].
    """
    own = set(nodes.tolist())
    owner, name = [-1] * len(table.node), [""] * len(table.node)
    found: dict[int, list[tuple[str, str]]] = {n: [] for n in own}
    # parents come before their children
    for row, (parent, label, ordinal, kind) in enumerate(zip(table.parent_row, table.label, table.ordinal, table.kind, strict=True)):
        if row in own:
            owner[row] = row
            if kind == _SCALAR:
                found[row].append(("", table.scalar[row]))
        elif parent >= 0 and owner[parent] >= 0:
            owner[row] = owner[parent]
            label = f"{label}[{ordinal}]" if ordinal else label
            name[row] = f"{name[parent]}.{label}" if name[parent] else label
            if kind == _SCALAR:
                found[owner[row]].append((name[row], table.scalar[row]))
    return found


def entities(df: DataFrame, key: str, payload: str, specs: Iterable[Entity] = PAPER_ENTITIES, scalars: bool = False) -> DataFrame:
    """Entity rows of every readable payload, with their link to the parent entity.

    scalars: also the column scalars map<string,string>, all scalars of the entity by label
    path (author_position, author.id, lineage, lineage[1]), '' being its own value; of paths
    that occur twice, as by labels with dots in them, the first stays.

    Columns: `key`, kind string, node int, parent int (node of the parent entity, -1 for
    top-level entities), pos int (ordinal of the top-level entity), sub_pos int (ordinal
    within the parent, -1 for top-level entities), item_text string ('' where the naming
    scalar is missing or null). Null elements give no row but keep their place; null,
    unreadable and empty payloads and empty tables give no rows; extra columns are not read.
    """
    from pyspark.sql import functions as F

    source = df.select(F.col(key).alias("rec"), F.col(payload).cast("string").alias("payload"))
    kind_of_key = source.schema["rec"].dataType.simpleString()
    specs = tuple(specs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                table = Adjacency()
                for i, text in enumerate(part.column(1).to_pylist()):
                    if (tree := parse_payload(text)) is not None:
                        table.add(i, tree)
                if not table.node:
                    continue
                record, node, ordinal = (np.asarray(x, np.int32) for x in (table.record, table.node, table.ordinal))
                found = list(_pivot(table, specs))
                below = _scalars_below(table, np.concatenate([x[1] for x in found])) if scalars and found else {}
                for kind, nodes, parents, text in found:
                    nested = parents >= 0
                    more = [pa.array([list({k: v for k, v in reversed(below[n])}.items())[::-1] for n in nodes.tolist()], pa.map_(pa.string(), pa.string()))] if scalars else []
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(record[nodes])),
                            pa.array([kind] * len(nodes), pa.string()),
                            pa.array(node[nodes]),
                            pa.array(np.where(nested, node[parents], -1).astype(np.int32)),
                            pa.array(np.where(nested, ordinal[parents], ordinal[nodes]).astype(np.int32)),
                            pa.array(np.where(nested, ordinal[nodes], -1).astype(np.int32)),
                            pa.array(["" if t is None else t for t in text], pa.string()),
                            *more,
                        ],
                        names=["rec", "kind", "node", "parent", "pos", "sub_pos", "item_text", "scalars"][: 7 + scalars],
                    )

    schema = f"rec {kind_of_key}, kind string, node int, parent int, pos int, sub_pos int, item_text string" + (", scalars map<string,string>" if scalars else "")
    return source.mapInArrow(run, schema).withColumnRenamed("rec", key)
