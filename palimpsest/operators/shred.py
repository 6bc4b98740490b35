"""Problem 2: deeply nested semi-structured records to related flat tables.

Columnar shredding: every leaf path of a declared schema becomes a column of (repetition level, definition level,
value) entries, for a whole batch of records at once. The table of any repeated ancestor is then rebuilt from the level
sequences alone: an entry of the ancestor starts wherever the repetition level is at most the ancestor's, it exists
wherever the definition level reaches the ancestor's, and running counts of those starts give the links to the parents.

Writers differ, so the schema also says under which other names a field comes, and a repeated field may arrive as a
list, as an object keyed by one of its fields, as a single object, or any of these as JSON text inside a string.

Defined results: a record that is null, no complete JSON, or without the wanted root gives no rows; a null entry of a
repeated field gives no row; neither does an entry without the field named ``needs``; absent optional fields are null;
a repeated record gives its rows again under its own key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_CAMEL = re.compile(r"(?<=[a-z0-9])([A-Z])")


def snake(name: str) -> str:
    return _CAMEL.sub(r"_\1", name).lower()


@dataclass
class Node:
    """A field. ``repeated``: an array. ``fields``: none for a leaf. ``key``: for a repeated field that comes as an
    object, the leaf its keys go to; ``value``: the leaf plain values of such an object go to; ``needs``: the leaf whose
    null means that the entry itself has a null value."""

    name: str
    fields: list[Node] = field(default_factory=list)
    repeated: bool = False
    key: str | None = None
    value: str | None = None
    needs: str | None = None
    cast: Callable = lambda v: v
    level: int = 0
    depth: int = 0
    path: tuple[str, ...] = ()

    def bind(self, path: tuple[str, ...] = (), level: int = 0, depth: int = 0) -> Node:
        """Set repetition and definition levels: ``level`` counts repeated steps, ``depth`` repeated and optional ones."""
        self.path = (*path, self.name) if self.name else path
        self.level = level + self.repeated
        self.depth = depth + bool(self.name)
        for f in self.fields:
            f.bind(self.path, self.level, self.depth)
        return self

    def leaves(self) -> list[Node]:
        return [self] if not self.fields else [x for f in self.fields for x in f.leaves()]


def parsed(value: object) -> object:
    """JSON text inside strings, however often it was wrapped: each time it gets shorter."""
    while isinstance(value, str) and value[:1] in '{["':
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def _named(obj: dict) -> dict:
    return {snake(k): v for k, v in obj.items()}


def _entries(node: Node, value: object) -> list[dict]:
    """The non-null entries of a repeated field of objects in any of the forms writers use, as objects."""
    value = parsed(value)
    if isinstance(value, list):
        found = [x for x in map(parsed, value) if isinstance(x, dict)]
        out = [_named(x) for x in found]
    elif isinstance(value, dict):
        names, own = _named(value), {f.name for f in node.fields}
        if names.keys() & own:
            out = [names]
        else:
            out = []
            for k, x in value.items():
                x = parsed(x) if node.value is None else x
                if isinstance(x, dict):
                    x = _named(x)
                    out.append({node.key: k} | {a: b for a, b in x.items() if a != node.key or b is not None} if node.key else x)
                elif x is not None and node.value:
                    out.append({node.key: k, node.value: x})
    else:
        return []
    return [x for x in out if x.get(node.needs) is not None] if node.needs else out


class Columns:
    """The shredded columns of a batch: per leaf path its repetition levels, definition levels and values."""

    def __init__(self, root: Node) -> None:
        self.root = root
        self.data: dict[tuple[str, ...], tuple[list[int], list[int], list]] = {x.path: ([], [], []) for x in root.leaves()}

    def add(self, record: object) -> None:
        """One record; None (no such record) leaves one entry of definition level 0 per column."""
        if isinstance(record, dict):
            self._fields(self.root, _named(record), 0)
        else:
            self._absent(self.root, 0, 0)

    def _absent(self, node: Node, r: int, d: int) -> None:
        for x in node.leaves():
            rs, ds, vs = self.data[x.path]
            rs.append(r)
            ds.append(d)
            vs.append(None)

    def _fields(self, node: Node, obj: dict, r: int) -> None:
        for f in node.fields:
            value = obj.get(f.name)
            if not f.repeated:
                if f.fields:
                    value = parsed(value)
                    if isinstance(value, dict):
                        self._fields(f, _named(value), r)
                    else:
                        self._absent(f, r, node.depth)
                else:
                    rs, ds, vs = self.data[f.path]
                    rs.append(r)
                    ds.append(f.depth if value is not None else node.depth)
                    vs.append(f.cast(value) if value is not None else None)
            elif f.fields:
                entries = _entries(f, value)
                if not entries:
                    self._absent(f, r, node.depth)
                for i, x in enumerate(entries):
                    self._fields(f, x, r if i == 0 else f.level)
            else:
                items = parsed(value)
                items = [x for x in items if x is not None] if isinstance(items, list) else []
                if not items:
                    self._absent(f, r, node.depth)
                rs, ds, vs = self.data[f.path]
                for i, x in enumerate(items):
                    rs.append(r if i == 0 else f.level)
                    ds.append(f.depth)
                    vs.append(f.cast(x))

    def table(self, node: Node) -> dict[str, np.ndarray]:
        """The rows of repeated ``node``: ``record`` (index of the record), one ``<ancestor>_ord`` per repeated
        ancestor and the node itself, every plain leaf of the ancestors (named ``<ancestor>.<leaf>``) and of the node.
        Leaves repeated below the node come as arrays."""
        lead = next(x for x in node.leaves())
        rs, ds = (np.asarray(x, dtype=np.int64) for x in self.data[lead.path][:2])
        starts = rs <= node.level
        there = starts & (ds >= node.depth)
        out: dict[str, np.ndarray] = {"record": (np.cumsum(rs == 0) - 1)[there]}
        for up in self._ancestors(node):
            # position of the ancestor's entry among all entries of that level, then counted from its parent's first
            at = np.cumsum(rs <= up.level) - 1
            firsts = np.flatnonzero(rs <= up.level)
            parents = rs[firsts] <= up.level - 1
            begun = np.maximum.accumulate(np.where(parents, np.arange(len(firsts)), 0)) if len(firsts) else np.zeros(0, dtype=np.int64)
            out[f"{up.name}_ord"] = (at - begun[at] if len(firsts) else at)[there]
            for f in up.fields:
                if f.fields:
                    continue
                own_r, own_v = np.asarray(self.data[f.path][0], dtype=np.int64), np.empty(len(self.data[f.path][2]), dtype=object)
                own_v[:] = self.data[f.path][2]
                if not f.repeated:
                    out[f.name if up is node else f"{up.name}.{f.name}"] = own_v[own_r <= up.level][at][there]
                elif up is node:
                    firsts = np.flatnonzero(own_r <= up.level)
                    ends = np.append(firsts[1:], len(own_r))
                    full = np.asarray(self.data[f.path][1], dtype=np.int64) >= f.depth
                    lists = np.empty(len(firsts), dtype=object)
                    for i, (a, b) in enumerate(zip(firsts, ends)):
                        lists[i] = [v for v, k in zip(own_v[a:b], full[a:b]) if k]
                    out[f.name] = lists[at][there]
        return out

    def _ancestors(self, node: Node) -> list[Node]:
        found: list[Node] = []

        def walk(x: Node, over: list[Node]) -> None:
            over = [*over, x] if x.repeated else over
            if x is node:
                found.extend(over)
            for f in x.fields:
                walk(f, over)

        walk(self.root, [])
        return found


def _decimal(v: object) -> float | None:
    try:
        return float(v) if not isinstance(v, bool) else None  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return None


def _whole(v: object) -> int | None:
    """A whole number of 64 bits, without going through a float where it is written as one."""
    try:
        if isinstance(v, bool):
            return None
        n = int(v) if isinstance(v, int) or (isinstance(v, str) and v.strip().lstrip("+-").isdigit()) else int(float(v))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return None
    return n if -(2**63) <= n < 2**63 else None


def _text(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def _flag(v: object) -> bool | None:
    return v if isinstance(v, bool) else {"true": True, "false": False, "1": True, "0": False}.get(str(v).lower())


def processing_log_schema() -> Node:
    """The audit log of a job: pages, their regions, engine durations and specialist dispatches."""
    num, whole = _decimal, _whole
    return Node("", [
        Node("pages", [
            Node("page_num", cast=whole), Node("is_ground_truth", cast=_flag), Node("region_count", cast=whole), Node("estimated_cost_usd", cast=num),
            Node("regions", [
                Node("region_id", cast=_text), Node("element_type", cast=_text), Node("bounding_box", repeated=True, cast=num), Node("engines_ran", repeated=True, cast=_text),
                Node("resolution", cast=_text), Node("confidence", cast=num), Node("ce_value", cast=num), Node("llm_invoked", cast=_flag), Node("hitl_flag", cast=_flag),
            ], repeated=True, key="region_id"),
            Node("engine_durations", [Node("engine", cast=_text), Node("seconds", cast=num)], repeated=True, key="engine", value="seconds", needs="seconds"),
            Node("specialist_dispatches", [Node("specialist", cast=_text), Node("count", cast=whole)], repeated=True, key="specialist", value="count", needs="count"),
        ], repeated=True, key="page_num"),
        Node("total_duration_s", cast=num), Node("total_cost_usd", cast=num),
    ]).bind()


def unwrap(value: object, root: Node, inside: tuple[str, ...] = ("processing_log", "result", "log", "data", "payload")) -> dict | None:
    """The object that has the schema's fields, however many objects or strings writers put around it."""
    names = {f.name for f in root.fields}
    value = parsed(value)
    while isinstance(value, dict):
        own = _named(value)
        if own.keys() & names:
            return own
        value = next((parsed(own[k]) for k in inside if k in own), None)
    return None


def shred(texts: pd.Series, root: Node) -> Columns:
    columns = Columns(root)
    for t in texts:
        try:
            value = json.loads(t)
        except (TypeError, ValueError, RecursionError):
            value = None
        columns.add(unwrap(value, root))
    return columns


def node_at(root: Node, path: str) -> Node:
    node = root
    for name in path.split("."):
        node = next(f for f in node.fields if f.name == name)
    return node


#: Tables of the log: name -> (path of the repeated ancestor, output columns after the key: name, type, source).
TABLES = {
    "pages": ("pages", [("page_ord", "int", "pages_ord"), ("page_num", "long", "page_num"), ("is_ground_truth", "boolean", "is_ground_truth"), ("region_count", "long", "region_count"), ("estimated_cost_usd", "double", "estimated_cost_usd")]),
    "regions": ("pages.regions", [("page_ord", "int", "pages_ord"), ("page_num", "long", "pages.page_num"), ("region_ord", "int", "regions_ord"), ("region_id", "string", "region_id"), ("element_type", "string", "element_type"), ("bounding_box", "array<double>", "bounding_box"), ("engines_ran", "array<string>", "engines_ran"), ("resolution", "string", "resolution"), ("confidence", "double", "confidence"), ("ce_value", "double", "ce_value"), ("llm_invoked", "boolean", "llm_invoked"), ("hitl_flag", "boolean", "hitl_flag")]),
    "engine_durations": ("pages.engine_durations", [("page_ord", "int", "pages_ord"), ("page_num", "long", "pages.page_num"), ("entry_ord", "int", "engine_durations_ord"), ("engine", "string", "engine"), ("seconds", "double", "seconds")]),
    "specialist_dispatches": ("pages.specialist_dispatches", [("page_ord", "int", "pages_ord"), ("page_num", "long", "pages.page_num"), ("entry_ord", "int", "specialist_dispatches_ord"), ("specialist", "string", "specialist"), ("count", "long", "count")]),
}


def log_table(jobs: DataFrame, name: str, key: str = "result_key", text: str = "processing_log") -> DataFrame:
    """Flat table ``name`` of ``TABLES`` with the key of the job result and the ordinal and number of the page as links."""
    path, wanted = TABLES[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = processing_log_schema()
        node = node_at(root, path)
        for pdf in batches:
            rows = shred(pdf[text], root).table(node)
            yield pd.DataFrame({key: pdf[key].to_numpy()[rows["record"]]} | {n: pd.Series(rows[source], dtype="int32" if kind == "int" else object) for n, kind, source in wanted})

    return jobs.select(key, text).mapInPandas(run, ", ".join([f"{key} long", *(f"{n} {kind}" for n, kind, _ in wanted)]))


def log_records(jobs: DataFrame, key: str = "result_key", text: str = "processing_log") -> DataFrame:
    """One row per record of each log: key, page_num, child_kind (page, region, duration, dispatch), child_id; all four tables from one shredding of the text."""
    kinds = {"page": ("pages", "page_num", None), "region": ("pages.regions", "pages.page_num", "region_id"), "duration": ("pages.engine_durations", "pages.page_num", "engine"), "dispatch": ("pages.specialist_dispatches", "pages.page_num", "specialist")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = processing_log_schema()
        for pdf in batches:
            columns, keys = shred(pdf[text], root), pdf[key].to_numpy()
            for kind, (path, number, child) in kinds.items():
                rows = columns.table(node_at(root, path))
                n = len(rows["record"])
                yield pd.DataFrame({key: keys[rows["record"]], "page_num": pd.Series(rows[number], dtype=object), "child_kind": pd.Series([kind] * n, dtype=object), "child_id": pd.Series(rows[child] if child else [""] * n, dtype=object)})

    return jobs.select(key, text).mapInPandas(run, f"{key} long, page_num long, child_kind string, child_id string")
