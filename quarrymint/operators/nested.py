"""Deeply nested records to related flat tables (problem 6), and merged-schema inference for JSON lines."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An object gets at most so many columns; its other fields are kept as JSON text in a column of their own.
MAX_FIELDS = 256
#: Field names that are counted for one object before the rarest are given up.
MAX_NAMES = 1 << 14
#: Column of what has no column of its own in an object: further fields, or a value that is no object.
REST = "_rest"
#: Containers nested deeper than this are kept as JSON text.
MAX_DEPTH = 24


# --- typed nested frames ---------------------------------------------------------------------------------------------


def array_paths(schema: T.StructType) -> list[tuple[str, ...]]:
    """Paths of every array or map level, outer before inner. Struct steps and array steps are both plain names;
    an array directly inside an array adds the step ``[]``."""
    out: list[tuple[str, ...]] = []

    def walk(kind: T.DataType, path: tuple[str, ...]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, (*path, f.name))
        elif isinstance(kind, T.ArrayType):
            out.append(path)
            walk(kind.elementType, (*path, "[]") if isinstance(kind.elementType, (T.ArrayType, T.MapType)) else path)
        elif isinstance(kind, T.MapType):
            out.append(path)
            walk(kind.valueType, (*path, "value"))

    walk(schema, ())
    return out


def _scalars(kind: T.DataType, col: Column, name: str) -> list[tuple[str, Column]]:
    """Named leaf columns of a value, structs flattened with ``_``; arrays and maps are left to their own tables."""
    if isinstance(kind, T.StructType):
        return [c for f in kind.fields for c in _scalars(f.dataType, col[f.name], f"{name}_{f.name}" if name else f.name)]
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return []
    return [(name or "value", col)]


def _unique(names: list[str], taken: set[str]) -> list[str]:
    out = []
    for n in names:
        m = n
        while m.lower() in taken:
            m += "_"
        taken.add(m.lower())
        out.append(m)
    return out


def child_table(df: DataFrame, key: str, path: Sequence[str]) -> DataFrame:
    """The flat table of one array level.

    Columns: ``parent_key`` (text of the parent row's key), ``ordinal`` (place in the parent array from 1), ``row_key``
    (``parent_key/ordinal``), ``root_key`` and ``positions`` (the ordinals from the outermost level down), then the
    element's scalar fields. Only the columns on the path are read. A null array or an empty one has no rows; a null
    element keeps its place as a row of nulls. Field names that clash with the link columns, or with each other in
    letter case, get ``_`` appended.
    """
    steps = list(path)
    kind: T.DataType = df.schema
    value: Column | None = None
    cur = df
    links = [F.col(f"`{key}`").cast("string").alias("__root"), F.array().cast("array<long>").alias("__pos")]
    started = False

    def explode(value: Column) -> None:
        nonlocal cur, started
        keep = links if not started else [F.col("__root"), F.col("__pos")]
        out = cur.select(*keep, F.posexplode(value).alias("__p", "__v"))
        cur = out.select("__root", F.concat("__pos", F.array((F.col("__p") + 1).cast("long"))).alias("__pos"), "__v")
        started = True

    while True:
        while isinstance(kind, T.StructType) and steps:  # struct steps up to the next array or map
            name = steps.pop(0)
            value = F.col(f"`{name}`") if value is None else value[name]
            kind = kind[name].dataType
        if isinstance(kind, T.MapType):
            value = F.array_sort(F.map_entries(value))
            kind = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        if not isinstance(kind, T.ArrayType):
            raise ValueError(f"{'.'.join(path)} is no array or map")
        kind = kind.elementType
        if not steps:
            break
        # a field is taken through the array before it is exploded, so that the scan reads that field alone
        while isinstance(kind, T.StructType) and steps:
            name = steps.pop(0)
            value, kind = value[name], kind[name].dataType
        if steps and steps[0] == "[]":
            steps.pop(0)
        explode(value)
        value = F.col("__v")
        if not steps and not isinstance(kind, (T.ArrayType, T.MapType)):
            raise ValueError(f"{'.'.join(path)} is no array or map")
    cols = _scalars(kind, value, "")
    if isinstance(kind, T.StructType) and cols:
        explode(F.arrays_zip(*[c for _, c in cols]))
        zipped = cur.schema["__v"].dataType.names
        cols = [(n, F.col("__v")[z]) for (n, _), z in zip(cols, zipped, strict=True)]
    else:
        explode(value)
        cols = _scalars(kind, F.col("__v"), "")
    pos = F.col("__pos")
    ords = F.transform(pos, lambda x: x.cast("string"))
    parent = F.concat_ws("/", F.col("__root"), F.slice(ords, 1, F.greatest(F.size(pos) - 1, F.lit(0))))
    taken = {"parent_key", "ordinal", "row_key", "root_key", "positions"}
    names = _unique([n for n, _ in cols], taken)
    return cur.select(
        parent.alias("parent_key"),
        F.element_at(pos, -1).alias("ordinal"),
        F.concat_ws("/", F.col("__root"), ords).alias("row_key"),
        F.col("__root").alias("root_key"),
        pos.alias("positions"),
        *[c.alias(n) for (_, c), n in zip(cols, names, strict=True)],
    )


def flat_tables(df: DataFrame, key: str, root: str = "root") -> dict[str, DataFrame]:
    """Every level of ``df`` as a flat table: the root's scalar columns, and one child table for each array or map,
    named ``root__a__b`` by its path. Frames are lazy and each reads only its own columns. An empty input gives empty
    tables with the same columns."""
    cols = [c for f in df.schema.fields if f.name != key for c in _scalars(f.dataType, F.col(f"`{f.name}`"), f.name)]
    names = _unique([n for n, _ in cols], {"row_key"})
    out = {root: df.select(F.col(f"`{key}`").cast("string").alias("row_key"), *[c.alias(n) for (_, c), n in zip(cols, names, strict=True)])}
    for p in array_paths(df.schema):
        out["__".join([root, *p])] = child_table(df, key, p)
    return out


# --- JSON lines ------------------------------------------------------------------------------------------------------


def _no_constant(text: str):
    raise ValueError(text)


def _int(text: str):
    return int(text) if len(text) < 4000 else float(text)


def strict_json(text: str):
    """The value of a JSON text; ValueError if it is none (NaN and Infinity are none, nor is too deep a nesting)."""
    try:
        return json.loads(text, parse_constant=_no_constant, parse_int=_int)
    except RecursionError as e:
        raise ValueError("too deep") from e


def decoded(value, depth: int = 0):
    """Text that holds JSON stands for the value that it encodes, at any level."""
    while isinstance(value, str):
        try:
            value = strict_json(value)
        except ValueError:
            return value
    if depth < MAX_DEPTH:
        if isinstance(value, dict):
            return {k: decoded(v, depth + 1) for k, v in value.items()}
        if isinstance(value, list):
            return [decoded(v, depth + 1) for v in value]
    return value


def _record(text, hoist: Sequence[str]):
    """A line as one object, or None; fields of a ``hoist`` object fill what the top lacks."""
    if text is None:
        return None
    try:
        value = strict_json(text)
    except ValueError:
        return None
    value = decoded(value)
    if not isinstance(value, dict):
        return None
    for h in hoist:
        inner = value.get(h)
        if isinstance(inner, dict):
            value = {**{k: v for k, v in value.items() if k != h}, **{k: v for k, v in inner.items() if value.get(k) is None}}
    return value


# A shape is {"k": [kinds], "f": {field: shape}, "n": {field: count}, "odd": bool, "e": shape}; kinds are object, array,
# long, double, boolean, string, text. An object is odd if some of its values need the rest column.


def _object(fields: dict, counts: dict, odd: bool) -> dict:
    if len(fields) > MAX_NAMES:
        names = sorted(fields, key=lambda k: (-counts[k], k))[:MAX_NAMES]
        fields, counts, odd = {k: fields[k] for k in names}, {k: counts[k] for k in names}, True
    return {"k": ["object"], "f": fields, "n": counts, "odd": odd}


def shape_of(value, depth: int = 0) -> dict:
    if isinstance(value, dict):
        if depth >= MAX_DEPTH:
            return {"k": ["text"]}
        return _object({k: shape_of(v, depth + 1) for k, v in value.items()}, dict.fromkeys(value, 1), False)
    if isinstance(value, list):
        if depth >= MAX_DEPTH:
            return {"k": ["text"]}
        out: dict = {"k": ["array"], "e": {"k": []}}
        for v in value:
            out["e"] = merge_shapes(out["e"], shape_of(v, depth + 1))
        return out
    if value is None:
        return {"k": []}
    if isinstance(value, bool):
        return {"k": ["boolean"]}
    if isinstance(value, int):
        return {"k": ["long" if -(2**63) <= value < 2**63 else "double"]}
    return {"k": ["double" if isinstance(value, float) else "string"]}


def merge_shapes(a: dict, b: dict) -> dict:
    """The least shape that holds both. A lone value where the other has a list is a list of one; an object stays an
    object beside a scalar, which goes to the rest column; scalars of different kinds are kept as JSON text, and so is a
    list of such values. The order of merging does not matter."""
    ka, kb = set(a["k"]), set(b["k"])
    if not ka or not kb:
        return b if not ka else a
    if "array" in ka or "array" in kb:
        ea = a["e"] if "array" in ka else a
        eb = b["e"] if "array" in kb else b
        return {"k": ["array"], "e": merge_shapes(ea, eb)}
    if ka == kb == {"object"}:
        fields, counts = dict(a["f"]), dict(a["n"])
        for k, v in b["f"].items():
            fields[k] = merge_shapes(fields[k], v) if k in fields else v
            counts[k] = counts.get(k, 0) + b["n"][k]
        return _object(fields, counts, a["odd"] or b["odd"])
    if "object" in ka | kb:
        return {**(a if "object" in ka else b), "odd": True}
    if ka == kb:
        return a
    return {"k": ["double"]} if ka | kb == {"long", "double"} else {"k": ["text"]}


def _struct(kinds: dict[str, T.DataType], first: Sequence[str] = (), rest: bool = False) -> T.StructType:
    """A struct of the fields, in the order of their names. Of names that differ only in letter case one stays, from
    ``first`` or else the one in small letters, and the others get ``_`` appended; metadata have the name in the JSON."""
    order = sorted(kinds, key=lambda k: (k not in first, k.swapcase()))
    named = dict(zip(order, _unique(order, taken := set()), strict=True))
    out = [T.StructField(named[k], kinds[k], True, {"json": k} if named[k] != k else None) for k in sorted(kinds)]
    return T.StructType([*out, T.StructField(_unique([REST], taken)[0], T.StringType(), True, {"rest": True})] if rest else out)


def _key(f: T.StructField) -> str | None:
    """The field's name in the JSON; None for the rest column."""
    return None if f.metadata.get("rest") else f.metadata.get("json", f.name)


def spark_type(shape: dict) -> T.DataType:
    """The Spark type of a shape. Of more than MAX_FIELDS fields those that have lists or objects come first, then the
    most frequent; the others, and values that are no object, are JSON text in the rest column."""
    kind = next(iter(shape["k"]), "string")
    if kind == "object":
        if not shape["f"]:
            return T.StringType()
        rank = lambda k: (not {"array", "object"} & set(shape["f"][k]["k"]), -shape["n"][k], k.swapcase())
        names = sorted(shape["f"], key=rank)[:MAX_FIELDS]
        return _struct({k: spark_type(shape["f"][k]) for k in names}, rest=shape["odd"] or len(names) < len(shape["f"]))
    if kind == "array" and "text" not in shape["e"]["k"]:
        return T.ArrayType(spark_type(shape["e"]))
    return {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, T.StringType())


def pinned(kind: T.DataType, want: T.DataType) -> T.DataType:
    """``kind`` with the fields and types of ``want``, whatever the lines made of them; other fields stay."""
    if isinstance(want, T.StructType):
        found = kind.fields if isinstance(kind, T.StructType) else []
        kinds = {k: f.dataType for f in found if (k := _key(f)) is not None}
        for f in want.fields:
            kinds[f.name] = pinned(kinds.get(f.name, T.NullType()), f.dataType)
        return _struct(kinds, want.names, any(_key(f) is None for f in found))
    if isinstance(want, T.ArrayType):
        return T.ArrayType(pinned(kind.elementType if isinstance(kind, T.ArrayType) else kind, want.elementType))
    return want


def fitted(value, kind: T.DataType):
    """``value`` in the form that ``kind`` asks for; what does not fit a scalar type is null."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [fitted(v, kind.elementType) for v in (value if isinstance(value, list) else [value])]
    if isinstance(kind, T.StructType):
        rest = next((f.name for f in kind.fields if _key(f) is None), None)
        known = {_key(f): f for f in kind.fields if _key(f) is not None}
        if not isinstance(value, dict):
            return None if rest is None else {rest: fitted(value, T.StringType())}
        out = {f.name: fitted(value.get(k), f.dataType) for k, f in known.items()}
        if rest is not None and (more := {k: v for k, v in value.items() if k not in known}):
            out[rest] = fitted(more, T.StringType())
        return out
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, T.DoubleType):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def infer_json(df: DataFrame, column: str, hoist: Sequence[str] = ()) -> T.StructType:
    """The merged schema of a JSON text column, over all rows. Each task folds its rows to one shape; the shapes are
    folded again in groups of 64 until one is left, so the driver gets a single row."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {"k": []}
        for part in parts:
            for text in part.iloc[:, 0]:
                if (r := _record(text, hoist)) is not None:
                    total = merge_shapes(total, shape_of(r))
        yield pd.DataFrame({"shape": [json.dumps(total)]})

    def again(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {"k": []}
        for part in parts:
            for text in part["shape"]:
                total = merge_shapes(total, json.loads(text))
        yield pd.DataFrame({"shape": [json.dumps(total)]})

    lines = df.select(F.col(f"`{column}`").cast("string").alias("line"))
    shapes, n = lines.mapInPandas(fold, "shape string"), max(1, df.rdd.getNumPartitions())
    while n > 64:
        n = -(-n // 64)
        shapes = shapes.repartition(n).mapInPandas(again, "shape string")
    total: dict = {"k": []}
    for row in shapes.collect():
        total = merge_shapes(total, json.loads(row["shape"]))
    kind = spark_type(total)
    return kind if isinstance(kind, T.StructType) else T.StructType([])


def parse_json_lines(df: DataFrame, key: str, column: str, schema: T.StructType | None = None, hoist: Sequence[str] = (), want: T.StructType | None = None) -> DataFrame:
    """``key`` and one column for each field of the merged schema. Lines that are null, not valid JSON or no object
    give no row. With a schema that has no fields the result has the key alone and no rows. Fields of ``want`` are there
    in its types whatever the lines hold; what does not fit them is null."""
    schema = infer_json(df, column, hoist) if schema is None else schema
    schema = schema if want is None else pinned(schema, want)
    if not schema.fields:
        return df.select(F.col(f"`{key}`")).where(F.lit(False))

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keys, out = [], []
            for k, text in zip(part.iloc[:, 0], part.iloc[:, 1], strict=True):
                if (r := _record(text, hoist)) is not None:
                    keys.append(k)
                    out.append(json.dumps(fitted(r, schema), ensure_ascii=False))
            yield pd.DataFrame({"__key": pd.Series(keys, dtype=part.iloc[:, 0].dtype), "__json": pd.Series(out, dtype=object)})

    key_type = df.schema[key].dataType.simpleString()
    parsed = df.select(F.col(f"`{key}`"), F.col(f"`{column}`").cast("string")).mapInPandas(parse, f"__key {key_type}, __json string")
    names = _unique(schema.names, {key.lower()})
    return parsed.select(F.col("__key").alias(key), F.from_json("__json", schema).alias("__r")).select(
        key, *[F.col("__r")[f].alias(n) for f, n in zip(schema.names, names, strict=True)]
    )


def has_path(schema: T.StructType, path: Sequence[str]) -> bool:
    kind: T.DataType = schema
    for step in path:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return False
        kind = kind[step].dataType
    return True
