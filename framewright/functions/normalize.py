"""Canonical message text: volatile header removed, compact JSON."""

from __future__ import annotations

import json
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: the header that changes with every request.
VOLATILE = ("headers.X-Amzn-Trace-Id",)


def normalize(
    messages: DataFrame, drop: tuple[str, ...] = VOLATILE, schema: str | None = None, sort_keys: bool = False,
    msg: str = "msg",
) -> DataFrame:
    """Rewrite the JSON column *msg*: nested keys named in *drop* removed, everything else kept, no spaces.

    Without *schema* any JSON goes: absent stays absent, null stays null and keys keep their order, unless *sort_keys*.
    With *schema* (DDL) the whole work stays inside Spark SQL; unknown keys disappear and absent ones appear as null,
    so declare all that matters. A message that is not a JSON object, or does not fit the schema, becomes null.

    A key ``a.b`` is removed only where ``a`` is an object.
    """
    if schema is None:
        return _any_json(messages, drop, sort_keys, msg)
    wanted = T.StructType.fromDDL(schema)
    parsed = F.from_json(
        F.col(msg), f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    # a projection of its own, so that the text is parsed once
    rows = messages.withColumn("_row", parsed)
    row, fields = F.col("_row"), {}
    for field in sorted(wanted.fields, key=lambda f: f.name) if sort_keys else wanted.fields:
        fields[field.name] = row[field.name]
    for path in drop:
        outer, _, inner = path.partition(".")
        if outer not in fields:
            continue
        kind = wanted[outer].dataType
        if not inner:
            del fields[outer]
        elif isinstance(kind, T.MapType):
            fields[outer] = _without_key(row[outer], inner)
        elif isinstance(kind, T.StructType) and inner in kind.names:
            fields[outer] = row[outer].dropFields(f"`{inner}`")
    text = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})
    usable = row.isNotNull() & row["_corrupt"].isNull() & F.ltrim(msg).startswith("{")
    return rows.withColumn(msg, F.when(usable, text)).drop("_row")


def _without_key(column: Column, name: str) -> Column:
    return F.map_filter(column, lambda key, value: key != name)


def _lone_surrogate(value: object) -> bool:
    try:
        json.dumps(value, ensure_ascii=False).encode()
    except UnicodeEncodeError:
        return True
    return False


def _any_json(messages: DataFrame, drop: tuple[str, ...], sort_keys: bool, msg: str) -> DataFrame:
    paths = [path.partition(".")[::2] for path in drop]

    def clean(text: str | None) -> str | None:
        try:
            value = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None
        if not isinstance(value, dict):
            return None
        for outer, inner in paths:
            if not inner:
                value.pop(outer, None)
            elif isinstance(value.get(outer), dict):
                value[outer].pop(inner, None)
        # half of a surrogate pair has no UTF-8 form and stays escaped
        broken = "\\ud" in text.lower() and _lone_surrogate(value)
        return json.dumps(value, ensure_ascii=broken, separators=(",", ":"), sort_keys=sort_keys)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([clean(t) for t in texts.to_pylist()], pa.string())

    # other columns don't go to Python
    return messages.withColumn(msg, F.arrow_udf(run, T.StringType())(F.col(msg)))
