"""Reading a dynamic attribute bag (a VARIANT parsed from ``value_json``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bag(value_json: Column | str = "value_json") -> Column:
    """Parse an attribute text once; unreadable text behaves like an empty bag."""
    return F.try_parse_json(F.col(value_json) if isinstance(value_json, str) else value_json)


def path_of(*keys: str) -> str:
    return "$" + "".join('["' + k.replace('"', '\\"') + '"]' for k in keys)


def item(v: Column, *keys: str) -> Column:
    return F.try_variant_get(v, path_of(*keys), "variant")


def kind(v: Column, *keys: str) -> Column:
    """BOOLEAN, BIGINT, DECIMAL(..), STRING, OBJECT<..>, ARRAY<..>, VOID, or NULL where absent."""
    return F.schema_of_variant(item(v, *keys))


def text(v: Column, *keys: str) -> Column:
    return F.try_variant_get(v, path_of(*keys), "string")


def number(v: Column, *keys: str) -> Column:
    """Value as a double where it can be read as one, numeric strings included."""
    return F.coalesce(
        F.try_variant_get(v, path_of(*keys), "double"),
        F.expr("double(null)"),
    )


def present(v: Column, *keys: str) -> Column:
    """The key exists, even with a JSON null."""
    return item(v, *keys).isNotNull()


def is_numeric(kind_text: Column) -> Column:
    return kind_text.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")


def truthy(v: Column, *keys: str) -> Column:
    """False for absent, null, false, zero, and empty text, list or object; else true."""
    k = kind(v, *keys)
    return (
        F.when(k.isNull() | (k == "VOID"), F.lit(False))
        .when(k == "BOOLEAN", F.try_variant_get(v, path_of(*keys), "boolean"))
        .when(k == "STRING", F.length(text(v, *keys)) > 0)
        .when(k == "OBJECT<>", F.lit(False))
        .when(k.startswith("ARRAY"), F.size(F.try_variant_get(v, path_of(*keys), "array<variant>")) > 0)
        .when(is_numeric(k), number(v, *keys) != 0.0)
        .otherwise(F.lit(True))
    )


def first_text(*candidates: Column) -> Column:
    """First candidate that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def tag(v: Column, *names: str) -> Column:
    """First non-empty of the named tags; a ``tags`` value that is no object has none."""
    return first_text(*[text(v, "tags", n) for n in names])


def folded_tag(v: Column, *names: str) -> Column:
    """Lower-cased first non-empty tag, empty text if none; a JSON null counts as text 'none'."""
    options = [
        F.lower(F.coalesce(text(v, "tags", n), F.when(kind(v, "tags", n) == "VOID", F.lit("none"))))
        for n in names
    ]
    return F.coalesce(first_text(*options), F.lit(""))
