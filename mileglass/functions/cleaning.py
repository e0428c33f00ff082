"""Column expressions for the lossy clean-up of JSON values.

JSON values are VARIANT columns.  Texts are measured in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a control character, the property keys that
# are never kept, and the fields of each object level.
CONTROL = r"[\x00-\x1f\x7f]"
FORBIDDEN_KEYS = ("__proto__", "constructor", "prototype")
GRAPH_FIELDS = ("nodes", "edges", "metadata")
NODE_FIELDS = ("id", "label", "type", "description", "properties")
EDGE_FIELDS = ("source", "target", "label", "weight", "properties")
ELLIPSIS = "…"

VISIBLE = r"(?U)\S"
# Free of control characters and not blank, in one search.
PLAIN = r"(?U)^[^\x00-\x1f\x7f]*?[^\s\x00-\x1f\x7f][^\x00-\x1f\x7f]*\z"
GAPS = r"(?U)[\x00-\x1f\x7f\s]+"


@dataclass(frozen=True, kw_only=True)
class GraphLimits:
    """Size limits; each one has to be chosen by the caller."""

    payload_bytes: int
    nodes: int
    edges: int
    id_chars: int
    label_chars: int
    type_chars: int
    description_chars: int
    node_properties: int
    edge_properties: int
    metadata_properties: int
    property_key_chars: int
    property_string_chars: int
    property_array_items: int
    weight: float


def as_number(condition: Column) -> Column:
    """1 if true, 0 if false or NULL."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def text_of(value: Column) -> Column:
    """The string held by a variant; NULL for any other kind of value."""
    return F.when(is_text(value), F.try_variant_get(value, "$", "string"))


def member(fields: Column, name: str) -> Column:
    """A field of an object given as a map.  NULL if it is missing; a JSON
    null stays a variant, so presence is ``isNotNull``."""
    return F.try_element_at(fields, F.lit(name))


def fields_of(value: Column) -> Column:
    """The fields of an object variant as a map; NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def items_of(value: Column) -> Column:
    """The items of an array variant; NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def unknown_fields(fields: Column, known: tuple[str, ...]) -> Column:
    """How many keys an object has beyond the known ones."""
    return F.size(F.array_except(F.map_keys(fields), F.array(*map(F.lit, known))))


def is_identifier(text: Column, longest: int) -> Column:
    """Visible text within the limit and free of control characters."""
    return F.coalesce((F.length(text) <= longest) & text.rlike(PLAIN), F.lit(False))


def is_property_key(key: Column, longest: int) -> Column:
    return is_identifier(key, longest) & ~key.isin(*FORBIDDEN_KEYS)


def squeezed(text: Column) -> Column:
    """Control characters and whitespace runs become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, GAPS, " "))


def shortened(text: Column, longest: int) -> Column:
    return F.concat(F.rtrim(F.substring(text, 1, longest - 1)), F.lit(ELLIPSIS))


def is_finite(value: Column, kind: Column | None = None) -> Column:
    """A number (not a boolean) that is not infinite.

    Only floats can be infinite, so other numbers are not converted.
    """
    kind = F.schema_of_variant(value) if kind is None else kind
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(
        F.when((kind == "BIGINT") | kind.startswith("DECIMAL"), True)
        .when(kind.isin("DOUBLE", "FLOAT"), F.abs(number) < F.lit(float("inf")))
        .otherwise(False), F.lit(False))


def usable_weight(value: Column, largest: float) -> Column:
    """The number itself if it is finite and from zero to the limit, else NULL."""
    number = F.try_variant_get(value, "$", "double")
    return F.when(is_finite(value) & number.between(0, largest), value)


def clean_scalar(value: Column, kind: Column, longest: int, text: Column | None = None) -> Column:
    """struct(value variant, kept, normalized, truncated) of a scalar.

    ``kind`` is its type name and ``text`` its string, if known.  A string is
    kept even if blank; nested and non-finite values are not.
    """
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")) if text is None else text
    plain = squeezed(text)
    long = F.length(plain) > longest

    def result(new, kept, normalized, truncated):
        return F.struct(new.alias("value"), kept.alias("kept"), normalized.alias("normalized"),
                        truncated.alias("truncated"))

    fixed = F.when(long, shortened(plain, longest)).otherwise(plain).cast(T.VariantType())
    zero, one, yes = F.lit(0), F.lit(1), F.lit(True)
    return (F.when(kind == "STRING",
                   F.when((F.length(text) <= longest) & ~text.rlike(CONTROL), result(value, yes, zero, zero))
                   .otherwise(result(fixed, yes, one, long.cast("int"))))
            .when(kind.isin("VOID", "BOOLEAN"), result(value, yes, zero, zero))
            .otherwise(result(value, is_finite(value, kind), zero, zero)))
