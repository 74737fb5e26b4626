"""Tags of a cell of any shape, as built-in expressions: texts, JSON and list texts, arrays, maps, structs and variants, nested.

The order of rules for a text: quoted tokens of a bracketed list; JSON (or a literal with single
quotes) taken apart; quoted tokens of anything else; blanks, if no other separator is there and
two tokens or more come out; separators, and / below 160 characters. Values inside lists are
tags as they stand; texts that are values of an object are cells of their own. Values of an
object come in the order of their keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col, strip

#: Separators of tags, what stands for no tag, and what goes at a tag's ends.
SEPARATORS = "，,、;；|\n\t"
NO_TAG = ("", "nan", "none", "[]", "{}")
BRACKETS = r"^[\[\](){}]+|[\[\](){}]+$"
EDGES = r"^[ \-•·：:'\"]+|[ \-•·：:'\"]+$"
SLASH_BELOW = 160
#: How deep JSON and variants are taken apart; what lies deeper is text.
DEPTH = 3


def none_() -> Column:
    return F.array().cast("array<string>")


def cleaned(tags: Column) -> Column:
    """Tags without blanks, brackets, quotes and bullets at their ends, no-tags out, each once in first-seen order."""
    bare = F.transform(tags, lambda t: F.regexp_replace(F.regexp_replace(strip(F.coalesce(t, F.lit(""))), BRACKETS, ""), EDGES, ""))
    return F.array_distinct(F.filter(bare, lambda t: ~F.lower(t).isin(*NO_TAG)))


def cut_text(raw: Column) -> Column:
    """Uncleaned tags of a text that is no list and no JSON."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"^[\[({]+|[\])}]+$", ""), "['\"]", "")
    any_separator = bare.rlike(f"[{SEPARATORS}]")
    by_blank = F.split(bare, r"\s{2,}|\s(?=[A-Za-z一-龥])")
    separated = F.split(F.when(F.length(bare) < SLASH_BELOW, F.replace(bare, F.lit("/"), F.lit(","))).otherwise(bare), f"[{SEPARATORS}]")
    return F.when(bare.contains(" ") & ~any_separator & (F.size(cleaned(by_blank)) >= 2), by_blank).otherwise(separated)


def of_text(c: Column, depth: int) -> Column:
    """Uncleaned tags of a text cell."""
    raw = strip(F.coalesce(c, F.lit("")))
    listed, braced = raw.rlike(r"(?s)^\[.*\]$"), raw.rlike(r"(?s)^\{.*\}$")
    list_tokens = F.regexp_extract_all(raw, F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))
    pairs = F.regexp_extract_all(raw, F.lit("'[^']+'|\"[^\"]+\""), F.lit(0))
    quoted = F.transform(pairs, lambda t: F.substr(t, F.lit(2), F.length(t) - 2))
    plain = F.when(F.size(quoted) > 0, quoted).otherwise(cut_text(raw))
    if depth > 0:
        literal = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(raw, "'", '"'), r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
        parsed = of_variant(F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.when(~raw.contains('"'), literal))), depth)
        plain = F.when((listed | braced) & (F.size(cleaned(parsed)) > 0), parsed).otherwise(plain)
    tokens = F.when(listed & (F.size(list_tokens) > 0), list_tokens).otherwise(plain)
    return F.when(F.lower(raw).isin(*NO_TAG), none_()).otherwise(tokens)


def of_variant(v: Column, depth: int, in_list: bool = False) -> Column:
    """Uncleaned tags of a variant: of the values of lists and objects, and of texts."""
    kind = F.coalesce(F.schema_of_variant(v), F.lit(""))
    text = F.try_variant_get(v, "$", "string")
    scalar = F.when(kind.isin("VOID", ""), none_()).otherwise(F.array(F.when(kind == "BOOLEAN", F.initcap(text)).when(kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double").cast("string")).otherwise(strip(text))))
    out = scalar if in_list else F.when(kind == "STRING", of_text(text, 0)).otherwise(none_())
    if depth > 0:
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        values = F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<variant>"))
        out = F.when(kind.startswith("ARRAY"), F.flatten(F.transform(items, lambda x: of_variant(x, depth - 1, True)))).when(kind.startswith("OBJECT"), F.flatten(F.transform(values, lambda x: of_variant(x, depth - 1)))).otherwise(out)
    return out


def parser(kind: T.DataType, depth: int = DEPTH, in_list: bool = False) -> Callable[[Column], Column]:
    """Uncleaned tags of a column of this type, or of a list's items of it."""
    if isinstance(kind, T.ArrayType):
        inner = parser(kind.elementType, depth, True)
        return lambda c: F.flatten(F.transform(F.coalesce(c, F.array().cast(kind)), inner))
    if isinstance(kind, T.MapType):
        inner = parser(kind.valueType, depth)
        return lambda c: F.flatten(F.transform(F.coalesce(F.map_values(c), F.array().cast(T.ArrayType(kind.valueType))), inner))
    if isinstance(kind, T.StructType):
        return lambda c: F.when(c.isNull() | F.lit(not kind.fields), none_()).otherwise(F.concat(none_(), *[parser(f.dataType, depth)(c[f.name]) for f in kind.fields]))
    if isinstance(kind, T.VariantType):
        return lambda c: of_variant(c, depth, in_list)
    if isinstance(kind, T.StringType):
        return (lambda c: F.array(strip(F.coalesce(c, F.lit(""))))) if in_list else (lambda c: of_text(c, depth))
    text = lambda c: F.initcap(c.cast("string")) if isinstance(kind, T.BooleanType) else c.cast("string")
    return (lambda c: F.when(c.isNull(), none_()).otherwise(F.array(text(c)))) if in_list else (lambda c: none_())


def tags_of(df: DataFrame, column: str, depth: int = DEPTH) -> Column:
    """The tags of a column of df, whatever its type; null and what holds no tag are an empty array."""
    return cleaned(parser(df.schema[column].dataType, depth)(F.col(column)))


def tag_list(c: Column | str, depth: int = DEPTH) -> Column:
    """The tags of a text column."""
    return cleaned(of_text(col(c), depth))
