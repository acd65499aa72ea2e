"""Path functions. Everything but `normalized` is a column expression; that one removes dot segments in one fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    return F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))


def with_separator(path: Column, wanted: bool) -> Column:
    """With exactly one, or without any, separator at the end; a path of separators alone is one separator."""
    bare = F.rtrim(path, F.lit("/"))
    return F.when((bare == "") & (path != ""), F.lit("/")).otherwise(F.concat(bare, F.lit("/")) if wanted else bare)


def normalized(path: Column) -> Column:
    """Without `.`, `..` and empty segments; `..` above the root of an absolute path vanishes, that of a relative one stays."""
    absolute = F.startswith(path, F.lit("/"))

    def step(stack: Column, part: Column) -> Column:
        last = F.try_element_at(stack, F.lit(-1))
        climbs = (F.size(stack) > 0) & (last != "..")
        up = F.when(climbs, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).when(absolute, stack).otherwise(F.array_append(stack, F.lit("..")))
        return F.when(part.isin("", "."), stack).when(part == "..", up).otherwise(F.array_append(stack, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    body = F.array_join(parts, "/")
    return F.when(absolute, F.concat(F.lit("/"), body)).when((body == "") & (path != ""), F.lit(".")).otherwise(body)


def ancestors(path: Column) -> Column:
    """All folders above a path, the root (empty) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
