"""File metadata as text and as a struct: packing, parsing, comparing and printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The type bits of a POSIX mode.
TYPES = {"fifo": 0o010000, "char": 0o020000, "dir": 0o040000, "block": 0o060000, "file": 0o100000, "link": 0o120000, "socket": 0o140000}
LETTERS = {"fifo": "p", "char": "c", "dir": "d", "block": "b", "file": "-", "link": "l", "socket": "s"}
PERMISSIONS = ["---", "--x", "-w-", "-wx", "r--", "r-x", "rw-", "rwx"]
FIELDS = ["dev", "ino", "mode", "size", "nlink", "uid", "gid", "ctime", "mtime", "atime"]


def type_of(mode: Column) -> Column:
    out = F.lit("unknown")
    for kind, bits in TYPES.items():
        out = F.when(mode.bitwiseAND(0o170000) == bits, F.lit(kind)).otherwise(out)
    return out


def to_text(stat: dict[str, Column], link_target: Column | None = None) -> Column:
    """P and upper-case hexadecimal fields between slashes; a link has S behind the P and its target at the end."""
    fields = F.concat_ws("/", *(F.hex(stat[f].cast("bigint")) for f in FIELDS))
    if link_target is None:
        return F.concat(F.lit("P"), fields)
    return F.when(link_target.isNull(), F.concat(F.lit("P"), fields)).otherwise(F.concat(F.lit("PS"), fields, F.lit("/"), link_target))


def from_text(text: Column) -> Column:
    """struct of the fields, the type and the link target; NULL unless the text begins with P."""
    link = F.startswith(text, F.lit("PS"))
    body = F.when(link, F.substring(text, 3, 1 << 20)).otherwise(F.substring(text, 2, 1 << 20))
    parts = F.split(body, "/", 11)
    number = lambda i: F.conv(F.try_element_at(parts, F.lit(i + 1)), 16, 10).cast("bigint")
    values = [number(i).alias(f) for i, f in enumerate(FIELDS)]
    target = F.when(link, F.try_element_at(parts, F.lit(11))).alias("link_target")
    return F.when(F.startswith(text, F.lit("P")), F.struct(*values, type_of(number(2)).alias("type"), number(2).bitwiseAND(0o777).alias("permissions"), target))


def permission_text(mode: Column) -> Column:
    table = F.array(*map(F.lit, PERMISSIONS))
    return F.concat(*(F.element_at(table, F.shiftright(mode, shift).bitwiseAND(7) + 1) for shift in (6, 3, 0)))


def may(mode: Column, uid: Column, gid: Column, want: int, as_uid: int, as_gid: int) -> Column:
    """Whether a user has the wanted bits (4 read, 2 write, 1 execute) as owner, group or other."""
    shift = F.when(uid == as_uid, F.shiftright(mode, 6)).when(gid == as_gid, F.shiftright(mode, 3)).otherwise(mode)
    return shift.bitwiseAND(want) == want


def pretty(meta: Column) -> Column:
    """A line as `ls -l` has it: type and permissions, owner, size, time."""
    kinds = F.lit("?")
    for kind, letter in LETTERS.items():
        kinds = F.when(meta["type"] == kind, F.lit(letter)).otherwise(kinds)
    owner, size = F.concat_ws(":", meta["uid"].cast("string"), meta["gid"].cast("string")), meta["size"].cast("string")
    return F.concat_ws(
        " ", F.concat(kinds, permission_text(meta["mode"])), F.rpad(owner, F.greatest(F.lit(19), F.char_length(owner)), " "),
        F.lpad(size, F.greatest(F.lit(7), F.char_length(size)), " "), F.date_format(meta["mtime"], "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )


def similar(a: Column, b: Column, mask: str = "all_but_access_time") -> Column:
    """Null-safe equality of two metadata structs: all, all_but_access_time or all_but_times."""
    fields = ["uid", "gid", "mode", "size", "type", "link_target"]
    fields += {"all": ["mtime", "ctime", "atime"], "all_but_access_time": ["mtime", "ctime"], "all_but_times": []}[mask]
    out = a.isNotNull() & b.isNotNull()
    for f in fields:
        out = out & a[f].eqNullSafe(b[f])
    return out
