"""Text functions. Positions count from 0 and are -1 where nothing is found; case folding is that of ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def ascii_upper(s: Column) -> Column:
    return F.translate(s, LOWER, UPPER)


def caseless_equal(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def to_number(s: Column, kind: str = "bigint") -> Column:
    """The leading number of a text, 0 where there is none."""
    pattern = r"^\s*([+-]?\d+)" if kind in ("int", "bigint") else r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    return F.coalesce(F.expr("null").cast(kind), F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast(kind), F.lit(0).cast(kind))


def parse_int(s: Column, base: int = 0) -> Column:
    """Digits up to the first bad one; base 0 takes it from a 0x, 0b or 0 prefix."""
    if base:
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
        return F.coalesce(F.conv(F.nullif(F.regexp_extract(ascii_lower(s), f"^\\s*([{digits}]+)", 1), F.lit("")), base, 10).cast("bigint"), F.lit(0).cast("bigint"))
    low = F.ltrim(ascii_lower(s))
    return F.when(low.rlike("^0x[0-9a-f]"), parse_int(F.substring(low, 3, 64), 16)).when(low.rlike("^0b[01]"), parse_int(F.substring(low, 3, 64), 2)).when(low.rlike("^0[0-7]"), parse_int(low, 8)).otherwise(to_number(low))


def find(s: Column, needle, start: int = 0) -> Column:
    return F.locate(needle, s, start + 1) - 1 if isinstance(needle, str) else F.call_function("locate", needle, s, F.lit(start + 1)) - 1


def caseless_find(s: Column, needle: str) -> Column:
    return find(ascii_lower(s), needle.lower())


def reverse_find(s: Column, needle: str) -> Column:
    at = F.locate(needle[::-1], F.reverse(s))
    return F.when(at == 0, -1).otherwise(F.char_length(s) - at - len(needle) + 1)


def caseless_reverse_find(s: Column, needle: str) -> Column:
    return reverse_find(ascii_lower(s), needle.lower())


def _set(chars: str, negated: bool) -> str:
    return ("[^" if negated else "[") + "".join("\\" + c if c in r"\]^-[&" else c for c in chars) + "]"


def find_any(s: Column, chars: str, negated: bool = False) -> Column:
    """First place of a character that is in the set, or with negated isn't."""
    return F.regexp_instr(s, F.lit(_set(chars, negated))) - 1


def reverse_find_any(s: Column, chars: str, negated: bool = False) -> Column:
    at = F.regexp_instr(F.reverse(s), F.lit(_set(chars, negated)))
    return F.when(at == 0, -1).otherwise(F.char_length(s) - at)


def count(s: Column, needle: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.char_length(s) - F.char_length(F.replace(s, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint") if needle else F.lit(0).cast("bigint")


def token(s: Column, separator: str, n: int) -> Column:
    """The n-th part between separators, empty beyond the last."""
    return F.coalesce(F.split_part(s, F.lit(separator), F.lit(n + 1)), F.lit(""))


def mid(s: Column, left: int, length: int) -> Column:
    """length characters from left; a negative left counts from the end, a negative length leaves so many off the end."""
    n = F.char_length(s)
    a = F.greatest(n + left, F.lit(0)) if left < 0 else F.least(F.lit(left), n)
    size = F.greatest(n - a + length, F.lit(0)) if length < 0 else F.lit(length)
    return F.substring(s, a + 1, size)


def _index(s: Column, needle: str, last: bool) -> Column:
    return (reverse_find if last else find)(s, needle)


def up_to(s: Column, needle: str, last: bool = False, include: bool = False) -> Column:
    """Head before the first (last) needle. Not found: the whole text, or empty with include."""
    at = _index(s, needle, last)
    return F.when(at < 0, F.lit("") if include else s).otherwise(F.substring(s, F.lit(1), at + (len(needle) if include else 0)))


def from_(s: Column, needle: str, last: bool = False, include: bool = False) -> Column:
    """Tail behind the first (last) needle. Not found: empty, or the whole text with include."""
    at = _index(s, needle, last)
    return F.when(at < 0, s if include else F.lit("")).otherwise(F.substring(s, at + 1 + (0 if include else len(needle)), F.char_length(s)))


def drop_up_to(s: Column, needle: str) -> Column:
    """Tail behind the first needle; the whole text where it isn't found."""
    return F.when(find(s, needle) < 0, s).otherwise(from_(s, needle))


def from_to(s: Column, start: str, end: str) -> Column:
    """Between the first start and the next end; empty if either is missing."""
    rest = from_(s, start)
    return F.when((find(s, start) < 0) | (find(rest, end) < 0), F.lit("")).otherwise(up_to(rest, end))


def split_at(s: Column, needle: str, last: bool = False) -> Column:
    """struct(head, tail) around the needle; all in head where it isn't found."""
    return F.struct(up_to(s, needle, last).alias("head"), from_(s, needle, last).alias("tail"))


def replace_at(s: Column, start: int, length: int, new: str) -> Column:
    return F.overlay(F.rpad(s, F.greatest(F.char_length(s), F.lit(start)), " "), F.lit(new), F.lit(start + 1), F.lit(length))


def insert(s: Column, start: int, new: str) -> Column:
    return replace_at(s, start, 0, new)


def remove(s: Column, start: int, length: int) -> Column:
    return replace_at(s, start, length, "")


def aligned(s: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    """Padded to width, never cut; side is where the text stands: left, right or center."""
    n = F.char_length(s)
    if side == "center":
        padded = F.rpad(F.lpad(s, n + F.floor((F.lit(width) - n) / 2).cast("int"), fill), width, fill)
    else:
        padded = (F.rpad if side == "left" else F.lpad)(s, width, fill)
    return F.when(n < width, padded).otherwise(s)


def trim_set(s: Column, chars: str, both: str = "both") -> Column:
    c = F.lit(chars)
    return {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[both](s, c)


def caseless_replace(s: Column, old: str, new: str) -> Column:
    quoted = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in old)
    return F.regexp_replace(s, f"(?i){quoted}", new.replace("\\", "\\\\").replace("$", "\\$"))


def replace_tokens(s: Column, chars: str, new: str) -> Column:
    """Each character of the set replaced by new."""
    return F.regexp_replace(s, _set(chars, False), new.replace("\\", "\\\\").replace("$", "\\$"))


def replace_first(s: Column, pattern: str, new: str, times: int = 1) -> Column:
    """Regular-expression replacement of the first `times` matches (-1: all); \\1 and so on refer to groups."""
    java = new.replace("$", "\\$")
    for i in range(10):
        java = java.replace(f"\\{i}", f"${i}")
    if times < 0:
        return F.regexp_replace(s, pattern, java)
    done, rest = F.lit(""), s
    for _ in range(times):
        at = F.regexp_instr(rest, F.lit(pattern))
        hit = F.regexp_substr(rest, F.lit(pattern))
        done = F.when(at > 0, F.concat(done, F.substring(rest, F.lit(1), at - 1), F.regexp_replace(hit, pattern, java))).otherwise(done)
        rest = F.when(at > 0, F.substring(rest, at + F.char_length(hit), F.char_length(rest))).otherwise(rest)
    return F.concat(done, rest)


def captures(s: Column, pattern: str, groups: int) -> Column:
    """struct(position, groups) of the first match; position -1 and empty groups where there is none. Group 0 is the match."""
    return F.struct((F.regexp_instr(s, F.lit(pattern)) - 1).alias("position"), F.array(*(F.regexp_extract(s, pattern, g) for g in range(groups + 1))).alias("groups"))


def code_point(s: Column) -> Column:
    """The first character's number."""
    return F.ascii(s)


def legible_size(size: Column) -> Column:
    """1536 -> 1.5KB. Divides by 1024 while that leaves 1024 or more; one digit, cut off."""
    units = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]
    out = F.concat(size.cast("string"), F.lit(".0B"))
    for k in range(1, 7):
        step = 1024**k
        whole, rest = F.call_function("div", size, F.lit(step)), F.call_function("div", size, F.lit(step // 1024)) % 1024
        text = F.concat(whole.cast("string"), F.lit("."), F.call_function("div", rest * 10, F.lit(1024)).cast("string"), F.lit(units[k]))
        out = F.when(size >= step, text).otherwise(out)
    return out


def legible_time(milliseconds: Column) -> Column:
    """A whole number of the largest unit that fits, of ms, sec, min, hour and day."""
    out = F.concat(milliseconds.cast("string"), F.lit("ms"))
    step = 1
    for base, unit in ((1000, "sec"), (60, "min"), (60, "hour"), (24, "day")):
        step *= base
        out = F.when(milliseconds >= step, F.concat(F.call_function("div", milliseconds, F.lit(step)).cast("string"), F.lit(unit))).otherwise(out)
    return out


def with_suffix(s: Column) -> Column:
    """10K, 3M, 1G as numbers."""
    n, last = to_number(s), ascii_upper(F.substring(F.trim(s), -1, 1))
    return n * F.when(last == "K", 1024).when(last == "M", 1024**2).when(last == "G", 1024**3).otherwise(1).cast("bigint")


def find_key(lines: Column, key: str) -> Column:
    """Value of the first `key: value` line of an array of lines; NULL if there is none."""
    hit = F.try_element_at(F.filter(lines, lambda x: F.substring_index(x, ":", 1) == key), F.lit(1))
    return from_(hit, ": ")


def savings(initial: Column, stored: Column) -> Column:
    """Percent saved in whole numbers; 100 where nothing was ingested."""
    return F.when(F.coalesce(initial, F.lit(0)) == 0, F.lit(100).cast("bigint")).otherwise(F.lit(100).cast("bigint") - F.call_function("div", stored * 100, initial))
