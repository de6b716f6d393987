r"""Algebra of materialised paths: parts joined by backslashes, no drive letter, the root is ''.

A null path is unknown and gives null everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\\"


def as_column(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def separators(path: Column | str) -> Column:
    path = as_column(path)
    return F.length(path) - F.length(F.replace(path, F.lit(SEP), F.lit("")))


def depth(path: Column | str) -> Column:
    """0 for the root, 1 at the top."""
    path = as_column(path)
    return F.when(path == "", F.lit(0)).otherwise(separators(path) + 1)


def prefix(path: Column | str, parts: Column | int) -> Column:
    """The first so many parts; the root for none."""
    path = as_column(path)
    return F.substring_index(path, SEP, parts) if isinstance(parts, int) else F.array_join(F.slice(F.split(path, r"\\"), F.lit(1), parts), SEP)


def parent(path: Column | str) -> Column:
    """Null for the root, '' at the top (also below a leading separator)."""
    path = as_column(path)
    cut = F.length(path) - F.length(F.substring_index(path, SEP, -1)) - 1
    return F.when(path == "", F.lit(None)).otherwise(F.substring(path, 1, F.greatest(cut, F.lit(0))))


def basename(path: Column | str, root: Column | str = "") -> Column:
    path = as_column(path)
    return F.when(path == "", root if isinstance(root, Column) else F.lit(root)).otherwise(F.substring_index(path, SEP, -1))


def ancestors_and_self(path: Column | str) -> Column:
    """Every prefix, from the root to the path itself."""
    path = as_column(path)
    parts = F.split(path, r"\\")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), SEP))
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), below))


def ancestors(path: Column | str, with_root: bool = True) -> Column:
    """The proper ancestors, from the root down."""
    path = as_column(path)
    every = ancestors_and_self(path)
    first = 1 if with_root else 2
    return F.slice(every, F.lit(first), F.greatest(F.size(every) - first, F.lit(0)))


def is_ancestor(a: Column | str, path: Column | str) -> Column:
    """Strictly above, by whole parts: Windows\\Temp isn't above Windows\\Temp2. The root is above all others."""
    a, path = as_column(a), as_column(path)
    return F.when(a == "", path != "").otherwise(F.startswith(path, F.concat(a, F.lit(SEP))))


def in_subtree_of_children(path: Column | str, of: str) -> Column:
    """Whether path is below `of`, as a range that column statistics can prune."""
    path = as_column(path)
    return path != "" if of == "" else (path >= of + SEP) & (path < of + chr(ord(SEP) + 1))


def attribution(path: Column | str, parts: int = 3) -> Column:
    """What a file counts towards: its first parts."""
    return prefix(path, parts)


def relative(raw: Column | str) -> Column:
    r"""A user's path in this form: slashes turned, a drive and outer separators dropped."""
    turned = F.replace(F.trim(as_column(raw)), F.lit("/"), F.lit(SEP))
    return F.regexp_replace(F.regexp_replace(turned, r"^[A-Za-z]:(?=\\|$)", ""), r"^\\+|\\+$", "")


def from_final_path(raw: Column | str, drive: Column | str) -> Column:
    r"""\\?\C:\a\b on drive C: as a\b; null for another drive, another prefix or a path relative to the drive."""
    raw, drive = as_column(raw), as_column(drive)
    start = F.concat(F.upper(F.regexp_replace(drive, r":?\\*$", "")), F.lit(":"))
    body = F.substring(raw, 5, 1 << 30)
    rest = F.substr(body, F.length(start) + 1)
    return F.when(
        F.startswith(raw, F.lit("\\\\?\\")) & F.startswith(F.upper(body), start),
        F.when(F.length(rest) == 0, F.lit("")).when(F.startswith(rest, F.lit(SEP)), F.regexp_replace(rest, r"^\\+", "")),
    )


def crumbs(path: Column | str) -> Column:
    """struct(level, path, current) of the root and every prefix."""
    path = as_column(path)
    return F.transform(ancestors_and_self(path), lambda p, i: F.struct(i.alias("level"), p.alias("crumb"), (p == path).alias("current")))
