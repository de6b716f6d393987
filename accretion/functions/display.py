"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")
KNEE = 1 << 20


def _scaled(n: Column, shown) -> Column:
    out = shown(n / 1024.0 ** (len(UNITS) - 1), UNITS[-1])
    for i in range(len(UNITS) - 2, -1, -1):
        out = F.when(F.abs(n) < 1024.0 ** (i + 1), shown(n / 1024.0**i, UNITS[i])).otherwise(out)
    return out


def size_text(n: Column | str) -> Column:
    """1,023.4 MB; whole bytes below a kilobyte; a dash for unknown."""
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    return F.when(n.isNull(), F.lit("—")).otherwise(_scaled(n, lambda v, u: F.format_string("%d B", v.cast("long")) if u == "B" else F.format_string(f"%,.1f {u}", v)))


def short_size_text(n: Column | str) -> Column:
    """Like size_text, but one decimal only below ten units, none above."""
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    text = _scaled(F.abs(n), lambda v, u: F.format_string("%.0f B", F.floor(v + 0.5).cast("double")) if u == "B" else F.when(v < 10, F.format_string(f"%.1f {u}", v)).otherwise(F.format_string(f"%.0f {u}", F.floor(v + 0.5).cast("double"))))
    return F.when(n.isNull(), F.lit("—")).otherwise(F.concat(F.when(n < 0, F.lit("−")).otherwise(F.lit("")), text))


def signed_size_text(n: Column | str) -> Column:
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    return F.when(n.isNull() | (n == 0), F.lit("0")).otherwise(F.concat(F.when(n > 0, F.lit("+")).otherwise(F.lit("−")), short_size_text(F.abs(n))))


def symlog(v: Column | str, peak: Column, knee: float = KNEE) -> Column:
    """-1..1: linear around zero, logarithmic beyond the knee."""
    v = (F.col(v) if isinstance(v, str) else v).cast("double")
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * F.log10(1 + F.abs(v) / knee) / F.log10(1 + peak.cast("double") / knee))


def used_percent(used: Column | str, total: Column | str) -> Column:
    used, total = (F.col(x) if isinstance(x, str) else x for x in (used, total))
    return F.when(total > 0, F.least(F.lit(100.0), used * 100.0 / total)).otherwise(F.lit(0.0))
