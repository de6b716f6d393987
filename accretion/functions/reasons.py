"""Reason masks of the change journal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The journal's reason bits.
BITS = {
    "data_overwrite": 0x1, "data_extend": 0x2, "data_truncation": 0x4, "named_overwrite": 0x10, "named_extend": 0x20, "named_truncation": 0x40, "create": 0x100, "delete": 0x200, "ea_change": 0x400, "security": 0x800,
    "rename_old": 0x1000, "rename_new": 0x2000, "indexable": 0x4000, "basic_info": 0x8000, "hard_link": 0x10000, "compression": 0x20000, "encryption": 0x40000, "object_id": 0x80000, "reparse": 0x100000, "stream": 0x200000,
    "transacted": 0x400000, "integrity": 0x800000, "close": 0x80000000,
}
# The labels that describe() lists, in this order.
DESCRIBED = (
    ("create", "新建"), ("delete", "删除"), ("rename_old", "改名前"), ("rename_new", "改名后"), ("data_extend", "写入变大"), ("data_truncation", "截断变小"), ("data_overwrite", "覆写"), ("named_extend", "附加流变大"), ("named_truncation", "附加流变小"),
    ("hard_link", "硬链接变化"), ("stream", "数据流变化"), ("basic_info", "属性变化"), ("security", "权限变化"), ("close", "关闭"),
)
WRITES = ("data_extend", "data_truncation", "data_overwrite", "named_extend", "named_truncation")
#: What a journal is asked for: changes that move space.
SPACE_MASK = sum(BITS[b] for b in (*WRITES, "create", "delete", "rename_old", "rename_new", "close"))
#: An event's kind is the first that its mask has: what makes or removes a file counts before writes.
KIND_MASKS = (*((n, BITS[n]) for n in ("delete", "create", "rename_old", "rename_new")), ("write", sum(BITS[b] for b in WRITES)))
OTHER = "other"
STORED_KINDS = ("create", "delete", "rename_old")
RECORD_MASK = (1 << 48) - 1


def _has(reason: Column, *names: str) -> Column:
    return reason.bitwiseAND(F.lit(sum(BITS[n] for n in names))) != 0


def kind(reason: Column | str) -> Column:
    """One kind for a mask."""
    reason = (F.col(reason) if isinstance(reason, str) else reason).cast("long")
    out = F
    for name, mask in KIND_MASKS:
        out = out.when(reason.bitwiseAND(F.lit(mask)) != 0, F.lit(name))
    return out.otherwise(F.lit(OTHER))


def describe(reason: Column | str) -> Column:
    reason = (F.col(reason) if isinstance(reason, str) else reason).cast("long")
    labels = F.concat_ws("+", *[F.when(_has(reason, n), F.lit(label)) for n, label in DESCRIBED])
    return F.when(labels == "", F.format_string("0x%08X", reason)).otherwise(labels)


def record_number(reference: Column | str) -> Column:
    """The record of a 64-bit reference, without its sequence number."""
    reference = F.col(reference) if isinstance(reference, str) else reference
    return reference.bitwiseAND(F.lit(RECORD_MASK))
