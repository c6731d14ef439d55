"""Ids, names, captions and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Captions.
STATUS_CAPTIONS = {
    "queued": "排队中",
    "rendering": "渲染页面",
    "locating": "定位证据区域",
    "recognizing": "识别证书和截图",
    "reviewing_urls": "复核地址栏 URL",
    "extracting_table": "提取汇总表",
    "associating": "关联截图与表格",
    "finalizing": "执行确定性规则",
    "completed": "已完成",
    "failed": "失败",
}
OUTCOME_CAPTIONS = {"passed": "核验通过", "issues_found": "发现问题", "needs_review": "需人工复核", "failed": "处理失败"}
LEGACY_NOTICE = "历史迁移记录，未由当前服务器重新核验。"
MAX_REPORT = 1_000_000
UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def legacy_id(owner: Column, source: Column) -> Column:
    """SHA-256 over owner, NUL and the old id."""
    return F.concat(F.lit("legacy-"), F.sha2(F.concat(owner, F.lit("\0"), source).cast("binary"), 256))


def safe_file_name(name: Column) -> Column:
    """the last part of a path, trimmed; null when it is empty, over 255 or holds control characters."""
    base = F.trim(F.regexp_replace(name, "^.*[/\\\\]", ""))
    return F.when((F.length(base).between(1, 255)) & ~base.rlike("[\\x00-\\x1f\\x7f]"), base)


def decoded_name(header: Column) -> Column:
    """A percent-encoded name, null unless encoding it again gives the same text; + stays +."""
    plain = F.try_url_decode(F.replace(header, F.lit("+"), F.lit("%2B")))
    again = F.url_encode(plain)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        again = F.replace(again, F.lit(code), F.lit(char))
    allowed = header.rlike("^[\\x21-\\x2b\\x2d-\\x7e]{1,2304}$")  # printable ASCII without a comma
    return F.when(allowed & (again == header), safe_file_name(plain))


def legacy_outcome(issues: Column) -> Column:
    """F26."""
    return F.when(F.size(issues) > 0, "issues_found").otherwise("needs_review")


def legacy_report(text: Column) -> Column:
    """with the notice in front, once, and cut."""
    marked = F.when(text.startswith(LEGACY_NOTICE), text).when(F.length(text) > 0, F.concat(F.lit(LEGACY_NOTICE + "\n\n"), text)).otherwise(LEGACY_NOTICE)
    return F.left(marked, F.lit(MAX_REPORT))


def format_bytes(n: Column) -> Column:
    """B, KB or MB with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1 << 20)))


def format_time(t: Column) -> Column:
    """month-day hour:minute, in the session's time zone."""
    return F.date_format(t, "MM/dd HH:mm")


def caption(c: Column, names: dict[str, str]) -> Column:
    """F31."""
    out = c
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def setting(value: str | int | None, least: int, most: int, default: int) -> int:
    """a whole number in its range, or the default when there is none; anything else is an error."""
    if value is None:
        return default
    try:
        number = float(str(value).strip() or 0)
    except ValueError:
        number = 0.5
    if not number.is_integer() or not least <= number <= most:
        raise ValueError(f"must be a whole number from {least} to {most}")
    return int(number)


def retention_hours(value=None) -> int:
    return setting(value, 1, 8760, 72)


def worker_slots(value=None) -> int:
    return setting(value, 1, 3, 3)


def poll_milliseconds(value=None) -> int:
    return setting(value, 100, 60_000, 1000)
