"""Text normalisation and comparison (Columns in, Columns out).

Text is compared after NFKC and trimming of JavaScript's white space. Spark has no NFKC, so values that hold anything but
ASCII and unified ideographs pass a vectorised function; those, which NFKC leaves as they are, stay in the JVM (the function gets a null for them).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.shipping import vectorised

# The white space that trim() and \s mean in the data's rules.
JS_SPACE = "".join(map(chr, [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
SPACE_CLASS = "[\\t\\n\\x0b\\f\\r\\u0020\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"

# Names that mean the same.
WORK_TYPES = {"美术": "美术作品", "美术作品": "美术作品"}
PLATFORMS = {"weibo": "微博", "微博": "微博", "xiaohongshu": "小红书", "小红书": "小红书", "douyin": "抖音", "抖音": "抖音"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@vectorised("string")
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@vectorised("array<string>")
def _nfkc_each(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [unicodedata.normalize("NFKC", x or "").strip(JS_SPACE) for x in v] if v is not None else None)


@vectorised("array<string>")
def _clean_each(values: pd.Series) -> pd.Series:
    def clean(warnings):
        kept = dict.fromkeys(w for x in warnings if (w := unicodedata.normalize("NFKC", x or "").strip(JS_SPACE)))
        return [w.encode("utf-16-le", "surrogatepass")[:1000].decode("utf-16-le", "replace") for w in list(kept)[:20]]

    return values.map(lambda v: clean(v) if v is not None else None)


def _stable(c: Column) -> Column:
    """Only ASCII and U+4E00-9FFF: none of them has a decomposition or composes with another."""
    return c.rlike("^[\\x00-\\x7f\\u4e00-\\u9fff]*$")


def all_stable(values: Column) -> Column:
    return F.coalesce(F.forall(values, lambda x: x.isNull() | _stable(x)), F.lit(True))


def norm_each(values: Column) -> Column:
    """F1 of every element."""
    plain = all_stable(values)
    return F.when(plain, F.transform(values, lambda x: js_trim(F.coalesce(x, F.lit(""))))).otherwise(_nfkc_each(F.when(~plain, values)))


def document_warnings(values: Column) -> Column:
    """Normalised, empty ones dropped, first occurrences only, cut to 500 UTF-16 units, the first 20; a null list is empty."""
    plain = all_stable(values)
    kept = F.array_distinct(F.filter(F.transform(values, lambda x: js_trim(F.coalesce(x, F.lit("")))), lambda w: w != ""))
    fast = F.transform(F.slice(kept, 1, 20), lambda w: F.left(w, F.lit(500)))
    return F.coalesce(F.when(plain, fast).otherwise(_clean_each(F.when(~plain, values))), F.array().cast("array<string>"))


def stage_warnings(warnings: Column) -> Column:
    """First occurrences, without empty ones, otherwise unchanged."""
    return F.array_distinct(F.filter(warnings, lambda w: w.isNotNull() & (w != "")))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(c: Column) -> Column:
    return F.trim(c, F.lit(JS_SPACE))


def norm(c: Column) -> Column:
    """null is empty; NFKC; trimmed."""
    c = F.coalesce(c, F.lit(""))
    plain = _stable(c)
    return js_trim(F.when(plain, c).otherwise(_nfkc(F.when(~plain, c))))


def recognized(obs: Column, text: Column) -> Column:
    """the normalised text (given) of a recognised observation, null when there is none."""
    return F.when((obs["status"] == "recognized") & (text != ""), text)


def display(obs: Column, text: Column) -> Column:
    """what a report shows for an observation."""
    return F.coalesce(recognized(obs, text), F.when(obs["status"] == "partial", F.lit("未完整识别")).otherwise(F.lit("未识别")))


def _renamed(c: Column, names: dict[str, str]) -> Column:
    """The other name of c, which is computed once; null without one."""
    listed = lambda v: F.array(*[F.lit(x) for x in v])
    return F.get(listed(names.values()), F.array_position(listed(names), c).cast("int") - 1)


def work_type(text: Column) -> Column:
    """F4, of a normalised text."""
    return F.coalesce(_renamed(text, WORK_TYPES), text)


def platform(text: Column) -> Column:
    """F5, of a normalised text."""
    return F.coalesce(_renamed(F.lower(text), PLATFORMS), _renamed(text, PLATFORMS), text)


def without_published_label(text: Column) -> Column:
    """F16: without a leading 编辑于, 发布于 or 发表于."""
    return F.regexp_replace(text, f"^(?:编辑于|发布于|发表于){SPACE_CLASS}*", "")


def ascii_fold(c: Column) -> Column:
    """F32: A-Z lower-cased, nothing else."""
    return F.translate(c, UPPER, LOWER)


def like_ascii(c: Column, query: str) -> Column:
    """The query anywhere in the value; % and _ are wildcards, only A-Z fold, no escape character."""
    folded = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in query)
    return F.like(ascii_fold(c), F.lit(f"%{folded}%"), F.lit("\x01"))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, without leaving the JVM: two bytes a unit."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")
