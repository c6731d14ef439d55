"""Strict schemas of the audit data: declared once, used for validation and as Spark types.

A schema accepts exactly its declared keys. Lengths count UTF-16 units. Limits are part of the meaning of the data: a
record beyond them is rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import Any

from pyspark.sql import types as T

# Limits.
MAX_PDF_BYTES = 20 * 1024 * 1024
MAX_PDF_PAGES = 80
MAX_BATCH_ITEMS = 6
MAX_URL_PAIRS = 4
MAX_IMAGE_BYTES = 7 * 1024 * 1024
MAX_BATCH_BYTES = 24 * 1024 * 1024
COMPLETE_CONFIDENCE = 0.8
MAX_TASK_ATTEMPTS = 3
MODEL = "qwen3.7-plus"
PARSER_MODE = "qwen3.7-plus 区域隔离识别 + 600 DPI URL 复核 + 确定性规则"

# Enumerations.
OUTCOMES = ("passed", "issues_found", "needs_review", "failed")
RECOGNITION = ("recognized", "partial", "unrecognized")
PRESENCE = ("provided", "not_provided", "uncertain")
REGION_TYPES = ("certificate", "rights_screenshot", "address_bar", "summary_table")
STAGES = ("layout", "evidence", "url_review", "table", "association")
SCOPES = ("RIGHTS", "RESULT", "STRUCTURE")
FIELDS = ("rightsHolderName", "workType", "platform", "publisher", "publishedAt", "url", "association", "structure")
ACTIVE_STATUSES = ("rendering", "locating", "recognizing", "reviewing_urls", "extracting_table", "associating", "finalizing")
TERMINAL_STATUSES = ("completed", "failed")
TASK_STATUSES = ("queued", *ACTIVE_STATUSES, *TERMINAL_STATUSES)

Issue = tuple[str, str]


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(ord(c) > 0xFFFF for c in text)


@dataclass(frozen=True)
class Spec:
    nullable: bool = False
    check: Callable[[Any, str], Iterator[Issue]] | None = None

    def errors(self, value: Any, path: str = "") -> Iterator[Issue]:
        """(path, message) of everything that is wrong with the value."""
        if value is None:
            if not self.nullable:
                yield path, "is null"
            return
        found = False
        for e in self.own(value, path):
            found = True
            yield e
        if not found and self.check:
            yield from self.check(value, path)

    def own(self, value: Any, path: str) -> Iterator[Issue]:
        raise NotImplementedError

    def spark(self) -> T.DataType:
        raise NotImplementedError


@dataclass(frozen=True)
class Text(Spec):
    least: int = 0
    most: int | None = None
    one_of: tuple[str, ...] = ()

    def own(self, value, path):
        if not isinstance(value, str):
            yield path, "isn't a text"
        elif self.one_of and value not in self.one_of:
            yield path, "isn't one of the allowed values"
        elif units(value) < self.least:
            yield path, "is too short"
        elif self.most is not None and units(value) > self.most:
            yield path, "is too long"

    def spark(self):
        return T.StringType()


@dataclass(frozen=True)
class Number(Spec):
    least: float | None = None
    most: float | None = None
    whole: bool = False
    above: float | None = None

    def own(self, value, path):
        if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value in (float("inf"), float("-inf")):
            yield path, "isn't a number"
        elif self.whole and value != int(value):
            yield path, "isn't a whole number"
        elif self.least is not None and value < self.least or self.above is not None and value <= self.above:
            yield path, "is too small"
        elif self.most is not None and value > self.most:
            yield path, "is too large"

    def spark(self):
        return T.IntegerType() if self.whole else T.DoubleType()


@dataclass(frozen=True)
class Flag(Spec):
    def own(self, value, path):
        if not isinstance(value, bool):
            yield path, "isn't true or false"

    def spark(self):
        return T.BooleanType()


@dataclass(frozen=True)
class Many(Spec):
    item: Spec = field(default_factory=Flag)
    least: int = 0
    most: int | None = None

    def own(self, value, path):
        if not isinstance(value, list):
            yield path, "isn't a list"
            return
        if len(value) < self.least:
            yield path, "has too few items"
        if self.most is not None and len(value) > self.most:
            yield path, "has too many items"
        for i, x in enumerate(value):
            yield from self.item.errors(x, f"{path}[{i}]")

    def spark(self):
        return T.ArrayType(self.item.spark())


@dataclass(frozen=True)
class Record(Spec):
    fields: tuple[tuple[str, Spec], ...] = ()

    def own(self, value, path):
        if not isinstance(value, dict):
            yield path, "isn't a record"
            return
        known = dict(self.fields)
        for k in value:
            if k not in known:
                yield f"{path}.{k}".lstrip("."), "is an unknown key"
        for k, s in self.fields:
            at = f"{path}.{k}".lstrip(".")
            if k not in value:
                yield at, "is missing"
            else:
                yield from s.errors(value[k], at)

    def spark(self):
        return T.StructType([T.StructField(k, s.spark()) for k, s in self.fields])


@cache
def fitting(spec: Spec) -> Callable[[Any], bool]:
    """A function that tells whether a parsed JSON value has no errors: one flat function, for the many values without any. It is never true for a value with errors; where it
    is false, errors() decides."""
    names: dict[str, Any] = {"units": units}
    lines: list[str] = []

    def named(value: Any) -> str:
        names[name := f"n{len(names)}"] = value
        return name

    def put(s: Spec, v: str, deep: int) -> None:
        def unless(holds: str) -> None:
            lines.append("    " * deep + f"if not ({holds}): return False")

        if s.nullable:
            lines.append("    " * deep + f"if {v} is not None:")
            deep += 1
        if isinstance(s, Text):
            unless(f"type({v}) is str")
            if s.one_of:
                unless(f"{v} in {named(frozenset(s.one_of))}")
            if s.least:
                unless(f"len({v}) >= {s.least}")
            if s.most is not None:
                unless(f"len({v}) <= {s.most // 2} or units({v}) <= {s.most}")
        elif isinstance(s, Number):
            unless(f"(type({v}) is int or type({v}) is float) and {v} - {v} == 0")
            for limit, sign in ((s.least, ">="), (s.above, ">"), (s.most, "<=")):
                if limit is not None:
                    unless(f"{v} {sign} {named(limit)}")
            if s.whole:
                unless(f"{v} == int({v})")
        elif isinstance(s, Flag):
            unless(f"type({v}) is bool")
        elif isinstance(s, Many):
            unless(f"type({v}) is list and len({v}) >= {s.least}" + (f" and len({v}) <= {s.most}" if s.most is not None else ""))
            lines.append("    " * deep + f"for {v}_ in {v}:")
            put(s.item, f"{v}_", deep + 1)
        elif isinstance(s, Record):
            unless(f"type({v}) is dict and len({v}) == {len(dict(s.fields))}")
            for i, (k, of) in enumerate(s.fields):
                lines.append("    " * deep + f"{v}{i} = {v}[{k!r}]")
                put(of, f"{v}{i}", deep)
        else:
            unless("False")
        if s.check:
            unless(f"next({named(s.check)}({v}, ''), None) is None")

    put(spec, "v", 2)
    exec("\n".join(["def fits(v):", "    try:", *lines, "        return True", "    except KeyError:", "        return False"]), names)
    return names["fits"]


def record(nullable: bool = False, check=None, **fields: Spec) -> Record:
    return Record(nullable, check, tuple(fields.items()))


def _id(nullable=False):
    return Text(nullable, least=1, most=100)


def _index(nullable=False):
    return Number(nullable, least=1, most=10_000, whole=True)


PAGE, CONFIDENCE = Number(least=1, most=MAX_PDF_PAGES, whole=True), Number(least=0, most=1)
ORDER = Number(least=1, most=100_000, whole=True)
SHORT, LONG_OR_NULL = Text(most=500), Text(True, most=2000)
_WARNING = Text(least=1, most=500)
BATCH_WARNINGS, DOCUMENT_WARNINGS = Many(item=_WARNING, most=20), Many(item=_WARNING, most=MAX_PDF_PAGES * 20)


def _inside(b, path):
    if b["x"] + b["width"] > 1 or b["y"] + b["height"] > 1:
        yield path, "isn't inside the page"


BOUNDS = record(x=Number(least=0, most=1), y=Number(least=0, most=1), width=Number(above=0, most=1), height=Number(above=0, most=1), check=_inside)
REGION = record(
    regionId=_id(), type=Text(one_of=REGION_TYPES), pageNumber=PAGE, bounds=BOUNDS, parentRegionId=_id(True),
    rightsImageIndex=_index(True), resultIndex=_index(True), readingOrder=ORDER, confidence=CONFIDENCE,
)


def _page(page, path):
    """Regions of a page: its page number, unique ids, what each type sets or leaves out, address bars inside a screenshot."""
    by_id = {}
    for i, r in enumerate(page["regions"]):
        if r["pageNumber"] != page["pageNumber"]:
            yield f"{path}.regions[{i}].pageNumber".lstrip("."), "isn't the page's number"
        if r["regionId"] in by_id:
            yield f"{path}.regions[{i}].regionId".lstrip("."), "is there twice"
        by_id[r["regionId"]] = r
    for i, r in enumerate(page["regions"]):
        at = f"{path}.regions[{i}]".lstrip(".")
        indexes = ("rightsImageIndex", "resultIndex")
        if r["type"] == "address_bar":
            parent = by_id.get(r["parentRegionId"])
            if parent is None or parent["type"] != "rights_screenshot":
                yield f"{at}.parentRegionId", "isn't a screenshot of the page"
                continue
            yield from ((f"{at}.{k}", "isn't its screenshot's") for k in indexes if r[k] != parent[k])
            continue
        if r["parentRegionId"] is not None:
            yield f"{at}.parentRegionId", "must be null"
        wants = r["type"] == "rights_screenshot"
        yield from ((f"{at}.{k}", "must be set" if wants else "must be null") for k in indexes if (r[k] is None) == wants)


PAGE_LAYOUT = record(pageNumber=PAGE, regions=Many(item=REGION, most=200), warnings=BATCH_WARNINGS, confidence=CONFIDENCE, check=_page)


def _batch(batch, path):
    pages, regions = set(), set()
    for i, page in enumerate(batch["pages"]):
        if page["pageNumber"] in pages:
            yield f"{path}.pages[{i}].pageNumber".lstrip("."), "is there twice"
        pages.add(page["pageNumber"])
        for j, r in enumerate(page["regions"]):
            if r["regionId"] in regions:
                yield f"{path}.pages[{i}].regions[{j}].regionId".lstrip("."), "is there twice"
            regions.add(r["regionId"])


LAYOUT_BATCH = record(pages=Many(item=PAGE_LAYOUT, least=1, most=MAX_BATCH_ITEMS), warnings=BATCH_WARNINGS, check=_batch)
_SEEN = {"rawText": LONG_OR_NULL, "status": Text(one_of=RECOGNITION), "confidence": CONFIDENCE, "pageNumber": PAGE, "regionId": _id()}
OBSERVATION = record(**_SEEN)
PUBLISHED_AT = record(**_SEEN, kind=Text(one_of=("published", "edited", "unknown")), yearContextClear=Flag())
CERTIFICATE = record(regionId=_id(), pageNumber=PAGE, isFormalCertificate=Text(one_of=("yes", "no", "uncertain")), owner=OBSERVATION, workType=OBSERVATION)
SCREENSHOT = record(
    screenshotId=_id(), regionId=_id(), pageNumber=PAGE, rightsImageIndex=_index(), resultIndex=_index(), visiblePlatform=OBSERVATION, addressHost=OBSERVATION,
    publisher=OBSERVATION, publishedAt=PUBLISHED_AT, initialUrl=OBSERVATION, addressBarRegionId=_id(True),
)
EVIDENCE_BATCH = record(certificates=Many(item=CERTIFICATE, most=200), screenshots=Many(item=SCREENSHOT, most=500), warnings=BATCH_WARNINGS)
_PLACE = Number(least=0, most=20_000, whole=True)
URL_REVIEW = record(
    screenshotId=_id(), colorRead=LONG_OR_NULL, grayscaleRead=LONG_OR_NULL,
    differingPositions=Many(item=record(index=_PLACE, colorCharacter=Text(True, most=8), grayscaleCharacter=Text(True, most=8)), most=500),
    unresolvedCharacters=Many(item=record(index=_PLACE, candidates=Many(item=Text(least=1, most=8), least=1, most=10)), most=500),
    finalRead=LONG_OR_NULL, status=Text(one_of=RECOGNITION), confidence=CONFIDENCE,
)
URL_REVIEW_BATCH = record(reviews=Many(item=URL_REVIEW, most=200), warnings=BATCH_WARNINGS)
TABLE_HEADER = record(regionId=_id(), pageNumber=PAGE, rightsHolderName=OBSERVATION, workType=OBSERVATION)
TABLE_ROW = record(
    tableRowId=_id(), pageNumber=PAGE, regionId=_id(), rightsImageIndex=_index(), resultIndex=_index(), platform=OBSERVATION, publisher=OBSERVATION,
    publishedAt=OBSERVATION, urlCellSegments=Many(item=SHORT, least=1, most=50),
)
TABLE_BATCH = record(headers=Many(item=TABLE_HEADER, most=20), rows=Many(item=TABLE_ROW, most=1000), warnings=BATCH_WARNINGS)
ASSOCIATION = record(screenshotId=_id(), tableRowId=_id(True), confidence=CONFIDENCE, reason=SHORT)
ASSOCIATION_BATCH = record(associations=Many(item=ASSOCIATION, most=1000), warnings=BATCH_WARNINGS)
STAGE_FAILURE = record(stage=Text(one_of=STAGES), code=_id(), pageNumber=Number(True, least=1, most=MAX_PDF_PAGES, whole=True), regionId=_id(True), message=SHORT)
REQUEST = record(
    fileName=Text(least=1, most=255), pageCount=PAGE,
    layout=record(pages=Many(item=PAGE_LAYOUT, least=1, most=MAX_PDF_PAGES), warnings=DOCUMENT_WARNINGS),
    evidence=record(certificates=Many(item=CERTIFICATE, most=MAX_PDF_PAGES * 2), screenshots=Many(item=SCREENSHOT, most=40_000), warnings=DOCUMENT_WARNINGS),
    urlReviews=record(reviews=Many(item=URL_REVIEW, most=40_000), warnings=DOCUMENT_WARNINGS),
    table=record(headers=Many(item=TABLE_HEADER, most=MAX_PDF_PAGES), rows=Many(item=TABLE_ROW, most=40_000), warnings=DOCUMENT_WARNINGS),
    associations=record(associations=Many(item=ASSOCIATION, most=40_000), warnings=DOCUMENT_WARNINGS),
    warnings=DOCUMENT_WARNINGS, stageFailures=Many(item=STAGE_FAILURE, most=1000),
)
FINDING = record(code=_id(), scope=Text(one_of=SCOPES), rightsImageIndex=_index(True), resultIndex=_index(True), field=Text(True, one_of=FIELDS), message=Text(most=2000))
REPORT = record(certificateIssues=Many(item=FINDING, most=1000), resultIssues=Many(item=FINDING, most=10_000), issues=Many(item=FINDING, most=11_000), verificationNotices=Many(item=FINDING, most=10_000))
SUMMARY = record(
    parserMode=Text(least=1, most=200), pageCount=PAGE, rightsFieldCount=Number(least=0, most=2, whole=True), groupCount=Number(least=0, most=10_000, whole=True),
    tableRowCount=Number(least=0, most=40_000, whole=True), screenshotHeadingCount=Number(least=0, most=40_000, whole=True), warnings=DOCUMENT_WARNINGS,
    confidence=CONFIDENCE, extractionComplete=Flag(),
)
_LOCATOR = record(id=_id(), pageNumber=PAGE, rightsImageIndex=_index(), resultIndex=_index(), readingOrder=ORDER)
_NAME = {"fileName": Text(least=1, most=255), "totalPages": PAGE}
_EVIDENCE_REGION = record(regionId=_id(), type=Text(one_of=("certificate", "rights_screenshot")), pageNumber=PAGE, rightsImageIndex=_index(True), resultIndex=_index(True), addressBarRegionId=_id(True), readingOrder=ORDER)
LAYOUT_REQUEST = record(**_NAME, pageNumbers=Many(item=PAGE, least=1, most=MAX_BATCH_ITEMS))
EVIDENCE_REQUEST = record(**_NAME, regions=Many(item=_EVIDENCE_REGION, least=1, most=MAX_BATCH_ITEMS))
URL_REVIEW_REQUEST = record(**_NAME, pairs=Many(item=record(screenshotId=_id(), pageNumber=PAGE, addressBarRegionId=_id()), least=1, most=MAX_URL_PAIRS))
TABLE_REQUEST = record(**_NAME, regions=Many(item=record(regionId=_id(), pageNumber=PAGE, readingOrder=ORDER), least=1, most=MAX_BATCH_ITEMS))
ASSOCIATION_REQUEST = record(screenshots=Many(item=_LOCATOR, most=40_000), tableRows=Many(item=_LOCATOR, most=40_000))

SPECS = {
    "layout_batch": LAYOUT_BATCH, "evidence_batch": EVIDENCE_BATCH, "url_review_batch": URL_REVIEW_BATCH, "table_batch": TABLE_BATCH, "association_batch": ASSOCIATION_BATCH,
    "request": REQUEST, "report": REPORT, "summary": SUMMARY, "layout_request": LAYOUT_REQUEST, "evidence_request": EVIDENCE_REQUEST,
    "url_review_request": URL_REVIEW_REQUEST, "table_request": TABLE_REQUEST, "association_request": ASSOCIATION_REQUEST,
}
