"""The object layer of a PDF: values, cross-reference tables and streams with their earlier revisions, object streams.

An object is read where the newest cross-reference section puts it, so neither an older revision nor what merely looks like an object inside a stream is taken. Only if the
sections can't be followed is the file walked from the front, stream by stream, and the last definition of a number holds.
"""

from __future__ import annotations

import re
import zlib

MAX_INFLATED = 64 * 1024 * 1024
MAX_DEPTH = 64
_SPACE, _END = b"\0\t\n\x0c\r ", b"\0\t\n\x0c\r ()<>[]{}/%"
_NUMBER = re.compile(rb"[-+]?(?:\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?=[\0\t\n\x0c\r ()<>\[\]{}/%]|$)")
_HEAD = re.compile(rb"(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+obj")


class PdfError(ValueError):
    """The file can't be read."""


class Name(str):
    """A name, without its slash."""


class Ref(tuple):
    """The number and generation of an object."""


class Word(bytes):
    """A keyword."""


class Values:
    """A reader of values in bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            c = data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 0x25:  # a comment
                while self.at < n and data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise PdfError("nested too deeply")
        self.skip()
        data, at = self.data, self.at
        c = data[at : at + 1]
        if not c:
            raise PdfError("the file ends within a value")
        if data.startswith(b"<<", at):
            return self._dictionary(depth)
        if c == b"[":
            self.at += 1
            out: list = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.value(depth + 1))
        if c == b"/":
            self.at += 1
            raw = self._run()
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self._string()
        if c == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise PdfError("a string doesn't end")
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if m := _REFERENCE.match(data, at):
            self.at = m.end()
            return Ref((int(m[1]), int(m[2])))
        if m := _NUMBER.match(data, at):
            self.at = m.end()
            return float(m[0]) if b"." in m[0] else int(m[0])
        word = self._run()
        if not word:
            raise PdfError(f"no value at {at}")
        return {b"true": True, b"false": False, b"null": None}.get(word, Word(word))

    def _run(self) -> bytes:
        at = self.at
        while self.at < len(self.data) and self.data[self.at] not in _END:
            self.at += 1
        return self.data[at : self.at]

    def _dictionary(self, depth: int) -> dict:
        self.at += 2
        out = {}
        while True:
            self.skip()
            if self.data.startswith(b">>", self.at):
                self.at += 2
                return out
            key = self.value(depth + 1)
            if not isinstance(key, Name):
                raise PdfError("a key isn't a name")
            out[key] = self.value(depth + 1)

    def _string(self) -> bytes:
        at, depth = self.at + 1, 1
        while at < len(self.data):
            c = self.data[at]
            if c == 0x5C:
                at += 1
            elif c in b"()":
                depth += 1 if c == 0x28 else -1
                if not depth:
                    raw, self.at = self.data[self.at + 1 : at], at + 1
                    return raw
            at += 1
        raise PdfError("a string doesn't end")


def _unpredicted(data: bytes, parms: dict) -> bytes:
    """Undo the rows' predictor."""
    kind, columns = parms.get("Predictor", 1), parms.get("Columns", 1)
    if kind == 1:
        return data
    if not isinstance(kind, int) or not isinstance(columns, int) or parms.get("Colors", 1) != 1 or parms.get("BitsPerComponent", 8) != 8 or not 1 <= columns <= 1 << 16:
        raise PdfError("an unknown predictor")
    out, above = bytearray(), bytearray(columns)
    if kind == 2:
        for at in range(0, len(data), columns):
            row = bytearray(data[at : at + columns])
            for i in range(1, len(row)):
                row[i] = (row[i] + row[i - 1]) & 255
            out += row
        return bytes(out)
    for at in range(0, len(data), columns + 1):
        how, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(len(row)):
            left, up, corner = row[i - 1] if i else 0, above[i], above[i - 1] if i else 0
            if how == 1:
                row[i] = (row[i] + left) & 255
            elif how == 2:
                row[i] = (row[i] + up) & 255
            elif how == 3:
                row[i] = (row[i] + (left + up) // 2) & 255
            elif how == 4:
                near = min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))  # the first of equal ones
                row[i] = (row[i] + near) & 255
        out += row
        above = row + bytearray(columns - len(row))
    return bytes(out)


class Pdf:
    """The objects of a file, by number."""

    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[int, tuple] = {}  # (1, offset), (2, stream's number, index) or (0,)
        self.trailer: dict = {}
        self.streams: dict[int, list[tuple[int, int]]] = {}
        self.plain: dict[int, bytes] = {}
        try:
            self._follow()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise PdfError("no catalog")
        except (PdfError, RecursionError):
            self._walk()

    # --- cross-reference sections

    def _follow(self) -> None:
        m = re.compile(rb"startxref[\0\t\n\x0c\r ]+(\d+)").search(self.data, max(0, self.data.rfind(b"startxref")))
        if not m:
            raise PdfError("no startxref")
        todo, seen = [int(m[1])], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            values = Values(self.data, at)
            values.skip()
            told = self._table(values) if self.data.startswith(b"xref", values.at) else self._stream_section(values.at)
            self.trailer = {**told, **self.trailer}
            todo += [told[k] for k in ("Prev", "XRefStm") if isinstance(told.get(k), int)]  # a hybrid file's stream comes before older sections

    def _table(self, values: Values) -> dict:
        values.at += 4
        while True:
            first = values.value()
            if first == b"trailer":
                told = values.value()
                if not isinstance(told, dict):
                    raise PdfError("no trailer")
                return told
            count = values.value()
            if not isinstance(first, int) or not isinstance(count, int) or count > len(self.data):
                raise PdfError("a section has no range")
            for number in range(first, first + count):
                offset, _, kind = values.value(), values.value(), values.value()
                if kind not in (b"n", b"f") or not isinstance(offset, int):
                    raise PdfError("an entry can't be read")
                self.places.setdefault(number, (1, offset) if kind == b"n" else (0,))

    def _stream_section(self, at: int) -> dict:
        _, told, content = self._object(at)
        if not isinstance(told, dict) or content is None or told.get("Type") != "XRef":
            raise PdfError("no cross-reference section")
        rows, widths = self._decoded(told, content), told.get("W")
        if not isinstance(widths, list) or len(widths) != 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths) or not sum(widths):
            raise PdfError("no widths")
        ranges, at = told.get("Index") or [0, told.get("Size", 0)], 0
        if not isinstance(ranges, list) or not all(isinstance(x, int) for x in ranges):
            raise PdfError("no ranges")
        for first, count in zip(ranges[::2], ranges[1::2], strict=False):
            for number in range(first, first + count):
                if at + sum(widths) > len(rows):
                    return told
                fields = []
                for w in widths:
                    fields.append(int.from_bytes(rows[at : at + w], "big"))
                    at += w
                kind = fields[0] if widths[0] else 1
                self.places.setdefault(number, (1, fields[1]) if kind == 1 else (2, fields[1], fields[2]) if kind == 2 else (0,))
        return told

    # --- a file whose sections can't be followed

    def _walk(self) -> None:
        self.places, self.trailer, self.streams, self.plain, at = {}, {}, {}, {}, 0
        while m := re.compile(rb"(?<![0-9])" + _HEAD.pattern + rb"|trailer").search(self.data, at):
            at = m.end()
            try:
                if m[1] is None:
                    told = Values(self.data, at).value()
                    self.trailer |= told if isinstance(told, dict) else {}
                    continue
                number, told, content = self._object(m.start())
                at = self._after
                self.places[number] = (1, m.start())
                self.streams.pop(number, None)
                if content is not None:
                    if told.get("Type") == "ObjStm":
                        self.places |= {n: (2, number, i) for i, (n, _) in enumerate(self._contents(number))}
                    elif told.get("Type") == "XRef":
                        self.trailer |= {k: told[k] for k in ("Root", "Encrypt") if k in told}
            except PdfError:
                continue
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            roots = [Ref((n, 0)) for n in self.places if isinstance(got := self._quiet(n), dict) and got.get("Type") == "Catalog"]
            self.trailer["Root"] = roots[-1] if roots else None

    def _quiet(self, number: int):
        try:
            return self.get(Ref((number, 0)))
        except PdfError:
            return None

    # --- objects

    def _object(self, at: int) -> tuple[int, object, bytes | None]:
        """Number, value and raw stream of the object at a place."""
        values = Values(self.data, at)
        values.skip()
        m = _HEAD.match(self.data, values.at)
        if not m:
            raise PdfError(f"no object at {at}")
        values.at = m.end()
        value = values.value()
        self._after = values.at
        if not isinstance(value, dict):
            return int(m[1]), value, None
        values.skip()
        if not self.data.startswith(b"stream", values.at):
            return int(m[1]), value, None
        start = values.at + 6
        start += 2 if self.data.startswith(b"\r\n", start) else 1
        length = value.get("Length")
        try:
            length = self.get(length) if isinstance(length, Ref) else length
        except PdfError:
            length = None
        if not isinstance(length, int) or not re.compile(rb"[\0\t\n\x0c\r ]*endstream").match(self.data, start + length):
            end = self.data.find(b"endstream", start)
            if end < 0:
                raise PdfError("a stream doesn't end")
            length = len(self.data[start:end].rstrip(b"\r\n"))
        self._after = start + length
        return int(m[1]), value, self.data[start : start + length]

    def _decoded(self, told: dict, content: bytes) -> bytes:
        filters = told.get("Filter") or []
        filters = filters if isinstance(filters, list) else [filters]
        parms = told.get("DecodeParms") or {}
        parms = parms[0] if isinstance(parms, list) and parms else parms
        if not filters:
            return content
        if filters != ["FlateDecode"]:
            raise PdfError("an unknown filter")
        inflate = zlib.decompressobj()
        try:
            plain = inflate.decompress(content, MAX_INFLATED)
        except zlib.error as e:
            raise PdfError(str(e)) from None
        if inflate.unconsumed_tail:
            raise PdfError("a stream is too large")
        return _unpredicted(plain, parms if isinstance(parms, dict) else {})

    def _contents(self, number: int) -> list[tuple[int, int]]:
        """The numbers and offsets of the objects in an object stream."""
        if number not in self.streams:
            place = self.places.get(number)
            if not place or place[0] != 1:
                raise PdfError("no object stream")
            _, told, content = self._object(place[1])
            if content is None or not isinstance(told.get("N"), int) or not isinstance(told.get("First"), int):
                raise PdfError("no object stream")
            plain = self._decoded(told, content)
            head = plain[: told["First"]].split()[: 2 * told["N"]]
            if not all(h.isdigit() for h in head):
                raise PdfError("an object stream's index can't be read")
            self.streams[number] = [(int(n), told["First"] + int(at)) for n, at in zip(head[::2], head[1::2], strict=False)]
            self.plain[number] = plain
        return self.streams[number]

    def get(self, value, depth: int = 0):
        """The value behind a reference, or the value itself; None for an object that isn't there."""
        if not isinstance(value, Ref):
            return value
        if depth > MAX_DEPTH:
            raise PdfError("references in a circle")
        place = self.places.get(value[0], (0,))
        if place[0] == 0:
            return None
        if place[0] == 1:
            number, found, _ = self._object(place[1])
            if number != value[0]:
                raise PdfError(f"another object stands in the place of {value[0]}")
        else:
            contents = self._contents(place[1])
            at = next((at for i, (n, at) in enumerate(contents) if n == value[0] and (i == place[2] or place[2] >= len(contents))), None) or next((at for n, at in contents if n == value[0]), None)
            if at is None:
                return None
            found = Values(self.plain[place[1]], at).value()
        return self.get(found, depth + 1) if isinstance(found, Ref) else found
