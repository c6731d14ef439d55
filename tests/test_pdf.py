import random
import struct
import zlib

import pytest

from tracewright.sources import pdf, pdf_objects

CATALOG = b"<< /Type /Catalog /Pages 2 0 R >>"


class File:
    """A PDF written revision by revision."""

    def __init__(self):
        self.data, self.at = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n", None

    def put(self, **objects):
        """Objects by number (o1=...), and where they are."""
        places = {}
        for name, body in objects.items():
            places[int(name[1:])] = len(self.data)
            self.data += b"%d 0 obj\n%s\nendobj\n" % (int(name[1:]), body)
        return places

    def close(self, trailer):
        self.data += b"%sstartxref\n%d\n%%%%EOF\n" % (trailer, self.at)

    def table(self, extra=b"", **objects):
        places = self.put(**objects)
        before, self.at = self.at, len(self.data)
        rows = b"".join(b"%d 1\n%010d 00000 n \n" % (n, at) for n, at in places.items())
        self.close(b"xref\n0 1\n0000000000 65535 f \n" + rows + b"trailer\n<< /Size 99 /Root 1 0 R %s%s >>\n" % (b"/Prev %d " % before if before else b"", extra))
        return self

    def streamed(self, packed=(), predictor=12, **objects):
        """Objects and a packed object stream, with a cross-reference stream."""
        places = {n: (1, at, 0) for n, at in self.put(**objects).items()}
        if packed:
            body = b" ".join(b for _, b in packed)
            offsets, at = [], 0
            for _, b in packed:
                offsets.append(at)
                at += len(b) + 1
            index = b" ".join(b"%d %d" % (n, at) for (n, _), at in zip(packed, offsets, strict=True)) + b" "
            places |= {n: (2, 50, i) for i, (n, _) in enumerate(packed)}
            stream = zlib.compress(index + body)
            places |= {n: (1, at, 0) for n, at in self.put(o50=b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), len(index), len(stream), stream)).items()}
        before, self.at = self.at, len(self.data)
        places[60] = (1, self.at, 0)
        rows = [struct.pack(">BIB", *places[n]) for n in sorted(places)]
        if predictor == 12:
            rows = [b"\2" + bytes((a - b) & 255 for a, b in zip(r, up, strict=True)) for r, up in zip(rows, [bytes(6), *rows], strict=False)]
        plain = zlib.compress(b"".join(rows))
        parms = b"/DecodeParms << /Predictor 12 /Columns 6 >> " if predictor == 12 else b""
        index = b" ".join(b"%d 1" % n for n in sorted(places))
        self.put(o60=b"<< /Type /XRef /Size 99 /Root 1 0 R /W [1 4 1] /Index [%s] /Filter /FlateDecode %s%s/Length %d >>\nstream\n%s\nendstream" % (index, parms, b"/Prev %d " % before if before else b"", len(plain), plain))
        self.close(b"")
        return self


def tree(*kids, more=b""):
    return b"<< /Type /Pages /Kids [%s] /Count %d %s >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids), more)


def page(more=b""):
    return b"<< /Type /Page /Parent 2 0 R %s >>" % more


def box(w, h, name=b"MediaBox"):
    return b"/%s [0 0 %d %d]" % (name, w, h)


def test_the_newest_revision_holds():
    first = File().table(o1=CATALOG, o2=tree(3), o3=page(box(100, 200)))
    assert pdf.page_sizes(first.data) == ([(100, 200)], None)
    second = first.table(o3=page(box(300, 400)), o4=page(box(5, 6)), o2=tree(3, 4))
    assert pdf.page_sizes(second.data) == ([(300, 400), (5, 6)], None)
    # An object that no section names, newer in the file than the one that holds.
    stale = File()
    stale.table(o1=CATALOG, o2=tree(3), o3=page(box(100, 200)))
    at = stale.data.rfind(b"xref\n0 1")
    stale.data = stale.data[:at] + b"3 0 obj\n" + page(box(9, 9)) + b"\nendobj\n" + stale.data[at:].replace(b"startxref\n%d" % stale.at, b"startxref\n%d" % (stale.at + len(page(box(9, 9))) + 16))
    assert pdf.page_sizes(stale.data) == ([(100, 200)], None)


def test_objects_within_streams_are_not_taken():
    hidden = b"endstream? no\nendobj\n3 0 obj\n" + page(box(1, 1)) + b"\nendobj\n"
    stream = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(hidden), hidden)
    whole = File().table(o1=CATALOG, o2=tree(3), o3=page(box(70, 80)), o7=stream)
    assert pdf.page_sizes(whole.data) == ([(70, 80)], None)
    broken = whole.data.replace(b"startxref", b"startxxxx")  # walked from the front, over the stream
    assert pdf.page_sizes(broken) == ([(70, 80)], None)
    moved = whole.data.replace(b"%PDF-1.7\n", b"%PDF-1.7\n% a line more\n")  # every offset is wrong
    assert pdf.page_sizes(moved) == ([(70, 80)], None)


@pytest.mark.parametrize("predictor", [1, 12])
def test_cross_reference_streams(predictor):
    file = File().streamed(packed=[(2, tree(3, 4)), (3, page(box(10, 20))), (4, page())], predictor=predictor, o1=CATALOG)
    assert pdf.page_sizes(file.data) == ([(10, 20), (612, 792)], None)
    file.streamed(predictor=predictor, o4=page(box(30, 40)))
    assert pdf.page_sizes(file.data) == ([(10, 20), (30, 40)], None)
    file.table(o3=page(box(11, 21)))  # a table over streams
    assert pdf.page_sizes(file.data) == ([(11, 21), (30, 40)], None)
    assert pdf.page_sizes(file.data.replace(b"startxref", b"startxxxx")) == ([(11, 21), (30, 40)], None)


def test_a_hybrid_file():
    file = File()
    places = file.put(o1=CATALOG, o2=tree(3), o3=page(box(1, 2)))
    hidden = File()
    hidden.data, hidden.at = file.data, None
    hidden.streamed(packed=[(3, page(box(50, 60)))])
    rows = b"".join(b"%d 1\n%010d 00000 n \n" % (n, at) for n, at in places.items() if n != 3)
    at = len(hidden.data)
    data = hidden.data + b"xref\n0 1\n0000000000 65535 f \n" + rows + b"trailer\n<< /Root 1 0 R /XRefStm %d >>\nstartxref\n%d\n%%%%EOF" % (hidden.at, at)
    assert pdf.page_sizes(data) == ([(50, 60)], None)


def test_boxes_rotation_and_units():
    sizes = lambda more, up=b"", **objects: pdf.page_sizes(File().table(o1=CATALOG, o2=tree(3, more=up), o3=page(more), **objects).data)[0]
    assert sizes(b"/MediaBox 5 0 R", o5=b"[0 6 0 R 100 300]", o6=b"50") == [(100, 250)]  # behind references
    assert sizes(b"/Rotate 90", box(10, 20)) == [(20, 10)] and sizes(b"", box(10, 20) + b" /Rotate -270") == [(20, 10)] and sizes(b"/Rotate 180", box(10, 20)) == [(10, 20)] and sizes(b"/Rotate 45", box(10, 20)) == [(10, 20)]
    assert sizes(box(100, 100) + b" /CropBox [10 20 200 60]") == [(90, 40)]
    assert sizes(box(100, 100) + b" /CropBox [200 200 300 300]") == [(100, 100)]  # nothing in common
    assert sizes(b"/MediaBox [100 300 0 50.5]") == [(100, 249.5)] and sizes(b"/MediaBox [0 0 0 5]") == [(612, 792)] and sizes(b"/MediaBox /Wrong") == [(612, 792)]
    assert sizes(box(10, 20) + b" /UserUnit 2.5") == [(25, 50)]
    assert sizes(b"/A#20B (a \\) (b) >>) /C <48 6> % >> a comment\n" + box(7, 8)) == [(7, 8)]


def test_files_that_cannot_be_read():
    good = File().table(o1=CATALOG, o2=tree(3), o3=page(box(1, 2))).data
    assert pdf.page_sizes(File().table(b"/Encrypt 9 0 R", o1=CATALOG, o2=tree(3), o3=page()).data) == ([], "PDF_ENCRYPTED")
    assert pdf.page_sizes(good.replace(b"/Kids", b"/Kidz")) == ([], "PDF_INVALID")
    loop = File().table(o1=CATALOG, o2=tree(3), o3=tree(2)).data
    deep = File().table(o1=b"[" * 500 + b"]" * 500).data
    circle = File().table(o1=CATALOG, o2=b"3 0 R", o3=b"2 0 R").data
    for bad in (loop, deep, circle, b"%PDF-1.7", good[:60]):
        assert pdf.page_sizes(bad) == ([], "PDF_INVALID")


def test_a_stream_that_grows_too_large(monkeypatch):
    monkeypatch.setattr(pdf_objects, "MAX_INFLATED", 1000)
    assert pdf.page_sizes(File().streamed(packed=[(2, tree(3)), (3, page(box(1, 2)) + b" " * 5000)], o1=CATALOG).data) == ([], "PDF_INVALID")


def test_broken_bytes_never_raise():
    rng = random.Random(1)
    files = [File().table(o1=CATALOG, o2=tree(3, 4), o3=page(box(1, 2)), o4=page()).table(o3=page(box(3, 4))).data, File().streamed(packed=[(2, tree(3)), (3, page(box(1, 2)))], o1=CATALOG).data]
    for _ in range(1500):
        data = bytearray(rng.choice(files))
        for _ in range(rng.randrange(1, 12)):
            data[rng.randrange(8, len(data))] = rng.randrange(256)
        sizes, problem = pdf.page_sizes(bytes(data[: rng.randrange(20, len(data) + 1)] if rng.random() < 0.3 else data))
        assert problem in (None, "PDF_INVALID", "PDF_ENCRYPTED") and bool(sizes) == (problem is None)


@pytest.mark.parametrize("how", [0, 1, 2, 3, 4])
def test_predictors(how):
    rng = random.Random(how)
    rows, above, packed = [bytes(rng.randrange(256) for _ in range(7)) for _ in range(5)], bytes(7), b""
    for row in rows:
        guess = []
        for i in range(7):
            left, up, corner = row[i - 1] if i else 0, above[i], above[i - 1] if i else 0
            p = left + up - corner
            near = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            guess.append([0, left, up, (left + up) // 2, near][how])
        packed += bytes([how]) + bytes((a - g) & 255 for a, g in zip(row, guess, strict=True))
        above = row
    assert pdf_objects._unpredicted(packed, {"Predictor": 15, "Columns": 7}) == b"".join(rows)
