import json
import zlib

import pytest
from golden import GOLDEN

from tracewright.operators import layout
from tracewright.sources import files, gateway, pdf, prompts


def made(*objects, head=b"%PDF-1.7\n"):
    return head + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, b) for n, b in objects)


CATALOG = (1, b"<< /Type /Catalog /Pages 2 0 R >>")
TREE = (2, b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 72 72] >>")
PAGES = [(3, b"<< /Type /Page /Parent 2 0 R >>"), (4, b"<< /Type /Page /Parent 2 0 R /MediaBox [ 0 0 612 792.5 ] >>")]


def test_page_sizes(spark):
    assert pdf.page_sizes(made(CATALOG, TREE, *PAGES)) == ([(72, 72), (612, 792.5)], None)
    packed = b" ".join(b for _, b in PAGES)
    index = b"3 0 4 %d " % (len(PAGES[0][1]) + 1)
    stream = zlib.compress(index + packed)
    whole = made(CATALOG, TREE, (9, b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(index), len(stream), stream)))
    assert pdf.page_sizes(whole) == ([(72, 72), (612, 792.5)], None)
    assert pdf.page_sizes(made(CATALOG, TREE, *PAGES) + b"\ntrailer << /Encrypt 7 0 R >>") == ([], "PDF_ENCRYPTED")
    loop = made(CATALOG, (2, b"<< /Type /Pages /Kids [2 0 R] >>"))
    for bad in (b"", b"nope", b"%PDF-1.4", made(CATALOG), loop, made(CATALOG, (2, b"<< /Type /Page >>"))):
        assert pdf.page_sizes(bad) == ([], "PDF_INVALID")
    many = made(CATALOG, (2, b"<< /Kids [" + b" ".join(b"%d 0 R" % n for n in range(10, 91)) + b"] /MediaBox [0 0 1 1] >>"), *[(n, b"<< /Type /Page >>") for n in range(10, 91)])
    df = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(many)), ("c", bytearray(b"x"))], "path string, content binary")
    assert sorted((r["path"], r["page_count"], r["problem"]) for r in pdf.opened(df).collect()) == [("a", 2, None), ("b", 81, "PDF_INVALID"), ("c", 0, "PDF_INVALID")]


def test_prompts():
    for stage in gateway.OUTPUTS:
        body = prompts.chat(stage, '{"a": 1}', [(b"x", "image/png")])
        assert len(body["messages"]) == 2 and body["messages"][1]["content"][1]["image_url"]["url"] == "data:image/png;base64,eA=="
        assert "warnings" in json.loads(body["messages"][0]["content"].split("Form: ", 1)[1])
        assert prompts.chat(stage, "{}", [], "again")["messages"][1]["content"][-1]["text"] == gateway.CORRECTION


def test_region_errors(spark):
    kind = "doc_id string, page int, region_id string, type string, page_number int, parent_region_id string, rights_image_index int, result_index int"
    good = [("d", 1, r["regionId"], r["type"], 1, r["parentRegionId"], r["rightsImageIndex"], r["resultIndex"]) for r in GOLDEN["layout"]["pages"][0]["regions"]]
    bad = [("e", 1, "c", "certificate", 2, "x", 1, None), ("e", 1, "s", "rights_screenshot", 1, None, None, 1), ("e", 1, "s", "rights_screenshot", 1, None, 1, 1), ("e", 1, "b", "address_bar", 1, "c", None, None), ("f", 1, "s", "rights_screenshot", 1, None, 1, 1), ("f", 1, "b", "address_bar", 1, "s", 1, 2)]
    got = {(r["doc_id"], r["region_id"], r["rights_image_index"]): list(r["errors"]) for r in layout.region_errors(spark.createDataFrame(good + bad, kind)).collect()}
    assert all(e == [] for k, e in got.items() if k[0] == "d")
    assert got["e", "c", 1] == ["page_number isn't the page's number", "parent_region_id must be null", "rights_image_index must be null"]
    assert got["e", "s", None] == ["region_id is there twice", "rights_image_index must be set"] and got["e", "s", 1] == ["region_id is there twice"]
    assert got["e", "b", None] == ["parent_region_id isn't a screenshot of the page"] and got["f", "b", 1] == ["result_index isn't its screenshot's"]


def test_sizes_on_the_command_line(tmp_path, capsys):
    good, bad = tmp_path / "good.pdf", tmp_path / "bad.pdf"
    good.write_bytes(made(CATALOG, TREE, *PAGES))
    bad.write_bytes(b"no")
    assert pdf.main([str(good)]) == 0 and pdf.main([str(good), str(bad)]) == 1
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[0]["pageCount"] == 2 and lines[0]["pages"][1] == {"page": 2, "width": 612.0, "height": 792.5} and lines[2]["problem"] == "PDF_INVALID"


def test_uploads_are_written_whole_and_removed_once(spark, tmp_path):
    store = files.FileStore(spark, str(tmp_path / "up"))
    name = "0f8fad5b-d9cb-469f-a165-70867728950e.pdf"
    path = store.store(name, b"%PDF-1.7 body")
    assert (tmp_path / "up" / name).read_bytes() == b"%PDF-1.7 body" and (tmp_path / "up" / name).stat().st_mode & 0o777 == 0o600
    with pytest.raises(OSError):
        store.store(name, b"another")
    assert (tmp_path / "up" / name).read_bytes() == b"%PDF-1.7 body" and not [f for f in (tmp_path / "up").iterdir() if f.name.endswith(".part")]
    for bad in ("x.pdf", f"../{name}", f"{name}\n"):
        with pytest.raises(ValueError):
            store.store(bad, b"")
    store.remove(path)
    store.remove(path)
    assert not (tmp_path / "up" / name).exists()
    for bad in ("/etc/passwd", f"{tmp_path}/up/../x", f"{tmp_path}/up", f"{tmp_path}/upper/x"):
        with pytest.raises(ValueError):
            store.remove(bad)
