"""Spans of page documents: what files hold in the ways that programs write them."""

import zlib

import pytest

from vellum.sinks.pdf import numbered, page_file, stream
from vellum.sources import pdf as P


def one_page(content, fonts=b"/F1 5 0 R", more=(), resources=b"", head=b""):
    page = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 600 800] /Contents 4 0 R " + head + b"/Resources << /Font << " + fonts + b" >> " + resources + b" >> >>"
    font = b"<< /Type /Font /Subtype /TrueType /BaseFont /ABCDEF+Some-Bold /FirstChar 32 /Widths [250 " + b"500 " * 95 + b"] >>"
    return numbered([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", page, content if content.startswith(b"<<") else stream(content), font, *more])


def texts(data):
    return [r["text"] for r in P.spans_of(data)]


def test_spans_are_those_that_were_written():
    rows = [{"text": t, "font": f, "size": s, "bold": b, "x0": x, "x1": x + 100.0, "page_width": 600.0} for t, f, s, b, x in (("第1章 绪论", "黑体", 16.0, True, 72.0), ("a(b)\\c𠀀", "ABCDEF+Times", 10.5, False, 80.25), ("x", "黑体", 9.0, False, 1.0))]
    got = list(P.spans_of(page_file(rows)))
    assert [(r["text"], r["font"], r["size"], r["bold"], r["page_width"]) for r in got] == [(r["text"], r["font"], r["size"], r["bold"], 600.0) for r in rows]
    assert all(abs(a[c] - b[c]) < 1e-6 for a, b in zip(got, rows, strict=True) for c in ("x0", "x1")) and [r["y"] for r in got] == sorted((r["y"] for r in got), reverse=True)


def test_operators_that_show_and_move():
    content = b"q 2 0 0 2 10 20 cm BT /F1 12 Tf 14 TL 100 200 Td (Hel\\154o \\(x\\)) Tj T* [(A) -300 (B) 20 (C)] TJ (next) ' 1 2 (last) \" ET Q BT /F1 5 Tf 3 Tr (unseen) Tj 0 Tr 1 0 0 1 7 8 Tm <48 69> Tj ET"
    got = list(P.spans_of(one_page(content)))
    assert [r["text"] for r in got] == ["Hello (x)", "A BC", "next", "last", "Hi"]
    assert [r["size"] for r in got] == [24, 24, 24, 24, 5] and got[0]["x0"] == 210 and got[0]["y"] == 420 and got[1]["y"] == 392 and got[2]["y"] == 364
    assert got[0]["x1"] - got[0]["x0"] == pytest.approx(2 * 12 * (8 * 0.5 + 0.25)) and got[4]["x0"] == 7 and all(r["bold"] for r in got)


def test_forms_and_inherited_resources():
    form = b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 5] /Length 38 >>\nstream\nBT /F1 10 Tf 1 1 Td (in form) Tj ET /X Do\nendstream"
    data = one_page(b"/X Do BI /W 1 ID \x00(no) Tj\x01 EI BT /F1 9 Tf (behind) Tj ET", resources=b"/XObject << /X 6 0 R >>", more=(form,))
    got = list(P.spans_of(data))
    assert got[0]["text"] == "in form" and got[0]["x0"] == 6 and got[-1]["text"] == "behind" and len(got) <= P.DEPTH + 2
    inherited = numbered([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R 3 0 R 2 0 R] /MediaBox [10 0 310 400] /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Type /Page /Contents [4 0 R 4 0 R] >>", stream(b"BT /F1 8 Tf 10 0 Td (p) Tj ET"), b"<< /Type /Font /BaseFont /Plain >>"])
    got = list(P.spans_of(inherited))
    assert [r["text"] for r in got] == ["p", "p"] and got[0]["x0"] == 0 and got[0]["page_width"] == 300 and not got[0]["bold"]


def test_object_streams_predictors_and_broken_tables():
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /MediaBox [0 0 600 800] /Contents 9 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Type /Font /BaseFont /Plain >>"]
    places, body = [], b""
    for n, o in zip((1, 2, 3, 5), inner, strict=True):
        places += [n, len(body)]
        body += o + b" "
    head = " ".join(map(str, places)).encode() + b" "
    data = head + body
    packed = zlib.compress(data)
    text = b"BT /F1 8 Tf (from streams) Tj ET  "
    rows = b"".join(b"\x02" + bytes((b - a) & 255 for a, b in zip(text[i - 4 : i] if i else bytes(4), text[i : i + 4], strict=False)) for i in range(0, len(text) - len(text) % 4, 4))
    up = zlib.compress(rows)
    file = b"%PDF-1.5\n" + b"8 0 obj << /Type /ObjStm /N 4 /First %d /Length %d /Filter /FlateDecode >>\nstream\r\n" % (len(head), len(packed)) + packed + b"\nendstream endobj\n"
    file += b"9 0 obj << /Length 7 /Filter [/FlateDecode] /DecodeParms [<< /Predictor 12 /Columns 4 >>] >>\nstream\n" + up + b"\nendstream endobj\nstartxref 99999 %%EOF"
    assert texts(file) == ["from streams"]


def test_maps_and_encodings():
    cmap = stream(b"1 begincodespacerange <00> <7F> endcodespacerange 1 begincodespacerange <8000> <FFFF> endcodespacerange 1 beginbfchar <01> <00660066> endbfchar 2 beginbfrange <8001> <8003> <4E00> <10> <12> [<0041> <0042>] endbfrange")
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /Wide /ToUnicode 7 0 R /DescendantFonts [<< /Subtype /CIDFontType0 /DW 500 /W [1 [700 800] 32769 32771 900] >>] >>"
    own = b"<< /Type /Font /Subtype /Type1 /BaseFont /Own /Encoding << /Differences [65 /uni4E2D /space /b 70 /endash] >> >>"
    data = one_page(b"BT /F2 10 Tf <01 8001 8003 10 11> Tj 0 -9 Td /F3 10 Tf (ABCFz\\223) Tj ET", fonts=b"/F2 6 0 R /F3 8 0 R", more=(font, cmap, own))
    got = list(P.spans_of(data))
    assert [r["text"] for r in got] == ["ff一丁AB".replace("一丁", "一丂"), "中 b–z“"] and got[0]["x1"] == pytest.approx((700 + 900 + 900 + 500 + 500) / 100)


def test_odd_files_are_rows_with_an_error(spark):
    fine = page_file([{"text": "x", "font": "A", "size": 9.0, "bold": False, "x0": 0.0, "x1": 9.0, "page_width": 600.0}])
    files = [("fine", fine), ("none", b""), ("null", None), ("half", fine[:200]), ("secret", fine.replace(b"trailer <<", b"trailer << /Encrypt 9 0 R")), ("empty", page_file([])), ("loop", numbered([b"<< /Type /Catalog /Pages 1 0 R >>"]))]
    out = {r.path: r for r in P.spans(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert out["fine"].text == "x" and out["fine"].error is None and "empty" not in out
    assert all(out[k].error and out[k].text is None for k in ("none", "null", "secret")) and "encrypted" in out["secret"].error


def test_time_grows_with_the_file_alone():
    import time

    def seconds(n):
        start = time.process_time()
        for body in (b"(" * n, b"[" * n + b"]" * n, b"<< /A " * n, b"BT /F1 9 Tf " + b"(x) Tj " * n, b"q " * n, b"% " * n):
            texts(one_page(body))
        return time.process_time() - start

    seconds(100)
    assert seconds(16000) < 8 * max(seconds(4000), 0.05)
