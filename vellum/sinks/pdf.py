"""Page documents from spans: a page a document, made on the executors, with fonts by name and a character map."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.batches import FILES, lots
from vellum.operators.durable import dealt_for_work

HEIGHT, LEADING = 842, 1.5


def numbered(objects: list[bytes]) -> bytes:
    """A file of objects 1, 2, .., the first of which is the catalog."""
    out, places = bytearray(b"%PDF-1.7\n"), []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + o + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at)


def stream(data: bytes) -> bytes:
    packed = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"


def name(text: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if chr(c).isalnum() and c < 128 or c in b"+-_." else b"#%02X" % c for c in text.encode())


def character_map(chars: list[str]) -> bytes:
    lines = b"".join(b"<%04X> <%s>\n" % (k, c.encode("utf-16-be").hex().encode()) for k, c in enumerate(chars, 1))
    return b"1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n%d beginbfchar\n" % len(chars) + lines + b"endbfchar\n"


def page_file(spans: list[dict]) -> bytes:
    """One page of spans(text, font, size, bold, x0, x1, page_width), a line each. Every character is as wide as it is high, scaled to x1."""
    chars = sorted({c for s in spans for c in s["text"]})
    code = {c: b"%04X" % k for k, c in enumerate(chars, 1)}
    fonts = {key: k for k, key in enumerate(dict.fromkeys((s["font"], bool(s["bold"])) for s in spans))}
    y, lines = float(HEIGHT), []
    for s in spans:
        y -= LEADING * s["size"]
        scale = 100 * (s["x1"] - s["x0"]) / (len(s["text"]) * s["size"])
        shown = b"".join(code[c] for c in s["text"])
        lines.append(f"BT /F{fonts[s['font'], bool(s['bold'])]} {s['size']!r} Tf {scale!r} Tz 1 0 0 1 {s['x0']!r} {y!r} Tm <".encode() + shown + b"> Tj ET")
    width = repr(float(spans[0]["page_width"] if spans else 595)).encode()
    used = b" ".join(b"/F%d %d 0 R" % (k, 6 + 3 * k) for k in fonts.values())
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 " + width + b" %d] /Contents 4 0 R /Resources << /Font << " % HEIGHT + used + b" >> >> >>", stream(b"\n".join(lines)), stream(character_map(chars)),
    ]
    for (font, bold), k in fonts.items():
        objects += [
            b"<< /Type /Font /Subtype /Type0 /BaseFont " + name(font) + b" /Encoding /Identity-H /ToUnicode 5 0 R /DescendantFonts [%d 0 R] >>" % (7 + 3 * k),
            b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont " + name(font) + b" /DW 1000 /FontDescriptor %d 0 R >>" % (8 + 3 * k),
            b"<< /Type /FontDescriptor /FontName " + name(font) + b" /Flags %d >>" % (4 | bold << 18),
        ]
    return numbered(objects)


def as_pages(spans: DataFrame) -> DataFrame:
    """(doc_id, content): a page document of each document's spans(doc_id, ord, text, ..); spans without text aren't drawn."""
    import json

    names = ["ord", "text", "font", "size", "bold", "x0", "x1", "page_width"]
    blank = dict.fromkeys(names)

    def content(rows: str) -> bytes:
        spans = sorted((blank | row for row in json.loads(rows)), key=lambda r: (r["ord"] is None, r["ord"]))
        return page_file([s | {c: float("nan" if s[c] is None else s[c]) for c in ("size", "x0", "x1", "page_width")} for s in spans])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = ((doc_id, content(rows)) for batch in batches for doc_id, rows in zip(batch["doc_id"], batch["rows"], strict=True))
        return lots(made, ["doc_id", "content"], FILES, dtype=object)

    rows = spans.filter(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*names).alias("row"))
    return dealt_for_work(rows).groupBy("doc_id").agg(F.to_json(F.collect_list("row")).alias("rows")).mapInPandas(build, "doc_id long, content binary")
