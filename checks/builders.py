"""Small document files, built from literal bytes so that their text is known."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def rels(*items: tuple[str, str, str]) -> str:
    body = "".join(
        f'<Relationship Id="{i}" Type="{OFFICE}/{kind}" Target="{target}"/>'
        for i, kind, target in items
    )
    return f'<Relationships xmlns="{RELS}">{body}</Relationships>'


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(body: str) -> bytes:
    return package(
        {
            "_rels/.rels": rels(("r1", "officeDocument", "word/document.xml")),
            "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>',
        }
    )


def paragraph(text: str) -> str:
    run = f'<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r>' if text else ""
    return f"<w:p>{run}</w:p>"


def xlsx(
    sheets: dict[str, str],
    shared: list[str] = (),
    styles: str = "",
    kind: str = "worksheet",
    before: str = "",
) -> bytes:
    links = [(f"r{i}", kind, f"worksheets/s{i}.xml") for i in range(len(sheets))]
    extra = [("rs", "sharedStrings", "sharedStrings.xml"), ("rt", "styles", "styles.xml")]
    listed = "".join(
        f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)
    )
    parts = {
        "_rels/.rels": rels(("r1", "officeDocument", "xl/workbook.xml")),
        "xl/_rels/workbook.xml.rels": rels(*links, *extra),
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>',
        "xl/sharedStrings.xml": f'<sst xmlns="{S}">{"".join(shared)}</sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{S}">{styles}</styleSheet>',
    }
    for i, rows in enumerate(sheets.values()):
        parts[f"xl/worksheets/s{i}.xml"] = (
            f'<worksheet xmlns="{S}">{before}<sheetData>{rows}</sheetData></worksheet>'
        )
    return package(parts)


def cell(value, ref: str = "", style: int | None = None) -> str:
    at = (f' r="{ref}"' if ref else "") + (f' s="{style}"' if style is not None else "")
    if value is None:
        return f"<c{at}/>"
    if isinstance(value, bool):
        return f'<c{at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c{at}><v>{value!r}</v></c>"
    return f'<c{at} t="inlineStr"><is><t>{escape(value)}</t></is></c>'


def row(*values) -> str:
    return "<row>" + "".join(cell(v) for v in values) + "</row>"


def pptx(*slides: str) -> bytes:
    links = [(f"r{i}", "slide", f"slides/s{i}.xml") for i in range(len(slides))]
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="r{i}"/>' for i in range(len(slides)))
    parts = {
        "_rels/.rels": rels(("r1", "officeDocument", "ppt/presentation.xml")),
        "ppt/_rels/presentation.xml.rels": rels(*links),
        "ppt/presentation.xml": (
            f'<p:presentation xmlns:p="{P}" xmlns:r="{OFFICE}">'
            f"<p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
        ),
    }
    for i, shapes in enumerate(slides):
        parts[f"ppt/slides/s{i}.xml"] = (
            f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{shapes}'
            "</p:spTree></p:cSld></p:sld>"
        )
    return package(parts)


def shape(*paragraphs: str) -> str:
    body = "".join(f"<a:p><a:r><a:t>{escape(p)}</a:t></a:r></a:p>" for p in paragraphs)
    return f"<p:sp><p:txBody>{body}</p:txBody></p:sp>"


def error(value: str) -> str:
    return f'<c t="e"><v>{value}</v></c>'


def shared(index: int, ref: str = "") -> str:
    at = f' r="{ref}"' if ref else ""
    return f'<c{at} t="s"><v>{index}</v></c>'


def strings(texts: list[str]) -> list[str]:
    return [f"<si><t>{escape(t)}</t></si>" for t in texts]


def truncated(text: str, kind: str) -> bytes:
    """A file whose first part of content ends amid a tag."""
    body = {"docx": docx, "pptx": pptx, "xlsx": lambda b: xlsx({"s": b}), "pdf": lambda b: package({"x": b})}
    whole = body[kind](paragraph(text) if kind == "docx" else shape(text) if kind == "pptx" else row(text))
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as z, zipfile.ZipFile(out, "w") as short:
        for name in z.namelist():
            data = z.read(name)
            cut = name.endswith(("document.xml", "s0.xml"))
            short.writestr(name, data[:-9] if cut else data)
    return out.getvalue()
