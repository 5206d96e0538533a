"""Office packages that tests share."""

import io
import zipfile


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


S, R = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
BOOK = package({
    "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="Da/ta" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>na</t><r><t>me</t></r></si></sst>',
    "xl/styles.xml": f'<styleSheet xmlns="{S}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="9"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>a,"b"</t></is></c></row><row><c r="B3" s="1"><v>45292</v></c><c r="C3"><f>SUM(A1:A2)</f><v>1.5</v></c></row><row><c r="A4" s="2"><v>0.38</v></c><c r="B4" t="b"><v>1</v></c><c r="C4" t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{S}"/>',
    "xl/media/image1.jpeg": "picture",
})
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
WORD = package({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
SHOWN = "".join(f'<w:drawing><wp:inline xmlns:wp="urn:wp"><wp:docPr descr="{alt}"/><a:graphic xmlns:a="{A}">{extra}<a:blip r:{how}="{rid}"/></a:graphic></wp:inline></w:drawing>' for alt, how, rid, extra in (("second shown first", "embed", "r2", ""), ("linked", "link", "r3", ""), ("decoration", "embed", "r1", '<d:decorative xmlns:d="urn:d" val="1"/>'), ("", "embed", "r1", "")))
WORD_WITH_PICTURES = package({
    "word/document.xml": f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body><w:p><w:r><w:t>text</w:t></w:r></w:p><w:p><w:r>{SHOWN}</w:r></w:p></w:body></w:document>',
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="media/image1.png"/><Relationship Id="r2" Target="media/image2.png"/><Relationship Id="r3" Target="http://a/b.png" TargetMode="External"/></Relationships>',
    "word/media/image1.png": "one", "word/media/image2.png": "two",
})
