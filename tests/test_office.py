import io
import zipfile

from palimpsest.operators import office

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook(rows, merges=""):
    return packed({
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="Q3" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {NS}><si><t>Item</t></si><si><r><t>Pri</t></r><r><t>ce</t></r></si><si><t>Invoice of March</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {NS}><sheetData>{rows}</sheetData>{merges}</worksheet>",
    })


SHEET = workbook(
    '<row><c r="B1" t="s"><v>2</v></c></row>'
    '<row><c r="B3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c><c r="D3" t="inlineStr"><is><t>Day</t></is></c></row>'
    '<row><c r="B4" t="str"><v>a  pen</v></c><c r="C4"><v>2.5</v></c><c r="D4" s="1"><v>45363</v></c></row>'
    '<row><c r="B5" t="str"><v>ink</v></c><c r="C5"><f>C4*2</f></c><c r="D5" t="b"><v>1</v></c></row>'
)


def test_rows_have_their_header_cells_and_dates():
    blocks, lost, dropped = office.xlsx_to_blocks(SHEET)
    assert [b["text"] for b in blocks] == ["a pen | 2.5 | 2024-03-12", "ink |  | TRUE"]
    assert {b["header"] for b in blocks} == {"Item | Price | Day"}
    assert [(b["sheet"], b["cell_from"], b["cell_to"]) for b in blocks] == [("Q3", "B4", "D4"), ("Q3", "B5", "D5")]
    assert (lost, dropped) == (1, 0)


def test_merged_cells_and_limits(monkeypatch):
    rows = "".join(f'<row><c r="A{i}"><v>{i}</v></c><c r="C{i}"><v>9</v></c></row>' for i in range(1, 6))
    merged = workbook(rows, '<mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="A1:XFD1048576"/></mergeCells>')
    monkeypatch.setattr(office, "MERGED_CELLS", 3)
    assert [b["text"] for b in office.xlsx_to_blocks(merged)[0]][:3] == ["1 | 1 | 9", "1 | 1 | 9", "3 |  | 9"]
    monkeypatch.setattr(office, "MOST_ROWS", 2)
    monkeypatch.setattr(office, "MOST_COLUMNS", 1)
    blocks, lost, dropped = office.xlsx_to_blocks(workbook(rows))
    assert ([b["text"] for b in blocks], lost, dropped) == (["1", "2"], 3, 2)


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
LETTER = packed({"word/document.xml": f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Terms &amp; rules</w:t></w:r></w:p>
<w:p><w:r><w:t>First</w:t></w:r><w:r><w:tab/><w:t>part.</w:t></w:r></w:p><w:p/>
<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>point</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
</w:body></w:document>"""})


def test_files_in_tables(spark):
    files = spark.createDataFrame([(1, bytearray(SHEET)), (2, bytearray(b"PK no zip")), (3, None)], "doc_id long, content binary")
    got = sorted((r.doc_id, r.pos, r.text, r.unreadable) for r in office.xlsx_blocks(files).collect())
    assert got == [(1, 0, "a pen | 2.5 | 2024-03-12", False), (1, 1, "ink |  | TRUE", False), (2, 0, None, True), (3, 0, None, True)]
    files = spark.createDataFrame([(1, bytearray(LETTER)), (2, bytearray(b"no")), (3, None)], "doc_id long, content binary")
    got = [(r.page_id, r.kind, r.level, r.text) for r in office.docx_blocks(files).orderBy("page_id", "pos").collect()]
    assert got == [(1, "heading", 2, "Terms & rules"), (1, "paragraph", None, "First part."), (1, "list", None, "point"), (1, "row", None, "a |  | c")]
    assert office.docx_blocks(files.limit(0)).count() == office.xlsx_blocks(files.limit(0)).count() == 0


def test_entities_are_refused(spark):
    bomb = packed({"word/document.xml": f'<!DOCTYPE x [<!ENTITY a "aa">]><w:document {W}><w:body><w:p><w:r><w:t>&a;</w:t></w:r></w:p></w:body></w:document>'})
    assert office.docx_blocks(spark.createDataFrame([(1, bytearray(bomb))], "doc_id long, content binary")).count() == 0
