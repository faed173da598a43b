"""Archives, elements, streams, and every query against DuckDB."""

import glob
import io
import json
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from slidemill import storage
from slidemill.operators import matrix
from slidemill.operators.palette import raw_colors
from slidemill.plans import document, queries
from slidemill.plans.document import documents
from slidemill.sources import archive, xmltree
from slidemill.streaming import landing

SF = "/root/testdata/sf0.001"


def deck(files):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return held.getvalue()


def test_parts_kinds_and_limits(spark):
    files = {"ppt/presentation.xml": "<p/>", "ppt\\slides\\slide1.xml": "<s/>", "ppt/slides/_rels/slide1.xml.rels": "<r/>", "ppt/media/a.png": b"\x89", "other.txt": "x"}
    table = spark.createDataFrame([("a", deck(files)), ("b", b"no archive"), ("c", None), ("d", deck({}))], "deck_id string, content binary")
    got = {r["part_path"]: r["kind"] for r in archive.parts(table).filter("status = 'ok'").collect()}
    assert sorted(r["deck_id"] for r in archive.parts(table).filter("status LIKE 'corrupt%'").collect()) == ["b", "c"]
    assert got == {"ppt/presentation.xml": "presentation", "ppt/slides/slide1.xml": "slide", "ppt/slides/_rels/slide1.xml.rels": "slide_rels", "ppt/media/a.png": "media", "other.txt": None}
    for limit, n in (("max_entries", 4), ("max_bytes", 5), ("max_entry_bytes", 0)):
        assert [r["status"] for r in archive.parts(table, **{limit: n}).filter("status NOT LIKE 'corrupt%'").collect()] == [f"limit: {limit}"]
        with pytest.raises(Exception, match=limit):
            archive.parts(table.filter("deck_id = 'a'"), strict=True, **{limit: n}).collect()
    assert archive.parts(table, max_entries=5, max_bytes=100).filter("status = 'ok'").count() == 5


def test_a_broken_file_spoils_its_own_deck_alone(spark):
    good, broken = deck({"ppt/presentation.xml": "<p/>"}), bytearray(deck({"ppt/presentation.xml": "<presentation/>"}))
    broken[50:54] = b"XXXX"  # the bytes no longer have the sum that the archive says
    table = spark.createDataFrame([("a", good), ("b", bytes(broken))], "deck_id string, content binary")
    got = {r["deck_id"]: r["status"].split(":")[0] for r in archive.parts(table).collect()}
    assert got == {"a": "ok", "b": "corrupt"}
    assert [r["deck_id"] for r in documents(table).collect()] == []


A = "http://schemas.openxmlformats.org/drawingml/2006/main"
NS = f'xmlns:a="{A}" xmlns:p="urn:p" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:c="urn:c"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels_xml(*rows):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{t}" Target="{x}"{m}/>' for i, t, x, m in rows) + "</Relationships>"


def shape_xml(id, name, inner, ph="", style="", body=""):
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{id}" name="{name}"/><p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{inner}</p:spPr>{style}{body}</p:sp>'


def box_xml(x, y, w, h):
    return f'<a:xfrm><a:off x="{x * 12700}" y="{y * 12700}"/><a:ext cx="{w * 12700}" cy="{h * 12700}"/></a:xfrm>'


@pytest.fixture(scope="module")
def full(spark):
    page = lambda kind, shapes, more="", attrs="": f"<p:{kind} {NS}{attrs}><p:cSld>{more if kind == 'sld' else ''}<p:spTree>{shapes}</p:spTree></p:cSld>{more if kind != 'sld' else ''}</p:{kind}>"
    body = lambda paras, pr="<a:bodyPr/>", lst="": f"<p:txBody>{pr}{lst}{paras}</p:txBody>"
    title = shape_xml(2, "Title", "", '<p:ph type="title"/>', body=body('<a:p><a:r><a:rPr b="1"/><a:t>Big &amp; bold</a:t></a:r></a:p>'))
    text = shape_xml(3, "Body", "", '<p:ph type="body" idx="1"/>', body=body(
        '<a:p><a:pPr lvl="1"/><a:r><a:t>first</a:t></a:r></a:p><a:p><a:pPr algn="r"><a:buAutoNum type="romanUcPeriod"/></a:pPr><a:r><a:t>one</a:t></a:r><a:br/><a:r><a:rPr i="1"/><a:t>two</a:t></a:r></a:p>'
        '<a:p><a:pPr><a:buNone/></a:pPr><a:r><a:rPr><a:hlinkClick r:id="rId9"/></a:rPr><a:t>web</a:t></a:r><a:r><a:rPr><a:solidFill><a:prstClr val="TOMATO"/></a:solidFill></a:rPr><a:t>red</a:t></a:r></a:p>'))  # fmt: skip
    style = '<p:style><a:lnRef idx="2"><a:schemeClr val="accent2"/></a:lnRef><a:fillRef idx="1"><a:schemeClr val="accent1"/></a:fillRef></p:style>'
    star = shape_xml(4, "Star", box_xml(10, 20, 100, 50) + '<a:prstGeom prst="roundRect"><a:avLst><a:gd name="adj" fmla="val 25000"/></a:avLst></a:prstGeom><a:gradFill><a:gsLst><a:gs pos="100000"><a:schemeClr val="accent1"/></a:gs><a:gs pos="0"><a:srgbClr val="FFFFFF"/></a:gs></a:gsLst><a:lin ang="5400000"/></a:gradFill><a:ln><a:prstDash val="dash"/></a:ln>', style=style)
    plain = shape_xml(5, "Plain", box_xml(0, 0, 10, 10) + '<a:prstGeom prst="rect"/><a:solidFill><a:hslClr hue="0" sat="100000" lum="50000"/></a:solidFill><a:ln w="25400"><a:solidFill><a:scrgbClr r="0" g="100000" b="0"/></a:solidFill><a:headEnd type="none"/><a:tailEnd type="arrow"/></a:ln>')
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="6" name="Pic"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId3"/><a:srcRect t="10000" l="25000"/></p:blipFill><p:spPr>' + box_xml(1, 2, 3, 4) + "</p:spPr></p:pic>"
    frame = lambda id, inner, uri: f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{id}" name="F{id}"/></p:nvGraphicFramePr><a:graphic><a:graphicData uri="urn:{uri}">{inner}</a:graphicData></a:graphic></p:graphicFrame>'
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = frame(7, f"<a:tbl><a:tblPr/><a:tr>{cell('x')}{cell('y')}</a:tr></a:tbl>", "table")
    chart = frame(8, '<c:chart r:id="rId4"/>', "chart")
    values = '<c:numRef><c:numCache><c:ptCount val="2"/><c:pt idx="1"><c:v>7</c:v></c:pt></c:numCache></c:numRef>'
    plot = f'<c:chartSpace xmlns:c="urn:c"><c:chart><c:plotArea><c:barChart><c:barDir val="col"/><c:ser/></c:barChart><c:lineChart><c:grouping val="standard"/><c:marker val="1"/><c:ser><c:val>{values}</c:val></c:ser></c:lineChart></c:plotArea></c:chart></c:chartSpace>'
    note = page("notes", shape_xml(1, "n", "", '<p:ph type="sldNum"/>', body=body("<a:p><a:r><a:t>12</a:t></a:r></a:p>")) + shape_xml(2, "b", "", '<p:ph type="body"/>', body=body("<a:p><a:r><a:t> note </a:t></a:r></a:p>")))
    level = '<a:lvl1pPr marL="12700" indent="-12700"><a:buChar char="-"/><a:defRPr sz="1400"><a:solidFill><a:schemeClr val="tx2"/></a:solidFill><a:latin typeface="+mj-lt"/></a:defRPr></a:lvl1pPr><a:lvl2pPr><a:spcBef><a:spcPct val="50000"/></a:spcBef><a:buChar char="x"/><a:defRPr sz="1000"/></a:lvl2pPr>'
    layout_ph = shape_xml(2, "lb", box_xml(5, 6, 70, 80), '<p:ph type="body" idx="1"/>', body=body("<a:p/>", lst='<a:lstStyle><a:lvl1pPr><a:lnSpc><a:spcPct val="90000"/></a:lnSpc><a:defRPr u="sng"/></a:lvl1pPr></a:lstStyle>'))
    fonts = '<a:fontScheme><a:majorFont><a:latin typeface="Head"/></a:majorFont><a:minorFont><a:latin typeface="Text"/></a:minorFont></a:fontScheme>'
    theme = f'<a:theme {NS}><a:themeElements><a:clrScheme><a:dk2><a:srgbClr val="112233"/></a:dk2><a:accent1><a:srgbClr val="4472C4"/></a:accent1><a:accent2><a:srgbClr val="ED7D31"/></a:accent2><a:hlink><a:srgbClr val="0563C1"/></a:hlink></a:clrScheme>{fonts}<a:fmtScheme><a:lnStyleLst><a:ln w="6350"/><a:ln w="19050"/></a:lnStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    files = {
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldSz cx="9144000" cy="6858000"/><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels_xml(("rId1", "slide", "slides/slide1.xml", "")),
        "ppt/slides/slide1.xml": page("sld", title + text + star + plain + pic + table + chart),
        "ppt/slides/_rels/slide1.xml.rels": rels_xml(("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml", ""), ("rId2", "notesSlide", "../notesSlides/notesSlide1.xml", ""), ("rId3", "image", "../media/a.PNG", ""), ("rId4", "chart", "../charts/chart1.xml", ""), ("rId9", "hyperlink", "https://example.org/?a=1&amp;b", ' TargetMode="External"')),
        "ppt/slideLayouts/slideLayout1.xml": page("sldLayout", layout_ph + shape_xml(9, "On layout", box_xml(1, 1, 1, 1) + '<a:prstGeom prst="rect"/>')),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rels_xml(("rId1", "slideMaster", "../slideMasters/slideMaster1.xml", "")),
        "ppt/slideMasters/slideMaster1.xml": page("sldMaster", shape_xml(3, "mt", box_xml(7, 8, 9, 10), '<p:ph type="title"/>') + shape_xml(4, "On master", box_xml(2, 2, 2, 2) + '<a:prstGeom prst="rect"/>'), f'<p:clrMap tx2="dk2" bg1="lt1"/><p:txStyles><p:titleStyle><a:lvl1pPr algn="ctr"><a:defRPr sz="4400"/></a:lvl1pPr></p:titleStyle><p:bodyStyle>{level}</p:bodyStyle></p:txStyles>'),
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": rels_xml(("rId1", "theme", "../theme/theme1.xml", "")),
        "ppt/theme/theme1.xml": theme, "ppt/charts/chart1.xml": plot, "ppt/notesSlides/notesSlide1.xml": note, "ppt/media/a.PNG": b"x",
    }
    rows = documents(spark.createDataFrame([("a", deck(files))], "deck_id string, content binary")).collect()
    return rows[0]["slides"][0]


def test_a_full_slide(full):
    by = {e["name"]: e for e in full["elements"]}
    assert [e["type"] for e in full["elements"]] == ["text", "text", "shape", "shape", "image", "table", "chart"]
    assert [e["name"] for e in full["layoutElements"]] == ["On master", "On layout"] and full["note"] == "note"
    assert (by["Title"]["left"], by["Title"]["width"], by["Body"]["left"], by["Body"]["height"]) == (7, 9, 5, 80)
    star, plain = by["Star"], by["Plain"]
    assert star["fill"]["type"] == "gradient" and [(s["pos"], s["color"]) for s in star["fill"]["stops"]] == [(0, "#FFFFFF"), (100, "#4472C4")] and star["fill"]["rot"] == 90 and star["keypoints"] == {"adj": 0.5}
    assert star["border"]["color"] == "#ED7D31" and star["border"]["width"] == 1.5 and star["border"]["type"] == "dashed" and star["border"]["dashes"] == "6.00,3.00"
    assert plain["fill"]["color"] == "#ff0000" and plain["border"].asDict() == {"color": "#00ff00", "width": 2.0, "type": "solid", "dashes": ""} and (plain["head"], plain["tail"]) == (None, "arrow")
    assert by["Pic"]["ref"] == "ppt/media/a.PNG" and by["Pic"]["media_type"] == "image/png" and by["Pic"]["crop"].asDict() == {"t": 0.1, "b": 0, "l": 0.25, "r": 0}
    assert [c["text"] for c in by["F7"]["cells"]] == [f'<p><span style="font-size: 12pt;color: #000000;font-family: Text;">{x}</span></p>' for x in "xy"]
    chart = by["F8"]["chart"]
    assert chart["chart"] == "lineChart" and chart["data"][0]["values"] == [0, 7] and chart["data"][0]["name"] == "0" and chart["colors"] == ["#4472C4"] and chart["grouping"] == "standard" and chart["marker"] and chart["bar_dir"] is None


def test_text_styles_by_levels(full):
    by = {e["name"]: e["content"] for e in full["elements"]}
    frame = lambda x: f'<div style="padding: 3.6pt 7.2pt 3.6pt 7.2pt;">{x}</div>'
    assert by["Title"] == frame('<p style="text-align: center;"><span style="font-size: 44pt;font-weight: bold;color: #000000;font-family: Text;">Big &amp; bold</span></p>')
    run = "font-size: 14pt;{}text-decoration: underline;color: {};font-family: Head;"
    ink = run.format("", "#112233")
    edge = "margin-left: 1.333333px;text-indent: -1.333333px;line-height: 0.9;"
    assert by["Body"] == frame(
        '<p style="margin-top: 5pt;"><span style="color: #000000;">x </span><span style="font-size: 10pt;color: #000000;font-family: Text;">first</span></p>'
        f'<p style="text-align: right;{edge}"><span style="color: #112233;">- </span><span style="{ink}">one</span><br/><span style="{run.format("font-style: italic;", "#112233")}">two</span></p>'
        f'<p style="{edge}"><a href="https://example.org/?a=1&amp;b" target="_blank" rel="noopener noreferrer" style="{run.format("", "#0563C1")}">web</a><span style="{run.format("", "#FF6347")}">red</span></p>'
    )


def test_pack_gives_the_same_bytes(spark):
    rows = spark.createDataFrame([("a", "x.xml", "<x/>"), ("a", "b.xml", "<b/>"), ("b", "x.xml", None)], "deck_id string, part_path string, content string")
    one, two = ({r["deck_id"]: bytes(r["content"]) for r in archive.pack(t).collect()} for t in (rows, rows.repartition(3)))
    assert one == two and zipfile.ZipFile(io.BytesIO(one["a"])).namelist() == ["b.xml", "x.xml"]


def test_walk_numbers_elements_in_document_order():
    rows = xmltree.walk(b'<a xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sp id="1" r:id="rId2"><p><t>x</t></p><p/></sp><!-- c --><b/></a>')
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in rows] == [(1, 6, 0, 1, "a"), (2, 5, 1, 1, "sp"), (3, 4, 2, 1, "p"), (4, 4, 3, 1, "t"), (5, 5, 2, 2, "p"), (6, 6, 1, 2, "b")]
    assert dict(rows[1][6]) == {"id": "1", "r:id": "rId2"} and rows[3][8:] == (2, "p/t", 3, None, None) and rows[5][8] is None
    assert xmltree.walk(b"<a>") == [] and xmltree.walk(b'<!DOCTYPE a [<!ENTITY b "c">]><a/>') == []


def test_stream_reads_each_deck_once(spark, tmp_path):
    source, target, held = (f"{tmp_path}/{x}" for x in ("in", "out", "held"))
    os.makedirs(source)
    for name in ("a", "b"):
        open(f"{source}/{name}.pptx", "wb").write(deck({"ppt/presentation.xml": "<p/>"}))
        landing.keep_parts(spark, source, target, held).awaitTermination(60)
    got = spark.read.parquet(target)
    assert sorted(r["deck_id"] for r in got.collect()) == ["a", "b"]
    files = archive.read_decks(spark, source)
    assert sorted(r["deck_id"] for r in archive.parts(files).collect()) == ["a", "b"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(map(tuple, frame[columns].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries(spark, tables, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), tables.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)


def test_documents_as_json(spark):
    got = [json.loads(r["document"]) for r in queries.QUERIES["deck_json"](spark, SF).collect()]
    assert len(got) == 5 and all(len(d["slides"]) == 5 and d["size"] == {"width": 720.0, "height": 540.0} for d in got)
    assert got[0]["slides"][0]["elements"][0]["type"] == "text"


def test_archives_of_a_large_source_are_of_bounded_size(spark, tmp_path):
    table = spark.createDataFrame([(k, "x" * 1000, "hot") for k in range(300)] + [(-1, "y", None), (-2, None, "a:b\nc"), (-3, "zz", "")], "doc_id long, text string, source string")
    sizes = [r["bytes"] for r in archive.archive_stats(archive.parts(archive.pack(queries._text_files(table, 20000)))).collect()]
    assert max(sizes) < 60000 and len(sizes) > 10
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["deck_id"]: tuple(r)[1:] for r in queries.QUERIES["archive_stats"](spark, str(tmp_path)).collect()}
    assert got == {"hot": (300, 300000, 1000), None: (1, 1, 1), "a:b\nc": (1, 0, 0), "": (1, 2, 2)}


P = 'xmlns:p="urn:p" xmlns:a="urn:a" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def sp(name, ph="", box=None):
    at = '<a:xfrm><a:off x="{}" y="{}"/><a:ext cx="{}" cy="{}"/></a:xfrm>'.format(*(12700 * x for x in box)) if box else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{at}</p:spPr><p:txBody><a:p><a:r><a:t>{name}</a:t></a:r></a:p></p:txBody></p:sp>'


def tree(kind, inner):
    return f"<p:{kind} {P}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:{kind}>"


def links(*each):
    return "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Type="{REL}/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(each, 1)) + "</Relationships>"


def test_documents_place_placeholders_and_deep_groups(spark):
    deep = sp("deep", box=(1, 2, 3, 4))
    for _ in range(13):
        deep = '<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="g"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="12700" y="0"/><a:ext cx="25400" cy="12700"/><a:chOff x="0" y="0"/><a:chExt cx="25400" cy="12700"/></a:xfrm></p:grpSpPr>' + deep + "</p:grpSp>"
    ph = lambda kind: f'<p:ph type="{kind}"/>'
    slide = sp("body", ph("body")) + sp("title", ph("title")) + sp("date", ph("dt")) + sp("own", ph("body"), (7, 8, 9, 10)) + deep
    files = {
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": links(("slide", "slides/slide1.xml")), "ppt/slides/slide1.xml": tree("sld", slide),
        "ppt/slides/_rels/slide1.xml.rels": links(("slideLayout", "../slideLayouts/slideLayout1.xml")), "ppt/slideLayouts/slideLayout1.xml": tree("sldLayout", sp("l", ph("body"), (100, 50, 30, 20))),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": links(("slideMaster", "../slideMasters/slideMaster1.xml")), "ppt/slideMasters/slideMaster1.xml": tree("sldMaster", sp("m", ph("title"), (200, 60, 40, 10))),
    }
    got = documents(spark.createDataFrame([("a", deck(files))], "deck_id string, content binary")).collect()
    found = {e["name"]: (e["left"], e["top"], e["width"], e["height"], e["content"]) for e in got[0]["slides"][0]["elements"] if e["name"] != "g"}
    want = {"body": (100, 50, 30, 20), "title": (200, 60, 40, 10), "date": (0, 0, 0, 0), "own": (7, 8, 9, 10), "deep": (14, 2, 3, 4)}
    assert {k: v[4] for k, v in found.items()} == {k: f'<p><span style="font-size: 12pt;color: #000000;">{k}</span></p>' for k in want}
    assert all(abs(x - y) < 1e-6 for k in want for x, y in zip(found[k][:4], want[k], strict=True))


def test_deck_documents_hold_placeholders(spark):
    docs = [json.loads(r["document"]) for r in queries.QUERIES["deck_json"](spark, SF).collect()]
    lefts = [e["left"] for d in docs for s in d["slides"] for e in s["elements"]]
    assert len(lefts) == 25 and sum(abs(x - 100) < 1e-6 for x in lefts) == 8


def test_entry(spark):
    assert __spark_entry__.entry(spark).filter(F.col("width") == 720).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_documents_take_looks_from_themes_groups_and_placeholders(spark):
    srgb = lambda c, more="": f'<a:srgbClr val="{c}">{more}</a:srgbClr>'
    scheme = lambda c: f'<a:schemeClr val="{c}"/>'
    solid = lambda c: f"<a:solidFill>{c}</a:solidFill>"
    words = lambda run="", t="w": f"<p:txBody><a:bodyPr/><a:p><a:r>{run}<a:t>{t}</a:t></a:r></a:p></p:txBody>"
    ref = lambda tag, idx, c: f'<a:{tag} idx="{idx}">{scheme(c)}</a:{tag}>'
    style = "<p:style>" + ref("lnRef", 1, "accent2") + ref("fillRef", 1, "accent1") + ref("effectRef", 1, "accent1") + ref("fontRef", "minor", "lt1") + "</p:style>"
    rect = '<a:prstGeom prst="rect"/>'
    drawn = shape_xml(2, "Drawn", box_xml(10, 10, 40, 20) + rect + '<a:ln w="127000"><a:noFill/></a:ln>', style=style, body=words())
    own = shape_xml(3, "Own", box_xml(0, 0, 5, 5) + rect + "<a:noFill/>", style=style, body=words(f'<a:rPr>{solid(srgb("AA0000"))}</a:rPr>'))
    child = lambda name, props: shape_xml(4, name, props + rect)
    group = lambda props, inner: f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="G"/></p:nvGrpSpPr><p:grpSpPr>{props}</p:grpSpPr>{inner}</p:grpSp>'
    flipped = '<a:xfrm flipH="1"><a:off x="127000" y="0"/><a:ext cx="1270000" cy="635000"/><a:chOff x="0" y="0"/><a:chExt cx="1270000" cy="635000"/></a:xfrm>'
    plain = '<a:xfrm><a:off x="0" y="0"/><a:ext cx="1270000" cy="635000"/><a:chOff x="0" y="0"/><a:chExt cx="1270000" cy="635000"/></a:xfrm>'
    inner = group(plain, child("Grouped", box_xml(0, 0, 30, 10) + "<a:grpFill/>") + child("Bare", box_xml(50, 0, 30, 10)))
    both = f'<mc:AlternateContent xmlns:mc="urn:mc"><mc:Choice>{child("Twice", box_xml(1, 1, 1, 1))}</mc:Choice><mc:Fallback>{child("Twice", box_xml(1, 1, 1, 1))}</mc:Fallback></mc:AlternateContent>'
    unknown = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="7" name="Unknown"/></p:nvGraphicFramePr><a:graphic><a:graphicData uri="urn:other"/></a:graphic></p:graphicFrame>'
    ole = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="8" name="Object"/></p:nvGraphicFramePr><p:xfrm><a:off x="12700" y="0"/><a:ext cx="25400" cy="12700"/></p:xfrm><a:graphic><a:graphicData uri="urn:ole"><mc:AlternateContent xmlns:mc="urn:mc"><mc:Choice><p:oleObj/></mc:Choice><mc:Fallback><p:oleObj><p:pic><p:nvPicPr><p:cNvPr id="0" name="inner"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId7"/></p:blipFill></p:pic></p:oleObj></mc:Fallback></mc:AlternateContent></a:graphicData></a:graphic></p:graphicFrame>'
    line = '<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="6" name="Line"/></p:nvCxnSpPr><p:spPr>' + box_xml(5, 5, 100, 0) + '<a:prstGeom prst="line"/></p:spPr>' + style + "</p:cxnSp>"
    still = lambda name, plays, more="", props="": f'<p:pic><p:nvPicPr><p:cNvPr id="30" name="{name}"/><p:nvPr>{plays}</p:nvPr></p:nvPicPr><p:blipFill><a:blip r:embed="rId7">{more}</a:blip></p:blipFill><p:spPr>{box_xml(0, 0, 9, 9)}{props}</p:spPr></p:pic>'
    pics = still("Video", '<a:videoFile r:link="rId10"/>') + still("Sound", '<a:audioFile r:link="rId11"/>') + still("Faint", "", '<a:alphaModFix amt="25000"/>', f'<a:prstGeom prst="ellipse"/><a:ln w="12700">{solid(srgb("00FF00"))}</a:ln>')
    title = shape_xml(5, "Title", "", '<p:ph type="title"/>', body="<p:txBody><a:bodyPr/><a:p/></p:txBody>")
    diagram = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="20" name="Diagram"/></p:nvGraphicFramePr><p:xfrm><a:off x="254000" y="127000"/><a:ext cx="1270000" cy="1270000"/></p:xfrm><a:graphic><a:graphicData uri="urn:diagram"><dgm:relIds xmlns:dgm="urn:d" r:dm="rId8"/></a:graphicData></a:graphic></p:graphicFrame>'
    arc = '<a:custGeom><a:pathLst><a:path w="10" h="10"><a:moveTo><a:pt x="0" y="5"/></a:moveTo><a:arcTo wR="5" hR="5" stAng="10800000" swAng="10800000"/><a:close/></a:path></a:pathLst></a:custGeom>'
    node = shape_xml(3, "Node", box_xml(1, 2, 10, 10) + arc + solid(scheme("accent1")), style=style, body=words(t="node")).replace("<p:", "<dsp:").replace("</p:", "</dsp:")
    drawing = f'<dsp:drawing xmlns:dsp="urn:dsp" {NS}><dsp:spTree>{node}</dsp:spTree></dsp:drawing>'
    layout = shape_xml(2, "l", box_xml(5, 6, 70, 80) + solid(scheme("accent2")), '<p:ph type="title"/>', body='<p:txBody><a:bodyPr anchor="ctr" vert="vert"/><a:p/></p:txBody>')
    theme = (
        f'<a:theme {NS}><a:themeElements><a:clrScheme><a:lt1>{srgb("FFFFFE")}</a:lt1><a:accent1>{srgb("4472C4")}</a:accent1><a:accent2>{srgb("ED7D31")}</a:accent2></a:clrScheme><a:fmtScheme>'
        f'<a:fillStyleLst><a:gradFill><a:gsLst><a:gs pos="0">{scheme("phClr")}</a:gs><a:gs pos="100000">{srgb("010203")}</a:gs></a:gsLst></a:gradFill></a:fillStyleLst><a:lnStyleLst><a:ln w="12700">{solid(srgb("123456"))}</a:ln></a:lnStyleLst>'
        f'<a:effectStyleLst><a:effectStyle><a:effectLst><a:outerShdw dist="12700" dir="5400000">{srgb("000000", chr(60) + "a:alpha val=" + chr(34) + "63000" + chr(34) + "/>")}</a:outerShdw></a:effectLst></a:effectStyle></a:effectStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    )
    page = lambda kind, inner, bg="", more="": f"<p:{kind} {NS}><p:cSld>{bg}<p:spTree>{inner}</p:spTree></p:cSld>{more}</p:{kind}>"
    files = {
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels_xml(("rId1", "slide", "slides/slide1.xml", "")),
        "ppt/slides/slide1.xml": page("sld", drawn + own + group(flipped + solid(srgb("00AA00")), inner) + both + unknown + ole + line + diagram + title + pics, f'<p:bg><p:bgRef idx="1001">{scheme("accent2")}</p:bgRef></p:bg>'),
        "ppt/slides/_rels/slide1.xml.rels": rels_xml(("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml", ""), ("rId7", "image", "../media/o.png", ""), ("rId8", "diagramData", "../diagrams/data3.xml", ""), ("rId9", "diagramDrawing", "../diagrams/drawing3.xml", ""), ("rId10", "video", "https://example.org/v", ' TargetMode="External"'), ("rId11", "audio", "../media/gone.mp3", "")),
        "ppt/diagrams/drawing3.xml": drawing,
        "ppt/slideLayouts/slideLayout1.xml": page("sldLayout", layout), "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rels_xml(("rId1", "slideMaster", "../slideMasters/slideMaster1.xml", "")),
        "ppt/slideMasters/slideMaster1.xml": page("sldMaster", ""), "ppt/slideMasters/_rels/slideMaster1.xml.rels": rels_xml(("rId1", "theme", "../theme/theme1.xml", "")), "ppt/theme/theme1.xml": theme, "ppt/media/o.png": b"o",
    }
    slide = documents(spark.createDataFrame([("a", deck(files))], "deck_id string, content binary")).collect()[0]["slides"][0]
    by = {e["name"]: e for e in slide["elements"]}
    assert [e["name"] for e in slide["elements"]] == ["Drawn", "Own", "G", "G", "Grouped", "Bare", "Object", "Line", "Diagram", "Node", "Title", "Video", "Sound", "Faint"]
    assert slide["background"]["color"] == "#ED7D31"
    seen = by["Drawn"]
    assert seen["border"].asDict() == {"color": "#123456", "width": 1.0, "type": "solid", "dashes": ""} and "color: #FFFFFE" in seen["content"]
    assert seen["fill"]["type"] == "gradient" and [s["color"] for s in seen["fill"]["stops"]] == ["#4472C4", "#010203"]
    assert seen["shadow"]["color"] == "rgba(0,0,0,0.630)" and abs(seen["shadow"]["v"] - 1) < 1e-9 and abs(seen["shadow"]["h"]) < 1e-9
    assert by["Own"]["fill"]["color"] == "transparent" and "color: #AA0000" in by["Own"]["content"] and by["Own"]["type"] == "shape"
    assert by["Grouped"]["fill"]["color"] == "#00AA00" and by["Bare"]["fill"]["color"] == "transparent"
    assert (by["Grouped"]["left"], by["Grouped"]["isFlipH"], by["Bare"]["left"]) == (80, True, 30)
    assert (by["Object"]["type"], by["Object"]["ref"], by["Object"]["left"], by["Object"]["width"]) == ("image", "ppt/media/o.png", 1, 2)
    assert [(by[n]["type"], by[n]["ref"], by[n]["blob"], by[n]["shapType"]) for n in ("Video", "Sound", "Faint")] == [("video", "ppt/media/o.png", "https://example.org/v", "rect"), ("audio", None, None, "rect"), ("image", "ppt/media/o.png", None, "ellipse")]
    assert by["Faint"]["filters"]["opacity"] == 0.25 and by["Video"]["filters"] is None and (by["Faint"]["border"]["color"], by["Faint"]["border"]["width"], by["Video"]["border"]["width"]) == ("#00FF00", 1, 0)
    assert (by["Line"]["height"], by["Line"]["width"], by["Line"]["fill"]["color"], by["Line"]["border"]["color"]) == (0.75, 100, "transparent", "#123456")
    shown = by["Node"]
    assert by["Diagram"]["type"] == "group" and (shown["left"], shown["top"], shown["group"]) == (21, 12, by["Diagram"]["nid"]) and "color: #FFFFFE" in shown["content"]
    assert (shown["fill"]["color"], shown["shapType"], shown["border"]["color"]) == ("#4472C4", "custom", "#123456") and shown["path"].startswith("M0,5 A5,5 0 0,1 10,") and shown["path"].endswith(" Z")
    assert (by["Title"]["fill"]["color"], by["Title"]["vAlign"], by["Title"]["isVertical"], by["Title"]["left"]) == ("#ED7D31", "mid", True, 5)


def test_documents_broadcast_small_tables_alone(spark, monkeypatch):
    """What is stored in little space may be large on the driver: a table beyond storage.BROADCAST is shuffled, whatever Spark would broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    said = lambda: [spark.conf.get(n, None) for n in names]
    held, seen = said(), []

    class Seen(Exception):
        pass

    def stopped(decks):
        seen.append(said())
        table = storage.written(spark.range(100_000).selectExpr("id", "id % 7 AS k"))
        for rows, kind in ((table, "SortMergeJoin"), (table.limit(3), "BroadcastHashJoin")):
            plan = spark.range(1_000_000).join(rows, "id")._jdf.queryExecution().executedPlan().toString()
            seen.append(kind in plan)
        raise Seen

    monkeypatch.setattr(document, "Deck", stopped)
    with pytest.raises(Seen):
        document.documents(spark.createDataFrame([], "deck_id string, content binary"))
    assert seen == [[str(storage.BROADCAST)] * 2, True, True] and said() == held
    spark.conf.set(names[0], "-1")
    try:
        with storage.small_broadcasts(spark):
            assert said() == ["-1", "-1"]
    finally:
        spark.conf.unset(names[0])


def test_contents_of_fills_and_lines_are_made_once(spark, monkeypatch):
    """Whoever asks for fills, lines and effects reads tables: nothing is joined anew, and gradients are made once for all of them."""
    sp = '<p:sp><p:spPr><a:gradFill><a:gsLst><a:gs pos="0"><a:srgbClr val="112233"/></a:gs></a:gsLst></a:gradFill><a:ln w="5"><a:solidFill><a:srgbClr val="445566"/></a:solidFill></a:ln></p:spPr></p:sp>'
    table = spark.createDataFrame([("a", deck({"ppt/slides/slide1.xml": f"<p:sld {NS}>{sp}</p:sld>"}))], "deck_id string, content binary")
    made, made_gradients = [], matrix.gradients
    monkeypatch.setattr(matrix, "gradients", lambda *given: made.append(1) or made_gradients(*given))
    nodes = storage.written(xmltree.deck_elements(table))
    own = matrix.Styles(nodes, raw_colors(nodes)).own("spPr")
    assert len(made) == 1 and "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    (got,) = own.collect()
    assert got["content"]["gradient"]["stops"][0]["raw"]["attrs"]["val"] == "112233" and (got["line"]["w"], got["line"]["raw"]["attrs"]["val"]) == (5.0, "445566")
