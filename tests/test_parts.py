"""Lists, fields, archives in archives, faults and media on small hand-made inputs, with their edge cases."""

import glob
import io
import tempfile
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from slidemill import storage
from slidemill.operators import fields, lists, matrix, media, shapes
from slidemill.sources import archive, builder, xmltree


def packed(files):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return held.getvalue()


def test_lists_open_close_and_skip_levels(spark):
    kind = "array<struct<kind:string,level:int,align:string,html:string>>"
    cases = [
        ([], ""),
        ([(None, 0, "left", "a")], '<p style="text-align:left;">a</p>'),
        ([("ul", 0, "left", "a"), ("ul", 1, "left", "b"), ("ol", 1, "left", "c"), ("ul", 0, "right", "d")],
         '<ul><li style="text-align:left;">a</li><ul><li style="text-align:left;">b</li></ul><ol><li style="text-align:left;">c</li></ol><li style="text-align:right;">d</li></ul>'),
        # a level that was skipped holds no list, and a plain paragraph closes all
        ([("ol", 2, "left", "a"), (None, 0, "left", "b"), ("ul", 0, "left", "c")], '<ol><li style="text-align:left;">a</li></ol><p style="text-align:left;">b</p><ul><li style="text-align:left;">c</li></ul>'),
        ([("ol", 2, "left", "a"), ("ul", 1, "left", "b")], '<ol><li style="text-align:left;">a</li></ol><ul><li style="text-align:left;">b</li></ul>'),
    ]
    table = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], f"i int, p {kind}")
    got = {r["i"]: r["h"] for r in table.select("i", lists.nested(F.col("p")).alias("h")).collect()}
    assert [got[i] for i in range(len(cases))] == [h for _, h in cases]


def word(*inner):
    return ('<w:document xmlns:w="urn:w"><w:body><w:p>' + "".join(inner) + "</w:p></w:body></w:document>").encode()


def mark(kind):
    return f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'


def t(x):
    return f"<w:r><w:t>{x}</w:t></w:r>"


def code(x):
    return f"<w:r><w:instrText>{x}</w:instrText></w:r>"


def test_fields_nest_and_survive_loose_marks(spark):
    docs = {
        "nested": word(t("a"), mark("begin"), code("x"), mark("begin"), code("y"), mark("separate"), t("1"), mark("end"), code("z"), mark("separate"), t("2"), mark("end"), t("b")),
        "loose": word(mark("end"), mark("end"), mark("begin"), code("q"), mark("separate"), t("r"), mark("end")),
        "open": word(mark("begin"), code("i"), mark("separate"), t("j")),
        "two": word(mark("begin"), code("m"), mark("end"), t("-"), mark("begin"), code("n"), mark("separate"), t("o"), mark("end")),
        "none": word(t(" plain ")), "empty": word(),
    }
    nodes = xmltree.elements(spark.createDataFrame([(k, "word/document.xml", v) for k, v in docs.items()], "deck_id string, part_path string, content binary"))
    got = sorted((r["deck_id"], r["depth"], r["instruction"], r["result"]) for r in fields.fields(nodes).collect())
    assert got == [("loose", 1, "q", "r"), ("nested", 1, "xz", "2"), ("nested", 2, "y", "1"), ("open", 1, "i", "j"), ("two", 1, "m", ""), ("two", 1, "n", "o")]
    text = {r["deck_id"]: r["text"] for r in fields.plain_text(nodes).collect()}
    assert text == {"nested": "a2b", "loose": "", "open": "", "two": "-", "none": "plain"}


def test_archives_in_archives_to_a_depth_and_within_limits(spark):
    inner = packed({"word/document.xml": "<w/>"})
    middle = packed({"a.txt": "x", "b.docx": inner})
    deck = packed({"ppt/presentation.xml": "<p/>", "ppt/embeddings/m.zip": middle, "ppt/embeddings/bad.bin": b"none", "ppt/embeddings/bomb.xlsx": packed({"big": "x" * 5000})})
    found = archive.parts(spark.createDataFrame([("d", deck), (None, b"no deck")], "deck_id string, content binary"))
    rows = lambda depth: sorted((r["inside"], r["part_path"], r["status"].split(":")[0]) for r in archive.embedded(found, depth, max_bytes=1000).collect())
    once = [("ppt/embeddings/bad.bin", None, "corrupt"), ("ppt/embeddings/bomb.xlsx", None, "limit"), ("ppt/embeddings/m.zip", "a.txt", "ok"), ("ppt/embeddings/m.zip", "b.docx", "ok")]
    assert rows(1) == once
    assert rows(2) == sorted([*once, ("ppt/embeddings/m.zip/b.docx", "word/document.xml", "ok")])
    assert rows(3) == rows(2)


def test_faults_name_parts_without_elements(spark):
    parts = [("good", b"<a/>"), ("bom", b"\xef\xbb\xbf<a/>"), ("cut", b"<a>"), ("empty", b""), ("none", None), ("typed", b"<!DOCTYPE a><a/>")]
    table = spark.createDataFrame([("d", k, v) for k, v in parts], "deck_id string, part_path string, content binary")
    assert {r["part_path"]: r["fault"] for r in xmltree.faults(table).collect()} == {"cut": "malformed", "empty": "malformed", "none": "malformed", "typed": "document type"}
    assert {r["part_path"] for r in xmltree.elements(table).collect()} == {"good", "bom"}


def test_media_are_kept_once(spark):
    decks = [("a", packed({"ppt/media/x.png": b"1", "ppt/media/y.PNG": b"1", "ppt/media/z.emf": b"2"})), ("b", packed({"ppt/media/x.png": b"1", "other/x.png": b"1"})), ("c", packed({"t": b""}))]
    parts = archive.parts(spark.createDataFrame(decks, "deck_id string, content binary"))
    places = media.placed(parts)
    once = {r["type"]: r for r in media.distinct(places).collect()}
    assert {k: (r["deck_id"], r["part_path"], r["n_places"], r["n_decks"]) for k, r in once.items() if r["n_places"] > 1} == {"image/png": ("a", "ppt/media/x.png", 3, 2)}
    assert sorted(bytes(r["content"]) for r in media.kept(parts, media.distinct(places)).collect()) == [b"1", b"2"]
    assert {r["part_path"]: r["conversion"] for r in places.filter("deck_id = 'a'").collect()} == {"ppt/media/x.png": False, "ppt/media/y.PNG": False, "ppt/media/z.emf": True}
    nothing = archive.parts(spark.createDataFrame([], "deck_id string, content binary"))
    assert media.distinct(media.placed(nothing)).count() == 0 and archive.embedded(nothing).count() == 0


def test_fills_of_one_colour_have_all_fields(spark):
    got = spark.range(1).select(matrix.plain(F.lit("#102030")).alias("f")).first()["f"]
    assert got["type"] == "color" and got["color"] == "#102030" and got["stops"] is None and got["rid"] is None


def test_workers_hold_little_of_large_tables(spark):
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 1000, 1, 1).select(F.expr("repeat('x', 20000)").alias("x"))
    got = [r["n"] for r in storage.written(rows.mapInArrow(sizes, "n long")).collect()]
    assert sum(got) >= 20_000_000 and max(got) <= storage.BATCH + 100_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == held


def test_elements_of_archives_are_those_of_their_parts(spark):
    slide = b'<a xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><grpSp id="1"><sp r:id="x"><p>b<!-- -->c</p><p/></sp></grpSp></a>'
    files = [("a", "ppt/slides/slide1.xml", slide), ("a", "b.rels", b"\xef\xbb\xbf<Relationships/>"), ("a", "c.xml", b"<broken"), ("a", "d.png", b"<a/>"), ("b", "ppt/slides/slide1.xml", b"<a>" + b"<b/>" * 25_000 + b"</a>")]
    decks = archive.pack(spark.createDataFrame(files, "deck_id string, part_path string, content binary")).unionByName(spark.createDataFrame([("c", b"no deck"), ("d", None)], "deck_id string, content binary"))
    for limits in ({}, {"max_entry_bytes": 1000}):
        xml = archive.parts(decks, **limits).filter(F.col("part_path").rlike(r"\.(xml|rels)$"))
        order = lambda df: sorted(map(str, df.collect()))
        got = order(xmltree.deck_elements(decks, **limits))
        assert got == order(xmltree.elements(xml)) and len(got) == (6 if limits else 25_007)
    assert xmltree.deck_elements(decks).schema == storage.written(xmltree.deck_elements(decks)).schema


def test_shapes_are_grouped_by_few_aggregates(spark, capsys):
    files = [("a", "ppt/slides/slide1.xml", b'<a><sp><nvSpPr><cNvPr id="1" name="n"/></nvSpPr><spPr><xfrm rot="60000"><off x="1" y="2"/><off x="9"/><ext cx="3"/></xfrm></spPr><txBody><p/></txBody></sp></a>')]
    nodes = xmltree.elements(spark.createDataFrame(files, "deck_id string, part_path string, content binary"))
    found = shapes.shapes(nodes)
    [row] = found.collect()
    assert (row["id"], row["name"], row["x"], row["y"], row["cx"], row["cy"], row["rot"], row["group_nid"], row["ph"]) == ("1", "n", 1.0, 2.0, 3.0, None, 60000.0, 0, False)
    found.select("id", *(c for c in found.columns if c != "id")).explain("formatted")
    wide = max(line.count("min_by(") for line in capsys.readouterr().out.splitlines() if line.startswith("Functions"))
    assert wide <= 50


def test_paragraphs_take_one_grouping(spark):
    """Texts of runs in the order of the runs: the first t of each alone, breaks, nested runs, a t outside; without a join of elements with themselves."""
    p = lambda inner: f"<a:p>{inner}</a:p>"
    body = p('<a:pPr lvl="2"><a:buNone/></a:pPr><a:r><a:t>one</a:t><a:t>not</a:t></a:r><a:br><a:t>no</a:t></a:br><a:fld><a:t>two</a:t></a:fld>') + p("") + p('<a:pPr lvl="x"><a:buAutoNum type="k"/></a:pPr><a:r><a:r><a:t>in</a:t></a:r><a:t>out</a:t></a:r><a:t>lost</a:t><a:r/><a:r><a:t/></a:r>')
    xml = f'<p:sld xmlns:a="urn:a" xmlns:p="urn:p"><p:sp><p:txBody>{body}</p:txBody></p:sp><p:sp><p:txBody>{p("<a:r><a:t>z</a:t></a:r>")}</p:txBody></p:sp></p:sld>'
    nodes = xmltree.elements(spark.createDataFrame([("d", "ppt/slides/slide1.xml", xml.encode())], "deck_id string, part_path string, content binary"))
    found = shapes.paragraphs(nodes)
    rows = [(r["para_index"], r["level"], r["auto_kind"], r["plain"], r["text"]) for r in found.orderBy("para").collect()]
    assert rows == [(0, 2, None, True, "one\ntwo"), (1, 0, None, False, ""), (2, 0, "k", False, "outin"), (0, 0, None, False, "z")]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_lines_are_paragraphs_of_each_line(spark):
    texts = [None, "", "\n", "a", "a\r\nb\rc\n\nd", "x<&>\"\n\x01\t y\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    each = F.transform(F.split(F.regexp_replace(F.coalesce("t", F.lit("")), "\r\n?", "\n"), "\n"), lambda x: builder.paragraph(builder.run(x)))
    assert all(r[0] == r[1] for r in rows.select(builder.lines(F.col("t")), F.array_join(each, "")).collect())


def test_tables_of_archives_are_read_a_few_at_a_time(spark):
    # readers hold the rows of a row group at once (4096 at most): what these weigh is bounded, however well they are compressed
    rows = spark.range(0, 64, 1, 1).select(F.col("id").cast("string").alias("deck_id"), F.concat("id", F.repeat(F.lit("x"), 400_000)).cast("binary").alias("content"))
    kept = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    archive.write_decks(rows, kept)
    found = storage.written(rows)
    for files in ([x.removeprefix("file://") for x in found.inputFiles()], glob.glob(f"{kept}/*.parquet")):
        groups = [m.row_group(i) for m in (pq.ParquetFile(f).metadata for f in files) for i in range(m.num_row_groups)]
        assert sum(g.num_rows for g in groups) == 64
        assert max(g.total_byte_size for g in groups) < 2 * storage.BATCH
    assert [tuple(r) for r in found.orderBy(F.col("deck_id").cast("int")).select(F.sha1("content")).collect()] == [tuple(r) for r in rows.select(F.sha1("content")).collect()]
    small = storage.written(rows.select("deck_id"))
    assert [pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in small.inputFiles()] == [1]


def test_shapes_need_their_own_elements_alone(spark, capsys):
    """Elements of some tags keep their numbers, owners and groups, and shapes are the same by those that tell of them; one aggregate for each kind."""
    box = lambda tag, n: f'<{tag} rot="{n}" flipH="1"><off x="{n}" y="2"/><off x="9"/><ext cx="3" cy="4"/></{tag}>'
    sp = lambda n, more="": f'<sp><nvSpPr><cNvPr id="{n}" name="n{n}"><hlinkClick r:id="h" action="a"/></cNvPr><cNvSpPr txBox="1"/><nvPr><ph type="body" idx="{n}"/></nvPr></nvSpPr><spPr>{box("xfrm", n)}<prstGeom prst="rect"/></spPr><txBody><p><r><t>x</t></r></p></txBody>{more}</sp>'
    pic = f'<pic><nvPicPr><cNvPr id="7" name="p"/><nvPr><videoFile r:link="v"/></nvPr></nvPicPr><blipFill><blip r:embed="i"/></blipFill><spPr>{box("xfrm", 7)}<custGeom/></spPr></pic>'
    chart = f'<graphicFrame><nvGraphicFramePr><cNvPr id="8" name="c"/></nvGraphicFramePr>{box("xfrm", 8)}<graphic><graphicData uri="u"><chart r:id="c"/></graphicData></graphic></graphicFrame>'
    formula = f'<AlternateContent><Choice>{sp(5).replace("<t>x</t>", "<oMath><t>1</t><t>+2</t></oMath>")}</Choice><Fallback>{sp(6)}</Fallback></AlternateContent>'
    group = f'<grpSp><nvGrpSpPr><cNvPr id="9" name="g"/></nvGrpSpPr><grpSpPr><xfrm><off x="1" y="1"/><ext cx="5" cy="5"/><chOff x="2" y="2"/><chExt cx="6" cy="6"/></xfrm></grpSpPr>{sp(2)}<grpSp>{pic}</grpSp></grpSp>'
    names = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    files = [("a", "ppt/slides/slide1.xml", f"<sld {names}><cSld><spTree>{sp(1)}{group}{chart}{formula}{sp(3)}</spTree></cSld></sld>".encode()), ("a", "ppt/presentation.xml", b"<p><q/></p>"), ("b", "ppt/slides/slide1.xml", b"<broken")]
    decks = archive.pack(spark.createDataFrame(files, "deck_id string, part_path string, content binary"))
    every, some = storage.written(xmltree.deck_elements(decks)), storage.written(xmltree.deck_elements(decks, shapes.TAGS))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(some) == order(every.filter(F.col("tag").isin(*shapes.TAGS))) and some.count() < every.count()
    found = shapes.shapes(some)
    assert order(found) == order(shapes.shapes(every))
    rows = {r["id"]: r for r in found.collect()}
    assert {k: (r["shape"], r["x"], r["cx"], r["rot"], r["flip_h"], r["formula"]) for k, r in rows.items()} == {
        "1": ("sp", 1.0, 3.0, 1.0, True, None), "2": ("sp", 2.0, 3.0, 2.0, True, None), "3": ("sp", 3.0, 3.0, 3.0, True, None), "5": ("sp", 5.0, 3.0, 5.0, True, "1+2"),
        "7": ("pic", 7.0, 3.0, 7.0, True, None), "8": ("graphicFrame", 8.0, 3.0, 8.0, True, None), "9": ("grpSp", 1.0, 5.0, 0.0, False, None), None: ("grpSp", None, None, 0.0, False, None),
    }
    assert (rows["9"]["ch_x"], rows["9"]["ch_cx"], rows["7"]["custom"], rows["7"]["video_rid"], rows["7"]["rid"], rows["8"]["rid"], rows["8"]["uri"]) == (2.0, 6.0, True, "v", "i", "c", "u")
    assert (rows["1"]["ph"], rows["1"]["ph_type"], rows["1"]["ph_idx"], rows["1"]["prst"], rows["1"]["text_box"], rows["1"]["link_rid"], rows["1"]["link_action"]) == (True, "body", 1, "rect", True, "h", "a")
    assert rows["2"]["group_nid"] == rows["9"]["nid"] and rows["7"]["group_nid"] == rows[None]["nid"]
    found.explain("formatted")
    assert max(line.count("min_by(") for line in capsys.readouterr().out.splitlines() if line.startswith("Functions")) <= 16
