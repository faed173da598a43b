"""Queries by name: each makes decks of the given tables, reads them back, and asks something of them; ORACLES says it in SQL over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colors, media, outlines, text, units
from ..operators import fields, frames, lists, looks, matrix, package, shapes, styles, tables, textbody
from ..operators import media as media_table
from ..operators.palette import painted, palettes, raw_colors, with_charts
from ..sources import archive, builder, xmltree
from ..sources.builder import text as put
from ..storage import cut, written
from .document import Colors, Deck, as_json, documents, elements
from .structure import structure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(x: Column) -> Column:
    return x.cast("long")


def _one_slide(rows: DataFrame, deck: Column, children: Column, order: str) -> DataFrame:
    """Decks of one slide each, which holds the shapes of a deck's rows."""
    each = rows.select(deck.cast("string").alias("deck_id"), order, children.alias("xml"))
    return builder.gathered(each, ["deck_id"], order, "xml").select("deck_id", F.lit(1).alias("n"), F.lit(1).alias("at"), builder.page(F.col("xml")).alias("xml"))


def _looks(deck: Deck) -> DataFrame:
    """Fills, lines and shadows of the shapes of decks."""
    colors_ = Colors(deck)
    return looks.own_looks(colors_.styles, looks.references(deck.nodes, colors_.paint), colors_.palette)


def _sp(id: Column, name: Column, value: Column, **more) -> Column:
    return builder.shape(id, name, body=builder.paragraph(builder.run(value)), **more)


# ---- the package


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").withColumn("at", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")))
    n = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("n_nationkey")))
    return nation.select(F.col("n_regionkey").cast("string").alias("deck_id"), n.alias("n"), "at", builder.page(_sp(F.col("n_nationkey"), F.col("n_name"), F.col("n_name"))).alias("xml"))


def _slide_texts(decks: DataFrame) -> DataFrame:
    deck = Deck(decks)
    words = shapes.joined(shapes.runs(deck.nodes), ["deck_id", "part_path"], "run_ord", "text")
    met = deck.slides().join(words.withColumnRenamed("part_path", "slide_part"), ["deck_id", "slide_part"])
    return met.select(_whole(F.col("deck_id")).alias("region"), _whole(F.col("slide_index")).alias("slide_index"), "text")


@_query("SELECT CAST(n_regionkey AS BIGINT) AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS slide_index, n_name AS text FROM nation")
def slide_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides in the order of the list, which is not that of their files."""
    return _slide_texts(written(builder.decks(_nations(spark, sf_dir))))


@_query("SELECT CAST(n_regionkey AS BIGINT) AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) - 1 AS slide_index, n_name AS text FROM nation")
def slide_order_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of decks without a list, by the numbers of relationships."""
    return _slide_texts(written(builder.decks(_nations(spark, sf_dir), listed=False)))


@_query("SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(720 + r_regionkey AS DOUBLE) AS width, CAST(540 AS DOUBLE) AS height FROM region")
def slide_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("deck_id"), F.lit(1).alias("n"), F.lit(1).alias("at"), builder.page("").alias("xml"), F.col("r_regionkey").alias("k"))
    files = region.select("deck_id", F.lit("ppt/presentation.xml").alias("part_path"), put("<p:presentation xmlns:p=\"urn:p\"><p:sldSz cx=\"", F.col("k") * 12700 + 9144000, "\" cy=\"6858000\"/></p:presentation>").alias("content"))
    found = package.slide_size(Deck(written(archive.pack(files))).nodes)
    return found.select(_whole(F.col("deck_id")).alias("region"), F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))


@_query(
    """SELECT p_partkey AS part, CASE WHEN p_size % 4 = 0 THEN 'ppt/media/a' || p_partkey || '.png' WHEN p_size % 4 = 1 THEN 'ppt/slides/b' || p_partkey || '.xml'
    WHEN p_size % 4 = 2 THEN 'ppt/c' || p_partkey || '.bin' ELSE 'ppt/slides/x/d' || p_partkey || '.xml' END AS resolved FROM part"""
)
def rel_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of relationships, with steps up, steps that stay, and from the root."""
    part = _table(spark, sf_dir, "part").withColumn("k", F.col("p_size") % 4)
    k = F.col("p_partkey")
    target = F.when(F.col("k") == 0, put("../media/a", k, ".png")).when(F.col("k") == 1, put("./b", k, ".xml")).when(F.col("k") == 2, put("/ppt/c", k, ".bin")).otherwise(put("x/../x//d", k, ".xml"))
    each = part.select((k / 200).cast("long").cast("string").alias("deck_id"), "p_partkey", builder.relationship(put("rId", k), "image", target).alias("xml"))
    files = builder.gathered(each, ["deck_id"], "p_partkey", "xml").select("deck_id", F.lit("ppt/slides/_rels/slide1.xml.rels").alias("part_path"), builder.relationships(F.col("xml")).alias("content"))
    return Deck(written(archive.pack(files))).rels.select(_whole(F.regexp_replace("rid", "rId", "")).alias("part"), "resolved")


@_query(
    """SELECT kind, CAST(count(*) AS BIGINT) AS parts, CAST(count(DISTINCT n_regionkey) AS BIGINT) AS decks FROM (
    SELECT 'slide' AS kind, n_regionkey FROM nation UNION ALL SELECT 'presentation', n_regionkey FROM (SELECT DISTINCT n_regionkey FROM nation)
    UNION ALL SELECT 'presentation_rels', n_regionkey FROM (SELECT DISTINCT n_regionkey FROM nation) UNION ALL SELECT 'notes', n_regionkey FROM nation WHERE n_nationkey % 2 = 0) GROUP BY kind"""
)
def part_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    notes = nation.select(F.col("n_regionkey").cast("string").alias("deck_id"), put("ppt/notesSlides/notesSlide", F.col("n_nationkey"), ".xml").alias("part_path"), builder.page("", "notes").alias("content"))
    found = archive.parts(written(builder.decks(_nations(spark, sf_dir), notes)))
    return found.groupBy("kind").agg(F.count("*").alias("parts"), F.count_distinct("deck_id").alias("decks"))


@_query("SELECT source AS deck_id, CAST(count(*) AS BIGINT) AS entries, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, CAST(max(strlen(coalesce(text, ''))) AS BIGINT) AS largest FROM documents GROUP BY source")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of what archives hold, before limits are set: a text to a file, a source to as many archives as its size wants."""
    found = archive.archive_stats(archive.parts(written(archive.pack(_text_files(_table(spark, sf_dir, "documents"))))))
    tail = F.regexp_extract("deck_id", "(?s)^[0-9]+:(.*)$", 1)
    source = F.when(tail != "", F.substring(tail, 2, 2147483647))
    return found.groupBy(source.alias("deck_id")).agg(F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"), F.max("largest").alias("largest"))


def _text_files(docs: DataFrame, most: int = 4 << 20) -> DataFrame:
    """(deck_id, part_path, content) of texts: deck_id is a bucket and the source.

    Texts go by their hash to as many buckets as the table holds times ``most`` bytes, so that no archive, which has one source's
    texts of a bucket, is much larger than that, however large a source is.  Files count 200 bytes besides their text.  A null source stays apart from an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    n = (docs.agg(F.sum(F.octet_length(text) + 200)).first()[0] or 0) // most + 1
    bucket = F.pmod(F.xxhash64("doc_id", text), F.lit(n))
    return docs.select(put(bucket, ":", F.concat(F.lit("="), F.col("source"))).alias("deck_id"), put("ppt/embeddings/d", F.col("doc_id"), ".txt").alias("part_path"), text.alias("content"))


# ---- text

_LINES = "SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), chr(10))) AS line FROM documents"


@_query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS paragraphs, CAST(sum(length(line)) AS BIGINT) AS chars, md5(string_agg(line, '|')) AS text_md5 FROM ({_LINES}) GROUP BY doc_id")
def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as shapes, a paragraph to a line, and back."""
    docs, body = _table(spark, sf_dir, "documents").select("doc_id", "text"), builder.lines(F.col("text"))
    slides = docs.select((F.col("doc_id") / 50).cast("long").cast("string").alias("deck_id"), F.col("doc_id").alias("n"), F.col("doc_id").alias("at"), builder.page(builder.shape(F.col("doc_id"), F.lit("body"), body=body)).alias("xml"))
    paras = shapes.paragraphs(Deck(written(builder.decks(slides))).nodes)
    doc = _whole(F.regexp_extract("part_path", r"(\d+)\.xml$", 1))
    found = paras.select(doc.alias("doc_id"), "para", F.col("text").alias("line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "line"))), lambda x: x["line"]), "|")
    return found.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("line")).cast("long").alias("chars"), F.md5(whole.cast("binary")).alias("text_md5"))


@_query(
    """SELECT page_id, md5(CASE WHEN contains(t, chr(9)) THEN e ELSE replace(e, '  ', ' ' || chr(160)) END) AS html_md5 FROM (SELECT page_id, t,
    replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS e FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '[\r\n]+', ' ', 'g') AS t FROM pages))"""
)
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as the text of runs, escaped for HTML."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.coalesce("html", F.lit("")), "[\r\n]+", " ").alias("t"))
    slides = pages.select((F.col("page_id") / 50).cast("long").cast("string").alias("deck_id"), F.col("page_id").alias("n"), F.col("page_id").alias("at"), builder.page(_sp(F.col("page_id"), F.lit("page"), F.col("t"))).alias("xml"))
    runs = shapes.runs(Deck(written(builder.decks(slides))).nodes)
    return runs.select(_whole(F.regexp_extract("part_path", r"(\d+)\.xml$", 1)).alias("page_id"), F.md5(text.run_html(F.col("text")).cast("binary")).alias("html_md5"))


@_query(
    """WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, CASE turn % 4 WHEN 0 THEN 'ul' WHEN 1 THEN 'ol' WHEN 3 THEN 'ul' END AS kind, CAST(turn % 3 AS BIGINT) AS level,
      CASE WHEN turn % 5 = 0 THEN 'center' ELSE 'left' END AS align, replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM conversations),
    r AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS open, '' AS html FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL SELECT conv_id, k, CASE WHEN kind IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_concat(list_resize(open[1:level], level), [kind]) END,
        html || list_aggregate(list_transform(list_reverse(list_filter(CASE WHEN kind IS NULL THEN open ELSE open[level + 2:] END, lambda x: x IS NOT NULL)) || [''], lambda x: CASE WHEN x = '' THEN '' ELSE '</' || x || '>' END), 'string_agg', '')
        || CASE WHEN kind IS NULL THEN '<p' WHEN open[level + 1] IS NULL THEN '<' || kind || '><li' WHEN open[level + 1] <> kind THEN '</' || open[level + 1] || '><' || kind || '><li' ELSE '<li' END
        || ' style="text-align:' || align || ';">' || t || CASE WHEN kind IS NULL THEN '</p>' ELSE '</li>' END
      FROM (SELECT r.conv_id, p.k, p.kind, p.level, p.align, p.t, r.open, r.html FROM r JOIN p ON p.conv_id = r.conv_id AND p.k = r.k + 1))
    SELECT conv_id, md5(html || list_aggregate(list_transform(list_reverse(list_filter(open, lambda x: x IS NOT NULL)) || [''], lambda x: CASE WHEN x = '' THEN '' ELSE '</' || x || '>' END), 'string_agg', '')) AS html_md5
    FROM (SELECT conv_id, arg_max(html, k) AS html, arg_max(open, k) AS open FROM r GROUP BY conv_id)"""
)
def note_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as HTML with nested lists: turns of a conversation as paragraphs, signs and numbers by turn, at three levels."""
    talk = _table(spark, sf_dir, "conversations")
    t = F.col("turn")
    sign = F.when(t % 4 == 1, '<a:buAutoNum type="arabicPeriod"/>').when(t % 4 == 2, "").otherwise('<a:buChar char="-"/>')
    props = put("<a:pPr", F.when(t % 5 == 0, ' algn="ctr"').otherwise(""), ' lvl="', t % 3, '">', sign, "</a:pPr>")
    each = talk.select("conv_id", "turn", "role", "text", builder.paragraph(builder.run(F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]+", " ")), props).alias("xml"))
    body = builder.gathered(each, ["conv_id"], ["turn", "role", "text"], "xml")
    deck, number = (F.col("conv_id") / 50).cast("long").cast("string").alias("deck_id"), F.col("conv_id")
    slide = body.select(deck, number.alias("n"), number.alias("at"), builder.page("").alias("xml"))
    note = body.select(deck, put("ppt/notesSlides/notesSlide", number, ".xml").alias("part_path"), builder.page(put(builder.shape(number, F.lit("n"), body=builder.paragraph(builder.run(number)), ph='<p:ph type="sldNum"/>'), builder.shape(number, F.lit("notes"), body=F.col("xml"), ph='<p:ph type="body"/>')), "notes").alias("content"))
    link = body.select(deck, put("ppt/slides/_rels/slide", number, ".xml.rels").alias("part_path"), builder.relationships(builder.relationship("rId1", "notesSlide", put("../notesSlides/notesSlide", number, ".xml"))).alias("content"))
    made = Deck(written(builder.decks(slide, note.unionByName(link))))
    found = lists.note_html(made.nodes, package.relationships(made.nodes))
    return found.select(_whole(F.regexp_extract("slide_part", r"(\d+)\.xml$", 1)).alias("conv_id"), F.md5(F.col("html").cast("binary")).alias("html_md5"))


@_query("SELECT CAST(page_id AS BIGINT) AS page, CASE WHEN page_id % 7 = 0 THEN 'malformed' WHEN page_id % 11 = 0 THEN 'document type' END AS fault FROM pages WHERE page_id % 7 = 0 OR page_id % 11 = 0")
def xml_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of decks that are no XML, or declare a type: they have no elements, and a row that says why; whole pages as texts of slides."""
    k = F.col("page_id")
    page = put("<a>", builder.clean(F.col("html")), F.when(k % 7 == 0, "<b>").otherwise(""), "</a>")
    page = F.when((k % 11 == 0) & (k % 7 != 0), put('<!DOCTYPE a [<!ENTITY e "x">]>', page)).otherwise(page)
    files = _table(spark, sf_dir, "pages").select((k / 50).cast("long").cast("string").alias("deck_id"), put("ppt/slides/slide", k, ".xml").alias("part_path"), page.alias("content"))
    found = xmltree.faults(archive.parts(written(archive.pack(files))).filter("kind = 'slide'"))
    return found.select(_whole(F.regexp_extract("part_path", r"(\d+)\.xml$", 1)).alias("page"), "fault")


@_query(
    """SELECT CAST(l_orderkey AS BIGINT) AS order_key, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(CAST(l_linenumber AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber) AS xs, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber) AS ys
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_quantity FROM lineitem) GROUP BY l_orderkey"""
)
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of points: numbers on both axes of the first series, a chart to an order; a second series doesn't count."""
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    rows = rows.withColumn("i", at)
    x, y = _pt(F.col("i"), F.col("l_linenumber")), _pt(F.col("i"), _whole(F.col("q")))
    each = rows.select("l_orderkey", "i", x.alias("x"), y.alias("y"))
    xs, ys = builder.gathered(each, ["l_orderkey"], "i", "x"), builder.gathered(each, ["l_orderkey"], "i", "y")
    n = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    met = xs.join(ys, "l_orderkey").join(n, "l_orderkey")
    numbers = lambda tag, inner: put(f"<c:{tag}><c:numRef><c:numCache><c:ptCount val=\"", F.col("n"), '"/>', inner, f"</c:numCache></c:numRef></c:{tag}>")
    first, second = put("<c:ser>", numbers("xVal", F.col("x")), numbers("yVal", F.col("y")), "</c:ser>"), put("<c:ser>", numbers("xVal", F.col("y")), numbers("yVal", F.col("x")), "</c:ser>")
    files = met.select((F.col("l_orderkey") / 100).cast("long").cast("string").alias("deck_id"), put("ppt/charts/chart", F.col("l_orderkey"), ".xml").alias("part_path"), put('<c:chartSpace xmlns:c="urn:c"><c:chart><c:plotArea><c:scatterChart>', first, second, "</c:scatterChart></c:plotArea></c:chart></c:chartSpace>").alias("content"))
    found = frames.scatter(frames.chart_series(Deck(written(archive.pack(files))).nodes))
    joined_ = lambda c: F.array_join(F.transform(c, lambda v: v.cast("long").cast("string")), ",")
    return found.select(_whole(F.regexp_extract("part_path", r"(\d+)\.xml$", 1)).alias("order_key"), _whole(F.size("xs")).alias("n"), joined_("xs").alias("xs"), joined_("ys").alias("ys"))


@_query(
    """SELECT p_partkey AS part, CAST(CASE p_size % 4 WHEN 0 THEN p_size WHEN 2 THEN p_size WHEN 3 THEN -5 END AS DOUBLE) / 100 AS brightness, CAST(CASE p_size % 4 WHEN 0 THEN 20 WHEN 3 THEN 10 END AS DOUBLE) / 100 AS contrast,
    CAST(CASE p_size % 4 WHEN 1 THEN p_size END AS DOUBLE) / 100 AS saturation, CAST(CASE p_size % 4 WHEN 1 THEN 6500 END AS DOUBLE) AS temperature, CAST(CASE p_size % 4 WHEN 1 THEN -25 END AS DOUBLE) / 100 AS sharpen FROM part"""
)
def picture_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of pictures, as a plain brightness and contrast or in the later format, which counts before the plain one."""
    k, z = F.col("p_partkey"), F.col("p_size")
    later = lambda *inner: put("<a:extLst><a:ext><a14:imgProps><a14:imgLayer>", *(put("<a14:imgEffect>", x, "</a14:imgEffect>") for x in inner), "</a14:imgLayer></a14:imgProps></a:ext></a:extLst>")
    change = (
        F.when(z % 4 == 0, put('<a:lum bright="', z * 1000, '" contrast="20000"/>')).when(z % 4 == 1, later(put('<a14:saturation sat="', z * 1000, '"/>'), F.lit('<a14:colorTemperature colorTemp="6500"/>'), F.lit('<a14:sharpenSoften amount="-25000"/>')))
        .when(z % 4 == 2, put('<a:lum bright="', z * 1000, '"/>')).otherwise(put('<a:lum bright="1"/>', later(F.lit('<a14:brightnessContrast bright="-5000" contrast="10000"/>'))))
    )
    picture = put('<p:pic><p:nvPicPr><p:cNvPr id="', k, '" name="p"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId1">', change, "</a:blip></p:blipFill><p:spPr/></p:pic>")
    rows = _table(spark, sf_dir, "part").select((k / 200).cast("long").cast("string").alias("deck_id"), "p_partkey", picture.alias("xml"))
    page = put('<p:sld xmlns:p="urn:p" xmlns:a="urn:a" xmlns:a14="urn:a14" xmlns:r="' + builder.RELATION + '"><p:cSld><p:spTree>', F.col("xml"), "</p:spTree></p:cSld></p:sld>")
    slides = builder.gathered(rows, ["deck_id"], "p_partkey", "xml").select("deck_id", F.lit(1).alias("n"), F.lit(1).alias("at"), page.alias("xml"))
    nodes = Deck(written(builder.decks(slides))).nodes
    ids = shapes.shapes(nodes).select("deck_id", "part_path", F.col("nid").alias("owner"), "id")
    met = ids.join(looks.picture_filters(nodes), ["deck_id", "part_path", "owner"])
    return met.select(_whole(F.col("id")).alias("part"), "brightness", "contrast", "saturation", "temperature", "sharpen")


@_query(
    """SELECT CAST(p_partkey // 100 AS BIGINT) AS deck, CAST(count(*) AS BIGINT) AS pictures, md5(string_agg('ppt/media/i' || p_partkey || '.png', ',' ORDER BY p_partkey DESC)) AS targets_md5, (p_partkey // 100) % 3 = 0 AS other FROM part WHERE p_size % 2 = 0 GROUP BY p_partkey // 100"""
)
def all_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pictures that a slide has relationships to, in their order, among other relationships; and whether another office suite wrote the deck."""
    k = F.col("p_partkey")
    part = _table(spark, sf_dir, "part").withColumn("deck_id", (k / 100).cast("long").cast("string"))
    kind = F.when(F.col("p_size") % 2 == 0, builder.relationship(put("rId", k), "image", put("../media/i", k, ".png"))).otherwise(builder.relationship(put("rId", k), "hyperlink", "https://example.org", "External"))
    links = builder.gathered(part.select("deck_id", (-k).alias("at"), kind.alias("xml")), ["deck_id"], "at", "xml").select("deck_id", F.lit("ppt/slides/_rels/slide1.xml.rels").alias("part_path"), builder.relationships(F.col("xml")).alias("content"))
    by = F.when(F.col("deck_id").cast("long") % 3 == 0, ' application="WPS Office"').otherwise("")
    main = links.select("deck_id", F.lit("ppt/presentation.xml").alias("part_path"), put('<p:presentation xmlns:p="urn:p"', by, "/>").alias("content"))
    deck = Deck(written(archive.pack(links.unionByName(main))))
    found = package.all_rels(deck.rels, "image").join(package.written_by_other_office(deck.nodes), "deck_id")
    return found.select(_whole(F.col("deck_id")).alias("deck"), _whole(F.size("targets")).alias("pictures"), F.md5(F.array_join("targets", ",").cast("binary")).alias("targets_md5"), "other")


# ---- archives in archives, and what their documents hold


def _word_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks in which text documents are embedded, one for each customer, fifty to a deck.

    Every 97th is a bomb, every 89th no archive.  In a document stands a field, with another one in its instruction; every third document begins with an
    end that has no begin.
    """
    k = F.col("c_custkey")
    customer = _table(spark, sf_dir, "customer").select("c_custkey")
    r = lambda *inner: put("<w:r>", *inner, "</w:r>")
    t = lambda *value: r("<w:t>", *value, "</w:t>")
    mark = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    instruction = lambda *value: r("<w:instrText>", *value, "</w:instrText>")
    inner = put(mark("begin"), instruction("PAGE"), mark("separate"), t("7"), mark("end"))
    field = put(F.when(k % 3 == 0, mark("end")).otherwise(""), t("a", k), mark("begin"), instruction("eq \\f(", k, ","), inner, instruction("x)"), mark("separate"), t("r", k), mark("end"), t("z"))
    body = put('<w:document xmlns:w="urn:w"><w:body><w:p>', field, "</w:p>", F.repeat(F.lit("<w:p/>"), (k % 5).cast("int")), "</w:body></w:document>")
    file = lambda path, content: F.struct(F.lit(path).alias("part_path"), content.alias("content"))
    files = customer.select(k.cast("string").alias("deck_id"), F.explode(F.array_compact(F.array(file("word/document.xml", body), file("docProps/app.xml", F.lit("<x/>")), F.when(k % 97 == 0, file("word/media/x.bin", F.repeat(F.lit("x"), 200_000)))))).alias("f"))
    made = written(archive.pack(files.select("deck_id", "f.*"))).select(F.col("deck_id").cast("long").alias("c_custkey"), "content")
    outer = made.select((k / 50).cast("long").cast("string").alias("deck_id"), put("ppt/embeddings/d", k, ".docx").alias("part_path"), F.when(k % 89 == 0, F.lit("no archive").cast("binary")).otherwise(F.col("content")).alias("content"))
    return written(archive.pack(outer))


def _word_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(archive.embedded(archive.parts(_word_decks(spark, sf_dir)), max_bytes=100_000))
    return found.withColumn("customer", _whole(F.regexp_extract("inside", r"d(\d+)\.docx$", 1)))


@_query(
    """SELECT CAST(c_custkey AS BIGINT) AS customer, CASE WHEN c_custkey % 89 = 0 THEN 'corrupt' WHEN c_custkey % 97 = 0 THEN 'limit' ELSE 'ok' END AS status, CAST(CASE WHEN c_custkey % 89 = 0 OR c_custkey % 97 = 0 THEN 0 ELSE 2 END AS BIGINT) AS files,
    CAST(CASE WHEN c_custkey % 89 = 0 OR c_custkey % 97 = 0 THEN 0 ELSE 1 + c_custkey % 5 END AS BIGINT) AS paragraphs FROM customer"""
)
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in decks: their files and paragraphs; what is beyond a limit or no archive says so."""
    found = _word_parts(spark, sf_dir)
    counts = found.groupBy("customer").agg(F.min(F.substring_index("status", ":", 1)).alias("status"), F.count("part_path").alias("files"))
    texts = written(xmltree.elements(found.filter("part_path = 'word/document.xml'").select(F.col("customer").cast("string").alias("deck_id"), "part_path", "content")))
    paras = texts.filter("tag = 'p'").groupBy(_whole(F.col("deck_id")).alias("customer")).agg(F.count("*").alias("paragraphs"))
    return counts.join(paras, "customer", "left").fillna(0, ["paragraphs"])


@_query(
    """SELECT customer, CAST(depth AS BIGINT) AS depth, instruction, result, plain FROM (SELECT CAST(c_custkey AS BIGINT) AS customer, 1 AS depth, 'eq \\f(' || c_custkey || ',x)' AS instruction, 'r' || c_custkey AS result, 'a' || c_custkey || 'r' || c_custkey || 'z' AS plain FROM customer
    WHERE c_custkey % 89 <> 0 AND c_custkey % 97 <> 0 UNION ALL SELECT c_custkey, 2, 'PAGE', '7', 'a' || c_custkey || 'r' || c_custkey || 'z' FROM customer WHERE c_custkey % 89 <> 0 AND c_custkey % 97 <> 0)"""
)
def word_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of documents in decks, one in the other, and the text outside of them."""
    found = _word_parts(spark, sf_dir).filter("part_path = 'word/document.xml'")
    nodes = written(xmltree.elements(found.select(F.col("customer").cast("string").alias("deck_id"), "part_path", "content")))
    met = fields.fields(nodes).join(fields.plain_text(nodes), ["deck_id", "part_path"])
    return met.select(_whole(F.col("deck_id")).alias("customer"), _whole(F.col("depth")).alias("depth"), "instruction", "result", F.col("text").alias("plain"))


@_query(
    """WITH u AS (SELECT p_partkey, p_partkey // 200 AS deck, 'm' || (p_size % 10) || CASE WHEN p_size % 10 = 0 THEN '' ELSE '-' || (p_partkey // 200) END AS medium FROM part),
    d AS (SELECT medium, count(DISTINCT deck) AS n_decks, count(DISTINCT deck) AS n_places FROM u GROUP BY medium) SELECT CAST(p_partkey AS BIGINT) AS part, sha256(medium) AS media_id, CAST(n_places AS BIGINT) AS n_places, CAST(n_decks AS BIGINT) AS n_decks, medium AS bytes FROM u JOIN d USING (medium)"""
)
def distinct_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of decks, of which one is in every deck: each once, by its bytes, with how many decks have it; and the one that each shape shows."""
    k, z = F.col("p_partkey"), F.col("p_size")
    part = _table(spark, sf_dir, "part").select(k, (k / 200).cast("long").cast("string").alias("deck_id"), (z % 10).alias("m"))
    picture = put('<p:pic><p:nvPicPr><p:cNvPr id="', k, '" name="p"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId', F.col("m"), '"/></p:blipFill><p:spPr/></p:pic>')
    slides = builder.gathered(part.select("deck_id", "p_partkey", picture.alias("xml")), ["deck_id"], "p_partkey", "xml").select("deck_id", F.lit(1).alias("n"), F.lit(1).alias("at"), builder.page(F.col("xml")).alias("xml"))
    held = part.select("deck_id", "m").distinct()
    bytes_ = put("m", F.col("m"), F.when(F.col("m") != 0, put("-", F.col("deck_id"))).otherwise(""))
    link = held.select("deck_id", "m", builder.relationship(put("rId", F.col("m")), "image", put("../media/i", F.col("m"), ".png")).alias("xml"))
    links = builder.gathered(link, ["deck_id"], "m", "xml").select("deck_id", F.lit("ppt/slides/_rels/slide1.xml.rels").alias("part_path"), builder.relationships(F.col("xml")).alias("content"))
    deck = Deck(written(builder.decks(slides, links.unionByName(held.select("deck_id", put("ppt/media/i", F.col("m"), ".png").alias("part_path"), bytes_.alias("content"))))))
    nodes, places = deck.nodes, cut(media_table.placed(deck.parts))
    once = cut(media_table.distinct(places))
    found = shapes.shapes(nodes)
    shown = media_table.used(found, package.relationships(nodes), places).join(found.select("deck_id", "part_path", "nid", "id"), ["deck_id", "part_path", "nid"])
    kept = media_table.kept(deck.parts, once).select("media_id", F.col("content").cast("string").alias("bytes"))
    return shown.join(once.select("media_id", "n_places", "n_decks"), "media_id").join(kept, "media_id").select(_whole(F.col("id")).alias("part"), "media_id", "n_places", "n_decks", "bytes")


@_query("SELECT conv_id, md5(trim(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text))) AS note_md5 FROM conversations GROUP BY conv_id")
def notes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as the notes of a slide: trimmed and without separators."""
    talk = _table(spark, sf_dir, "conversations")
    each = talk.select("conv_id", "turn", "role", "text", builder.paragraph(builder.run(F.col("text"))).alias("xml"))
    body = builder.gathered(each, ["conv_id"], ["turn", "role", "text"], "xml")
    slide = body.select((F.col("conv_id") / 50).cast("long").cast("string").alias("deck_id"), F.col("conv_id").alias("n"), F.col("conv_id").alias("at"), builder.page("").alias("xml"))
    number = F.col("conv_id")
    deck = (F.col("conv_id") / 50).cast("long").cast("string").alias("deck_id")
    note = body.select(deck, put("ppt/notesSlides/notesSlide", number, ".xml").alias("part_path"), builder.page(put(builder.shape(number, F.lit("number"), body=builder.paragraph(builder.run(number)), ph='<p:ph type="sldNum"/>'), builder.shape(number, F.lit("notes"), body=F.col("xml"), ph='<p:ph type="body"/>')), "notes").alias("content"))
    link = body.select(deck, put("ppt/slides/_rels/slide", number, ".xml.rels").alias("part_path"), builder.relationships(builder.relationship("rId1", "notesSlide", put("../notesSlides/notesSlide", number, ".xml"))).alias("content"))
    made = Deck(written(builder.decks(slide, note.unionByName(link))))
    found = package.notes(made.nodes, made.rels)
    return found.select(_whole(F.regexp_extract("slide_part", r"(\d+)\.xml$", 1)).alias("conv_id"), F.md5(F.col("note").cast("binary")).alias("note_md5"))


@_query(
    """SELECT user_id, CAST(island AS BIGINT) AS island, event_type AS style, CAST(count(*) AS BIGINT) AS n, md5(string_agg(CAST(event_id AS VARCHAR) || ' ', '' ORDER BY event_id)) AS text_md5 FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS island FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)
    AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, island, event_type"""
)
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal style that follow each other become one: a user's events in order, their type as style."""
    events = _table(spark, sf_dir, "events")
    style = put('lang="', builder.clean(F.col("event_type")), '"')
    each = events.select("user_id", "event_id", builder.run(put(F.col("event_id"), " "), style).alias("xml"))
    body = builder.gathered(each, ["user_id"], "event_id", "xml")
    slides = body.select((F.col("user_id") / 20).cast("long").cast("string").alias("deck_id"), F.col("user_id").alias("n"), F.col("user_id").alias("at"), builder.page(builder.shape(F.col("user_id"), F.lit("log"), body=builder.paragraph(F.col("xml")))).alias("xml"))
    nodes = Deck(written(builder.decks(slides))).nodes
    lang = nodes.filter(F.col("tag") == "rPr").select("deck_id", "part_path", F.col("parent").alias("run_ord"), xmltree.attr("lang").alias("style"))
    rows = shapes.runs(nodes).join(lang, ["deck_id", "part_path", "run_ord"])
    found = shapes.merged_runs(rows, ["part_path"], "run_ord", ["style"])
    n = F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    return found.select(_whole(F.regexp_extract("part_path", r"(\d+)\.xml$", 1)).alias("user_id"), _whole(F.col("island")).alias("island"), "style", _whole(n).alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_ROMAN = "CASE WHEN n >= 40 THEN 'XL' ELSE repeat('X', n // 10) END || CASE n % 10 WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' WHEN 9 THEN 'IX' ELSE '' END"


@_query(
    f"""SELECT o_custkey AS customer, o_orderkey AS order_key, CASE CAST(o_custkey % 4 AS INTEGER) WHEN 0 THEN CAST(n AS VARCHAR) || '.' WHEN 1 THEN {_ROMAN} || '.' WHEN 2 THEN chr(CAST(97 + (n - 1) % 26 AS INTEGER)) || ')' ELSE '(' || n || ')' END AS label
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE o_orderstatus IS NOT NULL"""
)
def bullets_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered paragraphs: a customer's orders in four kinds of numbers."""
    orders = _table(spark, sf_dir, "orders")
    kinds = F.element_at(F.array(*map(F.lit, ("arabicPeriod", "romanUcPeriod", "alphaLcParenR", "arabicParenBoth"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    each = orders.select("o_custkey", "o_orderkey", builder.paragraph(builder.run(F.col("o_orderkey")), put('<a:pPr lvl="', F.col("o_orderkey") % 3, '"><a:buAutoNum type="', kinds, '"/></a:pPr>')).alias("xml"))
    body = builder.gathered(each, ["o_custkey"], "o_orderkey", "xml")
    slides = body.select((F.col("o_custkey") / 100).cast("long").cast("string").alias("deck_id"), F.col("o_custkey").alias("n"), F.col("o_custkey").alias("at"), builder.page(builder.shape(F.col("o_custkey"), F.lit("list"), body=F.col("xml"))).alias("xml"))
    found = shapes.numbered(shapes.paragraphs(Deck(written(builder.decks(slides))).nodes))
    return found.select(_whole(F.regexp_extract("part_path", r"(\d+)\.xml$", 1)).alias("customer"), _whole(F.col("text")).alias("order_key"), text.auto_number(F.col("auto_kind"), F.col("number")).alias("label"))


@_query(r"SELECT page_id, regexp_matches(lower(trim(url)), '^(https?:/*[^/\s]|mailto:)') AS safe FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'mailto:' || page_id || '@example.org' WHEN 2 THEN 'javascript:go()' ELSE '/relative/' || page_id END AS url FROM pages)")
def links_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of links, as relationships have them: those of the web and of mail are safe."""
    pages = _table(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.col("url")).when(k == 1, put("mailto:", F.col("page_id"), "@example.org")).when(k == 2, "javascript:go()").otherwise(put("/relative/", F.col("page_id")))
    each = pages.select((F.col("page_id") / 200).cast("long").cast("string").alias("deck_id"), "page_id", builder.relationship(put("rId", F.col("page_id")), "hyperlink", text.escape(url), "External").alias("xml"))
    files = builder.gathered(each, ["deck_id"], "page_id", "xml").select("deck_id", F.lit("ppt/slides/_rels/slide1.xml.rels").alias("part_path"), builder.relationships(F.col("xml")).alias("content"))
    return Deck(written(archive.pack(files))).rels.select(_whole(F.regexp_replace("rid", "rId", "")).alias("page_id"), text.safe_link(F.col("target")).alias("safe"))


# ---- tables and charts


def _supplier_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each nation, its suppliers as rows."""
    s = _table(spark, sf_dir, "supplier")
    cell = lambda v: put("<a:tc><a:txBody>", builder.paragraph(builder.run(v)), "</a:txBody></a:tc>")
    row = put('<a:tr h="0">', cell(F.col("s_suppkey")), cell(F.col("s_name")), "</a:tr>")
    rows = builder.gathered(s.select("s_nationkey", "s_suppkey", row.alias("xml")), ["s_nationkey"], "s_suppkey", "xml")
    table = put("<a:tbl><a:tblPr/><a:tblGrid/>", F.col("xml"), "</a:tbl>")
    box = builder.xfrm(F.lit(0), F.lit(0), F.lit(914400), F.lit(914400), tag="p:xfrm")
    return written(builder.decks(rows.select(F.col("s_nationkey").cast("string").alias("deck_id"), F.lit(1).alias("n"), F.lit(1).alias("at"), builder.page(builder.frame(F.lit(1), table, "table", box)).alias("xml"))))


_ROWS = "SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS row FROM supplier"


@_query(f"SELECT CAST(s_nationkey AS BIGINT) AS nation, row, c.col AS col, CASE c.col WHEN 0 THEN CAST(s_suppkey AS VARCHAR) ELSE s_name END AS text, row % 2 AS band FROM ({_ROWS}), (VALUES (0), (1)) c(col)")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables, and the bands of their rows."""
    found = frames.banded(frames.cells(Deck(_supplier_tables(spark, sf_dir)).nodes), F.lit(False))
    return found.select(_whole(F.col("deck_id")).alias("nation"), _whole(F.col("row")).alias("row"), F.col("col").cast("int").alias("col"), "text", _whole(F.col("band")).alias("band"))


@_query("SELECT CAST(s_nationkey AS BIGINT) AS nation, CAST(count(*) AS BIGINT) AS n_rows, round(72.0 / count(*), 6) AS height FROM supplier GROUP BY s_nationkey")
def table_even_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a height share that of the table."""
    found = frames.row_heights(Deck(_supplier_tables(spark, sf_dir)).nodes, F.lit(914400.0))
    return found.select(_whole(F.col("deck_id")).alias("nation"), _whole(F.size("heights")).alias("n_rows"), F.round(units.emu_to_pt(F.col("heights")[0]), 6).alias("height"))


def _chart(deck: Column, series: DataFrame, kind: str = "barChart") -> DataFrame:
    """Decks with a chart part each; series: (deck_id, ord, xml)."""
    body = builder.gathered(series, ["deck_id"], "ord", "xml")
    content = put('<c:chartSpace xmlns:c="urn:c"><c:chart><c:plotArea><c:lineChart/>' if kind != "barChart" else '<c:chartSpace xmlns:c="urn:c"><c:chart><c:plotArea>', f"<c:{kind}>", F.col("xml"), f"</c:{kind}></c:plotArea></c:chart></c:chartSpace>")
    return written(archive.pack(body.select("deck_id", F.lit("ppt/charts/chart1.xml").alias("part_path"), content.alias("content"))))


def _series_xml(name: Column, n: Column | int, cats: Column, vals: Column) -> Column:
    count = F.lit(n) if isinstance(n, int) else n
    points = lambda tag, pts: put(f"<c:{tag}><c:strRef><c:strCache><c:ptCount val=\"", count, '"/>', pts, f"</c:strCache></c:strRef></c:{tag}>")
    return put('<c:ser><c:tx><c:strRef><c:strCache><c:pt idx="0"><c:v>', builder.clean(name), "</c:v></c:pt></c:strCache></c:strRef></c:tx>", points("cat", cats), points("val", vals), "</c:ser>")


def _pt(idx: Column, value: Column) -> Column:
    return put('<c:pt idx="', idx, '"><c:v>', builder.clean(value.cast("string")), "</c:v></c:pt>")


@_query(
    """SELECT l_returnflag AS deck_id, l_linestatus AS name, CAST(month AS BIGINT) AS category, CAST(n AS DOUBLE) AS value FROM (
    SELECT f.l_returnflag, f.l_linestatus, m.month, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) f CROSS JOIN (SELECT unnest(range(0, 12)) AS month) m
    LEFT JOIN (SELECT l_returnflag, l_linestatus, month(l_shipdate) - 1 AS month, count(*) AS n FROM lineitem WHERE month(l_shipdate) % 3 <> 0 GROUP BY ALL) g
    ON g.l_returnflag = f.l_returnflag AND g.l_linestatus = f.l_linestatus AND g.month = m.month)"""
)
def chart_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with points left out: every third month is missing and counts as 0."""
    sums = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", (F.month("l_shipdate") - 1).alias("month")).agg(F.count("*").alias("n"))
    shown = (F.col("month") + 1) % 3 != 0
    each = sums.select("l_returnflag", "l_linestatus", "month", F.when(shown, _pt(F.col("month"), F.col("n"))).otherwise("").alias("val"), F.when(shown, _pt(F.col("month"), F.col("month"))).otherwise("").alias("cat"))
    val = builder.gathered(each, ["l_returnflag", "l_linestatus"], "month", "val")
    cat = builder.gathered(each, ["l_returnflag", "l_linestatus"], "month", "cat")
    met = val.join(cat, ["l_returnflag", "l_linestatus"])
    series = met.select(F.col("l_returnflag").alias("deck_id"), F.col("l_linestatus").alias("ord"), _series_xml(F.col("l_linestatus"), 12, F.col("cat"), F.col("val")).alias("xml"))
    found = frames.chart_series(Deck(_chart(F.col("deck_id"), series)).nodes)
    return found.select("deck_id", "name", F.posexplode("values").alias("category", "value")).withColumn("category", _whole(F.col("category")))


@_query(
    """SELECT r_name AS deck_id, CAST(row_number() OVER (PARTITION BY r_name ORDER BY c_mktsegment) - 1 AS BIGINT) AS series, c_mktsegment AS name, CAST(count(*) AS DOUBLE) AS value, 'lineChart' AS chart
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment"""
)
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of charts with two kinds, of which the first in the fixed order that has any counts."""
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sums = c.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"))
    series = sums.select(F.col("r_name").alias("deck_id"), F.col("c_mktsegment").alias("ord"), _series_xml(F.col("c_mktsegment"), 1, _pt(F.lit(0), F.lit("all")), _pt(F.lit(0), F.col("n"))).alias("xml"))
    body = builder.gathered(series, ["deck_id"], "ord", "xml")
    content = put('<c:chartSpace xmlns:c="urn:c"><c:chart><c:plotArea><c:surfaceChart><c:ser/></c:surfaceChart><c:barChart><c:ser/></c:barChart><c:lineChart>', F.col("xml"), "</c:lineChart></c:plotArea></c:chart></c:chartSpace>")
    found = frames.chart_series(Deck(written(archive.pack(body.select("deck_id", F.lit("ppt/charts/chart1.xml").alias("part_path"), content.alias("content"))))).nodes)
    return found.select("deck_id", _whole(F.col("series")).alias("series"), "name", F.col("values")[0].alias("value"), "chart")


# ---- placeholders, groups, diagrams


@_query(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber)),
    t AS (SELECT *, list_extract(['#' || lpad(CAST(l_orderkey // 100 AS VARCHAR), 6, '0'), '#ED7D31', '#A5A5A5', '#FFC000', '#000000', '#70AD47'], CAST(i % 6 + 1 AS INTEGER)) AS accent FROM l)
    SELECT CAST(l_orderkey AS BIGINT) AS order_key, CASE l_orderkey % 3 WHEN 0 THEN '0|7' ELSE string_agg(CASE WHEN i % 2 = 0 THEN 's' || l_linenumber ELSE CAST(l_linenumber + 10 AS VARCHAR) END, '|' ORDER BY i) END AS names,
    string_agg(CASE WHEN q % 5 = 4 THEN accent WHEN l_orderkey % 3 = 0 OR q % 5 IN (0, 1) THEN '#' || lpad(CAST(q AS VARCHAR), 6, '0') WHEN q % 5 = 2 THEN '#445566' ELSE '#FF0000' END, ',' ORDER BY i) AS colors FROM t GROUP BY l_orderkey"""
)
def chart_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of charts, a chart to an order, on slides of their own themes: of series (their fill, line, marker or marker's line) or of a pie's points, else the theme's accents in turn; and what series without a name go by."""
    q, n, i, key = F.col("q"), F.col("l_linenumber"), F.col("i"), F.col("l_orderkey")
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(_whole(F.max("l_quantity")).alias("q"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1)
    srgb = put('<a:srgbClr val="', F.lpad(q.cast("string"), 6, "0"), '"><a:alpha val="50000"/></a:srgbClr>')
    fill = lambda inner: put("<a:solidFill>", inner, "</a:solidFill>")
    props = lambda inner: put("<c:spPr>", inner, "</c:spPr>")
    line = lambda inner: put("<a:ln>", inner, "</a:ln>")
    marker = lambda inner: put("<c:marker>", props(inner), "</c:marker>")
    wrong = F.lit('<a:solidFill><a:srgbClr val="BADBAD"/></a:solidFill>')
    own = F.when(q % 5 == 0, put(props(put(fill(srgb), line(wrong))), marker(wrong))).when(q % 5 == 1, put(props(line(fill(srgb))), marker(wrong))).when(q % 5 == 2, marker(put(fill(F.lit('<a:schemeClr val="tx1"/>')), line(wrong)))).when(q % 5 == 3, marker(line(fill(F.lit('<a:prstClr val="red"/>')))))
    name = F.when(i % 2 == 0, put("<c:tx><c:v>s", n, "</c:v></c:tx>"))
    series = put('<c:ser><c:order val="', n + 10, '"/>', name, own, "</c:ser>")
    point = put("<c:dPt>", F.when(q % 5 != 4, props(fill(srgb))), "</c:dPt>")
    other = '<c:ser><c:order val="7"/><c:dPt><c:spPr><a:solidFill><a:srgbClr val="BADBAD"/></a:solidFill></c:spPr></c:dPt></c:ser>'
    body = builder.gathered(rows.select(key, i, F.when(key % 3 == 0, point).otherwise(series).alias("xml")), ["l_orderkey"], "i", "xml")
    kind = F.when(key % 3 == 0, "pieChart").when(key % 3 == 1, "barChart").otherwise("lineChart")
    inner = F.when(key % 3 == 0, put("<c:ser>", F.col("xml"), "</c:ser>", other)).otherwise(F.col("xml"))
    deck = (key / 100).cast("long").cast("string").alias("deck_id")
    charts = body.select(deck, "l_orderkey", put('<c:chartSpace xmlns:c="urn:c" xmlns:a="urn:a"><c:chart><c:plotArea><c:', kind, ">", inner, "</c:", kind, "></c:plotArea></c:chart></c:chartSpace>").alias("content"))
    part = put("ppt/charts/chart", key, ".xml").alias("part_path")
    link = builder.relationship
    shown = builder.gathered(charts.select("deck_id", "l_orderkey", link(put("rId9", key), "chart", put("../charts/chart", key, ".xml")).alias("xml")), ["deck_id"], "l_orderkey", "xml")
    accents = put(*(put(f'<a:{k}><a:srgbClr val="', v, f'"/></a:{k}>') for k, v in (("dk1", F.lit("445566")), ("accent1", F.lpad("deck_id", 6, "0")), ("accent2", F.lit("ED7D31")), ("accent3", F.lit("A5A5A5")), ("accent4", F.lit("FFC000")), ("accent6", F.lit("70AD47")))))
    fixed = {
        "ppt/slides/_rels/slide1.xml.rels": builder.relationships(put(link("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), F.col("xml"))), "ppt/slideLayouts/_rels/slideLayout1.xml.rels": builder.relationships(link("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")),
        "ppt/slideMasters/slideMaster1.xml": builder.page("", "sldMaster", '<p:clrMap tx1="dk1"/>'), "ppt/slideMasters/_rels/slideMaster1.xml.rels": builder.relationships(link("rId1", "theme", "../theme/theme1.xml")),
        "ppt/theme/theme1.xml": put('<a:theme xmlns:a="urn:a"><a:themeElements><a:clrScheme>', accents, "</a:clrScheme></a:themeElements></a:theme>"),
    }
    more = shown.select("deck_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, fixed)), F.array(*fixed.values()))).alias("part_path", "content"))
    slides = shown.select("deck_id", F.lit(1).alias("n"), F.lit(1).alias("at"), builder.page("").alias("xml"))
    made = Deck(written(builder.decks(slides, more.unionByName(charts.select("deck_id", part, "content")))))
    made.rels = cut(made.rels)
    nodes = made.nodes
    palette = cut(with_charts(palettes(nodes, made.rels), made.rels))
    found = cut(frames.chart_series(nodes))
    colors_ = frames.series_colors(nodes, found, painted(raw_colors(nodes), palette), palette)
    names = found.groupBy("deck_id", "part_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("series", "name"))), lambda x: x["name"]), "|").alias("names"))
    return names.join(colors_, ["deck_id", "part_path"]).select(_whole(F.regexp_extract("part_path", r"(\d+)\.xml$", 1)).alias("order_key"), "names", F.array_join("colors", ",").alias("colors"))


@_query(
    """SELECT p_partkey AS part, CASE k WHEN 2 THEN 'https://example.org/v' || p_partkey WHEN 1 THEN CASE WHEN p_size % 3 <> 0 THEN 'ppt/media/m' || p_partkey || '.mp4' END WHEN 3 THEN CASE WHEN p_size % 3 <> 0 THEN 'ppt/media/m' || p_partkey || '.mp3' END END AS blob,
    CASE WHEN k IN (1, 2) AND p_size % 2 = 0 THEN 'ppt/media/still.png' END AS poster, CASE WHEN k = 0 AND p_size < 30 THEN greatest(0, CAST(p_size * 4000 - 20000 AS DOUBLE) / 100000) END AS opacity
    FROM (SELECT *, p_partkey % 4 AS k FROM part)"""
)
def picture_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What videos and sounds play, in the deck or on the web, and the stills of videos, of which metafiles don't count; how opaque pictures are."""
    k, z = F.col("p_partkey"), F.col("p_size")
    kind = k % 4
    part = _table(spark, sf_dir, "part").select(k, z, (k / 200).cast("long").cast("string").alias("deck_id"))
    plays = F.when(kind.isin(1, 2), put('<a:videoFile r:link="rId7', k, '"/>')).when(kind == 3, put('<a:audioFile r:link="rId7', k, '"/>'))
    alpha = F.when(kind == 0, put('<a:alphaModFix amt="', z * 8000, '"/><a:alphaMod val="50000"/><a:alphaOff val="-20000"/>'))
    picture = put('<p:pic><p:nvPicPr><p:cNvPr id="', k, '" name="p"/><p:nvPr>', plays, '</p:nvPr></p:nvPicPr><p:blipFill><a:blip r:embed="rId', 2 + z % 2, '">', alpha, "</a:blip></p:blipFill><p:spPr/></p:pic>")
    slides = _one_slide(part, (k / 200).cast("long"), picture, "p_partkey")
    name = put("m", k, F.when(kind == 3, ".mp3").otherwise(".mp4"))
    link = F.when(kind == 2, builder.relationship(put("rId7", k), "video", put("https://example.org/v", k), "External")).when(kind == 1, builder.relationship(put("rId7", k), "video", put("../media/", name))).when(kind == 3, builder.relationship(put("rId7", k), "audio", put("../media/", name)))
    links = builder.gathered(part.select("deck_id", "p_partkey", F.coalesce(link, F.lit("")).alias("xml")), ["deck_id"], "p_partkey", "xml")
    stills = put(builder.relationship("rId2", "image", "../media/still.png"), builder.relationship("rId3", "image", "../media/still.wmf"))
    links = links.select("deck_id", F.lit("ppt/slides/_rels/slide1.xml.rels").alias("part_path"), builder.relationships(put(stills, F.col("xml"))).alias("content"))
    held = part.filter(kind.isin(1, 3) & (z % 3 != 0)).select("deck_id", put("ppt/media/", name).alias("part_path"), F.lit("m").alias("content"))
    still = part.select("deck_id").distinct().select("deck_id", F.explode(F.array(F.lit("ppt/media/still.png"), F.lit("ppt/media/still.wmf"))).alias("part_path"), F.lit("s").alias("content"))
    deck = Deck(written(builder.decks(slides, links.unionByName(held).unionByName(still))))
    keys = ["deck_id", "part_path", "nid"]
    found = cut(shapes.shapes(deck.nodes))
    seen = looks.picture_filters(deck.nodes).withColumnRenamed("owner", "nid").select(*keys, "opacity")
    met = found.join(media_table.sources(found, deck.rels, deck.parts), keys, "left").join(seen, keys, "left")
    return met.select(_whole(F.col("id")).alias("part"), "blob", "poster", F.round("opacity", 6).alias("opacity"))


@_query(
    """SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 10 + n_nationkey WHEN n_nationkey % 3 = 1 THEN 100 ELSE 200 END AS DOUBLE) AS "left",
    CAST(CASE WHEN n_nationkey % 3 = 0 THEN 20 WHEN n_nationkey % 3 = 1 THEN 30 ELSE 40 END AS DOUBLE) AS width FROM nation"""
)
def placeholder_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of placeholders: their own, the layout's of that type and index, or the master's of that type."""
    k = F.col("n_nationkey")
    pt = lambda c: c * 12700
    box = F.when(k % 3 == 0, builder.xfrm(pt(k + 10), F.lit(0), F.lit(20 * 12700), F.lit(12700))).otherwise("")
    ph = F.when(k % 3 == 2, '<p:ph type="sldNum"/>').otherwise('<p:ph type="body" idx="7"/>')
    nation = _table(spark, sf_dir, "nation").withColumn("deck_id", F.col("n_regionkey").cast("string"))
    slides = nation.select("deck_id", k.alias("n"), k.alias("at"), builder.page(_sp(k, F.col("n_name"), F.col("n_name"), box=box, ph=ph)).alias("xml"))
    place = lambda left, width: builder.xfrm(F.lit(left * 12700), F.lit(0), F.lit(width * 12700), F.lit(12700))
    only = nation.select("deck_id").distinct()
    layout = put(builder.shape(F.lit(1), F.lit("a"), box=place(1, 1), ph='<p:ph type="body" idx="6"/>'), builder.shape(F.lit(2), F.lit("b"), box=place(100, 30), ph='<p:ph type="body" idx="7"/>'))
    master = builder.shape(F.lit(1), F.lit("c"), box=place(200, 40), ph='<p:ph type="sldNum" idx="4"/>')
    more = only.select("deck_id", F.lit("ppt/slideLayouts/slideLayout1.xml").alias("part_path"), builder.page(layout, "sldLayout").alias("content"))
    more = more.unionByName(only.select("deck_id", F.lit("ppt/slideMasters/slideMaster1.xml").alias("part_path"), builder.page(master, "sldMaster").alias("content")))
    more = more.unionByName(only.select("deck_id", F.lit("ppt/slideLayouts/_rels/slideLayout1.xml.rels").alias("part_path"), builder.relationships(builder.relationship("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")).alias("content")))
    more = more.unionByName(nation.select("deck_id", put("ppt/slides/_rels/slide", k, ".xml.rels").alias("part_path"), builder.relationships(builder.relationship("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")).alias("content")))
    deck = Deck(written(builder.decks(slides, more)))
    found = shapes.shapes(deck.nodes)
    order = package.chain(deck.slides(), deck.rels).drop("slide_index")
    own = found.withColumnRenamed("part_path", "slide_part").join(order, ["deck_id", "slide_part"])
    of = lambda part: found.filter(F.col("part_path").startswith(part))
    got = shapes.inherited(own, of("ppt/slideLayouts/"), of("ppt/slideMasters/"))
    return shapes.boxes(got).select(_whole(F.col("id")).alias("nation"), "left", "width")


@_query("SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line, round(l_quantity * 2 + 3.5, 4) AS \"left\", round(l_quantity / 2.0, 4) AS width FROM lineitem")
def nested_group_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes in two groups, one in the other: the inner one scales by four and moves by 1, the outer one halves and moves by 3."""
    rows = _table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity") * 12700)
    leaf = builder.shape(F.lit(1), put(F.col("l_orderkey"), "-", F.col("l_linenumber")), box=builder.xfrm(F.col("q"), F.lit(0), F.col("q") / 4, F.lit(12700)))
    each = rows.select((F.col("l_orderkey") / 100).cast("long").cast("string").alias("deck_id"), "l_orderkey", "l_linenumber", leaf.alias("xml"))
    body = builder.gathered(each, ["deck_id"], ["l_orderkey", "l_linenumber"], "xml")
    group = lambda inner, x, cx, ch: put('<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="g"/></p:nvGrpSpPr><p:grpSpPr>', builder.xfrm(F.lit(x * 12700), F.lit(0), F.lit(cx * 12700), F.lit(12700), inner=f'<a:chOff x="0" y="0"/><a:chExt cx="{ch * 12700}" cy="12700"/>'), "</p:grpSpPr>", inner, "</p:grpSp>")
    inner = group(F.col("xml"), 1, 200, 50)
    outer = group(inner, 3, 100, 200)
    slides = body.select("deck_id", F.lit(1).alias("n"), F.lit(1).alias("at"), builder.page(outer).alias("xml"))
    found = shapes.boxes(shapes.flattened(cut(shapes.shapes(Deck(written(builder.decks(slides)), shapes.TAGS).nodes)))).filter("shape = 'sp'")
    parts = F.split("name", "-")
    return found.select(_whole(parts[0]).alias("order_key"), _whole(parts[1]).alias("line"), F.round("left", 4).alias("left"), F.round("width", 4).alias("width"))


@_query(
    """SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line, round(CASE WHEN l_linenumber % 2 = 0 THEN 100 - x - 10 ELSE x END, 4) AS "left", round(CASE WHEN l_orderkey % 2 = 0 THEN 50 - y - 5 ELSE y END, 4) AS top,
    CAST(CASE WHEN l_linenumber % 2 = 0 AND l_orderkey % 2 = 0 THEN (r + 180) % 360 WHEN l_linenumber % 2 = 0 OR l_orderkey % 2 = 0 THEN (360 - r) % 360 ELSE r END AS DOUBLE) AS rotate,
    (l_linenumber % 2 = 0) <> (l_linenumber % 2 = 0 AND l_orderkey % 2 = 0) AS flip_h FROM (SELECT *, l_quantity AS x, l_quantity / 2 AS y, CAST(l_quantity AS BIGINT) * 5 AS r FROM lineitem)"""
)
def group_bake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of mirrored groups: places, turns and mirrors as seen from outside."""
    rows = _table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    group = {"width": F.lit(100.0), "height": F.lit(50.0), "rotate": F.lit(0.0), "flip_h": F.col("l_linenumber") % 2 == 0, "flip_v": F.col("l_orderkey") % 2 == 0}
    b = frames.baked(q, q / 2, F.lit(10.0), F.lit(5.0), q.cast("long") * 5.0, F.lit(False), F.lit(False), group)
    return rows.select(F.col("l_orderkey").alias("order_key"), _whole(F.col("l_linenumber")).alias("line"), b.alias("b")).select("order_key", "line", F.round("b.left", 4).alias("left"), F.round("b.top", 4).alias("top"), F.col("b.rotate").alias("rotate"), F.col("b.flip_h").alias("flip_h"))


@_query(
    """SELECT s_suppkey AS frame, arg_min(p_partkey, CAST(abs(p_size - s_suppkey % 60) AS BIGINT) * 1000000000 + p_partkey) AS drawing FROM supplier JOIN part ON p_partkey % 25 = s_nationkey GROUP BY s_suppkey"""
)
def diagram_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each frame the drawing of its deck with the nearest number."""
    a = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("deck_id"), F.col("s_suppkey").alias("frame"), (F.col("s_suppkey") % 60).alias("number"))
    b = _table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).cast("int").alias("deck_id"), F.col("p_partkey").alias("drawing"), F.col("p_size").alias("drawing_number"))
    return frames.nearest_drawing(a, b).select("frame", "drawing")


# ---- colours, lines, outlines


@_query(
    """WITH c AS (SELECT c_custkey, printf('%06X', CAST((c_custkey * 7919) % 16777216 AS BIGINT)) AS hex, (c_custkey * 7919) % 16777216 AS v FROM customer),
    k AS (SELECT c_custkey, hex, i, ((v >> (16 - 8 * i)) & 255) / 255.0 AS s FROM c, (VALUES (0), (1), (2)) t(i)),
    l AS (SELECT c_custkey, hex, i, 0.5 * CASE WHEN s <= 0.04045 THEN s / 12.92 ELSE pow((s + 0.055) / 1.055, 2.4) END AS x FROM k),
    o AS (SELECT c_custkey, i, CAST(floor(255 * CASE WHEN x <= 0.0031308 THEN x * 12.92 ELSE 1.055 * pow(x, 1 / 2.4) - 0.055 END + 0.5) AS BIGINT) AS b FROM l)
    SELECT c_custkey AS customer, '#' || string_agg(printf('%02x', b), '' ORDER BY i) AS shaded, CAST(0.25 AS DOUBLE) AS alpha FROM o GROUP BY c_custkey"""
)
def color_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours half way to black in linear light, and a quarter opaque."""
    c = _table(spark, sf_dir, "customer").withColumn("hex", F.lpad(F.hex((F.col("c_custkey") * 7919) % 16777216), 6, "0"))
    mods = F.array(F.struct(F.lit("shade").alias("name"), F.lit(50000.0).alias("val")), F.struct(F.lit("unknown").alias("name"), F.lit(1.0).alias("val")), F.struct(F.lit("alpha").alias("name"), F.lit(25000.0).alias("val")))
    return c.select(F.col("c_custkey").alias("customer"), colors.modified(F.col("hex"), mods).alias("m")).select("customer", F.col("m.hex").alias("shaded"), F.round("m.alpha", 6).alias("alpha"))


@_query(
    """SELECT p_partkey AS part, CASE p_size % 4 WHEN 0 THEN 'solid' WHEN 1 THEN 'dotted' ELSE 'dashed' END AS border_type, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN w || ',' || w * 2 WHEN 2 THEN w * 4 || ',' || w * 2 ELSE w * 8 || ',' || w * 3 || ',' || w || ',' || w * 3 END AS dash_array
    FROM (SELECT *, greatest(p_size, 1) AS w FROM part)"""
)
def border_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("solid", "sysDot", "dash", "lgDashDot"))), F.col("p_size") % 4 + 1)
    return part.select(F.col("p_partkey").alias("part"), text.border_type(kind).alias("border_type"), text.dash_array(kind, F.col("p_size")).alias("dash_array"))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS nation, CASE n_nationkey % 3 WHEN 0 THEN '4472C4' WHEN 1 THEN printf('%06d', n_regionkey) ELSE 'FFFFFF' END AS color FROM nation")
def scheme_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of scheme colours through a layout's override or a master's map to a theme."""
    k = F.col("n_nationkey")
    nation = _table(spark, sf_dir, "nation")
    theme = F.create_map(F.lit("accent1"), F.lit("4472C4"), F.lit("dk2"), F.format_string("%06d", "n_regionkey"), F.lit("lt1"), F.lit("FFFFFF"))
    name = F.when(k % 3 == 0, "accent1").when(k % 3 == 1, "tx2").otherwise("bg1")
    mapped = F.create_map(F.lit("tx2"), F.lit("dk2"), F.lit("bg1"), F.lit("dk1"))
    return nation.select(_whole(k).alias("nation"), colors.scheme(name, F.create_map(F.lit("bg1"), F.lit("lt1")), mapped, theme).alias("color"))


@_query(
    """SELECT p_partkey AS part, CASE p_size % 3 WHEN 0 THEN 'M0,0 L' || w || ',0 L' || w || ',' || h || ' L0,' || h || ' Z' WHEN 1 THEN 'M' || w // 2 || ',0 L' || w || ',' || h // 2 || ' L' || w // 2 || ',' || h || ' L0,' || h // 2 || ' Z'
    ELSE 'M' || w // 2 || ',0 L' || w || ',' || h || ' L0,' || h || ' Z' END AS path FROM (SELECT *, p_size * 2 AS w, (p_size + 1) * 2 AS h FROM part)"""
)
def preset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("rect", "diamond", "triangle"))), F.col("p_size") % 3 + 1)
    return part.select(F.col("p_partkey").alias("part"), outlines.preset_path(kind, F.col("p_size") * 2.0, (F.col("p_size") + 1) * 2.0).alias("path"))


@_query("SELECT p_partkey AS part, 'M0,0 L' || p_size * 2 || ',0 C' || p_size * 2 || ',' || p_size || ' ' || p_size || ',' || p_size || ' 0,' || p_size || ' Z' AS path FROM part")
def custom_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom geometry in a box twice as wide as the path's own extent."""
    part = _table(spark, sf_dir, "part")
    s = F.col("p_size")
    pt = lambda x, y: put('<a:pt x="', x, '" y="', y, '"/>')
    zero = F.lit(0)
    commands = put("<a:moveTo>", pt(zero, zero), "</a:moveTo><a:lnTo>", pt(s, zero), "</a:lnTo><a:cubicBezTo>", pt(s, s), pt(s / 2, s), pt(zero, s), "</a:cubicBezTo><a:close/>")
    geometry = put('<a:custGeom><a:pathLst><a:path w="', s, '" h="', s, '">', commands, "</a:path></a:pathLst></a:custGeom>")
    shape = builder.shape(F.col("p_partkey"), F.lit("s"), box=builder.xfrm(zero, zero, s * 2 * 12700, s * 12700), geometry=geometry)
    nodes = Deck(written(builder.decks(_one_slide(part, (F.col("p_partkey") / 200).cast("long"), shape, "p_partkey")))).nodes
    found = shapes.boxes(shapes.shapes(nodes)).filter("shape = 'sp'")
    boxes = found.select("deck_id", "part_path", F.col("nid").alias("owner"), "id", F.col("width").alias("w"), F.col("height").alias("h"))
    paths = outlines.custom_paths(nodes, boxes.drop("id"))
    return paths.join(boxes, ["deck_id", "part_path", "owner"]).select(_whole(F.col("id")).alias("part"), "path")


@_query("SELECT p_partkey AS part, round(p_size * 12700 / 914400.0 * 96, 6) AS px, CAST(p_size AS DOUBLE) AS pt, round(p_size * 1000 / 60000.0, 6) AS degrees FROM part")
def unit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.round(units.emu_to_px(s * 12700), 6).alias("px"), units.emu_to_pt(s * 12700).alias("pt"), F.round(units.angle_to_deg(s * 1000), 6).alias("degrees"))


# ---- looks


@_query(
    """SELECT CAST(n_nationkey AS BIGINT) AS nation, CASE n_nationkey % 3 WHEN 0 THEN 'fade' WHEN 1 THEN 'push' ELSE 'none' END AS type, CAST(CASE n_regionkey % 4 WHEN 0 THEN 500 WHEN 1 THEN 800 ELSE 1000 END AS BIGINT) AS duration,
    CASE WHEN n_nationkey % 3 = 1 THEN 'l' END AS direction FROM nation"""
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    speed = F.element_at(F.array(*map(F.lit, ("fast", "med", "slow", "other"))), (F.col("n_regionkey") % 4 + 1).cast("int"))
    kind = F.when(k % 3 == 0, "<p:fade/>").when(k % 3 == 1, "<p:push/><p:cut/>").otherwise("")
    each = put('<p:transition spd="', speed, '"', F.when(k % 3 == 1, ' dir="l"').otherwise(""), ">", kind, "</p:transition>")
    slides = nation.select(F.col("n_regionkey").cast("string").alias("deck_id"), k.alias("n"), k.alias("at"), builder.page("", extra=each).alias("xml"))
    found = styles.transitions(Deck(written(builder.decks(slides))).nodes)
    return found.select(_whole(F.regexp_extract("part_path", r"(\d+)\.xml$", 1)).alias("nation"), "type", _whole(F.col("duration")).alias("duration"), "direction")


@_query(
    """SELECT p_partkey AS part, CASE p_size % 3 WHEN 0 THEN 'mid' WHEN 1 THEN 'down' ELSE 'up' END AS valign, CASE p_size % 4 WHEN 0 THEN 'shape' WHEN 3 THEN NULL ELSE 'text' END AS autofit,
    CASE WHEN p_size % 4 = 1 THEN CAST(p_size AS DOUBLE) END AS font_scale, CASE p_size % 4 WHEN 0 THEN 'noFill' WHEN 1 THEN 'solidFill' ELSE 'gradFill' END AS fill FROM part"""
)
def bodies_and_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment, autofit and the fill that counts of shapes with several."""
    part, s = _table(spark, sf_dir, "part"), F.col("p_size")
    fit = F.when(s % 4 == 0, F.lit("<a:spAutoFit/><a:normAutofit/>")).when(s % 4 == 1, put('<a:normAutofit fontScale="', s * 1000, '"/>')).when(s % 4 == 2, "<a:normAutofit/>").otherwise("")
    anchor = F.when(s % 3 == 0, ' anchor="ctr"').when(s % 3 == 1, ' anchor="b"').otherwise("")
    fill = F.when(s % 4 == 0, "<a:noFill/>").when(s % 4 == 1, "<a:gradFill/><a:solidFill/>").otherwise("<a:noFill/><a:gradFill/>")
    shape = put('<p:sp><p:nvSpPr><p:cNvPr id="', F.col("p_partkey"), '" name="s"/></p:nvSpPr><p:spPr>', fill, "</p:spPr><p:txBody><a:bodyPr", anchor, ">", fit, "</a:bodyPr></p:txBody></p:sp>")
    nodes = Deck(written(builder.decks(_one_slide(part, (F.col("p_partkey") / 200).cast("long"), shape, "p_partkey")))).nodes
    keys = ["deck_id", "part_path", "owner"]
    ids = shapes.shapes(nodes).select("deck_id", "part_path", F.col("nid").alias("owner"), "id")
    met = ids.join(styles.bodies(nodes), keys).join(matrix.Styles(nodes, raw_colors(nodes)).own("spPr"), keys)
    return met.select(_whole(F.col("id")).alias("part"), styles.valign(F.col("anchor")).alias("valign"), "autofit", "font_scale", F.col("content.tag").alias("fill"))


@_query(
    """SELECT p_partkey AS part, p_size % 2 = 1 AS inset, round(CASE WHEN p_size % 2 = 1 THEN 0 ELSE p_size * cos(radians(p_size * 7)) END, 6) + 0.0 AS h, round(CASE WHEN p_size % 2 = 1 THEN 0 ELSE p_size * sin(radians(p_size * 7)) END, 6) + 0.0 AS v, CAST(4 AS DOUBLE) AS blur FROM part"""
)
def shadow_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadows from direction and distance."""
    part, s = _table(spark, sf_dir, "part"), F.col("p_size")
    tag = F.when(s % 2 == 1, "innerShdw").otherwise("outerShdw")
    effect = put("<a:effectLst><a:", tag, ' dir="', s * 7 * 60000, '" dist="', s * 12700, '" blurRad="50800"/></a:effectLst>')
    shape = builder.shape(F.col("p_partkey"), F.lit("s"), geometry=effect)
    deck = Deck(written(builder.decks(_one_slide(part, (F.col("p_partkey") / 200).cast("long"), shape, "p_partkey"))))
    ids = shapes.shapes(deck.nodes).select("deck_id", "part_path", "nid", "id")
    met = ids.join(_looks(deck).select("deck_id", "part_path", "nid", "shadow.*"), ["deck_id", "part_path", "nid"])
    return met.select(_whole(F.col("id")).alias("part"), "inset", (F.round("h", 6) + 0.0).alias("h"), (F.round("v", 6) + 0.0).alias("v"), "blur")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS nation, CASE n_nationkey % 3 WHEN 0 THEN '#808080' WHEN 1 THEN '#112233' ELSE '#ffffff' END AS fill FROM nation")
def background_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backgrounds: a slide's own (half of it let through), its layout's, or white."""
    nation, k = _table(spark, sf_dir, "nation"), F.col("n_nationkey")
    deck = F.col("n_regionkey").cast("string").alias("deck_id")
    bg = lambda c: f'<p:bg><p:bgPr><a:solidFill>{c}</a:solidFill></p:bgPr></p:bg>'
    page = lambda inner, kind="sld": put(f'<p:{kind} xmlns:p="urn:p" xmlns:a="urn:a"><p:cSld>', inner, f"</p:cSld></p:{kind}>")
    own = F.when(k % 3 == 0, bg('<a:srgbClr val="000000"><a:alpha val="50000"/></a:srgbClr>')).otherwise("")
    slides = nation.select(deck, k.alias("n"), k.alias("at"), page(own).alias("xml"))
    layouts = nation.select(deck).distinct().select("deck_id", F.lit("ppt/slideLayouts/slideLayout1.xml").alias("part_path"), page(bg('<a:srgbClr val="112233"/>'), "sldLayout").alias("content"))
    rels = nation.filter(k % 3 != 2).select(deck, put("ppt/slides/_rels/slide", k, ".xml.rels").alias("part_path"), builder.relationships(builder.relationship("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")).alias("content"))
    made = Deck(written(builder.decks(slides, layouts.unionByName(rels))))
    colors_ = Colors(made)
    found = matrix.backgrounds(package.chain(made.slides(), made.rels), colors_.styles, colors_.palette, made.rels, made.parts.filter("kind = 'media'"))
    return found.select(_whole(F.regexp_extract("slide_part", r"(\d+)\.xml$", 1)).alias("nation"), F.col("background.color").alias("fill"))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS nation, CASE n_nationkey % 3 WHEN 0 THEN '#slide-' || n_nationkey WHEN 1 THEN 'https://example.org/' || n_nationkey END AS link FROM nation")
def shape_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of shapes: jumps to slides, safe addresses outside, and none."""
    nation, k = _table(spark, sf_dir, "nation"), F.col("n_nationkey")
    deck = F.col("n_regionkey").cast("string").alias("deck_id")
    action = F.when(k % 3 == 0, ' action="ppaction://hlinksldjump"').otherwise("")
    shape = put('<p:sp><p:nvSpPr><p:cNvPr id="', k, '" name="s"><a:hlinkClick r:id="rId1"', action, "/></p:cNvPr></p:nvSpPr><p:spPr/></p:sp>")
    slides = nation.select(deck, k.alias("n"), k.alias("at"), builder.page(shape).alias("xml"))
    link = F.when(k % 3 == 0, builder.relationship("rId1", "slide", put("slide", k, ".xml"))).when(k % 3 == 1, builder.relationship("rId1", "hyperlink", put("https://example.org/", k), "External")).otherwise(builder.relationship("rId1", "hyperlink", "javascript:x", "External"))
    rels = nation.select(deck, put("ppt/slides/_rels/slide", k, ".xml.rels").alias("part_path"), builder.relationships(link).alias("content"))
    made = Deck(written(builder.decks(slides, rels)))
    found = styles.links(shapes.shapes(made.nodes), made.rels)
    return found.select(_whole(F.col("id")).alias("nation"), "link")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS nation FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0")
def decorations_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of a master that show: no placeholders, none without extent."""
    nation, k = _table(spark, sf_dir, "nation"), F.col("n_nationkey")
    ph = F.when(k % 2 == 1, '<p:ph type="body"/>').otherwise("")
    size = F.when(k % 3 == 0, 0).otherwise(12700)
    shape = builder.shape(k, F.col("n_name"), box=builder.xfrm(F.lit(0), F.lit(0), size, F.lit(0)), ph=ph)
    body = builder.gathered(nation.select(F.col("n_regionkey").cast("string").alias("deck_id"), "n_nationkey", shape.alias("xml")), ["deck_id"], "n_nationkey", "xml")
    files = body.select("deck_id", F.lit("ppt/slideMasters/slideMaster1.xml").alias("part_path"), builder.page(F.col("xml"), "sldMaster").alias("content"))
    return styles.decorations(shapes.shapes(Deck(written(archive.pack(files))).nodes)).select(_whole(F.col("id")).alias("nation"))


@_query(
    """SELECT p_partkey AS part, CASE WHEN p_size % 5 = 0 THEN '#' || lpad(CAST(p_size AS VARCHAR), 6, '0') ELSE list_extract(['#a', '#b', '#c', '#d', '#e', '#f'], CAST(p_partkey % 6 + 1 AS INTEGER)) END AS color FROM part"""
)
def series_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of series: their own, or accents in turn."""
    part, s = _table(spark, sf_dir, "part"), F.col("p_size")
    own = F.when(s % 5 == 0, F.concat(F.lit("#"), F.lpad(s.cast("string"), 6, "0")))
    accents = F.array(*(F.lit(f"#{c}") for c in "abcdef"))
    return part.select(F.col("p_partkey").alias("part"), styles.series_color(own, F.col("p_partkey"), accents).alias("color"))


@_query(
    """SELECT p_partkey AS part, CASE WHEN box OR ph = 'title' THEN TRUE WHEN custom THEN FALSE WHEN (prst IS NOT NULL AND prst <> 'rect') OR ph IS NULL THEN
    CASE WHEN prst IS NOT NULL AND NOT txt AND painted THEN FALSE WHEN prst IS NOT NULL AND prst <> 'rect' THEN FALSE WHEN prst IS NULL AND NOT txt THEN FALSE WHEN prst IS NOT NULL AND painted THEN FALSE ELSE TRUE END ELSE TRUE END AS is_text
    FROM (SELECT p_partkey, p_partkey % 7 = 0 AS box, CASE p_partkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'pic' END AS ph, p_partkey % 11 = 0 AS custom, CASE p_partkey % 4 WHEN 0 THEN 'rect' WHEN 1 THEN 'star5' END AS prst, p_partkey % 2 = 0 AS txt, p_partkey % 5 < 2 AS painted FROM part)"""
)
def shape_or_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is given out as a text and what as a shape."""
    part, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    ph = F.when(k % 3 == 0, "title").when(k % 3 == 1, "pic")
    prst = F.when(k % 4 == 0, "rect").when(k % 4 == 1, "star5")
    return part.select(k.alias("part"), styles.is_text(k % 7 == 0, ph, k % 11 == 0, prst, k % 2 == 0, k % 5 < 2).alias("is_text"))


@_query("SELECT CAST(s_nationkey AS BIGINT) AS nation, CAST(count(*) AS BIGINT) AS uses, CAST(count(DISTINCT s_suppkey % 3) AS BIGINT) AS media FROM supplier GROUP BY s_nationkey")
def media_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a deck and the media they share, by relationships."""
    s, k = _table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    pic = put('<p:pic><p:nvPicPr><p:cNvPr id="', k, '" name="p"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId', k, '"/></p:blipFill></p:pic>')
    deck = F.col("s_nationkey").cast("string").alias("deck_id")
    slides = _one_slide(s, F.col("s_nationkey"), pic, "s_suppkey")
    link = builder.relationship(put("rId", k), "image", put("../media/m", k % 3, ".png"))
    rels = builder.gathered(s.select(deck, "s_suppkey", link.alias("xml")), ["deck_id"], "s_suppkey", "xml").select("deck_id", F.lit("ppt/slides/_rels/slide1.xml.rels").alias("part_path"), builder.relationships(F.col("xml")).alias("content"))
    files = s.select(deck, put("ppt/media/m", k % 3, ".png").alias("part_path"), F.lit("image").alias("content")).distinct()
    made = Deck(written(builder.decks(slides, rels.unionByName(files))))
    pics = shapes.shapes(made.nodes).filter("shape = 'pic'").join(made.rels.withColumnRenamed("source_part", "part_path"), ["deck_id", "part_path", "rid"])
    media = made.parts.filter("kind = 'media'").select("deck_id", F.col("part_path").alias("resolved"))
    met = pics.join(media, ["deck_id", "resolved"])
    return met.groupBy(_whole(F.col("deck_id")).alias("nation")).agg(F.count("*").alias("uses"), F.count_distinct("resolved").alias("media"))


@_query(
    """SELECT p_partkey AS part, CAST(coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, CASE WHEN p_size % 3 = 0 THEN 30 END, CASE WHEN p_size % 5 = 0 THEN 50 END, 18) AS DOUBLE) AS size FROM part"""
)
def font_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's size, or that of the nearest level that has one: layout, master, and the default."""
    part, s = _table(spark, sf_dir, "part"), F.col("p_size")
    run = builder.run(F.col("p_partkey"), F.when(s % 2 == 0, put('sz="', s * 100, '"')).otherwise(""))
    shape = builder.shape(F.col("p_partkey"), F.lit("s"), body=builder.paragraph(run))
    nodes = Deck(written(builder.decks(_one_slide(part, (F.col("p_partkey") / 200).cast("long"), shape, "p_partkey")))).nodes
    levels = part.select(F.col("p_partkey").cast("string").alias("text"), F.when(s % 3 == 0, 3000.0).alias("layout"), F.when(s % 5 == 0, 5000.0).alias("master"))
    met = shapes.runs(nodes).join(levels, "text")
    return met.select(_whole(F.col("text")).alias("part"), units.hundredth_pt_to_pt(F.coalesce("size", "layout", "master", F.lit(1800.0))).alias("size"))


@_query(
    """SELECT p_partkey AS part, CASE p_size % 3 WHEN 2 THEN 'radial' ELSE 'linear' END AS type, CAST(CASE p_size % 3 WHEN 0 THEN p_size ELSE 0 END AS DOUBLE) AS angle, CAST(CASE p_size % 3 WHEN 2 THEN 0.25 END AS DOUBLE) AS cx,
    '0:#000001,' || CASE WHEN p_size % 2 = 0 THEN '50' ELSE '25' END || ':#00ff00,100:#ff000080' AS stops FROM part"""
)
def gradient_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients with stops out of order, along a line or around a point."""
    part, s = _table(spark, sf_dir, "part"), F.col("p_size")
    gs = lambda pos, c: put('<a:gs pos="', pos, f'">{c}</a:gs>')
    stops = put(gs(F.lit(100000), '<a:srgbClr val="ff0000"><a:alpha val="50000"/></a:srgbClr>'), gs(F.lit(0), '<a:srgbClr val="000001"/>'), gs(F.when(s % 2 == 0, 50000).otherwise(25000), '<a:srgbClr val="00ff00"/>'))
    way = F.when(s % 3 == 0, put('<a:lin ang="', s * 60000, '"/>')).when(s % 3 == 2, F.lit('<a:path path="circle"><a:fillToRect l="0" r="50000" t="50000" b="50000"/></a:path>')).otherwise("")
    shape = builder.shape(F.col("p_partkey"), F.lit("s"), geometry=put("<a:gradFill><a:gsLst>", stops, "</a:gsLst>", way, "</a:gradFill>"))
    deck = Deck(written(builder.decks(_one_slide(part, (F.col("p_partkey") / 200).cast("long"), shape, "p_partkey"))))
    ids = shapes.shapes(deck.nodes).select("deck_id", "part_path", "nid", "id")
    met = ids.join(_looks(deck).select("deck_id", "part_path", "nid", F.col("own_fill").alias("fill")), ["deck_id", "part_path", "nid"])
    shown = F.array_join(F.transform("fill.stops", lambda x: F.concat(units.js_number(x["pos"]), F.lit(":"), x["color"])), ",")
    return met.select(_whole(F.col("id")).alias("part"), F.when(F.col("fill.path") == "line", "linear").otherwise("radial").alias("type"), F.col("fill.rot").alias("angle"), F.col("fill.cx").alias("cx"), shown.alias("stops"))


@_query(
    f"""SELECT CAST(s_nationkey AS BIGINT) AS nation, row, c.col AS col, 'wholeTbl' || CASE WHEN row = 0 THEN '' WHEN row % 2 = 0 THEN ',band2H' ELSE ',band1H' END || CASE WHEN row = 0 THEN ',firstRow' ELSE '' END || CASE WHEN c.col = 1 THEN ',lastCol' ELSE '' END AS sections
    FROM ({_ROWS}), (VALUES (0), (1)) c(col)"""
)
def table_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a style that hold for each cell: the first row apart, bands of rows, the last column; the style has no last row."""
    sup = _table(spark, sf_dir, "supplier")
    cell = lambda v: put("<a:tc><a:txBody>", builder.paragraph(builder.run(v)), "</a:txBody></a:tc>")
    row = put('<a:tr h="0">', cell(F.col("s_suppkey")), cell(F.col("s_name")), "</a:tr>")
    rows = builder.gathered(sup.select("s_nationkey", "s_suppkey", row.alias("xml")), ["s_nationkey"], "s_suppkey", "xml")
    table = put('<a:tbl><a:tblPr firstRow="1" bandRow="1" lastRow="1" lastCol="true"><a:tableStyleId>{S}</a:tableStyleId></a:tblPr>', F.col("xml"), "</a:tbl>")
    deck = F.col("s_nationkey").cast("string").alias("deck_id")
    slides = rows.select(deck, F.lit(1).alias("n"), F.lit(1).alias("at"), builder.page(builder.frame(F.lit(1), table, "table")).alias("xml"))
    sections = "".join(f"<a:{x}/>" for x in ("wholeTbl", "band1H", "band2H", "firstRow", "lastCol", "band1V"))
    style = rows.select(deck, F.lit("ppt/tableStyles.xml").alias("part_path"), F.lit(f'<a:tblStyleLst xmlns:a="urn:a"><a:tblStyle styleId="{{S}}">{sections}</a:tblStyle></a:tblStyleLst>').alias("content"))
    nodes = Deck(written(builder.decks(slides, style))).nodes
    cells = frames.cells(nodes).withColumns({"rows": F.max("row").over(Window.partitionBy("deck_id", "part_path", "frame")) + 1, "cols": F.max("col").over(Window.partitionBy("deck_id", "part_path", "frame")) + 1})
    met = cells.join(frames.table_flags(nodes), ["deck_id", "part_path", "frame"]).join(frames.table_styles(nodes), ["deck_id", "style_id"])
    flags = {c: F.col(c) for c in ("bandRow", "bandCol", "firstRow", "lastRow", "firstCol", "lastCol")}
    found = frames.style_sections(F.col("row"), F.col("col"), F.col("rows"), F.col("cols"), flags, F.col("sections"))
    return met.select(_whole(F.col("deck_id")).alias("nation"), _whole(F.col("row")).alias("row"), F.col("col").cast("int").alias("col"), F.array_join(found, ",").alias("sections"))


# ---- levels, looks and media of whole slides


def _chained(spark: SparkSession, sf_dir: str, shape: Column, master: str, layout: str, theme: str, on_master: str = "") -> Deck:
    """Decks of parts, two hundred to a slide, each with one layout, one master and one theme; what documents need is at hand."""
    part = _table(spark, sf_dir, "part")
    slides = _one_slide(part, (F.col("p_partkey") / 200).cast("long"), shape, "p_partkey")
    only = slides.select("deck_id")
    link = lambda kind, target: builder.relationships(builder.relationship("rId1", kind, target))
    files = {
        "ppt/slides/_rels/slide1.xml.rels": link("slideLayout", "../slideLayouts/slideLayout1.xml"), "ppt/slideLayouts/slideLayout1.xml": builder.page(F.lit(layout), "sldLayout"),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": link("slideMaster", "../slideMasters/slideMaster1.xml"), "ppt/slideMasters/slideMaster1.xml": builder.page(F.lit(on_master), "sldMaster", F.lit(master)),
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": link("theme", "../theme/theme1.xml"), "ppt/theme/theme1.xml": F.lit(f'<a:theme xmlns:a="urn:a"><a:themeElements>{theme}</a:themeElements></a:theme>'),
    }
    more = only.select("deck_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, files)), F.array(*files.values()))).alias("part_path", "content"))
    deck = Deck(written(builder.decks(slides, more)))
    deck.parts = cut(deck.parts.drop("content"))
    deck.rels = cut(package.relationships(deck.nodes))
    return deck


@_query(
    """SELECT p_partkey AS part, '<div style="padding: 3.6pt 7.2pt 3.6pt 7.2pt;"><p' || CASE WHEN p_size % 3 = 0 THEN ' style="text-align: right;"' ELSE '' END || '><span style="font-size: ' ||
    CASE WHEN p_size % 2 = 0 THEN p_size WHEN p_size % 3 = 0 THEN 30 ELSE 11 END || 'pt;' || CASE WHEN p_size % 3 = 0 THEN 'font-weight: bold;' ELSE '' END || 'color: ' || CASE WHEN p_size % 3 = 0 THEN '#4472C4' ELSE '#000000' END ||
    ';font-family: Text;">' || p_partkey || '</span></p></div>' AS content FROM part"""
)
def text_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with sizes from the run, the layout's placeholder or the master, and what else the master says of bodies."""
    s = F.col("p_size")
    body = builder.paragraph(builder.run(F.col("p_partkey"), F.when(s % 2 == 0, put('sz="', s * 100, '"')).otherwise("")))
    shape = builder.shape(F.col("p_partkey"), F.lit("s"), body=body, ph=F.when(s % 3 == 0, '<p:ph type="body" idx="7"/>').otherwise(""))
    master = '<p:clrMap tx2="accent1"/><p:txStyles><p:bodyStyle><a:lvl1pPr algn="r"><a:defRPr sz="2000" b="1"><a:solidFill><a:schemeClr val="tx2"/></a:solidFill></a:defRPr></a:lvl1pPr></p:bodyStyle><p:otherStyle><a:defPPr><a:defRPr sz="1100"/></a:defPPr></p:otherStyle></p:txStyles>'
    layout = '<p:sp><p:nvSpPr><p:cNvPr id="2" name="b"/><p:nvPr><p:ph type="body" idx="7"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:lstStyle><a:lvl1pPr><a:defRPr sz="3000"/></a:lvl1pPr></a:lstStyle><a:p/></p:txBody></p:sp>'
    theme = '<a:clrScheme><a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme><a:fontScheme><a:minorFont><a:latin typeface="Text"/></a:minorFont></a:fontScheme>'
    deck = _chained(spark, sf_dir, shape, master, layout, theme)
    found = elements(deck, cut(package.chain(deck.slides(), deck.rels))).filter(F.col("part_path").startswith("ppt/slides/"))
    ids = shapes.shapes(deck.nodes).select("deck_id", "part_path", "nid", "id")
    return found.join(ids, ["deck_id", "part_path", "nid"]).select(_whole(F.col("id")).alias("part"), F.col("element.content").alias("content"))


@_query(
    """WITH p AS (SELECT p_partkey, p_size, p_size % 6 AS k, p_size % 4 AS o, CAST(CASE WHEN p_size % 4 = 1 THEN CAST(p_size * 127 AS DOUBLE) ELSE 12700::DOUBLE END / 914400 * 96 AS VARCHAR) || 'px' AS w, 'linear-gradient(' || (p_size + 90) % 360 || '.0deg, #112233 0.0%, rgba(68,114,196,0.500) ' || p_size || '.0%)' AS g,
    '-webkit-text-stroke-width: ' AS sw, ';-webkit-text-stroke-color: ' AS sc, ';paint-order: stroke fill;' AS po FROM part)
    SELECT p_partkey AS part, '<div style="padding: 3.6pt 7.2pt 3.6pt 7.2pt;"><p><span style="font-size: 12pt;color: ' || CASE k WHEN 3 THEN '#ABCDEF' ELSE '#000000' END || ';' || CASE WHEN k IN (1, 4) THEN 'background: ' || g || ';-webkit-background-clip: text;background-clip: text;color: transparent;' ELSE '' END ||
    CASE WHEN k = 2 THEN 'color: transparent;' ELSE '' END || CASE WHEN o = 2 AND k = 2 THEN sw || '0.75px' || sc || '#ffffff' || po || 'mask-image: ' || replace(g, '#112233', '#4472C4') || ';-webkit-mask-image: ' || replace(g, '#112233', '#4472C4') || ';'
    WHEN o = 1 THEN sw || w || sc || '#FF0000' || po ELSE sw || CASE WHEN o = 2 THEN '0.75px' ELSE w END || sc || '#00AA00' || po END || 'font-family: Text;">' || p_partkey || '</span></p></div>' AS content FROM p"""
)
def text_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with gradients, with outlines of their own, of the master or fading ones, and texts that show nothing but these."""
    s, k, o = F.col("p_size"), F.col("p_size") % 6, F.col("p_size") % 4
    gradient = lambda first: put('<a:gradFill><a:gsLst><a:gs pos="', s * 1000, '"><a:schemeClr val="accent1"><a:alpha val="50000"/></a:schemeClr></a:gs><a:gs pos="0">', first, '</a:gs></a:gsLst><a:lin ang="', s * 60000, '"/></a:gradFill>')
    scheme = F.lit('<a:schemeClr val="accent1"/>')
    srgb = lambda c: F.lit(f'<a:srgbClr val="{c}"/>')
    fill = F.when(k.isin(1, 4), gradient(srgb("112233"))).when(k == 2, "<a:noFill/>").when(k == 3, put("<a:solidFill>", srgb("ABCDEF"), "</a:solidFill>"))
    line = F.when(o == 1, put('<a:ln w="', s * 127, '"><a:solidFill>', srgb("FF0000"), "</a:solidFill></a:ln>")).when(o == 2, put("<a:ln>", gradient(scheme), "</a:ln>")).when(o == 3, F.lit('<a:ln w="1"><a:noFill/></a:ln>'))
    body = put("<a:p><a:r><a:rPr>", line, fill, "</a:rPr><a:t>", F.col("p_partkey"), "</a:t></a:r></a:p>")
    master = '<p:txStyles><p:otherStyle><a:lvl1pPr><a:defRPr><a:ln w="12700"><a:solidFill><a:srgbClr val="00AA00"/></a:solidFill></a:ln></a:defRPr></a:lvl1pPr></p:otherStyle></p:txStyles>'
    theme = '<a:clrScheme><a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme><a:fontScheme><a:minorFont><a:latin typeface="Text"/></a:minorFont></a:fontScheme>'
    deck = _chained(spark, sf_dir, builder.shape(F.col("p_partkey"), F.lit("s"), body=body), master, "", theme)
    nodes, keys = deck.nodes, ["deck_id", "part_path"]
    palette = cut(palettes(nodes, deck.rels))
    paint = cut(painted(raw_colors(nodes), palette))
    found = cut(shapes.shapes(nodes))
    chain = package.chain(deck.slides(), deck.rels).select("deck_id", F.col("slide_part").alias("part_path"), "layout_part", "master_part").distinct()
    none = {c: F.lit(None).cast(t) for c, t in (("l_ph", "int"), ("m_ph", "int"), ("font_color", "string"), ("font_bold", "boolean"))}
    bodies = found.join(chain, keys).select(*keys, "nid", "ph", "ph_type", "layout_part", "master_part").withColumns(none)
    made = textbody.html(bodies, nodes, paint, deck.rels, palette)
    return found.join(made, [*keys, "nid"]).select(_whole(F.col("id")).alias("part"), F.col("html").alias("content"))


@_query(
    """SELECT p_partkey AS part, CASE p_size % 5 WHEN 2 THEN 'pattern' WHEN 3 THEN 'gradient' ELSE 'color' END AS type, CASE p_size % 5 WHEN 0 THEN '#FF6347' WHEN 1 THEN '#4472C4' WHEN 4 THEN 'transparent' END AS color,
    CASE WHEN p_size % 5 = 2 THEN 'pct50/#112233/#ffffff' END AS pattern, CASE p_size % 3 WHEN 0 THEN '#00ff00' WHEN 1 THEN '#4472C4' ELSE '#000000' END AS border, CAST(CASE p_size % 3 WHEN 0 THEN p_size WHEN 1 THEN 1.5 ELSE 0 END AS DOUBLE) AS width,
    CASE p_size % 3 WHEN 1 THEN 'dotted' ELSE 'solid' END AS border_type FROM part"""
)
def fills_and_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills by named colours, schemes, patterns and gradients; borders of a shape's own or the theme's line, or none."""
    s = F.col("p_size")
    fill = (
        F.when(s % 5 == 0, '<a:solidFill><a:prstClr val="tomato"/></a:solidFill>').when(s % 5 == 1, '<a:solidFill><a:schemeClr val="accent1"/></a:solidFill>').when(s % 5 == 2, '<a:pattFill prst="pct50"><a:fgClr><a:srgbClr val="112233"/></a:fgClr></a:pattFill>')
        .when(s % 5 == 3, '<a:gradFill><a:gsLst><a:gs pos="0"><a:srgbClr val="000000"/></a:gs></a:gsLst></a:gradFill>').otherwise("<a:noFill/>")
    )
    line = F.when(s % 3 == 0, put('<a:ln w="', s * 12700, '"><a:solidFill><a:scrgbClr r="0" g="100000" b="0"/></a:solidFill></a:ln>')).when(s % 3 == 2, "<a:ln><a:noFill/></a:ln>").otherwise("")
    style = F.when(s % 3 == 1, '<p:style><a:lnRef idx="2"><a:schemeClr val="accent1"/></a:lnRef></p:style>').otherwise("")
    shape = put('<p:sp><p:nvSpPr><p:cNvPr id="', F.col("p_partkey"), '" name="s"/></p:nvSpPr><p:spPr>', fill, line, "</p:spPr>", style, "</p:sp>")
    theme = '<a:clrScheme><a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme><a:fmtScheme><a:lnStyleLst><a:ln w="6350"/><a:ln w="19050"><a:prstDash val="sysDot"/></a:ln></a:lnStyleLst></a:fmtScheme>'
    deck = _chained(spark, sf_dir, shape, "", "", theme)
    keys = ["deck_id", "part_path", "nid"]
    ids = shapes.shapes(deck.nodes).select(*keys, "id")
    met = ids.join(_looks(deck).withColumn("b", looks.border(F.col("line"))).withColumn("fill", F.coalesce("own_fill", "theme_fill")), keys, "left")
    pattern = F.when(F.col("fill.pattern").isNotNull(), F.concat_ws("/", "fill.pattern", "fill.fore", "fill.back"))
    return met.select(_whole(F.col("id")).alias("part"), F.col("fill.type").alias("type"), F.col("fill.color").alias("color"), pattern.alias("pattern"), F.coalesce("b.color", F.lit("#000000")).alias("border"), F.coalesce("b.width", F.lit(0.0)).alias("width"), F.coalesce("b.type", F.lit("solid")).alias("border_type"))


#: Colours of c (key, v) half way to black in linear light, as s (key, shaded).
_SHADED = """k AS (SELECT key, i, ((v >> (16 - 8 * i)) & 255) / 255.0 AS s FROM c, (VALUES (0), (1), (2)) t(i)),
    l AS (SELECT key, i, 0.5 * CASE WHEN s <= 0.04045 THEN s / 12.92 ELSE pow((s + 0.055) / 1.055, 2.4) END AS x FROM k),
    o AS (SELECT key, i, CAST(floor(255 * CASE WHEN x <= 0.0031308 THEN x * 12.92 ELSE 1.055 * pow(x, 1 / 2.4) - 0.055 END + 0.5) AS BIGINT) AS b FROM l),
    s AS (SELECT key, '#' || string_agg(printf('%02x', b), '' ORDER BY i) AS shaded FROM o GROUP BY key)"""


@_query(
    f"""WITH c AS (SELECT p_partkey AS key, p_size AS z, (p_partkey * 7919) % 16777216 AS v, '#' || printf('%06X', CAST((p_partkey * 7919) % 16777216 AS BIGINT)) AS hex FROM part), {_SHADED}
    SELECT key AS part, CASE WHEN z % 6 = 3 THEN 'gradient' ELSE 'color' END AS type, CASE z % 6 WHEN 1 THEN shaded WHEN 2 THEN '#102030' WHEN 3 THEN NULL WHEN 4 THEN 'transparent' ELSE hex END AS color,
    CASE WHEN z % 6 = 3 THEN '0:' || hex || ',100:' || lower(hex) || '80' END AS stops,
    CASE WHEN key % 5 = 4 THEN '#00FF00' ELSE CASE key % 4 WHEN 1 THEN shaded WHEN 2 THEN '#123456' WHEN 3 THEN '#00FF00' ELSE '#000000' END END AS border,
    CAST(CASE WHEN key % 5 = 4 THEN CASE key % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 WHEN 2 THEN 1.5 ELSE 3 END ELSE CASE key % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 1.5 WHEN 3 THEN 3 ELSE 0 END END AS DOUBLE) AS width,
    CASE WHEN key % 4 = 2 THEN 'dotted' ELSE 'solid' END AS border_type, CASE WHEN z % 2 = 1 THEN 'rgba(16,32,48,0.400)' END AS shadow FROM c JOIN s USING (key)"""
)
def theme_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills, lines and shadows by reference to a theme: entries with the reference's colour, changed or not, with a colour of their own, gradients, a pattern, and places beyond the list.

    Lines said not to be there take the theme's as a whole; a line of its own without a width takes the theme's width.
    """
    k, z = F.col("p_partkey"), F.col("p_size")
    color = put('<a:srgbClr val="', F.lpad(F.hex((k * 7919) % 16777216), 6, "0"), '"/>')
    ref = lambda tag, idx: put(f'<a:{tag} idx="', idx, '">', color, f"</a:{tag}>")
    own = F.when(k % 5 == 4, '<a:ln><a:solidFill><a:srgbClr val="00FF00"/></a:solidFill></a:ln>').when(k % 3 == 0, '<a:ln w="127000"><a:noFill/></a:ln>').otherwise("")
    shape = put('<p:sp><p:nvSpPr><p:cNvPr id="', k, '" name="s"/></p:nvSpPr><p:spPr>', own, "</p:spPr><p:style>", ref("lnRef", k % 4), ref("fillRef", z % 6), ref("effectRef", z % 2 + 1), "</p:style></p:sp>")
    ph = lambda inner="": f'<a:schemeClr val="phClr">{inner}</a:schemeClr>'
    solid = lambda c: f"<a:solidFill>{c}</a:solidFill>"
    fills = solid(ph('<a:shade val="50000"/>')) + solid('<a:srgbClr val="102030"/>') + f'<a:gradFill><a:gsLst><a:gs pos="100000">{ph("<a:alpha val=" + chr(34) + "50000" + chr(34) + "/>")}</a:gs><a:gs pos="0">{ph()}</a:gs></a:gsLst></a:gradFill><a:pattFill prst="pct50"/>'
    lines = f'<a:ln w="6350">{solid(ph("<a:shade val=" + chr(34) + "50000" + chr(34) + "/>"))}</a:ln><a:ln w="19050">{solid("<a:srgbClr val=" + chr(34) + "123456" + chr(34) + "/>")}<a:prstDash val="sysDot"/></a:ln><a:ln w="38100"><a:gradFill><a:gsLst><a:gs pos="0"><a:srgbClr val="ffffff"/></a:gs><a:gs pos="100000"><a:srgbClr val="00FF00"/></a:gs></a:gsLst></a:gradFill></a:ln>'
    effects = '<a:effectStyle><a:effectLst/></a:effectStyle><a:effectStyle><a:effectLst><a:outerShdw dist="12700"><a:srgbClr val="102030"><a:alpha val="40000"/></a:srgbClr></a:outerShdw></a:effectLst></a:effectStyle>'
    deck = _chained(spark, sf_dir, shape, "", "", f"<a:fmtScheme><a:fillStyleLst>{fills}</a:fillStyleLst><a:lnStyleLst>{lines}</a:lnStyleLst><a:effectStyleLst>{effects}</a:effectStyleLst></a:fmtScheme>")
    met = shapes.shapes(deck.nodes).join(_looks(deck), ["deck_id", "part_path", "nid"]).withColumn("b", looks.border(F.col("line")))
    stops = F.array_join(F.transform("theme_fill.stops", lambda x: F.concat(units.js_number(x["pos"]), F.lit(":"), x["color"])), ",")
    return met.select(_whole(F.col("id")).alias("part"), F.col("theme_fill.type").alias("type"), F.col("theme_fill.color").alias("color"), stops.alias("stops"), F.col("b.color").alias("border"), F.col("b.width").alias("width"), F.col("b.type").alias("border_type"), F.col("shadow.color").alias("shadow"))


@_query(
    """WITH d AS (SELECT p_partkey, p_size, p_partkey // 50 AS deck FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY deck ORDER BY p_partkey) - 1 AS r, count(*) OVER (PARTITION BY deck) AS n FROM d),
    c AS (SELECT *, CASE WHEN c = 1 AND p_size % 5 = 0 THEN '#0000FF' WHEN c = 2 THEN 'rgba(68,114,196,0.500)' WHEN r = 0 THEN '#EEEEEE' WHEN r % 2 = 1 THEN '#AAAAAA' ELSE '#DDDDDD' END AS fill FROM r, (VALUES (0), (1), (2)) t(c))
    SELECT p_partkey AS part, c AS col, fill, CASE WHEN r = 0 THEN '#FFFFFF' ELSE '#000001' END AS font_color, r = 0 AS font_bold, CASE WHEN c = 2 THEN 'mid' END AS valign,
    CASE WHEN r > 0 THEN '#111111/1.0/solid' ELSE '#222222/2.0/solid' END AS "top", CASE WHEN c = 0 AND p_size % 7 = 0 THEN '' WHEN r = 0 THEN '#333333/3.0/solid' WHEN r < n - 1 THEN '#111111/1.0/solid' ELSE '' END AS bottom,
    CASE WHEN c = 2 AND p_size % 3 = 0 THEN '#00FF00/0.5/dashed' WHEN c > 0 THEN '#4472C4/1.5/solid' ELSE '' END AS "left", CASE WHEN c < 2 THEN '#4472C4/1.5/solid' ELSE '' END AS "right", CASE WHEN r = 0 THEN '#222222/2.0/solid' END AS table_top FROM c"""
)
def table_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills, borders and text of cells by their table's style: inner and outer borders, a reference to a theme's line, an explicit none over a fill, the table's background, and what cells say themselves."""
    k, z = F.col("p_partkey"), F.col("p_size")
    srgb = lambda c: f'<a:srgbClr val="{c}"/>'
    solid = lambda c: f"<a:solidFill>{c}</a:solidFill>"
    line = lambda tag, w, inner: f'<a:{tag} w="{w}">{inner}</a:{tag}>'
    own = {0: F.when(z % 7 == 0, line("lnB", 1, "<a:noFill/>")), 1: F.when(z % 5 == 0, solid(srgb("0000FF"))), 2: F.when(z % 3 == 0, line("lnL", 6350, solid(srgb("00FF00")) + '<a:prstDash val="dash"/>'))}
    cell = lambda c: put("<a:tc><a:txBody><a:p/></a:txBody><a:tcPr", ' anchor="ctr"' if c == 2 else "", ">", own[c], "</a:tcPr></a:tc>")
    part = _table(spark, sf_dir, "part")
    rows = part.select((k / 50).cast("long").cast("string").alias("deck_id"), "p_partkey", put('<a:tr h="12700">', *map(cell, range(3)), "</a:tr>").alias("xml"))
    rows = builder.gathered(rows, ["deck_id"], "p_partkey", "xml")
    grid = "<a:tblGrid>" + '<a:gridCol w="12700"/>' * 3 + "</a:tblGrid>"
    table = put('<a:tbl><a:tblPr firstRow="1" bandRow="1" lastCol="true"><a:tableStyleId>{S}</a:tableStyleId></a:tblPr>', grid, F.col("xml"), "</a:tbl>")
    slides = rows.select("deck_id", F.lit(1).alias("n"), F.lit(1).alias("at"), builder.page(builder.frame(F.lit(1), table, "table")).alias("xml"))
    side = lambda name, inner: f"<a:{name}>{inner}</a:{name}>"
    section = lambda name, text="", fill="", borders="": f"<a:{name}>{text}<a:tcStyle><a:tcBdr>{borders}</a:tcBdr>{fill}</a:tcStyle></a:{name}>"
    filled = lambda inner: f"<a:fill>{inner}</a:fill>"
    borders = side("left", line("ln", 12700, "<a:noFill/>")) + side("top", line("ln", 25400, solid(srgb("222222")))) + side("insideH", line("ln", 12700, solid(srgb("111111")))) + side("insideV", '<a:lnRef idx="1"><a:schemeClr val="accent1"/></a:lnRef>')
    style = '<a:tblStyleLst xmlns:a="urn:a"><a:tblStyle styleId="{T}"><a:wholeTbl/></a:tblStyle><a:tblStyle styleId="{S}"><a:tblBg>' + solid(srgb("EEEEEE")) + "</a:tblBg>"
    style += section("wholeTbl", f'<a:tcTxStyle b="off"><a:fontRef idx="minor"/>{srgb("000001")}</a:tcTxStyle>', filled(solid(srgb("DDDDDD"))), borders) + section("band1H", fill=filled(solid(srgb("AAAAAA")))) + "<a:band2H/>"
    style += section("lastCol", fill=filled('<a:fillRef idx="1"><a:schemeClr val="accent1"><a:alpha val="50000"/></a:schemeClr></a:fillRef>'))
    style += section("firstRow", f'<a:tcTxStyle b="on">{solid(srgb("FFFFFF"))}</a:tcTxStyle>', filled("<a:noFill/>"), side("bottom", line("ln", 38100, solid(srgb("333333"))))) + "</a:tblStyle></a:tblStyleLst>"
    theme = '<a:theme xmlns:a="urn:a"><a:themeElements><a:clrScheme><a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme><a:fmtScheme><a:lnStyleLst><a:ln w="19050"/></a:lnStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    link = lambda kind, target: builder.relationships(builder.relationship("rId1", kind, target))
    fixed = {
        "ppt/slides/_rels/slide1.xml.rels": link("slideLayout", "../slideLayouts/slideLayout1.xml"), "ppt/slideLayouts/slideLayout1.xml": builder.page("", "sldLayout"), "ppt/slideLayouts/_rels/slideLayout1.xml.rels": link("slideMaster", "../slideMasters/slideMaster1.xml"),
        "ppt/slideMasters/slideMaster1.xml": builder.page("", "sldMaster"), "ppt/slideMasters/_rels/slideMaster1.xml.rels": link("theme", "../theme/theme1.xml"), "ppt/theme/theme1.xml": F.lit(theme), "ppt/tableStyles.xml": F.lit(style),
    }
    deck = Deck(written(builder.decks(slides, rows.select("deck_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, fixed)), F.array(*fixed.values()))).alias("part_path", "content")))))
    deck.rels = cut(package.relationships(deck.nodes))
    colors_ = Colors(deck)
    found = tables.cells(deck.nodes, colors_.styles, colors_.palette)
    order = part.select((k / 50).cast("long").cast("string").alias("deck_id"), "p_partkey", (F.row_number().over(Window.partitionBy((k / 50).cast("long")).orderBy("p_partkey")) - 1).alias("row"))
    told = lambda b: F.when(b.isNotNull(), F.concat_ws("/", b["color"], b["width"].cast("string"), b["type"]))
    edges = {c: F.coalesce(told(F.col("borders")[c]), F.lit("")).alias(c) for c in ("top", "bottom", "left", "right")}
    return found.join(order, ["deck_id", "row"]).select(F.col("p_partkey").alias("part"), F.col("col").cast("int").alias("col"), "fill", "font_color", "font_bold", "valign", *edges.values(), F.when(F.col("row") == 0, told(F.col("table_borders.top"))).alias("table_top"))


@_query(
    """SELECT s_suppkey AS slide, CASE s_suppkey % 7 WHEN 1 THEN 'gradient' WHEN 2 THEN 'pattern' WHEN 3 THEN 'image' WHEN 5 THEN CASE WHEN deck % 2 = 0 THEN 'image' ELSE 'color' END ELSE 'color' END AS type,
    CASE s_suppkey % 7 WHEN 0 THEN '#8080ff' WHEN 4 THEN '#ffffff' WHEN 5 THEN CASE WHEN deck % 2 = 1 THEN '#ED7D31' END WHEN 6 THEN '#445566' END AS color,
    CASE s_suppkey % 7 WHEN 1 THEN 'line/45/0:#0000ff,100:#ED7D31' WHEN 2 THEN 'pct20/#0000ff/#ffffff' WHEN 3 THEN 'ppt/media/own.png' WHEN 5 THEN CASE WHEN deck % 2 = 0 THEN 'ppt/media/layout.png' END END AS more
    FROM (SELECT s_suppkey, s_suppkey // 50 AS deck FROM supplier)"""
)
def background_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies behind slides: a scheme's colour half let through, by the layout's override, a gradient, a pattern, a picture, a picture that isn't there; the layout's picture, in its own
    scope of relationships, or reference to a theme; the master's colour behind layouts without one.
    """
    k = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(k, (k / 50).cast("long").alias("deck"), (k % 50 + 1).cast("int").alias("n"))
    deck = F.col("deck").cast("string").alias("deck_id")
    page = lambda inner, kind, after="": put(f'<p:{kind} xmlns:p="urn:p" xmlns:a="urn:a" xmlns:r="{builder.RELATION}"><p:cSld>', inner, "</p:cSld>", after, f"</p:{kind}>")
    props = lambda inner: f"<p:bg><p:bgPr>{inner}</p:bgPr></p:bg>"
    scheme = lambda name, inner="": f'<a:schemeClr val="{name}">{inner}</a:schemeClr>'
    picture = lambda rid: f'<a:blipFill><a:blip r:embed="{rid}"/></a:blipFill>'
    own = {
        0: f"<a:solidFill>{scheme('bg1', '<a:alpha val=' + chr(34) + '50000' + chr(34) + '/>')}</a:solidFill>", 1: f'<a:gradFill><a:gsLst><a:gs pos="0">{scheme("bg1")}</a:gs><a:gs pos="100000">{scheme("accent2")}</a:gs></a:gsLst><a:lin ang="2700000"/></a:gradFill>',
        2: f'<a:pattFill prst="pct20"><a:fgClr>{scheme("bg1")}</a:fgClr></a:pattFill>', 3: picture("rId2"), 4: picture("rId9"),
    }
    behind = F.lit("")
    for i, inner in own.items():
        behind = F.when(k % 7 == i, props(inner)).otherwise(behind)
    slides = rows.select(deck, "n", F.col("n").alias("at"), page(behind, "sld").alias("xml"))
    link = builder.relationship
    # slides without a background of their own have the layout with one, or (every seventh) the one without
    to = F.when(k % 7 == 6, "2").otherwise("1")
    files = [rows.select(deck, put("ppt/slides/_rels/slide", F.col("n"), ".xml.rels").alias("part_path"), builder.relationships(put(link("rId1", "slideLayout", put("../slideLayouts/slideLayout", to, ".xml")), link("rId2", "image", "../media/own.png"))).alias("content"))]
    only = rows.select("deck").distinct()
    override = '<p:clrMapOvr><a:overrideClrMapping bg1="accent1"/></p:clrMapOvr>'
    layout = F.when(F.col("deck") % 2 == 0, props(picture("rId2"))).otherwise(f'<p:bg><p:bgRef idx="1001">{scheme("accent2")}</p:bgRef></p:bg>')
    theme = '<a:theme xmlns:a="urn:a"><a:themeElements><a:clrScheme><a:lt1><a:srgbClr val="445566"/></a:lt1><a:accent1><a:srgbClr val="0000ff"/></a:accent1><a:accent2><a:srgbClr val="ED7D31"/></a:accent2></a:clrScheme></a:themeElements></a:theme>'
    fixed = {
        "ppt/slideLayouts/slideLayout1.xml": page(layout, "sldLayout", override), "ppt/slideLayouts/slideLayout2.xml": page("", "sldLayout"),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": builder.relationships(put(link("rId1", "slideMaster", "../slideMasters/slideMaster1.xml"), link("rId2", "image", "../media/layout.png"))),
        "ppt/slideLayouts/_rels/slideLayout2.xml.rels": builder.relationships(link("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")),
        "ppt/slideMasters/slideMaster1.xml": page(F.lit(props(f"<a:solidFill>{scheme('bg1')}</a:solidFill>")), "sldMaster", '<p:clrMap bg1="lt1"/>'), "ppt/slideMasters/_rels/slideMaster1.xml.rels": builder.relationships(link("rId1", "theme", "../theme/theme1.xml")),
        "ppt/theme/theme1.xml": F.lit(theme), "ppt/media/own.png": F.lit("o"), "ppt/media/layout.png": F.lit("l"),
    }
    files.append(only.select(deck, "deck").select("deck_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, fixed)), F.array(*fixed.values()))).alias("part_path", "content")))
    made = Deck(written(builder.decks(slides, files[0].unionByName(files[1]))))
    made.parts = cut(made.parts.drop("content"))
    made.rels = cut(package.relationships(made.nodes))
    colors_ = Colors(made)
    found = matrix.backgrounds(package.chain(made.slides(), made.rels), colors_.styles, colors_.palette, made.rels, made.parts.filter("kind = 'media'"))
    b = F.col("background")
    drawn = F.concat_ws("/", b["path"], units.js_number(b["rot"]), F.array_join(F.transform(b["stops"], lambda x: F.concat(units.js_number(x["pos"]), F.lit(":"), x["color"])), ","))
    more = F.when(b["type"] == "gradient", drawn).when(b["type"] == "pattern", F.concat_ws("/", b["pattern"], b["fore"], b["back"])).otherwise(b["ref"])
    slide = F.col("deck_id").cast("long") * 50 + F.regexp_extract("slide_part", r"(\d+)\.xml$", 1).cast("long") - 1
    return found.select(slide.alias("slide"), b["type"].alias("type"), b["color"].alias("color"), more.alias("more"))


@_query(
    """SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN 'down' WHEN p_size % 4 IN (0, 3) THEN 'mid' ELSE 'up' END AS valign, p_size % 4 = 1 OR p_partkey % 3 = 1 AS vertical,
    CASE WHEN p_partkey % 5 = 0 THEN 'transparent' WHEN p_partkey % 5 = 1 THEN '#010203' WHEN p_size % 4 = 0 THEN '#0a0b0c' WHEN p_size % 4 = 1 THEN '#4472C4' WHEN p_size % 4 = 3 THEN '#0d0e0f' END AS fill FROM part"""
)
def placeholder_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment, direction and fill of placeholders: their own, or the layout's, or the master's; a body without a fill to take stays without.

    Of the layout's placeholders one says nofill, so that the master's counts, one has a place but no body, so that the master's body doesn't.
    """
    k, z = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("body", "title", "ftr", "dt"))), z % 4 + 1)
    fill = F.when(k % 5 == 0, "<a:noFill/>").when(k % 5 == 1, '<a:solidFill><a:srgbClr val="010203"/></a:solidFill>').otherwise("")
    says = F.when(k % 3 == 0, '<a:bodyPr anchor="b"/>').when(k % 3 == 1, '<a:bodyPr vert="vert270" anchor=""/>').otherwise("<a:bodyPr/>")
    shape = put('<p:sp><p:nvSpPr><p:cNvPr id="', k, '" name="s"/><p:nvPr><p:ph type="', kind, '"/></p:nvPr></p:nvSpPr><p:spPr>', fill, "</p:spPr><p:txBody>", says, "<a:p/></p:txBody></p:sp>")
    ph = lambda type_, props, body: f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="p"/><p:nvPr><p:ph type="{type_}"/></p:nvPr></p:nvSpPr><p:spPr>{props}</p:spPr>{body}</p:sp>'
    solid = lambda c: f"<a:solidFill>{c}</a:solidFill>"
    body = lambda attrs: f"<p:txBody><a:bodyPr{attrs}/><a:p/></p:txBody>"
    box = '<a:xfrm><a:off x="1" y="1"/><a:ext cx="1" cy="1"/></a:xfrm>'
    layout = ph("body", box + solid('<a:srgbClr val="0a0b0c"/>'), body(' anchor="ctr"')) + ph("title", box + solid('<a:schemeClr val="accent1"/>'), body(' vert="eaVert"')) + ph("ftr", box, "") + ph("dt", "<a:noFill/>", "")
    master = ph("ftr", "", body(' anchor="ctr" vert="vert"')) + ph("dt", solid('<a:srgbClr val="0d0e0f"/>'), body(' anchor="ctr"'))
    theme = '<a:clrScheme><a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme>'
    deck = _chained(spark, sf_dir, shape, "", layout, theme, master)
    order = cut(package.chain(deck.slides(), deck.rels))
    found = cut(shapes.shapes(deck.nodes))
    behind = lambda part: found.filter(F.col("part_path").startswith(part))
    on_layouts, on_masters = behind("ppt/slideLayouts/"), behind("ppt/slideMasters/")
    own = found.withColumnRenamed("part_path", "slide_part").join(order.select("deck_id", "slide_part", "layout_part", "master_part"), ["deck_id", "slide_part"])
    own = cut(shapes.inherited(own, on_layouts, on_masters).withColumnRenamed("slide_part", "part_path"))
    keys = ["deck_id", "part_path", "nid"]
    said = styles.inherited_bodies(own, styles.bodies(deck.nodes))
    shown = cut(textbody.style_placeholder(textbody.style_placeholder(own, "layout_part", on_layouts, "l_ph"), "master_part", on_masters, "m_ph"))
    colors_ = Colors(deck)
    fills_ = looks.own_looks(colors_.styles, looks.references(deck.nodes, colors_.paint), colors_.palette, looks.inherited_contents(shown, colors_.styles))
    met = own.join(said, keys).join(fills_.select(*keys, F.coalesce("own_fill", "theme_fill", "more_fill").alias("fill")), keys, "left")
    return met.select(_whole(F.col("id")).alias("part"), "valign", "vertical", F.col("fill.color").alias("fill"))


@_query(
    """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s FROM part)
    SELECT p_partkey AS part, CAST(i AS INTEGER) AS i, letter, x, y, CAST(coalesce(large, -1) AS INTEGER) AS large, CAST(coalesce(sweep, -1) AS INTEGER) AS sweep FROM (
    SELECT p_partkey, 0 AS i, 'M' AS letter, 2 * s AS x, 2 * s AS y, NULL AS large, NULL AS sweep, s FROM p UNION ALL SELECT p_partkey, 1, 'A', 4 * s, s, 0, 1, s FROM p UNION ALL SELECT p_partkey, 2, 'C', 4 * s, 8 * s, NULL, NULL, s FROM p
    UNION ALL SELECT p_partkey, 3, 'A', 4 * s, 8 * s - 4 * s, 0, 0, s FROM p WHERE s % 2 = 0 UNION ALL SELECT p_partkey, 3, 'A', 4 * s + 2 * s, 8 * s - 2 * s, 1, 0, s FROM p WHERE s % 2 = 1 UNION ALL SELECT p_partkey, 4, 'Z', NULL, NULL, NULL, NULL, s FROM p)"""
)
def custom_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs in custom geometry, after a move and after a curve, each from where the pen is: quarters, halves and three quarters of ellipses, in a box twice as large; arcs without an angle are left out."""
    part, s = _table(spark, sf_dir, "part"), F.col("p_size")
    pt = lambda x, y: put('<a:pt x="', x, '" y="', y, '"/>')
    arc = lambda w, h, start, sweep: put('<a:arcTo wR="', w, '" hR="', h, '" stAng="', start, '" swAng="', sweep, '"/>')
    last = F.when(s % 2 == 0, arc(s, s, F.lit(5400000), F.lit(-10800000))).otherwise(arc(s, s, F.lit(5400000 * 2), F.lit(-16200000)))
    commands = put("<a:moveTo>", pt(s, s), "</a:moveTo>", arc(s, s / 2, F.lit(10800000), F.lit(5400000)), arc(s, s, F.lit(0), F.lit(0)), "<a:cubicBezTo>", pt(s, s), pt(s, s), pt(s * 2, s * 4), "</a:cubicBezTo><a:quadBezTo>", pt(s, s), "</a:quadBezTo>", last, "<a:close/>")
    geometry = put('<a:custGeom><a:pathLst><a:path w="', s * 10, '" h="', s * 10, '">', commands, "</a:path></a:pathLst></a:custGeom>")
    shape = builder.shape(F.col("p_partkey"), F.lit("s"), geometry=geometry)
    nodes = Deck(written(builder.decks(_one_slide(part, (F.col("p_partkey") / 200).cast("long"), shape, "p_partkey")))).nodes
    ids = shapes.shapes(nodes).select("deck_id", "part_path", F.col("nid").alias("owner"), "id").join(part.select(F.col("p_partkey").cast("string").alias("id"), (s * 20.0).alias("w"), (s * 20.0).alias("h")), "id")
    found = outlines.custom_paths(nodes, ids).join(ids, ["deck_id", "part_path", "owner"]).select("id", F.posexplode("commands").alias("i", "c"))
    v, from_end = F.col("c.values"), lambda i: F.round(F.try_element_at(F.col("c.values"), F.lit(i)), 6) + 0.0
    flag = lambda i: F.when(F.col("c.letter") == "A", F.get(v, F.lit(i)).cast("int")).otherwise(-1)
    return found.select(_whole(F.col("id")).alias("part"), "i", F.col("c.letter").alias("letter"), from_end(-2).alias("x"), from_end(-1).alias("y"), flag(3).alias("large"), flag(4).alias("sweep"))


@_query(
    """SELECT CAST(s_suppkey AS BIGINT) AS supplier, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE 'drawn' || (s_suppkey % 50 // 10 * 10 + CASE WHEN s_suppkey % 4 = 0 THEN 1 WHEN s_suppkey % 4 = 1 THEN 5 ELSE 1 END) END AS name FROM supplier"""
)
def diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part draws the diagram of each frame: that of the number nearest to its data's, the first one for data without a number, none on a slide without any; read from archives."""
    k = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(k, (k / 50).cast("long").cast("string").alias("deck_id"), (k % 50 / 10).cast("int").alias("slide"), (k % 4).alias("kind"))
    # two slides for each ten suppliers: one whose drawings are numbered 10 n + 1 and 10 n + 5, and one without any
    n = F.col("slide") * 2 + F.when(F.col("kind") == 3, 2).otherwise(1)
    data = F.when(F.col("kind") == 0, F.col("slide") * 10 + 2).when(F.col("kind") == 1, F.col("slide") * 10 + 4)
    frame = put('<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="', k, '" name="f"/></p:nvGraphicFramePr><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/diagram"><dgm:relIds xmlns:dgm="urn:d" r:dm="rIdD', k, '"/></a:graphicData></a:graphic></p:graphicFrame>')
    link = builder.relationship(put("rIdD", k), "diagramData", put("../diagrams/data", data, ".xml"))
    rows = rows.select("deck_id", n.alias("n"), "s_suppkey", "kind", "slide", frame.alias("frame"), link.alias("link"))
    slides = builder.gathered(rows, ["deck_id", "n"], "s_suppkey", "frame").select("deck_id", "n", F.col("n").alias("at"), builder.page(F.col("frame")).alias("xml"))
    links = builder.gathered(rows, ["deck_id", "n"], "s_suppkey", "link")
    ten = F.floor((F.col("n") - 1) / 2) * 10
    drawings = F.when(F.col("n") % 2 == 1, put(*(builder.relationship(f"rIdW{i}", "other/diagramDrawing", put("../diagrams/drawing", ten + i, ".xml")) for i in (1, 5)))).otherwise("")
    files = links.select("deck_id", put("ppt/slides/_rels/slide", F.col("n"), ".xml.rels").alias("part_path"), builder.relationships(put(F.col("link"), drawings)).alias("content"))
    tree = lambda i: put('<dsp:drawing xmlns:dsp="urn:dsp" xmlns:a="urn:a"><dsp:spTree><dsp:sp><dsp:nvSpPr><dsp:cNvPr id="1" name="drawn', ten + i, '"/></dsp:nvSpPr><dsp:spPr/></dsp:sp></dsp:spTree></dsp:drawing>')
    drawn = slides.filter("n % 2 = 1").select("deck_id", F.inline(F.array(*(F.struct(put("ppt/diagrams/drawing", ten + i, ".xml").alias("part_path"), tree(i).alias("content")) for i in (1, 5)))))
    deck = Deck(written(builder.decks(slides, files.unionByName(drawn))))
    deck.parts = cut(deck.parts.drop("content"))
    deck.rels = cut(package.relationships(deck.nodes))
    found = cut(shapes.shapes(deck.nodes))
    chosen = frames.diagram_drawings(deck.nodes, deck.rels, deck.parts)
    inside = found.filter(F.col("part_path").startswith("ppt/diagrams/")).select("deck_id", F.col("part_path").alias("drawing"), F.col("name").alias("shown"))
    met = found.filter(F.contains("uri", F.lit("diagram"))).join(chosen, ["deck_id", "part_path", "nid"], "left").join(inside, ["deck_id", "drawing"], "left")
    return met.select(_whole(F.col("id")).alias("supplier"), F.col("shown").alias("name"))


@_query(
    """SELECT CAST(o_orderkey AS BIGINT) AS order_key, CASE o_orderkey % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'formula' WHEN 3 THEN 'picture' WHEN 4 THEN 'word' END AS kind, CASE WHEN o_orderkey % 5 = 1 THEN 'x' || o_orderkey || '=y' END AS text,
    CASE o_orderkey % 5 WHEN 1 THEN 'rIdF' WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'rIdF' ELSE 'rIdC' END WHEN 4 THEN 'rIdF' END AS rid FROM orders WHERE o_orderkey % 5 <> 2"""
)
def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What AlternateContent comes to: nothing for shapes in two forms, one formula for a formula, one picture for an object, the Fallback's where it has one; plain shapes stay."""
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders")
    sp = lambda inner, body="": put('<p:sp><p:nvSpPr><p:cNvPr id="', k, '" name="s"/></p:nvSpPr><p:spPr>', inner, "</p:spPr>", body, "</p:sp>")
    both = lambda choice, other: put("<mc:AlternateContent><mc:Choice>", choice, "</mc:Choice><mc:Fallback>", other, "</mc:Fallback></mc:AlternateContent>")
    blip = lambda rid: f'<a:blip r:embed="{rid}"/>'
    math = put("<p:txBody><a:p><a14:m><m:oMathPara><m:oMath><m:r><m:t>x", k, "</m:t></m:r><m:r><m:t>=y</m:t></m:r></m:oMath></m:oMathPara></a14:m><a:r><a:t>after</a:t></a:r></a:p></p:txBody>")
    obj = lambda rid, prog: f'<p:oleObj progId="{prog}" r:id="rIdO">' + (f"<p:pic><p:blipFill>{blip(rid)}</p:blipFill></p:pic>" if rid else "") + "</p:oleObj>"
    frame = lambda inner: put('<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="', k, '" name="o"/></p:nvGraphicFramePr><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/presentationml/2006/ole">', inner, "</a:graphicData></a:graphic></p:graphicFrame>")
    shape = (
        F.when(k % 5 == 0, sp("")).when(k % 5 == 1, both(sp("", math), sp(f"<a:blipFill>{blip('rIdF')}</a:blipFill>"))).when(k % 5 == 2, both(sp(""), sp("")))
        .when(k % 5 == 3, frame(both(obj("rIdC", "Excel.Sheet"), F.when(k % 2 == 0, obj("rIdF", "Excel.Sheet")).otherwise(obj("", "Excel.Sheet"))))).otherwise(frame(both(obj("rIdC", "Word.Document.12"), obj("rIdF", "Word.Document.12"))))
    )
    each = rows.select((k / 200).cast("long").cast("string").alias("deck_id"), "o_orderkey", shape.alias("xml"))
    page = put('<p:sld xmlns:p="urn:p" xmlns:a="urn:a" xmlns:mc="urn:mc" xmlns:m="urn:m" xmlns:a14="urn:a14" xmlns:r="' + builder.RELATION + '"><p:cSld><p:spTree>', F.col("xml"), "</p:spTree></p:cSld></p:sld>")
    slides = builder.gathered(each, ["deck_id"], "o_orderkey", "xml").select("deck_id", F.lit(1).alias("n"), F.lit(1).alias("at"), page.alias("xml"))
    found = shapes.shapes(Deck(written(builder.decks(slides))).nodes)
    return found.select(_whole(F.col("id")).alias("order_key"), F.when(F.col("formula").isNotNull(), "formula").otherwise(F.coalesce("ole", F.lit("plain"))).alias("kind"), F.col("formula").alias("text"), "rid")


def _turned_sql() -> str:
    """SQL of ``turned_groups``: three groups, from the innermost to the outermost, each scales, mirrors and turns centres around its middle."""
    steps, last = [], "SELECT *, l_quantity + 5.0 AS px, 10.0 + l_linenumber / 2.0 AS py, 10.0 AS w, CAST(l_linenumber AS DOUBLE) AS h, CAST(30 * (l_linenumber % 3) AS DOUBLE) AS r, FALSE AS fh, FALSE AS fv FROM lineitem"
    for x, y, cx, cy, ox, oy, ex, ey, rot, h, v in _GROUPS:
        lx, ly = f"(px - {ox}) * {cx / ex}", f"(py - {oy}) * {cy / ey}"
        lx, ly = (f"{cx} - {lx}" if h else lx), (f"{cy} - {ly}" if v else ly)
        dx, dy = f"({lx} - {cx / 2})", f"({ly} - {cy / 2})"
        turn = f"(({'-' if h != v else ''}r + {rot + (180 if h and v else 0)}) % 360 + 360) % 360"
        steps.append(f"SELECT * REPLACE ({x + cx / 2} + {dx} * cos(radians({rot})) - {dy} * sin(radians({rot})) AS px, {y + cy / 2} + {dx} * sin(radians({rot})) + {dy} * cos(radians({rot})) AS py, w * {cx / ex} AS w, h * {cy / ey} AS h, {turn} AS r, {'NOT fh' if h and not v else 'fh'} AS fh, {'NOT fv' if v and not h else 'fv'} AS fv)")
    for step in steps:
        last = f"{step} FROM ({last})"
    return f'SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line, round(px - w / 2, 4) + 0.0 AS "left", round(py - h / 2, 4) + 0.0 AS top, round(CAST(w AS DOUBLE), 4) AS width, round(CAST(h AS DOUBLE), 4) AS height, round(r, 4) AS rotate, fh AS flip_h, fv AS flip_v FROM ({last})'


#: Groups of ``turned_groups``, the innermost first: left, top, width and height, offset and extent inside, degrees, mirrors.
_GROUPS = [(10, 20, 100, 60, 5, 5, 50, 60, 30, True, False), (7, 3, 80, 120, 0, 10, 160, 120, 45, False, True), (100, 50, 300, 200, 1, 2, 100, 100, 270, True, True)]


@_query(_turned_sql())
def turned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes in three groups, one in the other, of which each scales, turns and mirrors: read from archives, as seen from the slide."""
    rows = _table(spark, sf_dir, "lineitem")
    box = lambda x, y, cx, cy, attrs="", inner="": put("<a:xfrm", attrs, '><a:off x="', x, '" y="', y, '"/><a:ext cx="', cx, '" cy="', cy, '"/>', inner, "</a:xfrm>")
    emu = lambda c: _whole(c * 12700)
    leaf = builder.shape(F.lit(1), put(F.col("l_orderkey"), "-", F.col("l_linenumber")), box=box(emu(F.col("l_quantity")), F.lit(127000), F.lit(127000), emu(F.col("l_linenumber")), put(' rot="', F.col("l_linenumber") % 3 * 1800000, '"')))
    each = rows.select((F.col("l_orderkey") / 100).cast("long").cast("string").alias("deck_id"), "l_orderkey", "l_linenumber", leaf.alias("xml"))
    page = F.col("xml")
    for x, y, cx, cy, ox, oy, ex, ey, rot, h, v in _GROUPS:
        inside = '<a:chOff x="{}" y="{}"/><a:chExt cx="{}" cy="{}"/>'.format(*(12700 * c for c in (ox, oy, ex, ey)))
        attrs = f' rot="{rot * 60000}"' + ' flipH="1"' * h + ' flipV="true"' * v
        page = put('<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="g"/></p:nvGrpSpPr><p:grpSpPr>', box(*(F.lit(12700 * c) for c in (x, y, cx, cy)), attrs, inside), "</p:grpSpPr>", page, "</p:grpSp>")
    slides = builder.gathered(each, ["deck_id"], ["l_orderkey", "l_linenumber"], "xml").select("deck_id", F.lit(1).alias("n"), F.lit(1).alias("at"), builder.page(page).alias("xml"))
    found = shapes.boxes(shapes.flattened(cut(shapes.shapes(Deck(written(builder.decks(slides)), shapes.TAGS).nodes)))).filter("shape = 'sp'")
    parts = F.split("name", "-")
    near = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return found.select(_whole(parts[0]).alias("order_key"), _whole(parts[1]).alias("line"), *map(near, ("left", "top", "width", "height", "rotate")), "flip_h", "flip_v")


@_query(
    """SELECT p_partkey AS part, CASE p_size % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'audio/mp4' ELSE 'application/octet-stream' END AS type,
    md5('data:' || CASE p_size % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'audio/mp4' ELSE 'application/octet-stream' END || ';base64,' || to_base64(encode(p_name || p_name || p_name || p_name || p_name || p_name))) AS url_md5 FROM part"""
)
def media_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media in archives as addresses that hold their bytes."""
    part, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    ending = F.element_at(F.array(*map(F.lit, (".PNG", ".jpeg", ".m4a", ".xyz"))), F.col("p_size") % 4 + 1)
    files = part.select((k / 200).cast("long").cast("string").alias("deck_id"), put("ppt/media/m", k, ending).alias("part_path"), F.repeat("p_name", 6).alias("content"))
    found = archive.parts(written(archive.pack(files))).filter("kind = 'media'")
    return found.select(_whole(F.regexp_extract("part_path", r"m(\d+)\.", 1)).alias("part"), media.media_type(F.col("part_path")).alias("type"), F.md5(media.data_url(F.col("part_path"), F.col("content")).cast("binary")).alias("url_md5"))


# ---- documents


@_query(
    """SELECT CAST(s_nationkey AS BIGINT) AS nation, 'table' AS node_type, CAST(NULL AS VARCHAR) AS text, CAST(2 * count(*) AS BIGINT) AS cells FROM supplier GROUP BY s_nationkey"""
)
def deck_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks without looks: kinds, texts and cells."""
    found = structure(_supplier_tables(spark, sf_dir))
    return found.select(_whole(F.col("deck_id")).alias("nation"), "node_type", "text", _whole(F.size("cells")).alias("cells"))


def _placeholder_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks of _nations, of which two thirds of the shapes are placeholders without a box: the layout places one half, nothing the other."""
    k = F.col("n_nationkey")
    nation = _table(spark, sf_dir, "nation").withColumn("deck_id", F.col("n_regionkey").cast("string"))
    ph = F.when(k % 3 == 1, '<p:ph type="body" idx="7"/>').when(k % 3 == 2, '<p:ph type="title"/>').otherwise("")
    shown = nation.select("deck_id", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("n_nationkey"))).alias("n"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")).alias("at"), builder.page(_sp(k, F.col("n_name"), F.col("n_name"), ph=ph)).alias("xml"))
    layout = builder.shape(F.lit(1), F.lit("a"), box=builder.xfrm(*(F.lit(c * 12700) for c in (100, 50, 30, 20))), ph='<p:ph type="body" idx="7"/>')
    more = nation.select("deck_id").distinct().select("deck_id", F.lit("ppt/slideLayouts/slideLayout1.xml").alias("part_path"), builder.page(layout, "sldLayout").alias("content"))
    more = more.unionByName(shown.select("deck_id", put("ppt/slides/_rels/slide", F.col("n"), ".xml.rels").alias("part_path"), builder.relationships(builder.relationship("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")).alias("content")))
    return written(builder.decks(shown, more))


@_query(
    """SELECT CAST(n_regionkey AS BIGINT) AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS slide_index, 'text' AS type, n_name AS name, '<div style="padding: 3.6pt 7.2pt 3.6pt 7.2pt;"><p><span style="font-size: 12pt;color: #000000;">' || n_name || '</span></p></div>' AS content, CAST(720 AS DOUBLE) AS width, '#000000' AS accent FROM nation"""
)
def deck_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of whole documents, slide by slide."""
    docs = documents(_placeholder_decks(spark, sf_dir))
    each = docs.select("deck_id", "size", "theme_colors", F.explode("slides").alias("s")).select("deck_id", "size", "theme_colors", "s.slide_index", F.explode("s.elements").alias("e"))
    accent = F.coalesce(F.col("theme_colors")[0], F.lit("#000000"))
    return each.select(_whole(F.col("deck_id")).alias("region"), _whole(F.col("slide_index")).alias("slide_index"), "e.type", "e.name", "e.content", F.round("size.width", 6).alias("width"), accent.alias("accent"))


@_query(
    """WITH e AS (SELECT s_suppkey, s_name, i, name FROM supplier, (VALUES (0, 'Title'), (1, 'Drawn'), (2, 'frame'), (3, 'Line')) t(i, name)),
    f AS (SELECT *, '<div style="padding: 3.6pt 7.2pt 3.6pt 7.2pt;"><p><span style="font-size: 12pt;' AS o, '</span></p></div>' AS c FROM e)
    SELECT CAST(s_suppkey AS BIGINT) AS supplier, name, CASE i WHEN 0 THEN 'text' WHEN 2 THEN 'table' ELSE 'shape' END AS type, CAST(CASE i WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 0 ELSE s_suppkey % 50 END AS DOUBLE) AS "left",
    CAST(CASE i WHEN 0 THEN 70 WHEN 1 THEN 40 WHEN 2 THEN 2 ELSE 100 END AS DOUBLE) AS width, CASE i WHEN 0 THEN '#ED7D31' WHEN 1 THEN '#4472C4' WHEN 2 THEN '#DDDDDD' ELSE 'transparent' END AS fill, CASE WHEN i IN (1, 3) THEN '#123456' WHEN i = 0 THEN '#000000' END AS border,
    CASE i WHEN 0 THEN o || 'color: #000000;">' || s_name || c WHEN 1 THEN o || 'color: #FFFFFE;">' || s_suppkey || c WHEN 2 THEN '<p><span style="font-size: 12pt;font-weight: bold;color: #FFFFFF;">' || s_suppkey || '</span></p>|<p><span style="font-size: 12pt;color: #AA0000;">x</span></p>' END AS content,
    '#445566' AS background, 'note ' || s_suppkey AS note, CAST(1 AS BIGINT) AS behind FROM f"""
)
def deck_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, a slide to a supplier: a title placed and filled by its layout, a shape drawn by its theme, a styled table, a line, a note, a background and what lies behind."""
    k = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(k, "s_name", (k / 50).cast("long").cast("string").alias("deck_id"), (k % 50 + 1).cast("int").alias("n"))
    srgb = lambda c: f'<a:srgbClr val="{c}"/>'
    solid = lambda c: f"<a:solidFill>{c}</a:solidFill>"
    scheme = lambda c: f'<a:schemeClr val="{c}"/>'
    style = "<p:style>" + "".join(f'<a:{t} idx="{i}">{scheme(c)}</a:{t}>' for t, i, c in (("lnRef", 1, "accent2"), ("fillRef", 1, "accent1"), ("fontRef", "minor", "lt1"))) + "</p:style>"
    emu = lambda *c: [x * 12700 for x in map(F.lit, c)]
    title = builder.shape(F.lit(2), F.lit("Title"), body=builder.paragraph(builder.run(F.col("s_name"))), ph='<p:ph type="title"/>')
    drawn = put('<p:sp><p:nvSpPr><p:cNvPr id="3" name="Drawn"/></p:nvSpPr><p:spPr>', builder.xfrm(*emu(10, 10, 40, 20)), '<a:prstGeom prst="rect"/></p:spPr>', style, "<p:txBody><a:bodyPr/>", builder.paragraph(builder.run(k)), "</p:txBody></p:sp>")
    cell = lambda inner: put("<a:tc><a:txBody>", inner, "</a:txBody></a:tc>")
    cells = put(cell(builder.paragraph(builder.run(k))), cell(F.lit(f'<a:p><a:r><a:rPr b="0">{solid(srgb("AA0000"))}</a:rPr><a:t>x</a:t></a:r></a:p>')))
    table = builder.frame(F.lit(4), put('<a:tbl><a:tblPr firstRow="1"><a:tableStyleId>{S}</a:tableStyleId></a:tblPr><a:tblGrid><a:gridCol w="12700"/><a:gridCol w="12700"/></a:tblGrid><a:tr h="12700">', cells, "</a:tr></a:tbl>"), "table")
    line = put('<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="5" name="Line"/></p:nvCxnSpPr><p:spPr>', builder.xfrm(k % 50 * 12700, *emu(5, 100, 0)), '<a:prstGeom prst="line"/></p:spPr>', style, "</p:cxnSp>")
    slides = rows.select("deck_id", "n", F.col("n").alias("at"), builder.page(put(title, drawn, table, line)).alias("xml"))
    link = builder.relationship
    own = rows.select("deck_id", F.inline(F.array(
        F.struct(put("ppt/slides/_rels/slide", F.col("n"), ".xml.rels").alias("part_path"), builder.relationships(put(link("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), link("rId2", "notesSlide", put("../notesSlides/notesSlide", F.col("n"), ".xml")))).alias("content")),
        F.struct(put("ppt/notesSlides/notesSlide", F.col("n"), ".xml").alias("part_path"), builder.page(builder.shape(F.lit(2), F.lit("n"), body=builder.paragraph(builder.run(put("note ", k))), ph='<p:ph type="body"/>'), "notes").alias("content")),
    )))
    box = lambda x, y, w, h: '<a:xfrm><a:off x="{}" y="{}"/><a:ext cx="{}" cy="{}"/></a:xfrm>'.format(*(c * 12700 for c in (x, y, w, h)))
    sp = lambda name, props, ph="": f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="{name}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{props}</p:spPr></p:sp>'
    layout = builder.page(F.lit(sp("l", box(5, 6, 70, 80) + solid(scheme("accent2")), '<p:ph type="title"/>') + sp("behind", box(1, 1, 1, 1) + '<a:prstGeom prst="rect"/>')), "sldLayout")
    master = f'<p:sldMaster xmlns:p="urn:p" xmlns:a="urn:a"><p:cSld><p:bg><p:bgPr>{solid(scheme("bg1"))}</p:bgPr></p:bg><p:spTree/></p:cSld><p:clrMap bg1="dk1"/></p:sldMaster>'
    colors_ = "".join(f"<a:{n}>{srgb(c)}</a:{n}>" for n, c in (("dk1", "445566"), ("lt1", "FFFFFE"), ("accent1", "4472C4"), ("accent2", "ED7D31")))
    theme = f'<a:theme xmlns:a="urn:a"><a:themeElements><a:clrScheme>{colors_}</a:clrScheme><a:fmtScheme><a:fillStyleLst>{solid(scheme("phClr"))}</a:fillStyleLst><a:lnStyleLst><a:ln w="12700">{solid(srgb("123456"))}</a:ln></a:lnStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    styled = f'<a:tblStyleLst xmlns:a="urn:a"><a:tblStyle styleId="{{S}}"><a:firstRow><a:tcTxStyle b="on">{solid(srgb("FFFFFF"))}</a:tcTxStyle><a:tcStyle><a:fill>{solid(srgb("DDDDDD"))}</a:fill></a:tcStyle></a:firstRow></a:tblStyle></a:tblStyleLst>'
    fixed = {
        "ppt/slideLayouts/slideLayout1.xml": layout, "ppt/slideLayouts/_rels/slideLayout1.xml.rels": builder.relationships(link("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")), "ppt/slideMasters/slideMaster1.xml": F.lit(master),
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": builder.relationships(link("rId1", "theme", "../theme/theme1.xml")), "ppt/theme/theme1.xml": F.lit(theme), "ppt/tableStyles.xml": F.lit(styled),
    }
    shared = rows.select("deck_id").distinct().select("deck_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, fixed)), F.array(*fixed.values()))).alias("part_path", "content"))
    docs = documents(written(builder.decks(slides, own.unionByName(shared))))
    content = F.coalesce(F.array_join(F.transform("e.cells", lambda c: c["text"]), "|"), "e.content")
    fill = F.coalesce(F.get("e.cells", F.lit(0))["fill"], "e.fill.color")
    number = F.col("deck_id").cast("long") * 50 + F.regexp_extract("s.slide_part", r"(\d+)\.xml$", 1).cast("long") - 1
    each = docs.select("deck_id", F.explode("slides").alias("s")).select(number.alias("supplier"), "s.background", "s.note", _whole(F.size("s.layoutElements")).alias("behind"), F.explode("s.elements").alias("e"))
    return each.select("supplier", "e.name", "e.type", F.round("e.left", 4).alias("left"), F.round("e.width", 4).alias("width"), fill.alias("fill"), F.col("e.border.color").alias("border"), content.alias("content"), F.col("background.color").alias("background"), "note", "behind")


@_query()
def deck_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as JSON strings."""
    return as_json(documents(_placeholder_decks(spark, sf_dir)))
