"""Queries over files and office packages that are made from the test tables, with their SQL."""

from __future__ import annotations

import uuid
from io import BytesIO
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import grids, views
from docloom.plans.catalogue import query
from docloom.plans.corpus import read, spread
from docloom.sources import connector, ooxml, tables
from docloom.sources.ranges import column_letters
from docloom.store import shared_dir

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PNS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def _zipped(parts: dict[str, str]) -> bytes:
    out = BytesIO()
    with ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _packages(rows: DataFrame, make) -> DataFrame:
    """uri, content of a package for each row (uri and others), made where the row is dealt to."""
    import pyarrow as pa

    names = rows.columns

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                own = [dict(zip(names, row, strict=True)) for row in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r["uri"] for r in own], pa.string()), pa.array([_zipped(make(r)) for r in own], pa.binary())], ["uri", "content"])

    return spread(rows, 2_000).mapInArrow(run, "uri string, content binary")


# lines


def _written(rows: DataFrame, line, order: str, files: int = 4) -> str:
    """The folder of files of lines, one for each remainder of the key `order`, in its order."""
    path = f"{shared_dir(rows.sparkSession)}/csv-{uuid.uuid4().hex}"
    own = rows.select(line.alias("value"), F.pmod(F.col(order), F.lit(files)).alias("part"), F.col(order).alias("_k"))
    own.repartition(files, "part").sortWithinPartitions("part", "_k").drop("_k").write.partitionBy("part").text(path)
    return path


@query("SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'one' || chr(10) || chr(10) || 'two, \"q\"' WHEN o_orderkey % 3 = 1 THEN 'a, \"b\"' ELSE '5\" pipe' END AS v, CAST(o_orderkey % 2 AS VARCHAR) AS w FROM orders")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cell = F.when(k % 3 == 0, '"one\n\ntwo, ""q"""').when(k % 3 == 1, '"a, ""b"""').otherwise('5" pipe')
    rows = tables.read_csv(spark, _written(read(spark, sf_dir, "orders"), F.concat(k, F.lit(","), cell, F.lit(","), k % 2), "o_orderkey"))
    return rows.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("k", "v", "w"))))


@query("SELECT CAST(row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1 AS BIGINT) AS r, p_name AS name, p_brand AS brand, CAST(2 AS INT) AS width FROM part")
def csv_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = tables.CsvOptions(delimiter=";", quote="'", trim=True)
    rows = tables.read_csv(spark, _written(read(spark, sf_dir, "part"), F.concat(F.lit(" "), "p_name", F.lit(" ;'"), "p_brand", F.lit("'")), "p_partkey"), options)
    return rows.select("r", F.get("cells", F.lit(0)).alias("name"), F.get("cells", F.lit(1)).alias("brand"), F.size("cells").alias("width"))


@query("SELECT count(*) AS rows, CAST(3 AS INT) AS columns FROM part GROUP BY p_partkey % 4")
def csv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read_csv(spark, _written(read(spark, sf_dir, "part"), F.concat_ws("\t", "p_partkey", "p_brand", "p_type"), "p_partkey"), tables.CsvOptions.tsv())
    return tables.counts(rows).select("rows", "columns")


@query("SELECT CAST(p_partkey AS VARCHAR) AS k, r FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1 AS r FROM part) WHERE r BETWEEN 9 AND 59")
def csv_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read_csv(spark, _written(read(spark, sf_dir, "part"), F.concat_ws(",", "p_partkey", "p_brand"), "p_partkey"))
    return tables.csv_range(rows, "10:60").select(F.get("cells", F.lit(0)).alias("k"), "r")


@query("SELECT CAST(p_partkey AS VARCHAR) || '|' || p_brand AS cells, r FROM (SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1 AS INT) AS r FROM part) WHERE r BETWEEN 4 AND 19")
def table_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 5 to 20 of each file of a folder, through the data source."""
    connector.register(spark)
    path = _written(read(spark, sf_dir, "part"), F.concat_ws(";", "p_partkey", "p_brand"), "p_partkey")
    load = lambda i: spark.read.format(connector.TableSource.name()).options(path=f"{path}/part={i}", range="5:20", delimiter=";").load()
    rows = load(0)
    for i in range(1, 4):
        rows = rows.unionByName(load(i))
    return rows.select("r", F.array_join("cells", "|").alias("cells"))


def _sheets_of_text(spark: SparkSession, sf_dir: str) -> str:
    """The folder of CSV files, one for each remainder of a supplier's key by 3, in its order."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.concat(F.lit('say "'), "s_nationkey", F.lit('",\nthen')).alias("said"), F.pmod("s_suppkey", F.lit(3)).alias("k"))
    rows.repartition(3, "k").sortWithinPartitions("k", "s_suppkey").write.partitionBy("k").option("escape", '"').csv(path)
    return path


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, 'say \"' || s_nationkey || '\",' || chr(10) || 'then' AS said FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS n FROM supplier) WHERE n BETWEEN 2 AND 3")
def table_by_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 and 3 of files that are known for CSV by their ending."""
    rows = tables.read_table(spark, f"{_sheets_of_text(spark, sf_dir)}/*/*.csv", "2:3")
    return rows.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("key", "name", "said"))))


@query("""WITH s AS (SELECT s_suppkey, s_name, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS n, count(*) OVER (PARTITION BY s_suppkey % 3) AS m, s_suppkey % 3 AS k FROM supplier)
SELECT 'doc-' || k AS uri, 2 AS ln, CAST(n - 2 AS INT) AS r, CAST(s_suppkey AS VARCHAR) || '|' || s_name AS cells, n = 2 AS is_header, NULL AS problem FROM s WHERE n BETWEEN 2 AND 4
UNION ALL SELECT DISTINCT 'doc-' || k, 3, 0, '', false, 'FileNotFound: none.csv' FROM s UNION ALL SELECT DISTINCT 'doc-' || k, 4, 0, '', false, 'InvalidRange' FROM s""")
def include_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that include lines 2 to 4 of a file, one that isn't there, and a wrong range."""
    path = _sheets_of_text(spark, sf_dir)
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    k = F.regexp_extract("file", "/k=([0-9]+)/", 1)
    lines = F.array(F.concat(F.lit("include::"), "file", F.lit("[range=2:4,header]")), F.lit("include::none.csv[]"), F.concat(F.lit("include::"), "file", F.lit("[range=0:1]")))
    found = tables.includes(files.select(F.concat(F.lit("doc-"), k).alias("uri"), F.posexplode(lines).alias("ln", "line")).withColumn("ln", F.col("ln") + 2))
    rows = tables.resolve_includes(spark, found, path)
    return rows.select("uri", "ln", "r", F.array_join(F.slice("cells", 1, 2), "|").alias("cells"), "is_header", F.when(F.col("problem").startswith("InvalidRange"), "InvalidRange").otherwise(F.col("problem")).alias("problem"))


# workbooks


def _workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each region: nations (key, name, a date serial, whether even), an empty
    sheet, one of a single cell; for odd regions an empty sheet comes before them all."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    books = read(spark, sf_dir, "nation").groupBy(F.concat(F.lit("book-"), "n_regionkey").alias("uri")).agg(rows.alias("rows"))

    def make(row):
        cells = ""
        for r, own in enumerate(row["rows"], 1):
            k = own["n_nationkey"]
            values = (f"<v>{k}</v>", f'<is><t>{own["n_name"]}</t></is>', f"<v>{44927 + k}</v>", f"<v>{int(k % 2 == 0)}</v>")
            kinds = ("", ' t="inlineStr"', "", ' t="b"')
            cells += f'<row r="{r}">' + "".join(f'<c r="{column_letters(c)}{r}"{kind}>{v}</c>' for c, (kind, v) in enumerate(zip(kinds, values, strict=True)) if c != 2 or k % 3) + "</row>"
        sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
        return {
            "xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" {NS.split(" ", 1)[1]}><sheets>{'<sheet name="Cover" r:id="r3"/>' if row["uri"][-1] in "13579" else ""}<sheet name="Nations" r:id="r1"/><sheet name="Blank &amp; bare" r:id="r3"/><sheet name="More" r:id="r2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="r3" Target="worksheets/sheet3.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": sheet.format(cells), "xl/worksheets/sheet2.xml": sheet.format('<row r="3"><c r="B3"><v>1.5</v></c></row>'), "xl/worksheets/sheet3.xml": sheet.format(""),
        }

    return _packages(books, make)


NATIONS = "n AS (SELECT *, 'book-' || n_regionkey AS uri, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS r FROM nation)"


@query(f"WITH {NATIONS} SELECT uri, r, CASE WHEN n_nationkey >= 1 THEN strftime(DATE '1899-12-31' + CAST(n_nationkey AS INT), '%Y-%m-%d') ELSE '0' END || '|' || n_name || '|' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE strftime(DATE '1899-12-30' + CAST(44927 + n_nationkey AS INT), '%Y-%m-%d') END || '|' || CASE WHEN n_nationkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS cells FROM n")
def workbook_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tables.formatted(tables.sheet(tables.workbook_cells(_workbooks(spark, sf_dir)), "Nations"), dates=True)
    rows = grids.assembled(tables.read_range(cells, "*", strict=False))
    return rows.select(F.substring_index("table_id", "#", 1).alias("uri"), "r", F.array_join("cells", "|").alias("cells"))


@query(f"WITH {NATIONS} SELECT uri, r, n_name || '|' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE CAST(44927 + n_nationkey AS VARCHAR) END AS cells FROM n WHERE r BETWEEN 1 AND 2")
def workbook_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grids.assembled(tables.read_range(tables.formatted(tables.sheet(tables.workbook_cells(_workbooks(spark, sf_dir)), "Nations")), "B2:C3"))
    return rows.select(F.substring_index("table_id", "#", 1).alias("uri"), "r", F.array_join("cells", "|").alias("cells"))


@query("""SELECT DISTINCT 'book-' || n_regionkey AS uri, CAST(i + n_regionkey % 2 AS INT) AS sheet_no, ['Nations', 'Blank & bare', 'More'][i + 1] AS sheet FROM nation, range(3) t(i)
UNION ALL SELECT DISTINCT 'book-' || n_regionkey, 0, 'Cover' FROM nation WHERE n_regionkey % 2 = 1""")
def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.list_sheets(tables.workbook_cells(_workbooks(spark, sf_dir)))


@query(f"""WITH {NATIONS} SELECT uri, 'columns' AS kind, r, n_name || '|' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE CAST(44927 + n_nationkey AS VARCHAR) END AS cells FROM n
UNION ALL SELECT uri, 'rows', r, CAST(n_nationkey AS VARCHAR) || '|' || n_name || '|' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE CAST(44927 + n_nationkey AS VARCHAR) END || '|' || CASE WHEN n_nationkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END FROM n WHERE r BETWEEN 1 AND 2""")
def workbook_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of whole columns and of whole rows."""
    cells = tables.formatted(tables.sheet(tables.workbook_cells(_workbooks(spark, sf_dir)), "Nations"))
    parts = [grids.assembled(tables.read_range(cells, text, strict=False)).withColumn("kind", F.lit(kind)) for kind, text in (("columns", "B:c"), ("rows", "2:3"))]
    return parts[0].unionByName(parts[1]).select(F.substring_index("table_id", "#", 1).alias("uri"), "kind", "r", F.array_join("cells", "|").alias("cells"))


@query("SELECT DISTINCT 'book-' || n_regionkey AS uri, CASE WHEN n_regionkey % 2 = 1 THEN 'Cover' ELSE 'Nations' END AS sheet, CASE WHEN n_regionkey % 2 = 1 THEN 0 ELSE count(*) OVER (PARTITION BY n_regionkey) END AS rows FROM nation")
def workbook_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each workbook's first sheet, which may be empty, and its rows."""
    first = tables.sheet(tables.workbook_cells(_workbooks(spark, sf_dir)))
    return first.groupBy("uri", "sheet").agg(F.countDistinct("r").alias("rows"))


# Word documents


def _run(text: str, fmt: str = "") -> str:
    return f"<w:r><w:rPr>{fmt}</w:rPr><w:t>{text}</w:t></w:r>"


def _word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each supplier: a heading with a bookmark, text with bold parts, a link and a
    reference, a numbered item, code with a comment, a table; styles, properties, a source."""
    own = read(spark, sf_dir, "supplier").select(F.concat(F.lit("doc-"), "s_suppkey").alias("uri"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n"))

    def make(row):
        k, name = row["k"], row["name"]
        body = (
            f'<w:p><w:pPr><w:pStyle w:val="H{k % 3}"/></w:pPr><w:bookmarkStart w:name="_Toc{k}"/>{_run(name)}</w:p>'
            f'<w:p><w:bookmarkStart w:name="_Hlk1"/>{_run("see ")}{_run("a", "<w:b/>")}{_run("b", "<w:b/>")}<w:hyperlink r:id="rId7">{_run("site")}</w:hyperlink><w:hyperlink w:anchor="_Toc{k}">{_run("top")}</w:hyperlink></w:p>'
            f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{k % 2}"/><w:numId w:val="2"/></w:numPr></w:pPr>{_run("item")}</w:p>'
            f'<w:p><w:commentRangeStart w:id="3"/><w:r><w:rPr><w:rFonts w:ascii="Consolas"/></w:rPr><w:t>x = {k}</w:t><w:br/><w:t>y</w:t></w:r></w:p>'
            f"<w:tbl><w:tr><w:tc><w:p>{_run('n')}</w:p></w:tc><w:tc><w:p>{_run(str(row['n']))}</w:p></w:tc></w:tr></w:tbl>"
        )
        styles = "".join(f'<w:style w:type="paragraph" w:styleId="H{i}"><w:name w:val="heading {i + 1}"/><w:basedOn w:val="N"/><w:pPr><w:outlineLvl w:val="{i}"/></w:pPr></w:style>' for i in range(3))
        return {
            "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>",
            "word/styles.xml": f'<w:styles {NS}>{styles}<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="table" w:styleId="G"><w:name w:val="Table Grid"/></w:style></w:styles>',
            "word/_rels/document.xml.rels": f'<Relationships><Relationship Id="rId7" Type="x/hyperlink" Target="http://s/{k}" TargetMode="External"/><Relationship Id="rId{k % 20 + 8}" Type="x/styles" Target="styles.xml"/></Relationships>',
            "word/comments.xml": f'<w:comments {NS}><w:comment w:id="3"><w:p>{_run("Language: " + ("rust" if k % 2 else "sql"))}</w:p></w:comment></w:comments>',
            "docProps/core.xml": f"<p><title>T {k}</title><creator>{name}</creator><modified>2024-01-02T03:04:05Z</modified></p>",
            "kept/source.adoc": f"= Source {k}",
        }

    return _packages(own, make)


S = "SELECT *, 'doc-' || s_suppkey AS uri FROM supplier"


@query(f"""SELECT uri, array_to_string(['= T ' || s_suppkey, ':author: ' || s_name, ':revdate: 2024-01-02', '', repeat('=', CAST(s_suppkey % 3 + 2 AS INT)) || ' ' || s_name, '', 'see *ab*link:http://s/' || s_suppkey || '[site]link:#_Toc' || s_suppkey || '[top]', '',
 repeat('.', CAST(s_suppkey % 2 + 1 AS INT)) || ' item', '', '[source,' || CASE WHEN s_suppkey % 2 = 1 THEN 'rust' ELSE 'sql' END || ']', '----', 'x = ' || s_suppkey, 'y', '----', '', '[options="header"]', '|===', '|n |' || s_nationkey, '|==='], chr(10)) AS text FROM ({S})""")
def word_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _word(spark, sf_dir)
    return ooxml.to_asciidoc(ooxml.word_blocks(files), ooxml.styles(files), ooxml.relationships(files), ooxml.comments(files), ooxml.core_properties(files))


@query(f"SELECT uri, '_Toc' || s_suppkey AS bookmark, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS semantic_id, 'toc' AS anchor_type, s_name AS target_heading FROM ({S})")
def word_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.anchors_of(_word(spark, sf_dir)).drop("original_bookmark")


@query(f"SELECT uri, 'link1' AS link_id, true AS is_external, 'http://s/' || s_suppkey AS url, NULL AS anchor_target FROM ({S}) UNION ALL SELECT uri, 'link2', false, NULL, '_Toc' || s_suppkey FROM ({S})")
def word_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _word(spark, sf_dir)
    return ooxml.hyperlinks(ooxml.word_blocks(files), ooxml.relationships(files)).select("uri", "link_id", "is_external", "url", "anchor_target")


@query(f"SELECT uri, 'H' || i AS style_id, 'N' AS based_on, CAST(i AS INT) AS outline_level, false AS is_default FROM ({S}), range(3) t(i) UNION ALL SELECT uri, 'N', NULL, NULL, true FROM ({S}) UNION ALL SELECT uri, 'G', NULL, NULL, false FROM ({S})")
def word_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.styles(_word(spark, sf_dir)).select("uri", "style_id", "based_on", "outline_level", "is_default")


@query(f"SELECT uri, unnest(['heading1', 'heading2', 'heading3', 'paragraph', 'table', 'list_bullet', 'list_number', 'code_block', 'table_header', 'admonition']) AS element, unnest(['H0', 'H1', 'H2', 'N', 'G', 'ListBullet', 'ListNumber', 'Normal', 'TableGrid', 'Normal']) AS style_id FROM ({S})")
def word_style_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.style_map(ooxml.styles(_word(spark, sf_dir)))


@query(f"SELECT uri, '[styles]' || chr(10) || 'heading1 = \"H0\"' || chr(10) || 'heading2 = \"H1\"' || chr(10) || 'heading3 = \"H2\"' || chr(10) || 'paragraph = \"N\"' || chr(10) || 'table = \"G\"' || chr(10) AS text FROM ({S})")
def word_style_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.style_config(ooxml.styles(_word(spark, sf_dir)))


@query(f"SELECT uri, '3' AS comment_id, CASE WHEN s_suppkey % 2 = 1 THEN 'rust' ELSE 'sql' END AS language, 'T ' || s_suppkey AS title, s_name AS author, '2024-01-02T03:04:05Z' AS modified FROM ({S})")
def word_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _word(spark, sf_dir)
    return ooxml.comments(files).join(ooxml.core_properties(files), "uri").select("uri", "comment_id", "language", "title", "author", "modified")


@query(f"SELECT uri, 'rId' || (s_suppkey % 20 + 9) AS rid FROM ({S})")
def word_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.next_relationship_id(ooxml.relationships(_word(spark, sf_dir)))


@query(f"SELECT uri, 'source.adoc' AS name, sha256('= Source ' || s_suppkey) AS hash, s_suppkey % 5 = 0 AS drifted FROM ({S})")
def word_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ooxml.embedded(ooxml.parts(_word(spark, sf_dir)), "kept/").select("uri", "name", "hash")
    now = kept.withColumn("hash", F.when(F.substring_index("uri", "-", -1).cast("int") % 5 == 0, "other").otherwise(F.col("hash")))
    gone = ooxml.drifted(kept, now).select("uri", F.lit(True).alias("drifted"))
    return kept.join(gone, "uri", "left").select("uri", "name", "hash", F.coalesce("drifted", F.lit(False)).alias("drifted"))


@query(f"SELECT uri, kind, n, bold, mono FROM (SELECT uri, unnest(['paragraph', 'table']) AS kind, unnest([4, 1]) AS n, unnest([1, 0]) AS bold, unnest([1, 0]) AS mono FROM ({S}))")
def word_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ooxml.word_blocks(_word(spark, sf_dir)).withColumn("runs", ooxml.merged_runs(F.col("runs")))
    some = lambda flag: F.sum(F.exists("runs", lambda r: r[flag]).cast("int")).cast("int")
    return found.groupBy("uri", "kind").agg(F.count("*").cast("int").alias("n"), some("bold").alias("bold"), some("mono").alias("mono"))


BOX = '<mc:AlternateContent><mc:Choice Requires="wps"><w:drawing><wp:anchor><wps:wsp><wps:txbx><w:txbxContent>{}</w:txbxContent></wps:txbx></wps:wsp></wp:anchor></w:drawing></mc:Choice><mc:Fallback><w:pict><w:txbxContent>{}</w:txbxContent></w:pict></mc:Fallback></mc:AlternateContent>'
MORE = 'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:wps="http://schemas.microsoft.com/office/word/2010/wordprocessingShape" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


@query("""SELECT 'doc-' || p_partkey AS uri, CAST(unnest(range(0, 8)) AS INT) AS idx, unnest(['paragraph', 'paragraph', 'paragraph', 'paragraph', 'paragraph', 'table', 'paragraph', 'paragraph']) AS kind,
unnest([p_name, 'boxed ' || p_brand, 'kept ' || p_size || ' inserted', 'host', 'in a box of ' || p_partkey, 'cell' || chr(10) || 'inner ' || p_size || chr(10) || chr(10) || 'boxed in a cell|' || p_brand, 'drawn ' || p_type, 'last']) AS text,
unnest([CASE WHEN p_partkey % 2 = 0 THEN 'H1' END, 'S', NULL, NULL, 'B', NULL, NULL, NULL]) AS style_id FROM part""")
def word_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word documents whose text stands in content controls, insertions, text boxes, shapes and
    nested tables, with deleted text and older properties between."""
    own = read(spark, sf_dir, "part").select(F.concat(F.lit("doc-"), "p_partkey").alias("uri"), F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))

    def make(row):
        k, para = row["k"], lambda text, props="": f"<w:p>{props}{_run(text)}</w:p>"
        style = lambda s: f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>'
        was = '<w:pPr><w:pStyle w:val="H1"/><w:pPrChange><w:pPr><w:pStyle w:val="Old"/></w:pPr></w:pPrChange></w:pPr>' if k % 2 == 0 else '<w:pPr><w:pPrChange><w:pPr><w:pStyle w:val="Old"/></w:pPr></w:pPrChange></w:pPr>'
        body = (
            f"{para(row['name'], was)}"
            f"<w:sdt><w:sdtPr/><w:sdtContent><w:p>{style('S')}<w:sdt><w:sdtContent>{_run('boxed ')}</w:sdtContent></w:sdt>{_run(row['brand'])}</w:p></w:sdtContent></w:sdt>"
            f"<w:p>{_run('kept ')}<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:moveFrom>{_run('moved away')}</w:moveFrom><w:ins>{_run(str(row['size']))}<w:smartTag>{_run(' inserted')}</w:smartTag></w:ins></w:p>"
            f"<w:p><w:r>{BOX.format(para(f'in a box of {k}', style('B')), para('for old readers'))}</w:r>{_run('host')}</w:p>"
            f"<w:tbl><w:tr><w:tc>{para('cell')}<w:tbl><w:tr><w:tc>{para('inner ' + str(row['size']))}</w:tc></w:tr></w:tbl><w:p><w:r>{BOX.format(para('boxed in a cell'), para('x'))}</w:r></w:p></w:tc><w:sdt><w:sdtContent><w:tc>{para(row['brand'])}</w:tc></w:sdtContent></w:sdt></w:tr></w:tbl>"
            f"<w:p><w:r><w:drawing><wps:wsp><a:p><a:r><a:t>drawn {row['type']}</a:t></a:r></a:p></wps:wsp></w:drawing></w:r></w:p>{para('last')}"
        )
        return {"word/document.xml": f"<w:document {NS} {MORE}><w:body>{body}</w:body></w:document>"}

    found = ooxml.word_blocks(_packages(own, make))
    cells = F.array_join(F.transform(F.get("rows", F.lit(0)), lambda c: F.rtrim(c, F.lit("\n"))), "|")
    said = found.withColumn("text", F.when(F.col("kind") == "table", cells).otherwise(ooxml.plain_text(F.col("runs")))).where("text <> ''")
    order = Window.partitionBy("uri").orderBy("idx")
    return said.select("uri", (F.row_number().over(order) - 1).alias("idx"), "kind", "text", "style_id")


# presentations


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each nation with eleven layouts, of which the tenth is for pictures."""
    own = read(spark, sf_dir, "nation").select(F.concat(F.lit("deck-"), "n_nationkey").alias("uri"), F.col("n_nationkey").alias("k"))

    def make(row):
        layouts = {f"ppt/slideLayouts/slideLayout{i}.xml": f'<p:sldLayout {PNS}><p:cSld name="{"Picture" if i == 10 else "Content"} {i}"><p:ph type="{"pic" if i == 10 else "body"}" idx="{i}"/></p:cSld></p:sldLayout>' for i in range(1, 12)}
        return layouts | {"ppt/presentation.xml": f'<p:presentation {PNS}><p:sldSz cx="{row["k"] + 1}" cy="2"/></p:presentation>'} | ({"ppt/theme/theme1.xml": f'<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" name="T{row["k"]}"/>'} if row["k"] % 2 else {})

    return _packages(own, make)


@query("SELECT 'deck-' || n_nationkey AS uri, CAST(i AS INT) AS layout_index, CASE WHEN i = 10 THEN 'Picture 10' ELSE 'Content ' || i END AS name, CASE WHEN i = 10 THEN 'image' ELSE 'content' END AS layout, CAST(i AS INT) AS idx FROM nation, range(1, 12) t(i)")
def slide_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.slide_layouts(_templates(spark, sf_dir)).select("uri", "layout_index", "name", "layout", F.get("placeholders", F.lit(0))["idx"].alias("idx"))


@query("SELECT 'deck-' || n_nationkey AS uri, hint AS layout_hint, CASE WHEN hint = 'image' THEN 10 ELSE 1 END AS layout_index, n_nationkey + 1 AS width, CASE WHEN n_nationkey % 2 = 1 THEN 'T' || n_nationkey ELSE 'Default' END AS theme FROM nation, (SELECT unnest(['image', 'quote']) AS hint)")
def slide_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _templates(spark, sf_dir)
    asked = files.select("uri", F.explode(F.array(F.lit("image"), F.lit("quote"))).alias("layout_hint"))
    met = ooxml.layout_for(asked, ooxml.slide_layouts(files)).join(ooxml.slide_size(files), "uri").join(ooxml.themes(files).select("uri", F.col("name").alias("theme")), "uri")
    return met.select("uri", "layout_hint", "layout_index", "width", "theme")
