"""Files: directory CSV in unknown encodings, alias lists, XLSX sheets, XML entries, event logs."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kvartal.functions import text as X
from kvartal.functions.dual import name
from kvartal.operators.row_parse import fields_of
from kvartal.operators.sheet import looks_headerless, tag_summary

#: Headers of a directory file and the names of its columns, in the file's order.
DIRECTORY_HEADERS = {
    "Область": "region", "Адміністративний район(старий)": "old_district", "Адміністративний район(новий)": "new_district", "Найменування ОТГ(довідково)": "otg",
    "Населений пункт": "city", "Індекс НП": "city_index", "Назва вулиці": "street", "№ будинку": "buildings", "сортувальний центр 1 рівня": "sort_center_1",
    "сортувальний центр 2 рівня": "sort_center_2", "Адміністративний район доставки(вручення)": "delivery_district",
    "Технологічний індекс ОПЗ доставки(вручення)": "tech_index", "Особливості функціонування ВПЗ": "features", "Тимчасово не функціонує": "not_working",
}
#: Encodings in order of trial; the last two accept any bytes.
ENCODINGS = ("UTF-8", "windows-1251", "ISO-8859-1")


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_name, line_no, line of every line of the files, in the first encoding that fits the whole file.

    Files are decoded on the executors. A byte-order mark is no part of the first line; \\r\\n ends a line too.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_name"), "content")

    def decode(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for file, content in zip(b["file_name"], b["content"]):
                for encoding in ENCODINGS:
                    try:
                        body = bytes(content).decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                lines = body.removeprefix("\ufeff").replace("\r\n", "\n").split("\n")
                rows += [(file, i + 1, x) for i, x in enumerate(lines if lines[-1] else lines[:-1])]
            yield pd.DataFrame(rows, columns=["file_name", "line_no", "line"])

    return raw.mapInPandas(decode, "file_name string, line_no int, line string")


def read_directory(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A directory CSV with its Ukrainian headers, as text columns with '' for missing values, trimmed."""
    df = spark.read.csv(path, sep=";", header=True, encoding=encoding)
    named = {h.replace("\ufeff", "").strip(): h for h in df.columns}
    cell = lambda h: F.coalesce(F.regexp_replace(F.col(f"`{named[h]}`"), r"(?U)^\s+|\s+$", ""), F.lit(""))
    return df.select(*[(cell(h) if h in named else F.lit("")).alias(c) for h, c in DIRECTORY_HEADERS.items()])


def read_directory_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name and the directory's columns of all CSV files under path, each in its own encoding and with its own order
    of columns: '' for missing values, cells trimmed. Lines with broken quoting are left out (row_parse tells
    why)."""
    lines = decoded_lines(spark, path)
    cells = lines.where(lines.line != "").select("file_name", "line_no", fields_of(F.col("line")).alias("cells")).where(F.col("cells").isNotNull())
    clean = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    heads = cells.where("line_no = 1").select("file_name", F.transform("cells", clean).alias("head"))
    body = cells.where("line_no > 1").join(heads, "file_name")
    cell = lambda h: F.coalesce(clean(F.get("cells", F.array_position("head", h).cast("int") - 1)), F.lit(""))
    return body.select("file_name", *[F.when(F.array_contains("head", h), cell(h)).otherwise("").alias(c) for h, c in DIRECTORY_HEADERS.items()])


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """city, old_street, new_street of an alias list: normalized keys, rows with an empty part left out, the
    last of repeated keys (by line) holds."""
    df = spark.read.csv(path, header=True).withColumn("_n", F.monotonically_increasing_id())
    df = df.toDF(*[c.replace("\ufeff", "") for c in df.columns]).where("trim(city) != '' AND trim(old_street) != '' AND trim(new_street) != ''")
    keyed = df.select(X.normalize_city(name("city")).col.alias("city"), X.normalize_street(name("old_street")).col.alias("old_street"), F.trim("new_street").alias("new_street"), "_n")
    return keyed.groupBy("city", "old_street").agg(F.max_by("new_street", "_n").alias("new_street"))


def with_aliases(df: DataFrame, aliases: DataFrame, city: str = "city", street: str = "street") -> DataFrame:
    """df with street_aliases: the normalized street, 'відсутня' for a nameless one, and the city's new name.

    Alias lists are small; Spark broadcasts one below its threshold and shuffles a larger one.
    """
    own = df.withColumn("_c", X.normalize_city(name(city)).col).withColumn("_s", X.normalize_street(name(street)).col)
    a = aliases.select(F.col("city").alias("_c"), F.col("old_street").alias("_s"), X.normalize_street(name("new_street")).col.alias("_new"))
    nameless = F.when(F.col("_s") == "без назви", F.lit("відсутня"))
    names = F.array_distinct(F.array_compact(F.array(F.when(F.col("_s") != "", F.col("_s")), nameless, F.when(F.col("_s") != "", F.col("_new")))))
    return own.join(a, ["_c", "_s"], "left").withColumn("street_aliases", names).drop("_c", "_s", "_new")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(path: str) -> Iterator[list[str]]:
    """Rows of the first sheet of an XLSX file as text: leading zeros stay, whole numbers have no decimals."""
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        first = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))[0]
        with z.open(first) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                cells: list[str] = []
                for c in row.iter(f"{_NS}c"):
                    column = 0
                    for letter in re.match(r"[A-Z]*", c.get("r", "")).group():
                        column = column * 26 + ord(letter) - 64
                    while column and len(cells) < column - 1:
                        cells.append("")
                    v = c.find(f"{_NS}v")
                    text = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    if c.get("t") == "s":
                        text = shared[int(text)]
                    elif c.get("t") is None and re.fullmatch(r"-?\d+\.0+", text):
                        text = text.split(".")[0]
                    cells.append(text)
                yield cells
                row.clear()


#: Fixed value: rows that a sheet can hold.
MOST_ROWS = 1_048_576


def write_xlsx(df: DataFrame, path: str) -> str:
    """A sheet of text cells for a spreadsheet program; rows stream to the file, one at a time. Gives the path, which ends
    in .xlsx whatever old format was asked for. Raises ValueError if the rows don't fit on a sheet; such tables
    belong in partitioned files."""
    path = re.sub(r"\.xls$", ".xlsx", path)
    if df.limit(MOST_ROWS).count() >= MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS - 1} rows")
    from xml.sax.saxutils import escape

    def line(cells) -> str:
        return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if x is None else str(x))}</t></is></c>' for x in cells) + "</row>"

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0"?><worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode())
            f.write(line(df.columns).encode())
            for row in df.toLocalIterator():
                f.write(line(row).encode())
            f.write(b"</sheetData></worksheet>")
    return path


class SheetSource(DataSource):
    """spark.read.format("kvartal_xlsx").load(path): the first sheet, all columns text. A first row that looks
    like data is one; columns are then named 1, 2, 3 ..."""

    @classmethod
    def name(cls) -> str:
        return "kvartal_xlsx"

    def _head(self) -> tuple[list[str], bool]:
        first = next(sheet_rows(self.options["path"]), [])
        bare = looks_headerless(first)
        return [str(i + 1) if bare or not x else x for i, x in enumerate(first)], bare

    def schema(self) -> str:
        return ", ".join(f"`{c.replace('`', '``')}` string" for c in self._head()[0]) or "`1` string"

    def reader(self, schema):
        return _SheetReader(self.options["path"], len(schema.fields), not self._head()[1])


class _SheetReader(DataSourceReader):
    def __init__(self, path: str, width: int, header: bool):
        self.path, self.width, self.header = path, width, header

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for i, cells in enumerate(sheet_rows(self.path)):
            if i or not self.header:
                yield tuple((cells + [""] * self.width)[: self.width])


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SheetSource)
    return spark.read.format("kvartal_xlsx").load(path)


def read_entries(spark: SparkSession, path: str, tag: str, columns: list[str]) -> DataFrame:
    """Entry elements of XML answers as text columns, '' for missing ones; files that don't parse give none."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").schema(schema).load(path)
    return df.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in columns])


def request_key(endpoint: str, parameters: str = "parameters"):
    """Key of a cached answer: endpoint and sorted parameters (a map column), hashed."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(parameters)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "&")
    return F.sha2(F.concat(F.lit(endpoint + "|"), pairs), 256)


def append_events(df: DataFrame, event: str, path: str) -> None:
    """One JSON line per row, with the event's name and time."""
    df.select(F.lit(event).alias("event"), F.current_timestamp().alias("at"), F.struct(*df.columns).alias("data")).write.mode("append").json(path)


def save_report(df: DataFrame, path: str) -> None:
    """A quality report as CSV with header, in partitioned files as any table of its size, and its summary beside it as JSON
    lines (rows analyzed, modes, tags)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    tag_summary(df).write.mode("overwrite").json(f"{path}.summary.json")
