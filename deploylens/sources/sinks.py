"""Sinks: Parquet and CSV directories, and one workbook."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sheet names, headers and the columns they show. Fixed values.
SHEETS = {
    "Routes": ("URL", "HTTP_METHOD", "FRAMEWORK", "CLASS_NAME", "CLASS_PATH", "METHOD_NAME", "SOURCE_JAR"),
    "Controllers": ("FILE_PATH", "CLASS_NAME", "FRAMEWORK"),
    "Classes": ("CLASS_NAME", "CLASS_PATH", "SOURCE_JAR"),
    "Framework": ("FRAMEWORK", "VERSION", "CONFIDENCE", "EVIDENCE"),
    "Components": ("COMPONENT", "TYPE", "VERSION", "SOURCE"),
}
#: Rows a sheet can hold besides its header, and rows of a piece of one.
SHEET_ROWS, FRAGMENT_ROWS = 1_048_575, 1000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def routes_view(routes: DataFrame) -> DataFrame:
    return routes.select(F.col("url").alias("URL"), F.array_join("http_methods", ", ").alias("HTTP_METHOD"), F.col("framework").alias("FRAMEWORK"), F.col("class_name").alias("CLASS_NAME"), F.col("source_file").alias("CLASS_PATH"), F.col("method_name").alias("METHOD_NAME"), F.col("archive_name").alias("SOURCE_JAR"))


def controllers_view(controllers: DataFrame) -> DataFrame:
    return controllers.select(F.col("file_path").alias("FILE_PATH"), F.col("class_name").alias("CLASS_NAME"), F.col("framework").alias("FRAMEWORK"))


def classes_view(classes: DataFrame) -> DataFrame:
    return classes.select(F.col("full_name").alias("CLASS_NAME"), F.col("file_path").alias("CLASS_PATH"), F.col("archive_name").alias("SOURCE_JAR"))


def frameworks_view(frameworks: DataFrame) -> DataFrame:
    return frameworks.select(F.col("name").alias("FRAMEWORK"), F.col("version").alias("VERSION"), F.col("confidence").alias("CONFIDENCE"), F.array_join("evidence", "; ").alias("EVIDENCE"))


def components_view(components: DataFrame) -> DataFrame:
    return components.select(F.col("name").alias("COMPONENT"), F.col("type").alias("TYPE"), F.col("version").alias("VERSION"), F.array_join("jars", ", ").alias("SOURCE"))


def write_parquet(views: dict[str, DataFrame], path: str) -> None:
    for name, df in views.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_csv(views: dict[str, DataFrame], path: str) -> None:
    for name, df in views.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def _column(k: int) -> str:
    return (_column(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def _cell(v, style: str = "") -> str:
    if isinstance(v, int):
        return f"<c{style}><v>{v}</v></c>"
    clean = "".join(c for c in str(v or "") if c >= " " or c in "\t\n")
    return f'<c{style} t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def _head(header: tuple[str, ...]) -> str:
    widths = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{min(60.0, max(12.0, 1.5 * len(h)))}" customWidth="1"/>' for k, h in enumerate(header))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><cols>{widths}</cols><sheetData><row>{"".join(_cell(h, " s=\"1\"") for h in header)}</row>'


def fragments(df: DataFrame, rows: int = FRAGMENT_ROWS) -> DataFrame:
    """(n, xml): the rows of a relation as pieces of a sheet, made by the tasks that hold them and in their order. Places are left to the reader, who counts."""
    import pyarrow as pa

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                cols = [c.to_pylist() for c in part.columns]
                xml = "".join(f"<row>{''.join(map(_cell, row))}</row>" for row in zip(*cols, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([xml])], ["n", "xml"])

    return df.mapInArrow(each, "n int, xml string")


def write_xlsx(views: dict[str, DataFrame], path: str, sheet_rows: int = SHEET_ROWS) -> dict[str, int]:
    """One workbook; rows by sheet. Tasks make the sheets' pieces, and the driver passes them on to the file one at a time. A relation with more rows than a sheet holds
    goes on in further sheets."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    sheets: dict[str, int] = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in (n for n in SHEETS if n in views):
            header = SHEETS[name]
            pieces = fragments(views[name], min(FRAGMENT_ROWS, sheet_rows)).toLocalIterator(prefetchPartitions=True)
            left, part = next(pieces, None), 0
            while left is not None or not part:
                part += 1
                title = name if part == 1 else f"{name} {part}"
                sheets[title] = 0
                with z.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True) as out:
                    out.write(_head(header).encode())
                    while left is not None and sheets[title] + left["n"] <= sheet_rows:
                        out.write(left["xml"].encode())
                        sheets[title] += left["n"]
                        left = next(pieces, None)
                    out.write(f'</sheetData><autoFilter ref="A1:{_column(len(header) - 1)}{sheets[title] + 1}"/></worksheet>'.encode())
        numbers = range(1, len(sheets) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in numbers)
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        named = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(numbers, sheets, strict=True))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{rel}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId{len(sheets) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Arial"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF4472C4"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>')
    return sheets
