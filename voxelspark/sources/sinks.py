"""Files of a given content, workbooks and example tables: what is written for other programs to read."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.operators.learning import standardizer


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _put(store: fs.FileSystem, path: str, content: bytes) -> None:
    """Written beside and moved into place, so a task that is run again leaves whole files."""
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as out:
        out.write(content)
    store.move(beside, path)


def write_files(files: DataFrame, folder: str) -> None:
    """A file for each row of ``path, content`` (relative path, bytes) under a folder that all machines share; an existing one is replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _place(folder)
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                _put(store, f"{base.rstrip('/')}/{path}", bytes(content))
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, "n long").agg(F.sum("n")).first()


def write_thresholds(thresholds: DataFrame, folder: str) -> None:
    """``tile_id, view_id, t0, t1`` as files tile/view that hold two numbers."""
    write_files(thresholds.select(F.concat_ws("/", "tile_id", "view_id").alias("path"), F.concat_ws(",", "t0", "t1").alias("content")), folder)


#: The columns of an evaluation log.
LOG = "substack,method,parameter,precision,recall,F1,TP,FP,FN,|true|,|pred|"


def write_eval_logs(scores: DataFrame, folder: str, method: str = "unfiltered", parameter: str = "0") -> None:
    """A log tile/eval.log for each row of ``tile_id, tp, fp, fn, precision, recall, f1``."""
    line = F.concat_ws(",", "tile_id", F.lit(method), F.lit(parameter), "precision", "recall", "f1", "tp", "fp", "fn", F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp"))
    write_files(scores.select(F.concat("tile_id", F.lit("/eval.log")).alias("path"), F.concat(F.lit(LOG + "\n"), line, F.lit("\n")).alias("content")), folder)


def workbook(sheets: dict[str, pd.DataFrame]) -> bytes:
    """A spreadsheet file (Office Open XML) with a sheet a table: reports, so small."""
    letters = lambda k: (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)

    def cell(row: int, column: int, v) -> str:
        at = f"{letters(column)}{row}"
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return ""
        if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    names = list(sheets)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(names) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>",
    }
    for k, df in enumerate(sheets.values(), 1):
        rows = [list(df.columns), *df.itertuples(index=False)]
        body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, head + text)
    return out.getvalue()


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Report tables as one spreadsheet file, a sheet a table."""
    store, place = _place(path)
    _put(store, place, workbook({name: df.toPandas() for name, df in sheets.items()}))


def write_examples(examples: DataFrame, path: str, features: str = "features") -> None:
    """A training set: standardised ``features`` (arrays of one length) and the other columns, with mean and deviation of each position beside it."""
    mean, std = standardizer(examples.select(F.col(features).alias("patch")))
    figures = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, std, strict=True)])
    unit = F.zip_with(features, figures, lambda v, f: (v - f["m"]) / f["s"])
    examples.withColumn(features, unit).write.mode("overwrite").parquet(f"{path}/rows")
    examples.sparkSession.createDataFrame([(k, float(m), float(s)) for k, (m, s) in enumerate(zip(mean, std, strict=True))], "pos int, mean double, std double").write.mode("overwrite").parquet(f"{path}/figures")


def read_examples(spark: SparkSession, path: str, share: tuple[float, float] = (0.0, 1.0), shuffle: int | None = None) -> DataFrame:
    """Rows of a training set whose seeded hash falls in ``share`` of the whole (so shares that don't overlap make training and test sets), in seeded order if asked for."""
    rows = spark.read.parquet(f"{path}/rows")
    roll = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) / 1_000_000
    rows = rows.where((roll >= share[0]) & (roll < share[1]))
    return rows if shuffle is None else rows.orderBy(F.xxhash64("id", F.lit(shuffle)), "id")


def read_figures(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each position (a row a position)."""
    rows = spark.read.parquet(f"{path}/figures").orderBy("pos").collect()
    return np.array([r["mean"] for r in rows]), np.array([r["std"] for r in rows])
