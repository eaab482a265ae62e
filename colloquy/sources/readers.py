"""Readers: globs that skip what can't be read, files keyed by name, optional inputs, date windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import work_folder
from .probe import probe

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "subheader", "transcript_subheader", "speakers", "body", "list_item")])
BAD = "file_path string, error string"


def files_under(spark: SparkSession, path: str, pattern: str = "*.parquet") -> list[str]:
    """Sorted file names, through the file system that the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{pattern}")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in found or [])


def read_glob(
    spark: SparkSession, path: str, pattern: str = "*.parquet", schema: T.StructType | None = None, keep=None, pages: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(rows of all readable files, report of the others). Error if none match or none can be read.

    Tasks try footers and, unless ``pages`` is false, all pages of the files (see ``probe``); the rows are one scan of the good ones.
    """
    report = reported(probe(spark, path, pattern, pages, keep))
    if report.limit(1).count() == 0:
        raise FileNotFoundError(f"no file matches {pattern} in {path}")
    good = readable(report)
    if not good:
        raise OSError(f"no file in {path} can be read")
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return reader.parquet(*good), report.filter("error IS NOT NULL").select("file_path", "error")


def reported(report: DataFrame) -> DataFrame:
    """The report written down, so that files are tried once."""
    spark, where = report.sparkSession, work_folder(report.sparkSession, "files")
    report.write.parquet(where)
    return spark.read.schema(report.schema).parquet(where)


def readable(report: DataFrame) -> list[str]:
    """Names of the files without an error, sorted: what a scan is told, one name for each file."""
    return sorted(unquote(r["file_path"]) for r in report.filter("error IS NULL").select("file_path").collect())


def read_universe(spark: SparkSession, path: str, column: str = "Symbol") -> DataFrame:
    return spark.read.csv(path, header=True).select(X.ticker(F.col(column)).alias(column)).filter(F.col(column).isNotNull()).distinct()


def file_key(name: Column) -> Column:
    """The normalised stem of a file name."""
    return X.ticker(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?i)\.(parquet|pq)$", ""))


def key_of(name: str) -> str:
    """``file_key`` of one file name, outside Spark."""
    return re.sub(r"(?i)\.(parquet|pq)$", "", name.rsplit("/", 1)[-1]).strip().upper().replace(".", "-")


def files_below(spark: SparkSession, path: str) -> list[str]:
    """All file names under ``path``, from one listing of its file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found, out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(f for f in out if f.lower().endswith((".parquet", ".pq")))


def read_panels(spark: SparkSession, path: str, keys: Iterable[str] | None = None) -> DataFrame:
    """Panels under ``path`` in one read: ticker_norm from the file name; of several files of a key the best one counts.

    Best: ``KEY.parquet`` at the top, then ``KEY.pq`` at the top, then any other by path. With
    ``keys``, only files of these keys are opened.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true")
    if keys is None:
        rows = reader.parquet(path)
    else:
        wanted = {key_of(k) for k in keys}
        names = [f for f in files_below(spark, path) if key_of(f) in wanted]
        if not names:
            raise FileNotFoundError(f"no panel of {sorted(wanted)[:5]} in {path}")
        rows = reader.parquet(*names)
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("ticker_norm", file_key(F.col("_file")))
    top = F.regexp_replace(F.regexp_replace("_file", r"/[^/]*$", ""), r"^file:/*", "/") == F.lit(path.removeprefix("file:").rstrip("/"))
    rank = F.when(top & F.lower("_file").endswith(".parquet"), 0).when(top & F.lower("_file").endswith(".pq"), 1).otherwise(2)
    best = rows.groupBy("ticker_norm").agg(F.min(F.struct(rank.alias("r"), "_file")).alias("_b")).select("ticker_norm", F.col("_b._file").alias("_file"))
    out = rows.join(best, ["ticker_norm", "_file"], "left_semi").drop("_file")
    if "symbol" in out.columns:
        out = out.withColumn("ticker", F.coalesce("ticker", "symbol") if "ticker" in out.columns else F.col("symbol"))
    return out.withColumn("date", F.col("date").try_cast("date")) if "date" in out.columns else out


def optional(spark: SparkSession, path: str, needed: Iterable[str]) -> DataFrame | None:
    """The table, or None where it is missing, can't be read or lacks a column."""
    try:
        df = spark.read.parquet(path)
    except (PySparkException, Py4JJavaError):  # missing, or with a footer that is none
        return None
    return df if set(needed) <= set(df.columns) else None


def columns_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """These columns of a table (only they are read), or an empty table of ``schema`` where it is missing, can't be read or lacks one."""
    empty = spark.createDataFrame([], schema)
    found = optional(spark, path, empty.columns)
    return empty if found is None else found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema])


def date_windows(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """(start, end): consecutive inclusive windows, the last one cut at the end."""
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    out = spark.range(1).select(F.explode(F.sequence(first, last, F.expr(f"interval {days} day"))).alias("start"))
    return out.select("start", F.least(last, F.date_add("start", days - 1)).alias("end"))


def for_windows(windows: DataFrame, work: Callable[[str, str], object]) -> list[tuple[str, str, str | None]]:
    """Calls ``work(start, end)`` for each window in order; (start, end, error or None). One that fails doesn't end the rest."""
    out = []
    for r in windows.orderBy("start").collect():  # one row for each window
        error = None
        try:
            work(str(r["start"]), str(r["end"]))
        except Exception as e:  # noqa: BLE001  the error is the report
            error = (str(e) or type(e).__name__).splitlines()[0][:500]
        out.append((str(r["start"]), str(r["end"]), error))
    return out


#: What the class of an element must hold, per field; True where all elements count.
ARTICLE = {
    "title": ("article-title__articleTitle__heading", False), "subheader": ("article-title__articleTitle__subHeading", False),
    "transcript_subheader": ("article-title__articleTitle__transcriptSubHeader", False),
    "speakers": ("transcript-speakers__transcriptSpeakers__content", True), "body": ("slate-editor__container", True),
}
BREAKS = frozenset("br p div li tr h1 h2 h3 h4 h5 h6 section article ul ol table".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Elements(HTMLParser):
    """Texts of the elements whose class holds a mark, nested ones included."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.open, self.found, self.hidden = 0, [], {k: [] for k in ARTICLE}, 0

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.handle_data("\n")
        if tag in EMPTY:
            return
        self.depth += 1
        self.hidden += tag in ("script", "style")
        kind = dict(attrs).get("class") or ""
        for name, (mark, _) in ARTICLE.items():
            if tag == "div" and mark in kind:  # in the order in which they begin
                self.found[name].append([])
                self.open.append((self.depth, self.found[name][-1]))

    def handle_endtag(self, tag):
        if tag in EMPTY or not self.depth:
            return
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        self.open = [o for o in self.open if o[0] != self.depth]
        self.depth -= 1
        if tag in BREAKS:
            self.handle_data("\n")

    def handle_data(self, data):
        if not self.hidden:
            for _, parts in self.open:
                parts.append(data)


@F.pandas_udf(T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in ARTICLE]))
def elements(html: pd.Series) -> pd.DataFrame:
    rows = []
    for page in html:
        parser = Elements()
        parser.feed(page or "")
        parser.close()
        rows.append([["".join(parts) for parts in parser.found[k]] for k in ARTICLE])
    return pd.DataFrame(rows, columns=list(ARTICLE))


def article_fields(pages: DataFrame, html: str = "html", key: str | None = None) -> DataFrame:
    """The five fields of stored transcript pages, cleaned: the first element of a field, or all different ones a line each; ``list_item`` from ``key``."""
    out = pages.withColumn("_e", elements(F.col(html)))
    for name, (_, many) in ARTICLE.items():
        text = X.joined_texts(F.col(f"_e.{name}")) if many else X.as_text(F.get(F.col(f"_e.{name}"), 0))
        out = out.withColumn(name, X.clean_text(text))
    return (out.withColumn("list_item", F.col(key).cast("string")) if key else out).drop("_e")


def best_captures(captures: DataFrame, key: str, order: str) -> DataFrame:
    """One row per ``key``: its first capture whose body is there to stay, else its last one. Needs the columns of ``article_fields``."""
    ready = ~X.is_placeholder(F.col("body"))
    rank = F.struct((~ready).alias("a"), F.when(ready, F.col(order)).otherwise(-F.col(order)).alias("b"))
    row = F.struct(*[F.col(f"`{c}`") for c in captures.columns])
    return captures.groupBy(F.col(key).alias("_k")).agg(F.min_by(row, rank).alias("_r")).select("_r.*")


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title and visible text of stored pages, cleaned."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", "\n")
    return pages.withColumn("title", X.clean_text(title)).withColumn("body", X.clean_text(body))
