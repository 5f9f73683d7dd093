"""Sources: documents as bytes, HTML pages, manifests, JSON dumps, and host callbacks for parsing and embedding."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterable
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Elements whose text is no content, elements that hold a line of text, sizes given to headings and text.
BOILERPLATE = {"script", "style", "nav", "header", "footer", "aside", "noscript", "form", "svg"}
LEAVES = {"p", "li", "figcaption", "dt", "dd", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"}
SIZES = {"h1": 24.0, "h2": 18.0, "h3": 17.0}
BODY_SIZE = 14.0
#: Pages with less text are not worth an extraction.
LEAST_TEXT = 200
#: A page whose own text layer has fewer characters is read again by other means.
SPARSE = 40
#: Embeddings are asked for in batches of this many texts.
EMBEDDING_BATCH = 96

PAGE_SCHEMA = (
    "title string, text string, page_lines array<struct<text:string,top:double,avg_font_size:double>>, page_tables array<struct<rows:array<array<string>>,top:double,bottom:double>>, median_font_size double"
)


class _Page(HTMLParser):
    """Collects lines and tables in document order; each takes the next position. A leaf's text includes all it contains."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.tables, self.top = [], [], 0.0
        self.title, self.in_title, self.skipped = None, False, 0
        self.leaf, self.nested, self.parts = None, 0, []
        self.rows, self.cell, self.depth = None, None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "title" and not self.skipped:
            self.in_title = True
        elif tag in BOILERPLATE:
            self.skipped += 1
        elif self.skipped:
            pass
        elif self.leaf:
            self.nested += tag == self.leaf
        elif self.rows is None and tag == "table":
            self.rows, self.depth = [], 1
        elif self.rows is not None:
            if tag == "table":
                self.depth += 1
            elif tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.cell = []
        elif tag in LEAVES:
            self.leaf, self.nested, self.parts = tag, 0, []

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in BOILERPLATE:
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            pass
        elif self.leaf:
            if tag == self.leaf and self.nested:
                self.nested -= 1
            elif tag == self.leaf or tag in ("body", "html"):
                self.close_leaf()
        elif self.rows is not None and tag == "table":
            self.depth -= 1
            if not self.depth:
                self.close_table()
        elif self.cell is not None and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join(self.cell) or None)
            self.cell = None

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
            return
        text = data.strip()
        if not self.skipped and text:
            (self.cell if self.cell is not None else self.parts if self.leaf else []).append(text)

    def close_leaf(self):
        if self.leaf and self.parts:
            self.lines.append({"text": " ".join(self.parts), "top": self.top, "avg_font_size": SIZES.get(self.leaf, BODY_SIZE)})
            self.top += 1
        self.leaf, self.parts = None, []

    def close_table(self):
        rows = [r for r in self.rows or [] if any(r)]
        if rows:
            self.tables.append({"rows": rows, "top": self.top, "bottom": self.top + 1})
            self.top += 2
        self.rows = None


def parse_page(html: str | None) -> dict:
    """Title, lines, tables and text of a page; text holds the lines only. Null and empty pages have nothing."""
    p = _Page()
    p.feed(html or "")
    p.close()
    p.close_leaf()
    p.close_table()
    title = " ".join((p.title or "").split()) or None
    return {"title": title, "text": "\n".join(x["text"] for x in p.lines), "page_lines": p.lines, "page_tables": p.tables, "median_font_size": BODY_SIZE}


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with a struct ``page`` of their title, text, lines and tables, parsed in Arrow batches."""

    @F.pandas_udf(PAGE_SCHEMA)
    def parsed(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(x) for x in s], columns=["title", "text", "page_lines", "page_tables", "median_font_size"])

    return pages.withColumn("page", parsed(html))


def documents(spark: SparkSession, path: str, parser: Callable[[bytes], Iterable[dict]], schema: str, pattern: str = "*") -> DataFrame:
    """Files as rows of a parser of the host's choice (PDF, DOCX): path, sha256 of the content, and the parser's columns.

    A file that the parser fails on gives a row of nulls with the message in ``error``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.sha2("content", 256).alias("sha256"), "content")
    full = spark.createDataFrame([], f"path string, sha256 string, error string, {schema}").schema
    kinds = to_arrow_schema(full)

    def run(batches):
        for b in batches:
            rows = []
            for at, sha, content in zip(*(b.column(k).to_pylist() for k in range(3))):
                try:
                    rows += [{"path": at, "sha256": sha, **r} for r in parser(bytes(content))]
                except Exception as e:  # one broken file must not end the job
                    rows.append({"path": at, "sha256": sha, "error": str(e)[:500]})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.mapInArrow(run, full)


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is not known yet, one for each content."""
    return files.join(known.select("sha256").distinct(), "sha256", "left_anti").dropDuplicates(["sha256"])


def content_path(slug: str, sha256: str, extension: str) -> str:
    """Content-addressed place of a file."""
    return f"{slug}/{sha256[:2]}/{sha256}.{extension.lstrip('.')}"


def store(files: DataFrame, root: str) -> DataFrame:
    """(path, sha256, stored): files (slug, extension, content) put to their content-addressed place under a shared root.

    A content that is there already is not written again (``stored`` is false), so a task that is run again changes nothing.
    Null contents give no row.
    """

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            out = []
            for slug, extension, content in zip(*(c.to_pylist() for c in b.columns)):
                sha = hashlib.sha256(content).hexdigest()
                at = f"{base}/{content_path(slug, sha, extension)}"
                there = system.get_file_info(at).type == fs.FileType.File
                if not there:
                    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    part = f"{at}.{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as f:
                        f.write(content)
                    system.move(part, at)  # whole or not at all
                out.append((at, sha, not there))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_()))], ["path", "sha256", "stored"])

    return files.where("content is not null").select("slug", "extension", "content").mapInArrow(run, "path string, sha256 string, stored boolean")


def load(spark: SparkSession, root: str, slug: str | None = None) -> DataFrame:
    """(path, sha256, content) of stored files, of one owner or of all; the name and the content have to agree. Empty files are not
    read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{slug}" if slug else root)
    return files.select("path", F.regexp_extract("path", r"([0-9a-f]{64})\.[^/]*$", 1).alias("sha256"), "content").where(F.sha2("content", 256) == F.col("sha256"))


def fetched(urls: DataFrame, fetcher: Callable[[str], tuple[int, str]], least: float = 0.0) -> DataFrame:
    """(url, status_code, text, error) of each distinct URL by the host's fetcher; a failing one gives a row with the error.

    ``least`` seconds are kept between two fetches of a task. Null URLs give no row.
    """

    def run(batches):
        for b in batches:
            out = []
            for url in b.column(0).to_pylist():
                begun = time.monotonic()
                try:
                    status, text = fetcher(url)
                    out.append({"url": url, "status_code": status, "text": text, "error": None})
                except Exception as e:  # one page that cannot be had must not end the crawl
                    out.append({"url": url, "status_code": None, "text": None, "error": str(e) or type(e).__name__})
                time.sleep(max(0.0, least - (time.monotonic() - begun)) if least else 0)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("url", pa.string()), ("status_code", pa.int32()), ("text", pa.string()), ("error", pa.string())]))

    return urls.select("url").where("url is not null").distinct().mapInArrow(run, "url string, status_code int, text string, error string")


ANSWER = "response_text string, resolved_model_version string, citations array<string>, input_tokens int, output_tokens int"


def answers(prompts: DataFrame, engine: Callable[[str], dict], replicates: int = 1) -> DataFrame:
    """(prompt_id, replicate_index, error, ...) of each prompt (prompt_id, text) and replicate by the host's engine.

    Whatever the engine leaves out is null; citations that repeat are kept in order. A failing call gives a row with the
    error.
    """
    full = prompts.sparkSession.createDataFrame([], f"prompt_id bigint, replicate_index int, error string, {ANSWER}").schema
    kinds, names = to_arrow_schema(full), [f.split()[0] for f in ANSWER.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for i, text, k in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    got = engine(text)
                    out.append({"prompt_id": i, "replicate_index": k, "error": None, **{n: got.get(n) for n in names}})
                except Exception as e:  # the call's own failure
                    out.append({"prompt_id": i, "replicate_index": k, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    each = prompts.select("prompt_id", "text", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate_index"))
    return each.mapInArrow(run, full)


def with_fallback(pages: DataFrame, reader: Callable[[str, int], str], least: int = SPARSE) -> DataFrame:
    """Pages (path, page_number, text) with the text of a second reader where a page's own layer is sparse.

    ``used_fallback`` tells which. Null counts as no text; a reader that fails leaves what was there.
    """
    sparse = F.length(F.trim(F.coalesce("text", F.lit("")))) < least
    kind = "path string, page_number int, text string"

    def run(batches):
        for b in batches:
            out = []
            for path, number, text in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    text, used = reader(path, number), True
                except Exception:  # what the page has is better than nothing
                    used = False
                out.append({"path": path, "page_number": number, "text": text, "used_fallback": used})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("page_number", pa.int32()), ("text", pa.string()), ("used_fallback", pa.bool_())]))

    own = pages.select("path", "page_number", "text")
    read = own.where(sparse).mapInArrow(run, f"{kind}, used_fallback boolean")
    return own.where(~sparse).withColumn("used_fallback", F.lit(False)).unionByName(read)


def row_text(tables: Column) -> Column:
    """The tables of a page as text, row by row, cells parted by bars: what a page's text gains so that quotes of cells are found."""
    cells = lambda r: F.array_join(F.filter(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.trim(c) != ""), " | ")
    return F.array_join(F.filter(F.flatten(F.transform(F.coalesce(tables, F.array()), lambda t: F.transform(t["rows"], cells))), lambda x: x != ""), "\n")


def manifest(spark: SparkSession, path: str, required: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """Entries of a JSON manifest with ``problem``: the first required field that is missing or blank, else the first rule
    (a field and the pattern its value has to match, where given) that is broken; null if none is.
    """
    rows = spark.read.option("multiLine", True).json(path)
    missing = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"{c} missing")) if c in rows.columns else F.lit(f"{c} missing") for c in required]
    broken = [F.when(~F.coalesce(F.trim(F.col(c).cast("string")).rlike(f"^(?:{p})$"), F.lit(True)), F.lit(f"{c} invalid")) for c, p in (rules or {}).items() if c in rows.columns]
    return rows.withColumn("problem", F.coalesce(*missing, *broken, F.lit(None).cast("string")))


def manifest_files(entries: DataFrame, listing: DataFrame, file: str = "file") -> DataFrame:
    """(file, state): listed and there, ``missing`` file, or a file that is ``unlisted``. listing: path."""
    there = listing.select(F.regexp_extract("path", r"([^/]+)$", 1).alias(file)).distinct().withColumn("_there", F.lit(True))
    said = entries.select(file).where(F.col(file).isNotNull()).distinct().withColumn("_said", F.lit(True))
    return said.join(there, file, "full").select(F.col(file).alias("file"), F.when(F.col("_there").isNull(), "missing").when(F.col("_said").isNull(), "unlisted").otherwise("there").alias("state"))


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table of Parquet, ORC, CSV or JSON (one value a line, or one document with ``multiLine``); partitions are pruned by
    filters. CSV has a header unless told otherwise."""
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).load(path)


def table_list(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(name, kind) of the tables and views that a session knows."""
    rows = [(t.name, t.tableType) for t in (spark.catalog.listTables(database) if database else spark.catalog.listTables())]
    return spark.createDataFrame(rows, "name string, kind string")


def embed(rows: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], dimensions: int, column: str = "embedding") -> DataFrame:
    """Rows with the host's embedding of a text, asked for in batches; a vector of other dimensions is an error.

    Null texts get null and are not sent.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(column, T.ArrayType(T.FloatType()))])
    at = rows.columns.index(text)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            sent = [i for i, t in enumerate(texts) if t is not None]
            out = [None] * len(texts)
            for k in range(0, len(sent), EMBEDDING_BATCH):
                part = sent[k : k + EMBEDDING_BATCH]
                vectors = embedder([texts[i] for i in part])
                if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                    raise ValueError("the embedder gave another number or length of vectors")
                for i, v in zip(part, vectors):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], [*b.schema.names, column])

    return rows.mapInArrow(run, schema)
