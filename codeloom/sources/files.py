"""Sources and sinks: source trees, zip uploads, GraphML, reports, results.  Folders are given by the caller and must be shared."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import PARSED_EXTENSIONS, Settings
from ..functions.ranks import numbered

#: Files whose digests are hashed together.
HASH_BLOCK = 4096
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "latin-1")


def is_excluded(path: Column, parts: tuple[str, ...]) -> Column:
    """Whether any part of the path, the file's name included, is an excluded name; case counts."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts])) if parts else F.lit(False)


def suffix_as_written(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)


def wanted(path: Column, size: Column, s: Settings) -> Column:
    """The scan's filters: extension (case counts), size (the limit itself is kept), excluded parts."""
    return suffix_as_written(path).isin(*s.source_extensions, *s.config_extensions) & (size <= int(s.max_file_mb * 1024 * 1024)) & ~is_excluded(path, s.excluded_parts)


def decode_bytes(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    for e in ENCODINGS:
        try:
            return raw.decode(e).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(StringType())
def _decode_rest(c: pd.Series) -> pd.Series:
    return c.map(decode_bytes)


def decoded(content: Column) -> Column:
    """Text of bytes by the first encoding that fits, line ends folded; valid UTF-8 never leaves the JVM."""
    utf8 = F.regexp_replace(content.cast("string"), "\r\n?", "\n")
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(_decode_rest(F.when(~F.is_valid_utf8(content.cast("string")), content)))


def scan(spark: SparkSession, folder: str, s: Settings = Settings()) -> DataFrame:
    """(path, name, source_code, extension, start_line, depth, sort_key) of a source tree; filters come before contents are used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", r"^file:(?://)?", "")
    rows = files.select(path.alias("path"), "length", "content").where(wanted(F.col("path"), F.col("length"), s))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), decoded(F.col("content")).alias("source_code"), suffix_as_written(F.col("path")).alias("extension"), F.lit(1).alias("start_line"), F.size(F.split("path", "/")).alias("depth")).where(F.col("source_code").isNotNull())


def breadth_first(files: DataFrame, key: str, tie: str) -> DataFrame:
    """files with pos: each one's place within key by depth, then folder, then path, then tie."""
    rows = files.withColumn("_depth", F.size(F.split("path", "/"))).withColumn("_dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return numbered(rows, [key], ["_depth", "_dir", "path", tie], "pos").drop("_depth", "_dir")


def flattened(files: DataFrame, budget: int, engine: str = "auto") -> DataFrame:
    """(file_id, path, start_line, source_code): files whose dependencies are read from the code stay whole, unless the reviewer reads all; the
    others are cut into chunks within budget tokens.  Order is a column (``breadth_first``), not the order of rows."""
    from ..operators.chunks import chunks

    rows = files.where(F.length("source_code") > 0)
    whole = F.lit(engine != "llm") & F.lower(suffix_as_written(F.col("path"))).isin(*PARSED_EXTENSIONS)
    first = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("start_line")
    cut = chunks(rows.where(~whole), budget).join(rows.select("file_id", "path").dropDuplicates(["file_id"]), "file_id")
    return rows.where(whole).select("file_id", "path", first, "source_code").unionByName(cut.select("file_id", "path", "start_line", F.col("chunk").alias("source_code")))


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): whole UTF-8 files, one a row."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.regexp_replace(F.col("_metadata.file_path"), r"^file:(?://)?", "").alias("path"), F.col("value").alias("text"))


def tree_text(paths: list[str]) -> str:
    """An indented listing of paths; for a log, hence on the driver and over names only."""
    root: dict = {}
    for p in sorted(paths):
        at = root
        for part in p.strip("/").split("/"):
            at = at.setdefault(part, {})

    def show(at: dict, lead: str) -> Iterator[str]:
        for k, (name, below) in enumerate(at.items()):
            last = k == len(at) - 1
            yield f"{lead}{'└─ ' if last else '├─ '}{name}"
            yield from show(below, lead + ("   " if last else "│  "))

    return "\n".join(show(root, ""))


def as_export(files: DataFrame) -> DataFrame:
    """(path, block): each file as a path comment and its code in tags."""
    return files.select("path", F.concat(F.lit("//"), "path", F.lit("\n<code>\n"), "source_code", F.lit("\n</code>")).alias("block"))


def from_zips(archives: DataFrame) -> DataFrame:
    """(archive, path, name, content) of every file in zip archives (path, content); unsafe member names are left out.

    A single top folder is unwrapped, the resource forks of one system are skipped; a broken archive gives no row.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for archive, raw in zip(pdf.path, pdf.content):
                try:
                    z = zipfile.ZipFile(io.BytesIO(raw))
                    names = [n for n in z.namelist() if not n.endswith("/") and not n.startswith(("/", "__MACOSX")) and ".." not in n.split("/") and "\\" not in n and ":" not in n]
                    tops = {n.split("/", 1)[0] for n in names}
                    lone = len(tops) == 1 and all("/" in n for n in names)
                    for n in names:
                        p = n.split("/", 1)[1] if lone else n
                        out.append((archive, p, p.rsplit("/", 1)[-1], z.read(n)))
                except (zipfile.BadZipFile, TypeError, RuntimeError):
                    continue
            yield pd.DataFrame(out, columns=["archive", "path", "name", "content"])

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, name string, content binary")


# ---------------------------------------------------------------- GraphML

#: Attribute of a node -> its column.
ATTRIBUTES = {"source_code": "source_code", "target_name": "target_name", "source_name": "source_name", "desc": "descr", "start_code_line": "start_line", "end_code_line": "end_line", "name": "name", "path": "path"}
_NUMBERS = ("start_line", "end_line")
_HEAD = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *[f'<key id="d{k}" for="node" attr.name="{a}" attr.type="{"int" if c in _NUMBERS else "string"}"/>' for k, (a, c) in enumerate(ATTRIBUTES.items())], '<graph edgedefault="directed">']
_TAIL = ["</graph>", "</graphml>"]


def _xml(c: Column) -> Column:
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write_graphml(nodes: DataFrame, edges: DataFrame, folder: str, parts: int | None = None) -> None:
    """The graph as GraphML documents below folder, whole files to a part: each part is a document of its own, parts=1 makes one of all."""
    data = [F.concat(F.lit(f'<data key="d{k}">'), _xml(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</data>")) for k, c in enumerate(ATTRIBUTES.values())]
    n = nodes.select("path", F.lit(0).alias("kind"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), *data, F.lit("</node>")).alias("value"))
    e = edges.select("path", F.lit(1).alias("kind"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"/>')).alias("value"))
    rows = n.unionByName(e)
    rows = (rows.repartition(parts, "path") if parts else rows.repartition("path")).sortWithinPartitions("kind")

    def document(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = False
        for pdf in it:
            if len(pdf) and not opened:
                opened = True
                yield pd.DataFrame({"value": _HEAD})
            yield pdf[["value"]]
        if opened:
            yield pd.DataFrame({"value": _TAIL})

    rows.mapInPandas(document, "value string").write.mode("overwrite").text(folder)


def read_graphml(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML documents, however they are laid out; attributes that a node lacks come back as '' or 0.

    The keys of the documents say which attribute a value is of; they are settings of the format, a few for each document.
    """
    def elements(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", False).option("ignoreNamespace", True).schema(schema).load(folder)

    keys = elements("key", "`_id` string, `_attr.name` string, `_for` string").select(F.col("_id").alias("id"), F.col("`_attr.name`").alias("name")).where("id is not null and name is not null").distinct()
    names = {r.id: ATTRIBUTES[r.name] for r in keys.collect() if r.name in ATTRIBUTES}
    rows = elements("node", "`_id` string, data array<struct<`_VALUE`:string,`_key`:string>>").where("_id is not null")

    def value(column: str) -> Column:
        own = [k for k, c in names.items() if c == column]
        found = F.filter("data", lambda x: x["_key"].isin(*own)) if own else F.array().cast("array<struct<_VALUE:string,_key:string>>")
        return F.coalesce(F.get(found, F.lit(0))["_VALUE"], F.lit(""))

    nodes = rows.select(F.col("_id").alias("id"), *[F.coalesce(value(c).try_cast("int"), F.lit(0)).alias(c) if c in _NUMBERS else value(c).alias(c) for c in ATTRIBUTES.values()])
    edges = elements("edge", "`_source` string, `_target` string").where("_source is not null")
    return nodes, edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"))


# ---------------------------------------------------------------- reports and results

def write_report(reports: DataFrame, folder: str, column: str = "report") -> None:
    """Reports as text, overwritten as a whole, one file per partition, parts of the report separated by the dashed line."""
    from ..operators.reports import SEPARATOR

    reports.select(F.concat(F.col(column), F.lit(f"\n{SEPARATOR}")).alias("value")).write.mode("overwrite").text(folder)


def rewrite_report(batch: DataFrame, n: int, folder: str, column: str = "report") -> None:
    """The report after batch n: what was reported so far and the batch, written as a whole next to the one before, which it then replaces.

    Running a batch again gives the same report, as each batch's part is kept under its number.
    """
    spark = batch.sparkSession
    batch.select(F.col(column).alias("report")).write.mode("overwrite").parquet(f"{folder}/parts/batch={n}")
    write_report(spark.read.parquet(f"{folder}/parts").orderBy("batch"), f"{folder}/report")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """(dir, graph_path, report_path, modified): result folders that hold a graph, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime")
    return discovered(files)


def discovered(files: DataFrame) -> DataFrame:
    rows = files.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    per = rows.groupBy("dir").agg(F.min(F.when(F.col("path").endswith(".graphml"), F.col("path"))).alias("graph_path"), F.min(F.when(F.col("path").rlike(r"_(?:审计结果|report)\.log$"), F.col("path"))).alias("report_path"), F.max("modificationTime").alias("modified"))
    return per.where(F.col("graph_path").isNotNull()).orderBy(F.desc("modified"), "dir")


def with_latest(found: DataFrame, latest: DataFrame, key: str = "dir") -> DataFrame:
    """The latest result before those found, unless it is among them."""
    return latest.join(found.select(key), key, "left_anti").select(found.columns).unionByName(found)


def memo_path(root: str, fingerprint: str, s: Settings) -> str:
    """Where a project's graph is kept: by content, engine and the settings that shape it."""
    import hashlib

    shape = repr((s.engine(), s.source_extensions, s.config_extensions, s.excluded_parts, s.max_file_mb, s.drop_long_identifiers))
    return f"{root.rstrip('/')}/{fingerprint}-{hashlib.sha256(shape.encode()).hexdigest()[:12]}"


def graph_memo(spark: SparkSession, folder: str, build) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from folder if they were built before, else built by build() and written there."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder + "/edges/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        nodes, edges = build()
        nodes.write.mode("overwrite").parquet(folder + "/nodes")
        edges.write.mode("overwrite").parquet(folder + "/edges")  # written last: its marker says that both are whole
    return spark.read.parquet(folder + "/nodes"), spark.read.parquet(folder + "/edges")


def project_hashes(files: DataFrame, key: str) -> DataFrame:
    """(key, project_hash): SHA-256 over path, extension and code of the distinct files of each project, breadth first.

    Each file is reduced to its own digest where it is read, every HASH_BLOCK files in order to one digest, and these to the project's:
    no task holds more than a block, or one short row per block of a project.
    """
    row = files.select(key, F.size(F.split("path", "/")).alias("depth"), "path", F.sha2(F.concat_ws("\x00", F.coalesce("path", F.lit("")), F.coalesce("extension", F.lit("")), F.coalesce("source_code", F.lit(""))), 256).alias("digest")).distinct()
    placed = numbered(row, [key], ["depth", "path", "digest"], "_place").withColumn("_block", F.floor((F.col("_place") - 1) / HASH_BLOCK))
    joined = lambda at, c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, c))), lambda x: x[c]), ""), 256)
    blocks = placed.groupBy(key, "_block").agg(joined("_place", "digest").alias("digest"))
    return blocks.groupBy(key).agg(joined("_block", "digest").alias("project_hash"))

