"""Readers and writers.

* annotated corpus / predictions: JSON lines, one record per line
* stage sets: CSV with header, label vectors as JSON text
* member predictions: one directory (or file) per member under a root

Writers produce Spark's usual directory of part files; readers accept a
file, a directory or a glob, so both layouts round-trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_CORPUS = "id string, sentence_form string, annotation array<array<string>>"
LEGACY = "sentence string, aspect string, `답` string"


def _annotation_structs(raw):
    """``[aspect, span, polarity]`` (gold) or ``[aspect, polarity]``
    (prediction) -> struct; the middle element is kept as JSON text."""
    return F.transform(raw, lambda a: F.struct(
        F.get(a, 0).alias("aspect"),
        F.when(F.size(a) >= 3, F.get(a, 1)).alias("span"),
        F.get(a, F.size(a) - 1).alias("polarity")))


def read_corpus(spark: SparkSession, path: str, id_type: str = "string", by: str | None = None) -> DataFrame:
    """``id, sentence_form, annotation array<struct<aspect,span,polarity>>``.
    A malformed line fails the read (FAILFAST), like ``json.loads``.  ``by``:
    also the column (int) that names the folders of the files."""
    raw = (spark.read.schema(f"{RAW_CORPUS}, {by} int" if by else RAW_CORPUS).option("mode", "FAILFAST")
                .option("encoding", "UTF-8").json(path))
    return raw.select(*([by] if by else []), F.col("id").cast(id_type).alias("id"), "sentence_form",
                      _annotation_structs(F.coalesce("annotation", F.array()))
                      .alias("annotation"))


def _json_scalar(c):
    """JSON text of one string value (``null`` for NULL)."""
    j = F.to_json(F.array(c))
    return j.substr(F.lit(2), F.length(j) - 2)


def corpus_lines(corpus: DataFrame) -> DataFrame:
    """One JSON text per record in the corpus format; the span (JSON text)
    is embedded raw, so ``["aspect", ["x", 0, 3], "positive"]`` survives."""
    head = F.to_json(F.struct(F.col("id"), F.col("sentence_form")))
    items = F.transform("annotation", lambda a: F.concat(
        F.lit("["), _json_scalar(a["aspect"]), F.lit(","),
        F.coalesce(a["span"], F.lit("null")), F.lit(","),
        _json_scalar(a["polarity"]), F.lit("]")))
    ann = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    return corpus.select(F.concat(head.substr(F.lit(1), F.length(head) - 1),
                                  F.lit(',"annotation":'), ann, F.lit("}")).alias("value"))


def write_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Gold corpus -> JSON lines (UTF-8, not ASCII-escaped)."""
    corpus_lines(corpus).write.mode(mode).text(path)


def write_predictions(pred: DataFrame, path: str, mode: str = "overwrite", by: str | None = None,
                      compression: str = "none") -> None:
    """D9 -> JSON lines ``{"id", "sentence_form", "annotation":
    [[aspect, polarity], ...]}``.  ``by``: a column (the member) that names a
    folder of files each, written in one job; ``compression``: of the files,
    as Spark's text writer has it (readers tell it by the file's name)."""
    ann = F.transform("annotation", lambda a: F.array(a["aspect"], a["polarity"]))
    # a NULL field is written as null, not left out
    lines = pred.select(*([by] if by else []), F.to_json(
        F.struct("id", "sentence_form", ann.alias("annotation")), {"ignoreNullFields": "false"}).alias("value"))
    writer = lines.write.mode(mode).option("compression", compression)
    (writer.partitionBy(by) if by else writer).text(path)


def read_predictions(spark: SparkSession, path: str, id_type: str = "string", by: str | None = None) -> DataFrame:
    """D9 reader: ``id, sentence_form, annotation array<struct<aspect,polarity>>``;
    ``by``: the column (int) of a set of folders, read in one scan."""
    c = read_corpus(spark, path, id_type, by)
    return c.withColumn("annotation", F.transform(
        "annotation", lambda a: F.struct(a["aspect"].alias("aspect"),
                                         a["polarity"].alias("polarity"))))


def read_members(spark: SparkSession, root: str, id_type: str = "string",
                 layout: str = "dirs", names: list[str] | None = None) -> DataFrame:
    """Every member under ``root`` in one scan: ``member, id,
    sentence_form, annotation``.  ``member`` = rank of the member's name
    (sorted; the reference used the arbitrary ``os.listdir`` order).
    ``layout='dirs'``: root/<member>/part-*; ``'files'``: root/<member>.

    ``names`` gives the members; without it the distinct names of the files'
    members are found on the executors, from paths alone (no content is
    read), and only these names, one per member, reach the driver.  The rank
    is then a literal map lookup, without a shuffle.  A file of no named
    member is an error.
    """
    raw = (spark.read.schema(RAW_CORPUS).option("mode", "FAILFAST")
                .option("recursiveFileLookup", True).json(root.rstrip("/")))
    idx = -2 if layout == "dirs" else -1
    member_of = lambda path: F.element_at(F.split(path, "/"), idx)
    if names is None:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.rstrip("/"))
                      .select(member_of(F.col("path")).alias("name")).distinct())
        names = [r["name"] for r in files.collect()]
    ranks = [F.lit(x) for i, n in enumerate(sorted(names)) for x in (n, i)]
    name = member_of(F.col("_metadata.file_path"))
    err = F.raise_error(F.concat(F.lit("file of an unknown member: "), name))
    rank = F.coalesce(F.try_element_at(F.create_map(*ranks), name), err.cast("int")) if ranks else F.lit(None)
    ann = F.transform(_annotation_structs(F.coalesce("annotation", F.array())),
                      lambda a: F.struct(a["aspect"].alias("aspect"),
                                         a["polarity"].alias("polarity")))
    return raw.select(rank.cast("int").alias("member"),
                      F.col("id").cast(id_type).alias("id"), "sentence_form",
                      ann.alias("annotation"))


def write_legacy(legacy: DataFrame, path: str, mode: str = "overwrite") -> None:
    (legacy.select(F.to_json(F.struct("sentence", "aspect", F.col("answer").alias("답")))
                   .alias("value"))
           .write.mode(mode).text(path))


def read_legacy_polarity(spark: SparkSession, path: str) -> DataFrame:
    """Legacy polarity corpus ``sentence, aspect, answer``."""
    return (spark.read.schema(LEGACY).option("mode", "FAILFAST").json(path)
                 .withColumnRenamed("답", "answer"))


# a file of multi-line CSV is read by one task, so files are kept small
CSV_FILE_ROWS = 100_000


def _csv_writer(df: DataFrame, mode: str):
    # the writer trims surrounding blanks by default; texts must stay whole
    return (df.write.mode(mode).option("header", True).option("quote", '"')
              .option("maxRecordsPerFile", CSV_FILE_ROWS)
              .option("escape", '"').option("lineSep", "\n")
              .option("ignoreLeadingWhiteSpace", False)
              .option("ignoreTrailingWhiteSpace", False))


def write_stage_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: header CSV, label vectors as JSON text (``[1,0,0]``)."""
    cols = [F.to_json("label").alias("label") if c == "label" and
            df.schema["label"].dataType.typeName() == "array" else F.col(c)
            for c in df.columns]
    _csv_writer(df.select(*cols), mode).csv(path)


def read_stage_csv(spark: SparkSession, path: str, label: str = "array",
                   columns: tuple[str, ...] = ("input", "label")) -> DataFrame:
    """Read a stage CSV; ``label='array'`` parses the JSON vector,
    ``'int'`` keeps a single class code.  Texts may hold quotes and line
    breaks (multiLine)."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
               .option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
               .option("ignoreLeadingWhiteSpace", False)
               .option("ignoreTrailingWhiteSpace", False)
               .csv(path))
    lab = (F.from_json("label", "array<int>") if label == "array"
           else F.col("label").cast("int"))
    return df.withColumn("label", lab)
