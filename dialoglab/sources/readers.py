"""Readers for dialogue corpora.

All text columns stay strings exactly as in the files; an empty field is
the empty string, never NULL.  Quoted fields may span lines (``multiLine``);
doubled quotes are the escape (RFC 4180), which is what Python's ``csv``
writes.  Readers are lazy: nothing is read until an action runs.

Scale note: Spark's own CSV reader cannot split a file whose fields hold newlines
(``multi_line=True``), so it reads each file in one task.  ``multi_line="split"`` reads
such files by ranges (:mod:`dialoglab.sources.csv_split`), which takes a few scans but any
number of tasks; when no field contains a newline, ``multi_line=False``
lets Spark split every file into blocks.  JSON lines are always splittable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from . import csv_split

# --- fixed values -------------------------------------------------------------
# Field holding the list of posts in the thread JSON-lines format.
THREAD_FIELD = "reddit_thread"
# --------------------------------------------------------------------------------

# Python's str.strip() whitespace, as a regex on both ends.
_STRIP = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"

# --- fixed values: columns of the annotation and final-label files ---
ANNOTATION_COLUMNS = ["inner_id", "id", "dialogue", "original movie dialogue", "movie name", "agreement"] + [
    f"{f}_{k}" for k in (1, 2, 3)
    for f in ("annotator", "manipulative", "technique", "victim", "vulnerability", "marks", "confidence")
]
LABELLED_COLUMNS = ["ID", "Dialogue", "Manipulative", "Technique", "Vulnerability"]
# ---------------------------------------------------------------------


def strip(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, _STRIP, "")


def _csv(spark: SparkSession, path, header: bool, sep: str = ",", schema: Ty.StructType | None = None,
         multi_line: bool | str = True, number: str | None = None):
    if number and multi_line != "split":
        raise ValueError('numbers need multi_line="split"')
    if multi_line == "split":
        columns = schema.names if schema is not None else _csv(spark, path, header, sep).columns
        return csv_split.read_split_csv(spark, path, columns, header, sep, number)
    r = (spark.read.option("header", header).option("multiLine", multi_line).option("quote", '"')
         .option("escape", '"').option("sep", sep).option("inferSchema", False))
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def _all_strings(columns: Sequence[str]) -> Ty.StructType:
    return Ty.StructType([Ty.StructField(c, Ty.StringType()) for c in columns])


def read_labelled_csv(spark: SparkSession, path, drop_id: bool = False, lower_names: bool = True,
                      multi_line: bool | str = True, number: str | None = None) -> DataFrame:
    """Header CSV of final labels (``ID, Dialogue, Manipulative, Technique, Vulnerability``, ...).

    ``number`` names a column for the record's place in the files, from 0 (only with ``multi_line="split"``).
    """
    df = _csv(spark, path, header=True, multi_line=multi_line, number=number).na.fill("")
    if drop_id and "ID" in df.columns:
        df = df.drop("ID")
    if lower_names:
        df = df.select(*[F.col(f"`{c}`").alias(c.lower()) for c in df.columns])
    return df


def read_annotations(spark: SparkSession, path, multi_line: bool | str = True) -> DataFrame:
    """The wide three-annotator CSV, fixed all-string schema."""
    return _csv(spark, path, header=True, schema=_all_strings(ANNOTATION_COLUMNS), multi_line=multi_line).na.fill("")


THREAD_SCHEMA = Ty.StructType([
    Ty.StructField("id", Ty.StringType()),
    Ty.StructField(THREAD_FIELD, Ty.ArrayType(Ty.StructType([Ty.StructField("text", Ty.StringType())]))),
])


def thread_dialogue(thread: Column) -> Column:
    """Posts -> one dialogue: the first post loses its first line (the title) and
    its other lines are joined with a space; every post is stripped and tagged
    ``utterance <i>: ``; posts are joined by newline."""
    def post(x, i):
        lines = F.split(F.coalesce(x["text"], F.lit("")), "\n")
        first = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), " ")
        body = strip(F.when(i == 0, first).otherwise(x["text"]))
        return F.concat(F.lit("utterance "), i.cast("string"), F.lit(": "), body)

    return F.array_join(F.transform(thread, post), "\n")


def read_thread_jsonl(spark: SparkSession, paths, ids: str = "text") -> DataFrame:
    """S3: JSON lines with an array of posts (``THREAD_FIELD``) -> ``(id, dialogue)``.

    Records that carry no id (the usual case) get one from their own text, so it is the same in
    every run and partitioning; equal records get equal ids.  With ``ids="line"`` they get the number of
    their line over all files instead, which no two records share.
    """
    if ids == "line":
        lines = csv_split.number_lines(spark, paths).where(F.trim("value") != "")
        df = lines.select("line_no", F.from_json("value", THREAD_SCHEMA).alias("r")).select("line_no", "r.*")
        own = F.col("line_no").cast("string")
    elif ids == "text":
        df = spark.read.schema(THREAD_SCHEMA).json(paths).withColumn("line_no", F.lit(None))
        own = F.md5("dialogue")
    else:
        raise ValueError("ids must be text or line")
    out = df.select("id", "line_no", thread_dialogue(F.col(THREAD_FIELD)).alias("dialogue"))
    return out.select(F.coalesce("id", own).alias("id"), "dialogue")


def turn_line(turn_col: str, text_col: str, prefix: str = "Turn ", remove: Sequence[str] = ("@USER",)) -> Column:
    """A turn as a line of its dialogue."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    for r in remove:
        t = F.replace(t, F.lit(r), F.lit(""))
    return F.concat(F.lit(prefix), F.col(turn_col).cast("string"), F.lit(": "), strip(t))


def lines_in_order(turn: str, line: str) -> Column:
    """Aggregate: the lines of a group, by turn and then by text, joined by newline."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, line))), lambda x: x[line]), "\n")


def assemble_dialogues(df: DataFrame, id_col: str, turn_col: str, text_col: str,
                       prefix: str = "Turn ", remove: Sequence[str] = ("@USER",)) -> DataFrame:
    """Turn rows -> one dialogue per id: clean, tag ``Turn <n>: ``, join by newline in turn order.

    One string per dialogue is the output by definition, so the turns of one
    dialogue meet in one task (the output row itself has that size); all
    other dialogues are spread by the hash of their id.
    """
    line = turn_line(turn_col, text_col, prefix, remove)
    rows = df.select(F.col(id_col).alias("id"), F.col(turn_col).cast("bigint").alias("_t"), line.alias("_line"))
    return rows.groupBy("id").agg(lines_in_order("_t", "_line").alias("dialogue"))


def read_turn_table(spark: SparkSession, path, multi_line: bool | str = True) -> DataFrame:
    """TSV ``Number, Turn, utterance`` -> ``(id, dialogue)``."""
    df = _csv(spark, path, header=True, sep="\t", schema=_all_strings(["Number", "Turn", "utterance"]),
              multi_line=multi_line)
    return assemble_dialogues(df.na.fill(""), "Number", "Turn", "utterance")


def read_text_column_csv(spark: SparkSession, path, index: int, skip_header: bool,
                         multi_line: bool | str = True, ids: str = "text") -> DataFrame:
    """One text column picked by position, stripped -> ``(id, dialogue)``.

    The id is the text's md5, so that equal texts share one; with ``ids="line"`` (and ``multi_line="split"``) it is the
    record's number over all files, from 0, which no two records share and by which files can be aligned.
    """
    if ids not in ("text", "line"):
        raise ValueError("ids must be text or line")
    if ids == "line" and multi_line != "split":
        raise ValueError('line ids need multi_line="split"')
    if multi_line == "split":
        text = F.coalesce(F.get("fields", F.lit(index)), F.lit(""))
        out = csv_split.read_records(spark, path, skip_header).select("line_no", strip(text).alias("dialogue"))
        return out.select((F.col("line_no").cast("string") if ids == "line" else F.md5("dialogue")).alias("id"), "dialogue")
    df = _csv(spark, path, header=skip_header, multi_line=multi_line)
    out = df.select(strip(F.coalesce(F.col(f"`{df.columns[index]}`"), F.lit(""))).alias("dialogue"))
    return out.select(F.md5("dialogue").alias("id"), "dialogue")


def union_corpora(corpora: Mapping[str, DataFrame], cols: Sequence[str] = ("id", "dialogue"),
                  qualify: bool = False) -> DataFrame:
    """Corpora side by side, tagged with their name in ``dataset``.

    ``qualify`` puts the name before the id (``name/id``), so that ids of different corpora differ.
    """
    out = None
    for name, df in corpora.items():
        part = df.select(F.lit(name).alias("dataset"), *cols)
        if qualify:
            part = part.withColumn("id", F.concat(F.lit(f"{name}/"), F.col("id").cast("string")))
        out = part if out is None else out.unionByName(part)
    return out
