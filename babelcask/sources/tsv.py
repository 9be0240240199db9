"""Tab-separated sources and sinks.

Quoting follows the writer the corpus files come from: fields are quoted with
``"`` and a quote inside a field is doubled, so ``escape`` must be ``"`` (Spark's
default escape is a backslash).  Quoted newlines and tabs stay in the field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_COLUMNS = ("text", "label", "language")

# language code = name up to the first '_' of the file, or of its folder when
# the file is a Spark part file
LANGUAGE_FROM_PATH = r"([^/_]+)_[^/]*(/part-[^/]*)?$"

# Set by the parser, with the whole raw record, exactly when a record does not
# have the expected number of fields.
RECORD = "_record"
FILE = "_file"

_READ_OPTIONS = {
    "sep": "\t",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": RECORD,
    # the width is judged on whole records, so all fields are parsed even if few are selected
    "columnPruning": "false",
    # keep fields exactly as written: no trimming, no null or NaN guessing
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "\u0000no-null\u0000",
    "emptyValue": "",
    "nanValue": "\u0000no-nan\u0000",
}


def _string_schema(columns, partition: str | None) -> T.StructType:
    fields = [*columns, RECORD] + ([partition] if partition else [])
    return T.StructType([T.StructField(c, T.StringType(), True) for c in fields])


# Size the sink aims at for a part file: a file with quoted line breaks is read
# by one task (it cannot be split), so no file may grow with the data.
FILE_BYTES = 128 << 20


def read_tsv(spark: SparkSession, path: str, columns=CORPUS_COLUMNS, multi_line: bool = True,
             header: bool = True, partition: str | None = None) -> DataFrame:
    """Tab-separated files (one, a glob or a directory): ``columns``, ``_record``, ``_file`` (and ``partition``).

    ``multi_line`` keeps quoted line breaks inside a field; such a file is read
    by one task, so large inputs should come as many files (the sink writes
    files of about ``FILE_BYTES``).  Files known to hold no line break inside a
    field can pass ``multi_line=False``: they are split into blocks and read by
    many tasks.  ``header``: the first row of each file is dropped.

    Columns are taken by position under the fixed names ``columns``; every
    field is a string, never inferred.  A record with more or fewer fields
    carries itself, raw, in ``_record``; :func:`split_rejects` takes those out.
    ``partition`` names a column that comes from ``<partition>=<value>`` folders
    under ``path``; it is declared a string, so codes such as ``01`` stay.
    """
    opts = dict(_READ_OPTIONS, multiLine=str(multi_line).lower(), header=str(header).lower())
    df = spark.read.options(**opts).schema(_string_schema(columns, partition)).csv(path)
    return df.withColumn(FILE, F.col("_metadata.file_path"))


def field_count(record) -> Column:
    """Fields of a raw record: tabs outside quoted fields, plus one (a quote inside an unquoted field is text)."""
    c = F.col(record) if isinstance(record, str) else record
    # doubled quotes go first, so a quoted field is one run without quotes (no backtracking over long texts)
    plain = F.replace(c, F.lit('""'), F.lit(""))
    bare = F.regexp_replace(plain, r'(^|\t)"[^"]*+"(?=\t|$)', "$1")
    return (F.length(bare) - F.length(F.replace(bare, F.lit("\t"), F.lit(""))) + 1).cast("int")


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the expected width, rejected records).

    Rejects are (file, n_fields, expected, record): every record with a field
    too many or too few, whole and as it was written.  None is shifted, cut or
    padded, whatever its surplus fields hold.
    """
    fields = [c for c in df.columns if c not in (RECORD, FILE)]
    expected = len([c for c in fields if not _is_partition(df, c)])
    # always true; the reader refuses plans whose only column is the raw record
    read = F.coalesce(F.length(fields[0]), F.lit(0)) >= 0
    ok = df.filter(F.col(RECORD).isNull() & read).select(fields)
    bad = df.filter(F.col(RECORD).isNotNull() & read).select(
        F.col(FILE).alias("file"), field_count(RECORD).alias("n_fields"),
        F.lit(expected).alias("expected"), F.col(RECORD).alias("record"))
    return ok, bad


def _is_partition(df: DataFrame, column: str) -> bool:
    """Columns after the raw record come from the folders (the reader puts them last)."""
    return df.columns.index(column) > df.columns.index(RECORD)


def reject_counts(rejects: DataFrame) -> DataFrame:
    """(file, n_fields, expected, n): what was rejected, by file and width."""
    return rejects.groupBy("file", "n_fields", "expected").agg(F.count(F.lit(1)).alias("n"))


def read_language_files(spark: SparkSession, pattern: str, columns=("text", "label"), language: str | None = None,
                        path_pattern: str = LANGUAGE_FROM_PATH, partition: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Many per-language files in one scan, positional union of all of them: (rows, rejects).

    The language is appended as the last column: a fixed code when given; the
    value of the ``partition`` folders, as written, when named; else the name
    before the first ``_`` of the file (``am_train.tsv`` -> ``am``) or, for a
    folder of part files, of the folder (``am_train/part-0...`` -> ``am``).
    """
    ok, bad = split_rejects(read_tsv(spark, pattern, columns, partition=partition).withColumn("language", (
        F.lit(language) if language is not None
        else F.col(partition) if partition
        else F.regexp_extract(path_text(F.col(FILE)), path_pattern, 1))))
    return ok.select(*columns, "language"), bad


def path_text(path: Column) -> Column:
    """A file path as it was named (paths come percent-encoded; a plus sign is a plus sign)."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def positional_union(frames: list[DataFrame], columns=CORPUS_COLUMNS) -> DataFrame:
    """UNION ALL by position with the fixed header; duplicates kept."""
    out = None
    for f in frames:
        f = f.toDF(*columns)
        out = f if out is None else out.union(f)
    return out


def rows_per_file(df: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Rows that make about ``file_bytes``, from the mean row of ``df`` (one aggregate over its columns)."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 1 for c in df.columns), F.lit(0))
    mean = df.agg(F.avg(size)).first()[0]
    return max(1, int(file_bytes / max(mean or 1.0, 1.0)))


def write_tsv(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite",
              file_bytes: int = FILE_BYTES) -> None:
    """Tab-separated part files with a header row and minimal quoting, of about ``file_bytes`` at most.

    Each task writes its own files (per ``partition_by`` value): no shuffle, so
    a language holding a third of all rows is still written by every task.
    """
    w = (df.write.mode(mode)
         .option("sep", "\t").option("header", "true")
         .option("quote", '"').option("escape", '"')
         .option("quoteAll", "false")
         # keep leading and trailing blanks (the writer trims them by default)
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
         .option("encoding", "UTF-8")
         .option("maxRecordsPerFile", rows_per_file(df, file_bytes)))
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)
