"""Delimited phrase files: encoding and separator found from a bounded head, then an ordinary distributed CSV scan of strings."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes looked at, encodings tried, headers of phrase and volume columns.
HEAD = 262_144
ENCODINGS = ("utf-8", "cp1251", "cp866")
JAVA = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1251": "windows-1251", "cp866": "IBM866"}
PHRASE_HEADERS = ("поисковый запрос", "фраза", "keyword", "query", "запрос", "phrase")
VOLUME_WORDS = ("частот", "показы", "frequency", "volume")


def head_of(spark: SparkSession, path: str, n: int = HEAD) -> bytes:
    """The first n bytes of a file in any file system that Spark reaches; of a folder, of its first file by name."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(target).isDirectory():
        files = sorted(s.getPath().toString() for s in fs.listStatus(target) if s.isFile() and s.getPath().getName()[0] not in "._")
        target = jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def detect_encoding(head: bytes) -> str:
    """utf-8-sig for a mark at the start, else the first encoding that decodes the head; a character cut off at its end is no error."""
    if head.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    for name in ENCODINGS:
        try:
            codecs.getincrementaldecoder(name)().decode(head, final=False)
        except UnicodeDecodeError:
            continue
        return name
    raise ValueError("the file is in none of the known encodings")


def header_key(name: str) -> str:
    return " ".join(str(name).strip().strip('"').lower().replace("ё", "е").split())


def detect_separator(header: str, path: str = "") -> str:
    """Tab for .tsv files and headers with one, and for a single phrase column, whose commas are text; else ; or , or tab."""
    if path.lower().endswith(".tsv") or "\t" in header or header_key(header) in PHRASE_HEADERS:
        return "\t"
    return ";" if ";" in header else "," if "," in header else "\t"


def options_of(spark: SparkSession, path: str) -> dict[str, str]:
    head = head_of(spark, path)
    encoding = detect_encoding(head)
    header = codecs.getincrementaldecoder(encoding)().decode(head, final=False).splitlines()[:1] or [""]
    return {"encoding": JAVA[encoding], "sep": detect_separator(header[0], path), "header": "true"}


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings. Spark rejects the Cyrillic charsets unless its legacy charsets are on, so they are turned on for such a file."""
    options = options_of(spark, path)
    if options["encoding"] != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.options(**options).option("inferSchema", "false").csv(path)


def phrase_column(columns: list[str], wanted: str | None = None) -> str:
    """The column that was asked for, else the first known header in the order of PHRASE_HEADERS, else the first column."""
    keys = {header_key(c): c for c in columns}
    if wanted:
        if header_key(wanted) not in keys:
            raise ValueError(f"no column {wanted}; there are {columns}")
        return keys[header_key(wanted)]
    return next((keys[h] for h in PHRASE_HEADERS if h in keys), columns[0])


def volume_column(columns: list[str], wanted: str | None = None) -> str | None:
    if wanted:
        return phrase_column(columns, wanted)
    return next((c for c in columns if any(w in header_key(c) for w in VOLUME_WORDS)), None)


def phrases(df: DataFrame, phrase: str | None = None, volume: str | None = None) -> DataFrame:
    """(phrase, search_volume, source_row) of a scan; volumes that do not parse are 0. source_row orders rows within a run of the same files."""
    text, number = phrase_column(df.columns, phrase), volume_column(df.columns, volume)
    value: Column = F.coalesce(F.col(f"`{number}`").try_cast("double"), F.lit(0.0)) if number else F.lit(0.0)
    return df.select(F.trim(F.col(f"`{text}`").cast("string")).alias("phrase"), value.alias("search_volume"), F.monotonically_increasing_id().alias("source_row")).where("phrase <> ''")
