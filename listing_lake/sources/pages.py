"""Page tables and the decoding of fetched bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# --- fixed values: must equal the stored data's rules -------------------------------------------
META_CHARSET = r"""(?i)<meta[^>]+charset\s*=\s*["']?([\w.:-]+)"""
SNIFF_BYTES = 4096
# ------------------------------------------------------------------------------------------------

# Charset names pages use, as Java names. Korean pages declare EUC-KR but use the wider Windows table.
CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII",
    "euc-kr": "x-windows-949", "euc_kr": "x-windows-949", "ks_c_5601-1987": "x-windows-949", "cp949": "x-windows-949",
    "ms949": "x-windows-949", "uhc": "x-windows-949",
    "shift_jis": "Shift_JIS", "shift-jis": "Shift_JIS", "sjis": "Shift_JIS", "x-sjis": "Shift_JIS", "cp932": "windows-31j",
    "euc-jp": "EUC-JP", "iso-2022-jp": "ISO-2022-JP", "gb2312": "GB2312", "gbk": "GBK", "gb18030": "GB18030", "big5": "Big5",
    "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "windows-1252": "windows-1252",
    "cp1252": "windows-1252", "utf-16": "UTF-16",
}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_pages(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def _java_charset(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for alias, java in CHARSETS.items():
        out = F.when(name == alias, F.lit(java)).otherwise(out)
    return out


def page_charset(body: Column, content_type: Column) -> Column:
    """Charset of the header, else of the page's meta tag, else by whether the bytes are valid UTF-8."""
    header = F.regexp_extract(F.lower(content_type), r"charset\s*=\s*[\"']?([\w.:-]+)", 1)
    head = F.decode(F.substring(body, 1, SNIFF_BYTES), "ISO-8859-1")
    meta = F.lower(F.regexp_extract(head, META_CHARSET, 1))
    meta_only = F.when(~F.contains(F.coalesce(F.lower(content_type), F.lit("")), F.lit("charset")), _java_charset(meta))
    valid = F.try_validate_utf8(body.cast("string")).isNotNull()
    return F.coalesce(_java_charset(header), meta_only, F.when(valid, F.lit("UTF-8")).otherwise(F.lit("x-windows-949")))


def decode_pages(raw: DataFrame, body: str = "body", content_type: str = "content_type", out: str = "html") -> DataFrame:
    """Adds the page text. Needs `spark.sql.legacy.javaCharsets`, which `session.configure` sets.

    `decode` wants a constant charset, so each known one is its own branch and only the fitting branch runs.
    """
    data = F.col(body)
    marked = raw.withColumn("_charset", page_charset(data, F.col(content_type)))
    text = F.make_valid_utf8(data.cast("string"))
    for java in sorted({*CHARSETS.values()} - {"UTF-8"}):
        text = F.when(F.col("_charset") == java, F.decode(data, java)).otherwise(text)
    return marked.withColumn(out, text).drop("_charset", body)
