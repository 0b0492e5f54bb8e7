"""Readers of text, JSON and CSV files, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroborate.functions import fields as E
from corroborate.functions import names as N


def read_texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, text): whole files by base name."""
    df = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
    return df.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, html, listed): a folder of pages; those named mirror or clone are in no directory."""
    pages = read_texts(spark, folder, "*.html")
    name = F.regexp_replace("file", r"\.html$", "")
    return pages.select(name.alias("page_id"), F.col("text").alias("html"), (~F.lower(name).rlike("mirror|clone")).alias("listed"))


def read_personas(spark: SparkSession, folder: str) -> DataFrame:
    return read_texts(spark, folder, "*.txt").select(E.parse_persona(F.col("text")).alias("p")).select("p.*")


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all snapshot texts. Snapshots order by name as text, so t10 comes before t2."""
    return E.parse_snapshots(read_texts(spark, folder, "*.txt"))


def read_arcs(spark: SparkSession, folder: str) -> DataFrame:
    """(victim_id, arc): negotiation texts, the id from the file's name."""
    texts = read_texts(spark, folder, "*.txt")
    return texts.select(F.regexp_extract("file", r"(\d+)", 1).try_cast("int").alias("victim_id"), E.parse_arc(F.col("text")).alias("arc"))


CHAT = T.StructType(
    [
        T.StructField("chat_id", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("ransom_group", T.StringType()),
        T.StructField("backend", T.StringType()),
        T.StructField("messages", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("party", "content", "timestamp")]))),
    ]
)


def read_chats(spark: SparkSession, path: str, digits: bool = True) -> DataFrame:
    """(group_name, chat_id, seq, party, content): turns of chats kept as JSON documents. A quote mark at the start is
    dropped, personal details are taken out, and empty turns are left out, but seq stays the place in the document.
    Documents that can't be read or have no messages give nothing."""
    docs = spark.read.schema(CHAT).json(path, multiLine=True, mode="DROPMALFORMED").where("size(messages) > 0")
    group = F.coalesce("group", "ransom_group", F.lit("unknown"))
    turns = docs.select(group.alias("group_name"), "chat_id", F.posexplode("messages").alias("seq", "m"))
    said = E.scrub(E.unquoted(F.coalesce("m.content", F.lit(""))), digits)
    return turns.select("group_name", "chat_id", "seq", E.party_of(F.coalesce("m.party", F.lit(""))).alias("party"), said.alias("content")).where("content <> ''")


def read_posts(spark: SparkSession, path: str, salt: str = "corroborate") -> DataFrame:
    """(seq, group_name, victim_id, ymd, ordinal) of a feed of posts (post_title, group_name, discovered) in JSON:
    rows without a title or a date are dropped, victims become pseudonyms, seq orders by day and ordinal counts days
    since the first. seq is numbered from the counts of earlier days, so no task sorts the whole feed."""
    raw = spark.read.schema("post_title string, group_name string, discovered string").json(path)
    rows = raw.select(N.norm_group(F.coalesce("group_name", F.lit(""))).alias("group_name"), F.trim("post_title").alias("title"), N.parse_day(F.col("discovered")).alias("ymd")).where("ymd is not null and title <> ''")
    named = rows.select("group_name", N.pseudonym(F.col("title"), "victim-", salt).alias("victim_id"), "ymd")
    days = named.groupBy("ymd").agg(F.count("*").alias("n"))
    w = Window.orderBy("ymd")
    before = days.select("ymd", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.datediff("ymd", F.min("ymd").over(Window.partitionBy())).alias("ordinal"))
    inside = F.row_number().over(Window.partitionBy("ymd").orderBy("group_name", "victim_id")) - 1
    return named.withColumn("r", inside).join(before, "ymd").select((F.col("before") + F.col("r")).alias("seq"), "group_name", "victim_id", "ymd", "ordinal")


def read_market(spark: SparkSession, path: str, salt: str = "corroborate") -> DataFrame:
    """One row per listing of CSV files (list, date, vendor, cat, subcat, subsubcat, price, from, to, feedback flags):
    the first by file and content counts, feedback over all rows."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    yes = lambda *cols: F.greatest(*[(F.upper(F.coalesce(F.col(c), F.lit(""))) == "TRUE") for c in cols])
    rows = raw.where(F.trim("list") != "").withColumns({"rating": N.rating_class(yes("goodFB", "greatFB"), yes("poorFB", "badFB", "worstFB")), "file": F.col("_metadata.file_name")})
    first = F.min_by(F.struct("date", "vendor", "cat", "subcat", "subsubcat", "price", "from", "to"), F.struct("file", "date", "vendor", "price"))
    one = rows.groupBy(F.trim("list").alias("list_id")).agg(first.alias("r"), F.count("*").alias("n_feedback"), F.count_if(F.col("rating") == "pos").alias("fb_pos"), F.count_if(F.col("rating") == "neg").alias("fb_neg"))
    p = N.price_range(F.col("r.price"))
    return one.select("list_id", F.trim("r.date").alias("date"), N.pseudonym(F.coalesce("r.vendor", F.lit("unknown")), "vendor-", salt).alias("vendor_id"), F.trim("r.cat").alias("category"), F.trim("r.subcat").alias("subcategory"), F.trim("r.subsubcat").alias("subsubcategory"), p["low"].alias("price_btc_low"), p["high"].alias("price_btc_high"), N.clean_place(F.col("r.from")).alias("origin"), N.clean_place(F.col("r.to")).alias("dest"), "n_feedback", "fb_pos", "fb_neg")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(series, t): the first number of each line of each file; other lines are ignored."""
    lines = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.\w+$", "").alias("series"), F.split(F.trim("value"), r"\s+")[0].try_cast("double").alias("t"))
    return lines.where("t is not null and not isnan(t)")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def html_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as an HTML page, for reports; a longer one is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: a report is for small results")
    esc = lambda x: str("" if x is None else x).replace("&", "&amp;").replace("<", "&lt;")
    body = "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in rows)
    head = "".join(f"<th>{esc(c)}</th>" for c in df.columns)
    return f"<!doctype html><title>{esc(title)}</title><h1>{esc(title)}</h1><table><tr>{head}</tr>{body}</table>"
