"""Entity tables from plain tables: texts, web pages, chats and event logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the folder that driver and executors share, and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="inkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, p_idx, text): the lines of each text in order. Null texts have none."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p_idx", "text"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, p_idx, style, text): headings, paragraphs and list items of web pages, scripts and styles left out."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    block = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)(?=<(?:h[1-6]|p|li|/h[1-6]|/p|/li|/body|/ul|/div)\b|$)"
    found = F.arrays_zip(F.regexp_extract_all("bare", F.lit(block), F.lit(1)).alias("tag"), F.regexp_extract_all("bare", F.lit(block), F.lit(2)).alias("inner"))
    rows = pages.select(F.col("page_id").alias("doc_id"), bare.alias("bare")).select("doc_id", F.posexplode(found).alias("p_idx", "x"))
    tag, text = F.lower(F.col("x.tag")), F.trim(F.regexp_replace(F.regexp_replace("x.inner", r"<[^>]*>", ""), r"(?U)\s+", " "))
    style = F.when(tag.startswith("h"), F.concat(F.lit("Heading"), F.substring(tag, 2, 1))).when(tag == "li", "ListParagraph").otherwise("Normal")
    return rows.select("doc_id", "p_idx", style.alias("style"), text.alias("text"))


HEADING = r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]>"


def page_headings(pages: DataFrame) -> DataFrame:
    """(doc_id, h_idx, level, heading): headings of web pages in order."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(HEADING), F.lit(1)).alias("level"), F.regexp_extract_all("html", F.lit(HEADING), F.lit(2)).alias("text"))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("h_idx", "x"))
    return rows.select("doc_id", "h_idx", F.col("x.level").cast("int").alias("level"), F.trim(F.regexp_replace("x.text", r"<[^>]*>", "")).alias("heading"))


LINK = r'(?is)<a\b[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'


def page_links(pages: DataFrame) -> DataFrame:
    """(doc_id, link_idx, target, text): anchors of web pages in order."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("target"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("text"))
    return pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("link_idx", "x")).select("doc_id", "link_idx", "x.target", F.regexp_replace("x.text", r"<[^>]*>", "").alias("text"))


def chat_comments(conversations: DataFrame) -> DataFrame:
    """(doc_id, comment_id, parent_id, author, text): a thread for each conversation, each turn answering the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("comment_id"), F.lag("turn").over(w).alias("parent_id"), F.col("role").alias("author"), "text")


# What kind of change each kind of event stands for.
EVENT_CHANGES = {"click": "insertion", "view": "deletion", "purchase": "format_run", "signup": "move_to", "error": "move_from"}


def event_changes(events: DataFrame) -> DataFrame:
    """(doc_id, change_id, change_type, author, date, text): an event log as a log of tracked changes, 50 events a document."""
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in EVENT_CHANGES.items() for x in kv)), F.col("event_type")), F.lit("insertion"))
    return events.select(
        F.floor(F.col("event_id") / 50).alias("doc_id"), F.col("event_id").alias("change_id"), kind.alias("change_type"), F.concat(F.lit("user"), F.col("user_id") % 20).alias("author"),
        F.col("ts").alias("date"), F.concat(F.lit("value "), F.floor(F.col("value"))).alias("text"),
    )


def edit_file(spark: SparkSession, path: str, default_track: bool | None = None) -> DataFrame:
    """(seq, type, …): the edits of JSON files {default_track, edits: […]}; default_track fills what an edit leaves open."""
    fields = "type string, find string, replace string, text string, after string, before string, heading string, scope string, regex boolean, occurrence string, track boolean, author string"
    files = spark.read.schema(f"default_track boolean, edits array<struct<{', '.join(f.replace(' ', ': ', 1) for f in fields.split(', '))}>>").json(path, multiLine=True)
    rows = files.select("default_track", F.posexplode("edits").alias("seq", "e")).select("seq", "default_track", "e.*")
    return rows.withColumn("track", F.coalesce("track", F.lit(default_track).cast("boolean"), "default_track", F.lit(False))).drop("default_track")
