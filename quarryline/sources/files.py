"""A folder of Markdown and HTML files as documents and blocks, with sidecar metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quarryline.functions import text as X
from quarryline.session import materialize

SUFFIXES = r"(?i)\.(md|markdown|html?|txt)$"
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
META = ("title", "doc_type", "jurisdiction", "effective_date", "tenant_id", "owner_id", "visibility")
BLOCK = "doc_id string, block_idx int, text string, kind string, level int"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(rel, doc_id, doc_hash, content) of the text files under a folder; the id depends on the path alone, the hash on the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    return files.where(F.col("path").rlike(SUFFIXES)).select(rel.alias("rel"), X.uuid5(NAMESPACE, F.concat(F.lit("doc:"), rel)).alias("doc_id"), F.sha2("content", 256).alias("doc_hash"), "content")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(rel, meta) of ``<file>.meta.json``; files that hold no JSON object give an empty map."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", ""), r"\.meta\.json$", "")
    meta = F.coalesce(F.from_json(F.decode("content", "UTF-8"), "map<string, string>"), F.create_map().cast("map<string, string>"))
    return files.select(rel.alias("rel"), meta.alias("meta"))


def front_matter(text: Column | str) -> Column:
    """Map of the ``key: value`` lines between leading ``---`` lines; keys lower-cased, quotes dropped; of a repeated key the last counts."""
    c = F.col(text) if isinstance(text, str) else text
    head = F.regexp_extract(c, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.regexp_replace(F.trim(x.substr(F.instr(x, ":") + 1, F.length(x))), "^[\"']|[\"']$", "").alias("v"))
    pairs = F.transform(lines, pair)
    # of a key that is repeated the last line counts
    last = lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"])
    return F.map_from_entries(F.filter(pairs, last))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of (doc_id, text): ATX headings, fenced code kept as it is (also unterminated), paragraphs between blank lines.

    Lines are numbered rows; whether a line is inside a fence is the parity of fences before it, and a paragraph is the
    running count of boundaries.
    """
    body = F.regexp_replace("text", r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")
    lines = docs.select("doc_id", F.posexplode(F.split(body, r"\r?\n")).alias("n", "line"))
    order = W.partitionBy("doc_id").orderBy("n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    x = lines.withColumn("fence", fence).withColumn("inside", F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1)
    head = ~F.col("inside") & F.col("line").rlike(r"^#{1,6}\s+\S")
    blank = ~F.col("inside") & (F.trim("line") == "")
    opens = F.col("fence") & ~F.col("inside")
    x = x.withColumn("head", head).withColumn("blank", blank)
    last_head = F.coalesce(F.lag("head").over(order), F.lit(False))
    closed = F.coalesce(F.lag(F.col("fence") & F.col("inside")).over(order), F.lit(False))
    x = x.withColumn("edge", (F.col("head") | F.col("blank") | opens | last_head | closed).cast("int")).withColumn("part", F.sum("edge").over(order.rowsBetween(W.unboundedPreceding, 0)))
    parts = x.where("not blank").groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"), F.max("head").alias("head"), F.max("fence").alias("code"))
    raw = F.array_join(F.transform("ls", lambda s: s["line"]), "\n")
    mark = F.length(F.regexp_extract(raw, r"^(#{1,6})\s", 1))
    text = F.when(F.col("head"), F.regexp_replace(F.regexp_replace(raw, r"^#{1,6}\s+", ""), r"\s+#*\s*$", "")).when(F.col("code"), raw).otherwise(X.squeeze(raw))
    out = parts.select("doc_id", "part", text.alias("text"), F.when(F.col("head"), "heading").otherwise("paragraph").alias("kind"), F.when(F.col("head"), mark).alias("level")).where("text <> ''")
    return out.withColumn("block_idx", F.row_number().over(W.partitionBy("doc_id").orderBy("part")) - 1).select("doc_id", "block_idx", "text", "kind", "level")


class _Blocks(HTMLParser):
    """Blocks of one page; pieces of navigation, scripts and forms are dropped, a table is its rows of cells."""

    DROP = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form"}
    EMIT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre", "table"}
    OUTER = {"li", "blockquote", "pre", "table"}

    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[tuple[str, str]] = []
        self.title, self._drop, self._tag, self._buf, self._in_title = "", 0, None, [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.DROP:
            self._drop += 1
        elif tag == "title":
            self._in_title = True
        elif self._tag == "table" and tag in ("td", "th"):
            self._buf.append("\x1f")
        elif self._tag == "table" and tag == "tr":
            self._buf.append("\x1e")
        elif tag in self.EMIT and self._tag not in self.OUTER and not self._drop:
            self._close()
            self._tag, self._buf = tag, []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.DROP:
            self._drop = max(0, self._drop - 1)
        elif tag == "title":
            self._in_title = False
        elif tag == self._tag:
            self._close()

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        elif self._tag and not self._drop:
            self._buf.append(data)

    def _close(self) -> None:
        if self._tag:
            raw = "".join(self._buf)
            if self._tag == "table":
                rows = [" | ".join(c for c in (" ".join(c.split()) for c in r.split("\x1f")) if c) for r in raw.split("\x1e")]
                text = "\n".join(r for r in rows if r)
            else:
                text = raw.strip("\n") if self._tag == "pre" else " ".join(raw.split())
            if text:
                self.blocks.append((self._tag, text))
        self._tag, self._buf = None, []


def html_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of (doc_id, text) pages, with the page's title in front as a heading of level 0."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            rows = []
            for doc_id, page in zip(batch["doc_id"], batch["text"]):
                p = _Blocks()
                p.feed(page or "")
                p.close()
                p._close()
                found = ([("h0", " ".join(p.title.split()))] if p.title.strip() else []) + p.blocks
                rows += [(doc_id, i, t, "heading" if re.fullmatch(r"h\d", tag) else "paragraph", int(tag[1]) if re.fullmatch(r"h\d", tag) else None) for i, (tag, t) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "block_idx", "text", "kind", "level"]).astype({"level": "Int32"})

    return docs.select("doc_id", "text").mapInPandas(run, BLOCK)


def load_folder(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks): metadata by sidecar, then front matter, then the content, then defaults."""
    files = materialize(discover(spark, root).withColumn("text", F.decode("content", "UTF-8")).drop("content"), "files")  # the folder is read once
    html = F.col("rel").rlike(r"(?i)\.html?$")
    blocks = markdown_blocks(files.where(~html)).unionByName(html_blocks(files.where(html)))
    heads = blocks.where("kind = 'heading'").groupBy("doc_id").agg(F.min_by("text", "block_idx").alias("found_title"))
    meta = files.join(sidecars(spark, root), "rel", "left").join(heads, "doc_id", "left").withColumn("fm", front_matter("text"))
    own = lambda k: F.coalesce(F.nullif(F.col("meta")[k], F.lit("")), F.nullif(F.col("fm")[k], F.lit("")))
    stem = F.regexp_replace(F.regexp_extract("rel", r"([^/]+)$", 1), r"\.[^.]+$", "")
    default = {"title": F.coalesce("found_title", stem), "doc_type": F.lit("unknown"), "tenant_id": F.lit("global"), "visibility": F.lit("tenant")}
    cols = [F.coalesce(own(k), default[k]).alias(k) if k in default else own(k).alias(k) for k in META]
    return meta.select("doc_id", "doc_hash", F.col("rel").alias("source_file"), *cols), blocks


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from a JSON array or an object with ``questions``; a page or a pair of pages becomes page_lo and page_hi."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(F.from_json(F.get_json_object("value", "$.questions"), "array<string>"), F.from_json("value", "array<string>"))).alias("q"))
    get = lambda k: F.get_json_object("q", f"$.{k}")
    pages = F.from_json(get("source_page"), T.ArrayType(T.IntegerType()))
    single = get("source_page").cast("int")
    return raw.select(
        get("question").alias("question"), get("category").alias("category"), F.coalesce(get("expected_behavior"), F.lit("answer")).alias("expected_behavior"), get("ground_truth").alias("ground_truth"), get("source_doc").alias("source_doc"), get("gold_section").alias("gold_section"),
        F.coalesce(F.get(pages, F.lit(0)), single).alias("page_lo"), F.coalesce(F.get(pages, F.lit(1)), F.get(pages, F.lit(0)), single).alias("page_hi"),
    )


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A report as JSON lines or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)
