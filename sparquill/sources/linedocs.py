"""Line documents: tab-separated text files with a header, and what is made from or for them.

Columns of a line document are title, body, tokens, offsets, positions, phrase
ends and phrase beginnings; a format says how many of them are used. All
reading and writing goes through Spark's own text reader and writer, so any
store that Spark can read will do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: How header lines begin (fixed by the format).
HEADER = "FIELDS_HEADER_INDICATOR###"
#: Columns of each format after title and body, by their place in a line.
FORMATS: dict[str, dict[str, int]] = {
    "TOKEN_ONLY": {"tokens": 2},
    "WITH_OFFSETS": {"tokens": 2, "offsets": 3},
    "WITH_POSITIONS": {"tokens": 2, "offsets": 3, "positions": 4},
    "WITH_PHRASE_END": {"tokens": 2, "offsets": 3, "positions": 4, "phrase_ends": 5},
    "WITH_BI_BLOOM": {"tokens": 2, "offsets": 3, "positions": 4, "phrase_ends": 5, "phrase_begins": 6},
}


def numbered(rows: DataFrame, order: Column | str, name: str = "doc_id") -> DataFrame:
    """``rows`` with dense ids from 0 in the order of ``order``, without a global sort into one task.

    Rows are dealt by range and numbered inside each range; the counts of the
    ranges, one row a partition, give each its first number.
    """
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    inside = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = inside.groupBy("_part").agg(F.max("_n").alias("_size"))
    first = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_first"))
    return inside.join(F.broadcast(first), "_part").withColumn(name, (F.col("_first") + F.col("_n") - 1).cast("long")).drop("_part", "_n", "_first")


def parse_offsets(column: Column) -> Column:
    """``0,4;19,23.7,10;.`` as arrays of (start, end), one array a term. Both ``,`` and ``-`` part a pair."""
    pair = lambda p: F.struct(F.split(p, "[,-]")[0].cast("int").alias("start"), F.split(p, "[,-]")[1].cast("int").alias("end"))
    return F.transform(T.nonempty(F.split(column, r"\.")), lambda g: F.transform(T.nonempty(F.split(g, ";")), pair))


def parse_positions(column: Column) -> Column:
    """``1;5;.2;.`` as arrays of numbers, one array a term; what is no number is an error."""
    return F.transform(T.nonempty(F.split(column, r"\.")), lambda g: F.transform(T.nonempty(F.split(g, ";")), lambda x: x.cast("int")))


def parse_phrases(column: Column) -> Column:
    """``a b!!→`` as arrays of neighbouring terms, one array a term, empty for none."""
    parts = F.split(column, "!", -1)
    return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda g: T.split_space(g))


def parse(lines: DataFrame, format: str = "TOKEN_ONLY") -> DataFrame:
    """Line documents from a column ``value``; header lines go. Columns that a line lacks are null."""
    if format not in FORMATS:
        raise ValueError(f"unknown line document format: {format}")
    parts = F.split("value", "\t", -1)
    kinds = {"tokens": T.split_space, "offsets": parse_offsets, "positions": parse_positions, "phrase_ends": parse_phrases, "phrase_begins": parse_phrases}
    own = [kinds[name](F.get(parts, F.lit(at))).alias(name) for name, at in FORMATS[format].items()]
    rows = lines.filter(~F.col("value").startswith(HEADER))
    kept = [c for c in lines.columns if c != "value"]
    return rows.select(*kept, F.get(parts, F.lit(0)).alias("title"), F.get(parts, F.lit(1)).alias("body"), *own)


def read(spark: SparkSession, path: str, format: str = "TOKEN_ONLY", n_rows: int | None = None) -> DataFrame:
    """Line documents of files, with dense ids in the order of files and lines; at most ``n_rows`` if given."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_at"))
    rows = numbered(parse(lines.drop("file_path", "file_block_start"), format), F.col("_at")).drop("_at")
    return rows if n_rows is None else rows.filter(F.col("doc_id") < n_rows)


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, offsets, positions) of line documents with their own term lists.

    With offsets, tf is how many there are; without, terms are counted and positions are unknown (null).
    """
    if "offsets" not in docs.columns:
        each = docs.select("doc_id", F.explode("tokens").alias("term"))
        none = F.lit(None)
        return each.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf")).select("term", "doc_id", "tf", none.cast("array<struct<start:int,end:int>>").alias("offsets"), none.cast("array<int>").alias("positions"))
    columns = [F.col("tokens"), F.col("offsets")] + ([F.col("positions")] if "positions" in docs.columns else [])
    each = docs.select("doc_id", F.explode(F.arrays_zip(*columns)).alias("x"))
    positions = F.col("x.positions") if "positions" in docs.columns else F.lit(None).cast("array<int>")
    return each.select(F.col("x.tokens").alias("term"), "doc_id", F.size("x.offsets").alias("tf"), F.col("x.offsets").alias("offsets"), positions.alias("positions"))


def token_offsets(tokens: Column) -> Column:
    """(term, start, end) of tokens in their text joined by single blanks; end is the last character's place."""
    ends = T.running_sums(F.transform(tokens, lambda t: F.length(t) + 1))
    return F.zip_with(tokens, ends, lambda t, e: F.struct(t.alias("term"), (e - 1 - F.length(t)).alias("start"), (e - 2).alias("end")))


def phrase_offsets(tokens: Column, terms: Sequence[str]) -> Column:
    """(start, stop) of the places where the terms stand one after another, in the tokens joined by single blanks; stop is the last character's place."""
    phrase = " ".join(terms)
    # cut before each place; with two blanks in front even the first token's place has something before it
    quoted = phrase.replace("\\E", "\\E\\\\E\\Q")
    parts = F.split(F.concat(F.lit("  "), F.array_join(tokens, " "), F.lit(" ")), rf"(?=\Q {quoted} \E)", -1)
    cuts = T.running_sums(F.transform(parts, F.length))
    starts = T.let(cuts, lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))))
    return F.transform(starts, lambda c: F.struct((c - 1).alias("start"), (c + (len(phrase) - 2)).alias("stop")))


def lines(docs: DataFrame, title: str = "title", body: str = "body", tokens: Column | None = None) -> DataFrame:
    """(value): line documents with positions, from raw text: distinct terms in order of first place, offsets and positions in the grammar of parse()."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ")
    given = tokens if tokens is not None else T.split_space(clean(body))
    rows = docs.select(clean(title).alias("t"), clean(body).alias("b"), given.alias("tokens"))
    rows = rows.withColumn("at", token_offsets(F.col("tokens"))).withColumn("terms", F.array_distinct("tokens"))
    of = lambda w: F.filter("at", lambda x: x["term"] == w)
    grouped = lambda each: F.array_join(F.transform("terms", lambda w: F.concat(F.array_join(each(w), ""), F.lit("."))), "")
    offsets = grouped(lambda w: F.transform(of(w), lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["end"].cast("string"), F.lit(";"))))
    places = grouped(lambda w: F.filter(F.transform("tokens", lambda x, i: F.when(x == w, F.concat(i.cast("string"), F.lit(";")))), lambda x: x.isNotNull()))
    return rows.select(F.concat_ws("\t", "t", "b", F.array_join("terms", " "), offsets, places).alias("value"))


def write(docs: DataFrame, path: str, fields: tuple[str, ...] = ("title", "date", "body")) -> None:
    """Tab-separated lines of the given columns, tabs and line ends inside them as blanks. The header is a file of its own that sorts first."""
    spark = docs.sparkSession
    each = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in fields]
    docs.select(F.concat_ws("\t", *each).alias("value")).write.mode("overwrite").text(path)
    spark.createDataFrame([(f"{HEADER}\t" + "\t".join(fields),)], "value string").coalesce(1).write.mode("append").text(path)


# --- query logs


def query_log(lines_: DataFrame, n_results: int = 5, snippets: bool = True, passages: int = 3) -> DataFrame:
    """Queries of a log (query_id, value): terms; a line in double quotes is a phrase. The other columns are the defaults of a query."""
    line = T.trim_white(F.col("value"))
    phrase = line.startswith('"') & line.endswith('"') & (F.length(line) > 1)
    terms = T.split_space(F.when(phrase, F.substring(line, 2, F.length(line) - 2)).otherwise(line))
    return lines_.select("query_id", terms.alias("terms"), phrase.alias("is_phrase"), F.lit(n_results).alias("n_results"), F.lit(snippets).alias("return_snippets"), F.lit(passages).alias("n_passages"))


def read_query_log(spark: SparkSession, path: str, **defaults) -> DataFrame:
    rows = numbered(spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()), F.col("_at"), "query_id")
    return query_log(rows.drop("_at"), **defaults)


def pools(log: DataFrame, n: int, key: str = "query_id") -> DataFrame:
    """Queries dealt in turn to ``n`` pools."""
    return log.withColumn("pool", F.pmod(F.col(key), F.lit(n)).cast("int"))


def clean_search_log(line: Column) -> Column:
    """The query of a raw log line, which stands between a tab and a date of 2006, its words joined by AND; null without one."""
    raw = F.regexp_extract(line, "\t([^\t]*)\t?2006-", 1)
    return F.when(raw != "", F.concat(F.lit('"'), F.array_join(T.split_white(raw), '" AND "'), F.lit('"')))


def clean_trace(line: Column) -> Column:
    """The ``search`` parameter of a traced address, decoded; null if it has none or is encoded beyond that."""
    raw = F.regexp_extract(line, "[?&]search=([^&\\s]*)", 1)
    return F.when((raw != "") & ~raw.contains("%"), F.regexp_replace(raw, r"\+", " "))


def close_quote(line: Column) -> Column:
    """``line`` with the double quote it lacks at its end."""
    marks = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return F.when(marks % 2 == 1, F.concat(line, F.lit('"'))).otherwise(line)


# --- other corpora and formats


def read_pages_xml(spark: SparkSession, path: str) -> DataFrame:
    """(title, redirect, date, text) of the pages of an encyclopedia dump, redirects dropped."""
    rows = spark.read.format("xml").option("rowTag", "page").schema("title string, redirect struct<_title:string>, revision struct<timestamp:string,text:string>").load(path)
    return rows.filter("redirect is null").select("title", F.to_timestamp("revision.timestamp").alias("date"), F.col("revision.text").alias("text"))


def read_abstracts_xml(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, body) of an abstracts dump."""
    rows = spark.read.format("xml").option("rowTag", "doc").schema("title string, url string, abstract string").load(path)
    return rows.select("title", "url", F.col("abstract").alias("body"))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text): a row for each file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("filename"), F.col("value").alias("text"))


def read_separated(spark: SparkSession, path: str, separator: str = "</doc>\n") -> DataFrame:
    """(text): documents that end in ``separator``, tags removed, on one line each."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.trim(F.regexp_replace(F.regexp_replace("value", "<[^>]*>", ""), r"\s+", " ")).alias("text")).filter("text <> ''")


def with_dates(docs: DataFrame, dates: list[str], key: str = "doc_id") -> DataFrame:
    """Document i gets the date i modulo their number; ``dates`` is a short list."""
    return docs.withColumn("date", F.element_at(F.array(*map(F.lit, dates)), (F.pmod(F.col(key), F.lit(len(dates))) + 1).cast("int")))


def trec_documents(text: DataFrame) -> DataFrame:
    """(docno, title, body) of the DOC elements in a column ``value`` that holds whole files or single documents."""
    each = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<DOC>(.*?)</DOC>"), F.lit(1))).alias("d"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    of = lambda p: F.regexp_extract("d", p, 1)
    title = F.coalesce(*[F.nullif(plain(of(rf"(?s)<{t}>(.*?)</{t}>")), F.lit("")) for t in ("HEADLINE", "TITLE", "HL", "TI")], F.lit(""))
    return each.select(F.trim(of(r"(?s)<DOCNO>(.*?)</DOCNO>")).alias("docno"), title.alias("title"), plain(of(r"(?s)<TEXT>(.*?)</TEXT>")).alias("body"))


def trec_qrels(lines_: DataFrame) -> DataFrame:
    """(query_id, docno, relevant) of judgement lines ``topic 0 docno relevance``."""
    parts = T.split_white(F.col("value"))
    return lines_.filter(F.size(parts) == 4).select(parts[0].alias("query_id"), parts[2].alias("docno"), (parts[3].cast("int") > 0).alias("relevant"))


def trec_topics(text: DataFrame) -> DataFrame:
    """(query_id, title, description, narrative) of the top elements in whole files."""
    each = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<top>(.*?)</top>"), F.lit(1))).alias("d"))
    part = lambda tag, label, to: F.trim(F.regexp_replace(F.regexp_extract("d", rf"(?s)<{tag}>\s*(?:{label})?(.*?)(?={to})", 1), r"\s+", " "))
    return each.select(part("num", "Number:", "<title>").alias("query_id"), part("title", "Topic:", "<desc>|$").alias("title"), part("desc", "Description:", "<narr>|$").alias("description"), part("narr", "Narrative:", "$").alias("narrative"))


def trec_run(hits: DataFrame, tag: str = "run") -> DataFrame:
    """(value): lines ``query Q0 doc rank score tag`` of ranked hits."""
    return hits.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", F.col("score")), F.lit(tag)).alias("value"))


def to_tsv(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(value): id, tab, text on one line."""
    return docs.select(F.concat_ws("\t", F.col(key).cast("string"), F.regexp_replace(body, r"\s+", " ")).alias("value"))


def to_trec(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(value): a DOC element a document."""
    return docs.select(F.format_string("<DOC>\n<DOCNO>%s</DOCNO>\n<TEXT>\n%s\n</TEXT>\n</DOC>", F.col(key).cast("string"), F.col(body)).alias("value"))


def to_query_xml(log: DataFrame, key: str, query: str) -> DataFrame:
    """(value): a query element a row, numbered by its key."""
    return log.select(F.format_string("<query>\n<type>indri</type>\n<number>%s</number>\n<text>%s</text>\n</query>", F.col(key).cast("string"), F.col(query)).alias("value"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, weight, payload) of a suggestion file: term, and behind tabs a weight (1 if none) and a payload."""
    parts = F.split("value", "\t", -1)
    return spark.read.text(path).filter("value <> ''").select(parts[0].alias("term"), F.coalesce(F.get(parts, F.lit(1)).cast("long"), F.lit(1).cast("long")).alias("weight"), F.get(parts, F.lit(2)).alias("payload"))
