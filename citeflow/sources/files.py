"""Files that the store is read from and written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "doi string, title string, authors array<string>, year string, journal string, issn array<string>, source string, added_round string, overlap string, gap string, "
    "citation_key string, study_type string, verification_status string, retracted boolean, oa_status string, superseded_by string, supersedes array<string>, "
    "excluded_reason string, keep_uncited boolean, paths struct<abstract: string, pdf: string, pdf_text: string, ocr: string>"
)
HIT = "source string, rank0 int, doi string, title string, year int, authors array<string>, first_author_family string, cited_by_count int, publication_type string"
QUARANTINE = "openalex_id string, title string, doi string, reason string, uncertain boolean, gap string, round int, source string"


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries of all topics: one JSON object a file, below a directory for
    each topic. Integers that are none become null; topic and file name come
    from the path, so a filter on the topic prunes nothing but reads lazily."""
    rows = spark.read.schema(ENTRY + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{root}/*/references/*.json")
    path = F.input_file_name()
    rows = rows.withColumn("topic", F.regexp_extract(path, r"/([^/]+)/references/[^/]+$", 1)).withColumn("file", F.regexp_extract(path, r"([^/]+)$", 1))
    rows = rows.where("_corrupt_record IS NULL").drop("_corrupt_record")
    return rows.withColumns({c: F.expr(f"try_cast({c} AS INT)") for c in ("year", "added_round", "overlap")})


def write_store(entries: DataFrame, path: str) -> None:
    """The store as columns, by topic: a query on one topic reads its files."""
    entries.write.mode("overwrite").partitionBy("topic").parquet(path)


def file_name(doi: Column) -> Column:
    """A file name for a DOI: all but letters, digits, dot and hyphen replaced.
    Different DOIs may share one."""
    return F.regexp_replace(doi, r"[^\p{L}\p{N}_.\-]", "_")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): lines of a list, without blank ones and comments, trimmed."""
    rows = spark.read.text(path).select(F.trim("value").alias("line"))
    return rows.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_batch(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of a tab-separated batch: doi, title, year, authors and
    perhaps gap. Blank lines and comments are skipped; a line of under four
    fields, or whose year is no number, is rejected with the reason."""
    c = F.split("line", "\t")
    rows = read_lines(spark, path).withColumn("c", F.transform(c, lambda x: F.trim(x)))
    why = F.when(F.size("c") < 4, "too few fields").when(F.col("c")[0] == "", "no identifier").when(F.expr("try_cast(c[2] AS INT)").isNull(), "year is no number")
    authors = F.filter(F.transform(F.split(F.col("c")[3], ";"), lambda x: F.trim(x)), lambda x: x != "")
    gap = F.try_element_at("c", F.lit(5))
    good = rows.where(why.isNull()).select(F.lower(F.col("c")[0]).alias("doi"), F.col("c")[1].alias("title"), F.expr("try_cast(c[2] AS INT)").alias("year"), authors.alias("authors"), F.when(gap != "", gap).alias("gap"))
    return good, rows.where(why.isNotNull()).select("line", why.alias("why"))


def write_batch(hits: DataFrame, path: str) -> None:
    """Hits as a tab-separated batch; tabs and line ends within a field become
    blanks."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    line = F.concat_ws("\t", clean(F.col("doi")), clean(F.col("title")), clean(F.col("year")), clean(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "; ")))
    hits.where(F.coalesce("doi", F.lit("")) != "").select(line.alias("value")).write.mode("overwrite").text(path)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Rejected candidates, one JSON object a line; malformed lines are
    skipped."""
    return spark.read.schema(QUARANTINE).option("mode", "DROPMALFORMED").json(path)


def append_quarantine(rows: DataFrame, path: str) -> None:
    rows.select(*[c.split(" ")[0] for c in QUARANTINE.split(", ")]).write.mode("append").json(path)


def card(doi: Column, title: Column, year: Column, authors: Column, abstract: Column, introduction: Column, conclusion: Column) -> Column:
    """An abstract card: front matter and three sections."""
    field = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit("")), F.lit("\n"))
    part = lambda name, c: F.concat(F.lit(f"\n## {name}\n"), F.coalesce(c, F.lit("")), F.lit("\n"))
    head = F.concat(F.lit("---\n"), field("doi", doi), field("title", title), field("year", year), field("authors", F.array_join(authors, ", ")), F.lit("---\n"))
    return F.concat(head, part("Abstract", abstract), part("Introduction", introduction), part("Conclusion", conclusion))


def notes(entries: DataFrame) -> DataFrame:
    """Notes of each gap: its entries' lines in order of year and key. A gap's
    lines are one value, as the format wants one file a gap."""
    line = F.concat(F.lit("- [@"), F.coalesce("citation_key", F.lit("")), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit(")"))
    rows = entries.where("gap IS NOT NULL").select("topic", "gap", F.struct(F.coalesce("year", F.lit(0)).alias("y"), F.coalesce("citation_key", F.lit("")).alias("k"), line.alias("t")).alias("r"))
    return rows.groupBy("topic", "gap").agg(F.count("*").alias("entries"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["t"]), "\n").alias("text"))
