"""Files at rest: pages as JSON, programs as CSV by version, gold as JSON lines; rejects are kept beside the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_PAGE = (
    "county string, page_url string, link_text string, program_name_guess string, nav_path string, scraped_at timestamp_ntz, text string, "
    "contacts struct<phones:array<string>,emails:array<string>>, pdf_links array<string>, registry_signals array<string>, source_depth int, scraper_version string"
)
GOLD_COUNTY = "county_name string, county_url string, programs array<struct<program_name:string,program_url:string,category:string,description:string,target_population:string,eligibility_requirements:string,application_process:string,contact_phone:string,contact_email:string,pdf_links:array<string>>>"
DISCOVERY = "generated_at string, results array<struct<county_name:string,county_url:string,health_dept_url:string,maternal_section_url:string,programs:array<struct<name:string,url:string,link_text:string,nav_path:string,score:double>>,discovered_at:timestamp_ntz>>"
#: Columns of the published table (fixed values).
CSV_COLUMNS = ["State", "County_Name", "County_Website_URL", "Health_Department_Name", "Health_Department_Contact_Email", "Health_Department_Contact_Phone", "Program_Name", "Program_Category", "Program_Description", "Target_Population", "Eligibility_Requirements", "Application_Process", "Required_Documentation", "Financial_Assistance_Available", "Program_Website_URL", "Last_Updated", "Data_Collector_Name", "Notes"]


def read_raw_pages(spark: SparkSession, folder: str, county: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects): one JSON document a file, in folders county=<slug> or <slug>; the schema is given, so nothing
    is inferred. county reads one folder only."""
    path = f"{folder}/{county}" if county else folder
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parsed = F.from_json("value", RAW_PAGE + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    read = whole.select(F.col("_metadata.file_path").alias("file"), parsed.alias("r")).select("r.*", "file")
    pages = read.where("_corrupt_record is null").drop("_corrupt_record")
    parent = F.element_at(F.split("file", "/"), -2)
    pages = pages.withColumn("county", F.coalesce(F.nullif("county", F.lit("")), parent))
    return pages, read.where("_corrupt_record is not null").select("file", "_corrupt_record")


def read_programs(spark: SparkSession, folder: str) -> DataFrame:
    """Structured CSV files in folders v<N>, all columns text, with the version from the path; combined files are left
    out, rows without a name too."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema(", ".join(f"`{c}` string" for c in CSV_COLUMNS)).csv(folder)
    path = F.col("_metadata.file_path")
    return read.withColumns({"version": F.regexp_extract(path, r"/v(\d+)/", 1).try_cast("int"), "file": path}).where(~F.lower("file").contains("combined") & (F.trim("Program_Name") != ""))


#: Other names of columns in older files (fixed values).
OTHER_NAMES = {"Program_Name": "program_name", "Services": "services_provided", "Program_Website_URL": "program_website_url", "Program_Description": "program_description"}


def read_all_programs(spark: SparkSession, folder: str) -> DataFrame:
    """county, name, url, description, services (array), file of all CSV files below folder, combined ones too, in either
    spelling of the headers; the county is the file's name without its prefix and suffix. Rows without a name are left
    out. A column that no file has is null."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    rows = None
    # the headers of files differ, so a file list by header, each with its own columns
    at = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    heads = at.select("path", F.trim(F.regexp_replace(F.split_part(F.decode(F.substring("content", 1, 4000), "UTF-8"), F.lit("\n"), F.lit(1)), "[\"\r\ufeff]", "")).alias("head"))
    for head, paths in heads.groupBy("head").agg(F.collect_list("path")).collect():
        names = head.split(",")
        have = {n: n if n in names else o if (o := OTHER_NAMES.get(n)) in names else None for n in ("Program_Name", "Services", "Program_Website_URL", "Program_Description")}
        df = read.schema(", ".join(f"`{c}` string" for c in names)).csv(paths)
        own = df.select(*[(F.coalesce(F.col(f"`{c}`"), F.lit("")) if c else F.lit("")).alias(n) for n, c in have.items()], F.col("_metadata.file_path").alias("file"))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return spark.createDataFrame([], "county string, name string, url string, description string, services array<string>, file string")
    county = F.trim(F.replace(F.replace(F.replace(F.regexp_replace(F.element_at(F.split("file", "/"), -1), "[.]csv$", ""), F.lit("California_"), F.lit("")), F.lit("_Healthcare_Data"), F.lit("")), F.lit("_"), F.lit(" ")))
    services = F.filter(F.transform(F.split("Services", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.where("Program_Name <> ''").select(county.alias("county"), F.col("Program_Name").alias("name"), F.col("Program_Website_URL").alias("url"), F.col("Program_Description").alias("description"), services.alias("services"), "file")


def read_documents(spark: SparkSession, folder: str, extract: Callable[[bytes, int], str | None], pattern: str = "*.pdf", most_pages: int = 20) -> DataFrame:
    """path, text, error of binary files: extract(content, most_pages), a library of the user's (none is built in), is
    called on the executors; what it raises becomes a row's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for content in b.column(1).to_pylist():
                try:
                    texts.append(extract(content, most_pages))
                    errors.append(None)
                except Exception as x:  # a broken file is a row, not the end of the job
                    texts.append(None)
                    errors.append(f"{type(x).__name__}: {x}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def read_settings(path: str) -> dict[str, str]:
    """key = value lines of a settings file: blank lines and comments are skipped, quotes around values taken off."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and key.strip() and not key.startswith("#"):
                v = value.strip()
                out[key.strip()] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    return out


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """county_name, county_url and the fields of each gold program; blank lines are skipped."""
    rows = spark.read.schema(GOLD_COUNTY).json(path).where("county_name is not null")
    return rows.select("county_name", "county_url", F.posexplode("programs").alias("pos", "p")).select("county_name", "county_url", "pos", "p.*")


def read_discovery(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(DISCOVERY).option("multiLine", True).json(path)
    return rows.select(F.explode("results").alias("r")).select("r.*")


def latest_version(df: DataFrame, version_col: str) -> DataFrame:
    """df's rows of the greatest version, written as v<N>."""
    number = F.regexp_extract(version_col, r"^v(\d+)$", 1).try_cast("int")
    top = df.agg(F.max(number).alias("_top"))
    return df.join(F.broadcast(top), number == F.col("_top"), "left_semi")
