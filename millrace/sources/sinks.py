"""Writing results: partitioned pages, published CSV, reports; rewriting only the partitions at hand."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.files import CSV_COLUMNS


def page_key(name, url):
    """The file name of a page: its slug and ten digits of the URL's hash."""
    return F.concat(T.slugify(name), F.lit("-"), F.substring(F.sha1(url.cast("binary")), 1, 10))


def write_pages(df: DataFrame, folder: str) -> None:
    """Pages as JSON in folders by county; a later page with one key replaces the earlier."""
    keyed = df.withColumns({"county_slug": T.slugify(F.col("county")), "key": page_key(F.col("program_name_guess"), F.col("page_url"))})
    row = F.struct(*keyed.columns)
    last = keyed.groupBy("county_slug", "key").agg(F.max_by(row, F.struct("scraped_at", "page_url")).alias("r")).select("r.*")
    last.repartition("county_slug").write.mode("overwrite").partitionBy("county_slug").json(folder)


def publish_rows(counties: DataFrame, programs: DataFrame, updated: str) -> DataFrame:
    """The 18 published columns: a row a program, one placeholder row for a county without programs."""
    joined = counties.join(programs, "county_code", "left")
    text = lambda c, empty: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(empty))
    values = {
        "State": "California", "County_Name": F.col("county_name"), "County_Website_URL": text("county_website_url", "Not found"), "Health_Department_Name": text("health_department_name", "Not found"),
        "Health_Department_Contact_Email": text("health_department_contact_email", "Not found"), "Health_Department_Contact_Phone": text("health_department_contact_phone", "Not found"),
        "Program_Name": text("program_name", "Not found"), "Program_Category": text("program_category", "Other"), "Program_Description": text("program_description", "Not specified"), "Target_Population": text("target_population", "Not specified"),
        "Eligibility_Requirements": text("eligibility_requirements", "Not specified"), "Application_Process": text("application_process", "Not specified"), "Required_Documentation": text("required_documentation", "Not specified"),
        "Financial_Assistance_Available": text("financial_assistance_available", "Unknown"), "Program_Website_URL": text("program_website_url", "Not found"), "Last_Updated": updated, "Data_Collector_Name": "millrace", "Notes": text("notes", ""),
    }
    return joined.select(*[(F.lit(values[c]) if isinstance(values[c], str) else values[c]).alias(c) for c in CSV_COLUMNS])


def _files(spark: SparkSession, folder: str):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def next_version(spark: SparkSession, folder: str) -> int:
    """One more than the greatest N of the folders v<N> in folder; 1 if there is none."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return 1
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return max([int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()], default=0) + 1


def write_versioned(df: DataFrame, folder: str, version: int | None = None, by: str = "County_Name") -> None:
    """Files by county and one combined folder, as version v<N>; without a number, as the next version."""
    version = version or next_version(df.sparkSession, folder)
    df.repartition(by).write.mode("overwrite").option("header", True).partitionBy(by).csv(f"{folder}/v{version}/by_county")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/v{version}/combined")


def run_id(at: datetime, commit: str, config: dict) -> str:
    """Time stamp, commit and eight digits of the configuration's hash."""
    return f"{at:%Y%m%d_%H%M%S}_{commit[:7]}_{hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, as a report is, in any file system that the session knows."""
    fs, at = _files(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_gap_report(candidates: DataFrame, absence: DataFrame, folder: str, shown: int = 10, least: float = 0.65) -> None:
    """gap_candidates: all candidates as JSON lines; alias_suggestions: a JSON line (program_id, names) a program, of the
    candidates and absence signals (program_id, matching_text, score) of at least this similarity; gap_report.txt: the
    first candidates by score and the programs with most absence signals, for reading."""
    candidates.write.mode("overwrite").json(f"{folder}/gap_candidates")
    names = candidates.where(F.col("semantic_match").isNotNull() & (F.col("semantic_score") >= least)).select(F.col("semantic_match").alias("program_id"), F.col("extracted_name").alias("name"))
    texts = absence.where(F.col("score") >= least).select("program_id", F.trim(F.substring("matching_text", 1, 60)).alias("name"))
    both = names.unionByName(texts).groupBy("program_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    both.write.mode("overwrite").json(f"{folder}/alias_suggestions")
    top = candidates.orderBy(F.col("gap_score").desc(), "norm_name").limit(shown).collect()
    missed = absence.groupBy("program_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "program_id").limit(5).collect()
    lines = ["candidates by score", *(f"[{r['gap_score']:.2f}] {r['extracted_name']} ({r['label']}, {r['frequency']} records of {r['n_counties']} counties)" for r in top)]
    lines += ["programs said to be absent", *(f"{r['program_id']}: {r['n']} pages" for r in missed)]
    write_text(candidates.sparkSession, f"{folder}/gap_report.txt", "\n".join(lines) + "\n")


def write_metrics(counties: DataFrame, averages: DataFrame, folder: str, run: str) -> None:
    """metrics_<run>.json: the run and its averages (one row); metrics_<run>: a CSV row a county."""
    doc = averages.select(F.to_json(F.struct(F.lit(run).alias("run_id"), F.struct(*averages.columns).alias("aggregate_metrics")))).first()[0]
    write_text(counties.sparkSession, f"{folder}/metrics_{run}.json", doc)
    counties.write.mode("overwrite").option("header", True).csv(f"{folder}/metrics_{run}")


def write_benchmark(suites: dict[str, DataFrame], folder: str, run: str) -> None:
    """A folder a suite in <folder>/<run>, as JSON lines."""
    for name, df in suites.items():
        df.write.mode("overwrite").json(f"{folder}/{run}/{name}")


def write_discovery(results: DataFrame, folder: str, at: datetime) -> None:
    """Documents {generated_at, results[]}, one a task of results; read_discovery reads them all."""
    stamped = results.select(F.spark_partition_id().alias("part"), F.struct(*results.columns).alias("r"))
    docs = stamped.groupBy("part").agg(F.collect_list("r").alias("results")).select(F.lit(at.isoformat()).alias("generated_at"), "results")
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).json(folder)


def rewrite_partitions(df: DataFrame, folder: str, by: str) -> None:
    """Only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)
