"""The queries of this subpackage: name -> (session, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, canon, leaks, mainbody, neardup, pii, repeated, residue, split, survivor
from millrace.runtime import stage


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    out = split.split_oversized(_table(spark, folder, "raw_pages"))
    return out.where("cut in ('forced', 'natural')").select(F.col("id").alias("page_id"), "cut").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.piece_texts(_table(spark, folder, "raw_pages")).withColumnRenamed("id", "page_id")


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Of each text of more than 800 characters: the hash of the text put together again from its pieces, and whether
    all pieces keep the limit, share 100 characters and end behind a boundary character unless they say otherwise."""
    pieces = split.piece_texts(_table(spark, folder, "raw_pages")).where("end_pos > 800 or piece_no > 1 or boundary <> 'end'")
    new = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.substring("piece", 101, 800))
    at_end = F.col("boundary").isin("end", "forced", "overlap") | F.substring("piece", -1, 1).isin(*split._CLASS)
    good = (F.length("piece") <= 800) & (F.length("piece") == F.col("end_pos") - F.col("start_pos") + 1)
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", new.alias("new"))))
    grouped = pieces.groupBy(F.col("id").alias("page_id")).agg(parts.alias("p"), F.min(good).alias("within"), F.min(at_end).alias("at_boundaries"))
    shared = F.forall(F.sequence(F.lit(2), F.size("p")), lambda k: F.get("p", k - 1)["start_pos"] == F.get("p", k - 2)["end_pos"] - 99)
    return grouped.where("size(p) > 1").select("page_id", F.md5(F.array_join(F.transform("p", lambda x: x["new"]), "").cast("binary")).alias("md5"), "within", shared.alias("overlapping"), "at_boundaries")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neardup.document_pairs(*neardup.near_duplicates(_table(spark, folder, "raw_pages")))
    return pairs.select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links between classes of copies, with their similarity."""
    links, _ = neardup.near_duplicates(_table(spark, folder, "raw_pages"))
    similarity = F.round(F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap")), 6)
    return links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), similarity.alias("similarity"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    links, members = neardup.near_duplicates(_table(spark, folder, "raw_pages"))
    return neardup.duplicate_classes(stage(links, "links"), members).withColumnRenamed("id", "page_id")


def p2_groups_five(spark: SparkSession, folder: str) -> DataFrame:
    """As p2_groups, for shingles of five words and a similarity of 0.8."""
    links, members = neardup.near_duplicates(_table(spark, folder, "raw_pages"), size=5, threshold=0.8)
    return neardup.duplicate_classes(stage(links, "links"), members).withColumnRenamed("id", "page_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated.repeated_lines(_table(spark, folder, "raw_pages")).select(F.col("id").alias("page_id"), "line_no")


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    return repeated.clean_texts(_table(spark, folder, "raw_pages")).withColumnRenamed("id", "page_id")


def p3_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The texts without the chunks, of no regard to lines, that a county repeats excessively."""
    return repeated.cut_chunks(_table(spark, folder, "raw_pages")).withColumnRenamed("id", "page_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "raw_pages")
    read = residue.read_pages(pages, weights=mainbody.fitted(pages, _table(spark, folder, "line_labels")))
    lines = read.select("id", F.explode("furniture").alias("line_no"))
    cases = residue.residue_cases(read).select("id")
    return lines.join(cases, "id", "left_anti").select(F.col("id").alias("page_id"), F.col("line_no").cast("long").alias("line_no"))


def p4_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return mainbody.main_bodies(_table(spark, folder, "raw_pages"), _table(spark, folder, "line_labels")).withColumnRenamed("id", "page_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_pages(_table(spark, folder, "raw_pages")).select(F.col("id").alias("page_id")).distinct()


def p6_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_pages(_table(spark, folder, "raw_pages")).withColumnRenamed("id", "page_id")


def p6_templates(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_templates(_table(spark, folder, "raw_pages"))


def _contacts(spark: SparkSession, folder: str) -> DataFrame:
    counties = _table(spark, folder, "structured_counties")
    fields = {
        "health_department_contact_email": survivor.usable_email(F.col("health_department_contact_email")),
        "health_department_contact_phone": survivor.usable_phone(F.col("health_department_contact_phone")),
    }
    programs = _table(spark, folder, "structured_programs")
    eligibility = {"eligibility_requirements": survivor.usable_text(F.col("eligibility_requirements"))}
    return survivor.survivors(counties, "county_code", fields).unionByName(survivor.survivors(programs, "program_uid", eligibility))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _contacts(spark, folder).select("group_key", "field_name", "record_id")


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    return _contacts(spark, folder).groupBy("group_key").agg(
        *[F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in ("health_department_contact_email", "health_department_contact_phone", "eligibility_requirements")]
    )


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    registry = canon.reference(_table(spark, folder, "program_registry"), "program_id", ["canonical_name"], ["county_aliases"], ["acronym"])
    categories = canon.reference(_table(spark, folder, "category_list"), "category_id", ["category_name"], ["also_written"])
    return canon.map_values(_table(spark, folder, "structured_programs"), {"program_name": registry, "program_category": categories})


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mapped(spark, folder).select("record_id", "field_name", "entry_id").distinct()


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """For each field and entry the records mapped to it, and how many of them were typed otherwise."""
    return _mapped(spark, folder).groupBy("field_name", "entry_id").agg(F.count("*").alias("records"), F.count_if(F.col("distance") > 0).alias("mistyped"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(_table(spark, folder, "documents"))


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Number of ids of each document, and whether decoding them gives the text."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    back = bpe.decode_corpus(bpe.encode_corpus(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", F.col("text").eqNullSafe(F.col("decoded")).alias("same"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))
    return found.where("distance = 0").select("doc_id", "item_id").distinct()


def p9_near(spark: SparkSession, folder: str) -> DataFrame:
    """As p9_found, but a passage may differ by one word."""
    return leaks.leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which each item leaked."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_information(_table(spark, folder, "documents"), _table(spark, folder, "known_names"))
    return found.select("doc_id", "kind", "char_pos").distinct()


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact(_table(spark, folder, "documents"), _table(spark, folder, "known_names"))


def p10_names(spark: SparkSession, folder: str) -> DataFrame:
    """The words that count as given or family names in this corpus."""
    return pii.learn_names(_table(spark, folder, "documents"), _table(spark, folder, "known_names"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}
    return dict(sorted(own.items(), key=lambda x: (int(x[0][1:].split("_")[0]), x[0])))
