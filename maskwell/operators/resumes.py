"""Resume records: schemas, projection to text, and their small analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESUME = (
    "id string, language string, job_title string, "
    "personal_info struct<name:string,email:string,address:string,postal_code:string,phone:string,date_of_birth:string>, "
    "education struct<university:string,degree:string,graduation_year:int>, "
    "work_experience array<struct<company:string,position:string,start_year:int,end_year:int,description:string>>, "
    "technologies array<string>, certifications array<string>"
)
ANNOTATION = "resume_id string, language string, annotations map<string,struct<value:string,type:string,japanese_label:string,english_label:string>>"
NORMALIZED = (
    "resume_id string, language string, normalized_personal_info struct<"
    "name:struct<original:string,format:string,full_name:string,first_name:string,last_name:string,alphabetic:boolean,character_count:int,japanese_chars:boolean>,"
    "email:struct<original:string,local_part:string,domain:string,tld:string,normalized:string>,"
    "address:struct<original:string,format:string,normalized:string,street:string,city:string,state:string,character_count:int>,"
    "postal_code:struct<original:string,format:string,normalized:string,prefix:string,suffix:string>,"
    "phone:struct<original:string,country_code:string,area_code:string,number:string,normalized_format:string>,"
    "date_of_birth:struct<original:string,iso_format:string,year:int,month:int,day:int,age:int,japanese_era:string>>"
)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON arrays; the schema is given, so maps stay maps and both languages fit."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _labels(english: str, japanese: str) -> Column:
    return F.when(F.col("language") == "English", english).otherwise(japanese)


def as_text(resumes: DataFrame, out: str = "text") -> DataFrame:
    """``resumes`` with the text of their sections, headings by language."""
    p, e = F.col("personal_info"), F.col("education")
    top = F.array(
        p["name"], F.concat(F.lit("Email: "), p["email"]), F.concat(F.lit("Phone: "), p["phone"]), F.concat(F.lit("Address: "), p["address"]),
        F.concat(F.lit("Postal Code: "), p["postal_code"]), F.concat(F.lit("Date of Birth: "), p["date_of_birth"]),
    )
    first = F.array_join(F.slice("technologies", 1, 3), ", ")
    summary = F.when(F.col("language") == "English", F.concat(F.lit("Experienced "), F.col("job_title"), F.lit(" with expertise in "), first, F.lit("."))).otherwise(
        F.concat(F.col("job_title"), F.lit("として、"), first, F.lit("の知識を有する。"))
    )
    school = F.concat(e["university"], F.lit(" - "), e["degree"], F.lit(" ("), e["graduation_year"].cast("string"), F.lit(")"))
    jobs = F.flatten(F.transform("work_experience", lambda w: F.array(
        F.concat(w["company"], F.lit(" - "), w["position"], F.lit(" ("), w["start_year"].cast("string"), F.lit("-"), F.coalesce(w["end_year"].cast("string"), F.lit("現在")), F.lit(")")),
        w["description"])))
    parts = [
        top, F.array(_labels("PROFESSIONAL SUMMARY", "職務経歴書サマリー"), summary), F.array(_labels("EDUCATION", "学歴"), school),
        F.array(_labels("WORK EXPERIENCE", "職務経歴")), jobs, F.array(_labels("TECHNICAL SKILLS", "技術スキル"), F.array_join("technologies", ", ")),
        F.array(_labels("CERTIFICATIONS", "資格")), F.transform("certifications", lambda c: F.concat(F.lit("• "), c)),
    ]
    return resumes.withColumn(out, F.array_join(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in parts])), "\n"))


def job_titles(resumes: DataFrame) -> DataFrame:
    return resumes.groupBy("job_title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "job_title")


def top_technologies(resumes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most common technologies; of equals the one first seen by id and place."""
    rows = resumes.select("id", F.posexplode_outer("technologies").alias("place", "technology")).where("technology IS NOT NULL")
    counted = rows.groupBy("technology").agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(k).select("technology", "n")


def annotation_types(annotations: DataFrame) -> DataFrame:
    rows = annotations.select(F.explode_outer(F.map_values("annotations")).alias("a")).where("a IS NOT NULL")
    return rows.select(F.col("a.type").alias("type")).distinct().orderBy("type")


def of_language(resumes: DataFrame, language: str) -> DataFrame:
    return resumes.where(F.col("language") == language).select("id", "job_title", F.col("personal_info.email").alias("email"))


def evaluation(resumes: DataFrame, annotations: DataFrame, normalized: DataFrame) -> DataFrame:
    """A row for each annotation of a resume, with its normalised email domain and age."""
    a = annotations.select("resume_id", F.explode_outer("annotations").alias("label", "a")).where("a IS NOT NULL")
    n = normalized.select("resume_id", F.col("normalized_personal_info.email.domain").alias("domain"), F.col("normalized_personal_info.date_of_birth.age").alias("age"))
    rows = resumes.select(F.col("id").alias("resume_id"), "job_title").join(a, "resume_id").join(n, "resume_id", "left")
    return rows.select("resume_id", "job_title", "label", "a.type", "a.value", "domain", "age")
