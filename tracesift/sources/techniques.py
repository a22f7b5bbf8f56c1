"""ATT&CK techniques from STIX bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.operators.ranking import first_per_key
from tracesift.schemas import conform

OBJECT_SCHEMA = (
    "struct<type:string,name:string,revoked:boolean,x_mitre_deprecated:boolean,"
    "external_references:array<struct<source_name:string,external_id:string,url:string>>,"
    "kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>"
)
CHAINS = ("mitre-attack", "mitre-ics-attack")


def techniques(objects: DataFrame) -> DataFrame:
    """Techniques of STIX objects with ``matrix`` and ``matrix_no`` columns.

    Revoked and deprecated ones are skipped. An id that occurs in several
    matrices keeps the one with the highest number; within a matrix the last
    object (``object_no``) counts.
    """
    current = objects.where(
        (F.col("type") == "attack-pattern")
        & ~F.coalesce("revoked", F.lit(False))
        & ~F.coalesce("x_mitre_deprecated", F.lit(False))
    )
    reference = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), 0)
    phases = F.filter(F.coalesce("kill_chain_phases", F.array().cast(
        "array<struct<kill_chain_name:string,phase_name:string>>")), lambda p: p["kill_chain_name"].isin(*CHAINS))
    rows = current.withColumn("ref", reference).where(F.coalesce("ref.external_id", F.lit("")) != "").select(
        F.col("ref.external_id").alias("technique_id"), F.coalesce("name", F.lit("")).alias("name"),
        F.transform(phases, lambda p: F.initcap(F.replace(p["phase_name"], F.lit("-"), F.lit(" ")))).alias("tactics"),
        "matrix", F.coalesce("ref.url", F.lit("")).alias("url"),
        (-F.col("matrix_no")).alias("_matrix"), (-F.col("object_no")).alias("_object"),
    )
    return conform(first_per_key(rows, ["technique_id"], "_matrix", "_object"), "techniques")


def read_techniques(spark: SparkSession, bundles: dict[str, str]) -> DataFrame:
    """Techniques of bundle files by matrix name; later matrices override earlier ones."""
    parts = []
    for number, (matrix, path) in enumerate(bundles.items()):
        bundle = spark.read.schema(f"objects array<{OBJECT_SCHEMA}>").json(path, multiLine=True)
        parts.append(
            bundle.select(F.posexplode("objects").alias("object_no", "_object")).select(
                "object_no", "_object.*", F.lit(matrix).alias("matrix"), F.lit(number).alias("matrix_no")
            )
        )
    return techniques(reduce(DataFrame.unionByName, parts))
