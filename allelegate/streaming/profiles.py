"""Matching a stream against stored profiles: one row per patient and per medication, in buckets of their ids.

A patient's profile holds the first result per gene and phenotype, a medication's its approved rules.  They are kept
up by deltas: a change of results rewrites the profiles in its patients' buckets, a change of rules those in its
medications' buckets.  A micro-batch of requests reads the buckets of its own patients and medications, so what it
scans follows the batch and not the results ever stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from allelegate.functions.text import trim_all
from allelegate.operators.match import first_results, match_profiles, medication_profiles, risk_history_rows
from allelegate.sources.buckets import BUCKETS, BucketTable
from allelegate.sources.tables import append_risk_results
from allelegate.streaming.apply import KEEP, Merge, apply_batch
from allelegate.streaming.match import batch_clock

def patient_rows(patients: DataFrame, pgx: DataFrame) -> DataFrame:
    """(patient_id, genes, results) of every patient; null arrays: no result at all."""
    first = first_results(pgx).withColumn("patient_id", F.col("patient_id").cast("string"))
    pair = F.struct(F.concat("gene_key", F.lit("\u0001"), "phenotype_key").alias("pair"), F.col("pgx_result_id").alias("id"))
    # a patient has at most one entry per gene and phenotype
    grouped = first.groupBy("patient_id").agg(F.sort_array(F.collect_set("gene_key")).alias("genes"), F.sort_array(F.collect_list(pair)).alias("results"))
    return patients.select(F.col("id").cast("string").alias("patient_id")).distinct().join(grouped, "patient_id", "left")


def used_facts(patients: DataFrame, medications: DataFrame) -> DataFrame:
    """Patients' genes and results that some rule of `medications` uses, as `match_profiles` takes them.

    The lists of what is used depend on the curated rules only; a patient without any keeps empty ones.
    """
    values = lambda c, field: medications.select(F.explode(F.col(c)[field]).alias("v")).distinct().agg(F.collect_set("v").alias(f"_used_{field}"))
    used = values("_required", "key").crossJoin(values("_rules", "pair"))
    pairs = F.array_intersect(F.col("results")["pair"], F.col("_used_pair"))
    return (
        patients.crossJoin(F.broadcast(used))
        .withColumn("_pairs", pairs)
        .select(
            F.col("patient_id").alias("_patient_id"),
            F.array_intersect("genes", "_used_key").alias("_genes"),
            F.map_from_entries(F.filter("results", lambda r: F.array_contains("_pairs", r["pair"]))).alias("_found"),
        )
    )


@dataclass
class Profiles:
    """Results in buckets of patients, and the profiles of patients and medications, all under `root`."""

    spark: SparkSession
    root: str
    #: Columns of the stored results, and of the profiles.
    result: T.StructType
    patient: T.StructType
    medication: T.StructType
    buckets: int = BUCKETS
    keep: int = KEEP

    @classmethod
    def started(cls, root: str, patients: DataFrame, meds: DataFrame, rules: DataFrame, pgx: DataFrame, buckets: int = BUCKETS) -> Profiles:
        """Profiles of the tables as they are."""
        schemas = pgx.schema, patient_rows(patients, pgx).schema, medication_profiles(meds, rules).schema
        found = cls(patients.sparkSession, root, *schemas, buckets)
        found.known.write(patients.select(F.col("id").cast("string").alias("id")).distinct(), "-start")
        found.results.write(pgx, "-start")
        found.patients.write(patient_rows(found.known.read(), found.results.read()), "-start")
        found.medications.write(medication_profiles(meds, rules), "-start")
        return found

    def _table(self, name: str, key: str, schema: T.StructType) -> BucketTable:
        return BucketTable(self.spark, self.root, name, key, self.buckets, schema)

    @property
    def known(self) -> BucketTable:
        return self._table("patient_ids", "id", T.StructType([T.StructField("id", T.StringType())]))

    @property
    def results(self) -> BucketTable:
        return self._table("pgx_results", "patient_id", self.result)

    @property
    def patients(self) -> BucketTable:
        return self._table("patient_profiles", "patient_id", self.patient)

    @property
    def medications(self) -> BucketTable:
        return self._table("medication_profiles", "_med_id", self.medication)

    def change_results(self, batch: DataFrame, merge: Merge, version: str) -> list[int]:
        """Merge a batch into the results, and rewrite the profiles of its patients' buckets."""
        touched = apply_batch(batch, merge, self.results, version, self.keep)
        self.patients.write(patient_rows(self.known.read(touched), self.results.read(touched)), version, touched)
        self.patients.expire(self.keep)
        return touched

    def change_medications(self, meds: DataFrame, rules: DataFrame, version: str) -> list[int]:
        """Rewrite the profiles in the buckets of `meds`, which holds all medications of these buckets."""
        new = medication_profiles(meds, rules)
        touched = self.medications.touched(meds, "id")
        self.medications.write(new, version, touched)
        self.medications.expire(self.keep)
        return touched

    def results_stream(self, changes: DataFrame, merge: Merge, checkpoint: str, **trigger) -> StreamingQuery:
        """`change_results` for each micro-batch."""
        return (
            changes.writeStream.foreachBatch(lambda batch, number: self.change_results(batch, merge, f"{number:010d}") and None)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def match(self, requests: DataFrame) -> DataFrame:
        """Decisions for a batch of requests, from the buckets of its patients and medications.

        A patient's results go along with every request, so they are first brought down to what these medications' rules use.
        """
        ids = requests.select(*[trim_all(F.col(c).cast("string")).alias(c) for c in ("patient_id", "medication_id")])
        medications = self.medications.read(self.medications.touched(ids, "medication_id"))
        return match_profiles(requests, used_facts(self.patients.read(self.patients.touched(ids)), medications), medications)

    def history_stream(self, requests: DataFrame, path: str, checkpoint: str, request: list[str], clock: str | None = None, **trigger) -> StreamingQuery:
        """Decide streamed requests against the profiles as they are, and keep the history, a run per micro-batch.

        A batch that runs again replaces its own rows, which carry the batch's own time.
        """

        def decide(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            at = batch_clock(batch.sparkSession, clock or f"{checkpoint}-clock", number)
            run = f"batch-{number:010d}"
            append_risk_results(risk_history_rows(self.match(batch), run, F.lit(at), request), path, f"{at:%Y-%m-%d}", run)
            batch.unpersist()

        return (
            requests.writeStream.foreachBatch(decide)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
