"""Risk matching: every (patient, medication) request against the approved rules.

Rules are gathered per medication and results per patient, and each request is decided by expressions on its own
row; nothing is exploded, and a hot medication or patient only repeats a joined row.  The arrays depend on the
curated rules, not on the number of requests, patients or results: one medication's rules, which its matches list
anyway, and per patient at most the gene and phenotype pairs that rules use.  This plan is taken at every size, on
tables and on streams.

`plan="rows"` gives the same rows from one row per (request pair, rule) and (request pair, gene), for a caller whose
medications have very many rules.  It gathers the requests of a patient, and then those of a
medication, in one task that Spark does not divide.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelegate.functions.text import (
    match_key,
    missing_gene_message,
    risk_rank,
    stable_id,
    trim_all,
)
from allelegate.plans import domains as D

RULE_TEXTS = ["patient_summary", "clinician_summary", "recommended_action", "evidence_source"]

# Tasks over which requests without an id are spread where they meet patients or medications.
SPREAD = 1024

BRANCHES = [
    "missing_ids",
    "unsupported",
    "unknown_patient",
    "no_rules",
    "no_results",
    "missing_genes",
    "no_match",
    "matched",
]


def active_medications(meds: DataFrame) -> DataFrame:
    return meds.where("is_active")


def approved_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("review_status") == D.APPROVED)


def keyed_rules(rules: DataFrame) -> DataFrame:
    """Approved rules with their match keys, rank and texts; absent texts are null."""
    have = set(rules.columns)
    texts = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in RULE_TEXTS]
    return approved_rules(rules).select(
        "medication_id",
        F.col("id").alias("rule_id"),
        "gene",
        "phenotype",
        "risk_level",
        *texts,
        match_key("gene").alias("gene_key"),
        match_key("phenotype").alias("phenotype_key"),
        risk_rank("risk_level").alias("risk_rank"),
    )


def keyed_results(pgx: DataFrame) -> DataFrame:
    """Patient results with match keys; `first_by` orders results that share a key."""
    order = F.struct(F.col("created_at") if "created_at" in pgx.columns else F.col("updated_at"), F.col("id"))
    return pgx.select(
        "patient_id",
        F.col("id").alias("pgx_result_id"),
        "gene",
        "phenotype",
        match_key("gene").alias("gene_key"),
        match_key("phenotype").alias("phenotype_key"),
        order.alias("first_by"),
    )


def required_genes(rules: DataFrame) -> DataFrame:
    """Genes a medication needs: one row per gene key, the spelling of its first rule."""
    return (
        keyed_rules(rules)
        .where("gene_key <> ''")
        .groupBy("medication_id", "gene_key")
        .agg(F.min_by("gene", "rule_id").alias("gene"), F.min("rule_id").alias("first_rule_id"))
    )


def request_pairs(requests: DataFrame) -> DataFrame:
    """Distinct pairs with both ids."""
    return requests.select("patient_id", "medication_id").dropna().distinct()


def relevant_results(pgx: DataFrame, requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Results of the requested patients whose gene the requested medication needs."""
    pairs = request_pairs(requests)
    needed = required_genes(rules).select("medication_id", "gene_key")
    return pairs.join(needed, "medication_id").join(keyed_results(pgx), ["patient_id", "gene_key"])


def missing_genes(requests: DataFrame, rules: DataFrame, pgx: DataFrame) -> DataFrame:
    """Required genes without a result: one row per (patient, medication, gene)."""
    pairs = request_pairs(requests)
    known = keyed_results(pgx).select("patient_id", "gene_key").distinct()
    return pairs.join(required_genes(rules), "medication_id").join(known, ["patient_id", "gene_key"], "left_anti")


def first_results(pgx: DataFrame) -> DataFrame:
    """First result per (patient, gene key, phenotype key)."""
    return (
        keyed_results(pgx)
        .groupBy("patient_id", "gene_key", "phenotype_key")
        .agg(F.min_by("pgx_result_id", "first_by").alias("pgx_result_id"))
    )


def match_first(requests: DataFrame, rules: DataFrame, pgx: DataFrame) -> DataFrame:
    """Each approved rule of a requested medication with the patient's first matching result.

    A pair meets its patient's results as one array, no longer than the gene and phenotype pairs that rules use, and its
    medication's rules last: the rows of (pair, rule) are filtered where they arise and never shuffled.
    """
    named = keyed_rules(rules).where("gene_key <> ''")
    used = named.select("gene_key", "phenotype_key").distinct()
    result = F.struct("gene_key", "phenotype_key", "pgx_result_id")
    held = (
        first_results(pgx)
        .join(used, ["gene_key", "phenotype_key"], "left_semi")
        .groupBy("patient_id")
        .agg(F.collect_list(result).alias("_results"))
    )
    same = lambda r: (r["gene_key"] == F.col("gene_key")) & (r["phenotype_key"] == F.col("phenotype_key"))
    met = request_pairs(requests).join(held, "patient_id").join(named, "medication_id")
    hits = met.where(F.exists("_results", same)).withColumn("pgx_result_id", F.filter("_results", same)[0]["pgx_result_id"])
    keys = ["patient_id", "gene_key", "phenotype_key", "medication_id"]
    return hits.select(*keys, *[c for c in named.columns if c not in keys], "pgx_result_id")


def match_risk(
    requests: DataFrame,
    patients: DataFrame,
    meds: DataFrame,
    rules: DataFrame,
    pgx: DataFrame,
    plan: str = "array",
) -> DataFrame:
    """Decide every request; the columns of `requests` are kept.

    `decided_patient` and `decided_medication` are the trimmed ids that the decision is about.

    `branch` names the decision (see BRANCHES); `matches` holds the matched
    rules by falling risk, then rule id, and its first element is the primary
    one that the flat columns repeat.
    """
    if plan not in ("array", "rows"):
        raise ValueError(f"unknown plan: {plan}")
    requests = requests.withColumns(
        {"_patient": _clean(requests, "patient_id"), "_medication": _clean(requests, "medication_id")}
    )
    if plan == "array":
        facts = _facts_by_arrays(requests, patients, meds, rules, pgx)
    else:
        facts = _facts_by_rows(requests, patients, meds, rules, pgx)
    return _decide(facts)


def match_profiles(requests: DataFrame, patient_side: DataFrame, medication_side: DataFrame) -> DataFrame:
    """`match_risk` against profiles that are there already.

    `patient_side` has the columns of `patient_profiles`, for any superset of the genes and pairs that rules use;
    `medication_side` those of `medication_profiles`.  Ids compare as text.
    """
    requests = requests.withColumns(
        {"_patient": _clean(requests, "patient_id"), "_medication": _clean(requests, "medication_id")}
    )
    return _decide(_facts_of_profiles(requests, patient_side, medication_side))


def _clean(df: DataFrame, name: str) -> Column:
    """Trimmed id, null when blank; ids that are not text can only be null."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.nullif(trim_all(name), F.lit(""))
    return F.col(name)


def _medication_columns(meds: DataFrame) -> DataFrame:
    return active_medications(meds).select(
        F.col("id").alias("_med_id"),
        F.struct("id", "generic_name", "brand_name", "drug_class").alias("medication"),
    )


def _match_struct() -> list[str]:
    return ["rule_id", "gene", "phenotype", "risk_level", *RULE_TEXTS]


def medication_profiles(meds: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per active medication: rules by falling risk, genes by first rule."""
    rule = F.struct("rule_id", "gene_key", "phenotype_key", "risk_rank", *_match_struct()[1:])
    grouped = keyed_rules(rules).groupBy("medication_id").agg(F.sort_array(F.collect_list(rule)).alias("_by_id"))
    named = F.filter("_by_id", lambda r: r["gene_key"] != "")
    keys = F.array_distinct(F.transform(named, lambda r: r["gene_key"]))
    genes = F.transform(
        keys,
        lambda k: F.struct(
            k.alias("key"), F.filter(named, lambda r: r["gene_key"] == k)[0]["gene"].alias("gene")
        ),
    )
    ranked = F.transform(
        named,
        lambda r: F.struct(
            (-r["risk_rank"]).alias("falling"),
            r["rule_id"].alias("rule_id"),
            F.concat(r["gene_key"], F.lit("\u0001"), r["phenotype_key"]).alias("pair"),
            *[r[c].alias(c) for c in _match_struct()[1:]],
        ),
    )
    profiles = grouped.select(
        "medication_id",
        F.size("_by_id").alias("_n_rules"),
        genes.alias("_required"),
        F.sort_array(ranked).alias("_rules"),
    )
    return _medication_columns(meds).join(
        profiles, F.col("_med_id") == F.col("medication_id"), "left"
    ).drop("medication_id")


def patient_profiles(patients: DataFrame, rules: DataFrame, pgx: DataFrame) -> DataFrame:
    """One row per patient: genes with a result, and the first result per rule pair.

    Results are first brought down to the genes and pairs that rules use, so an
    array never outgrows the number of rule pairs, however many results a
    patient has.
    """
    used = (
        keyed_rules(rules)
        .where("gene_key <> ''")
        .groupBy(F.col("gene_key").alias("_gene"))
        .agg(F.collect_set("phenotype_key").alias("_phenotypes"))
    )
    keyed = keyed_results(pgx).join(used, F.col("gene_key") == F.col("_gene"), "left")
    reduced = (
        keyed.select(
            "patient_id",
            F.col("_gene").alias("gene"),
            F.when(F.array_contains("_phenotypes", F.col("phenotype_key")), F.col("phenotype_key")).alias("phenotype"),
            "pgx_result_id",
            "first_by",
        )
        .groupBy("patient_id", "gene", "phenotype")
        .agg(F.min_by("pgx_result_id", "first_by").alias("pgx_result_id"))
    )
    pair = F.when(
        F.col("phenotype").isNotNull(),
        F.struct(F.concat("gene", F.lit("\u0001"), "phenotype").alias("key"), F.col("pgx_result_id").alias("value")),
    )
    grouped = reduced.groupBy(F.col("patient_id").alias("_owner")).agg(
        F.collect_set("gene").alias("_genes"),
        F.map_from_entries(F.collect_list(pair)).alias("_found"),
    )
    return (
        patients.select(F.col("id").alias("_patient_id"))
        .join(grouped, F.col("_patient_id") == F.col("_owner"), "left")
        .drop("_owner")
    )


def _facts_by_arrays(requests, patients, meds, rules, pgx) -> DataFrame:
    return _facts_of_profiles(requests, patient_profiles(patients, rules, pgx), medication_profiles(meds, rules))


def _facts_of_profiles(requests: DataFrame, patient_side: DataFrame, medication_side: DataFrame) -> DataFrame:
    joined = requests.join(patient_side, F.col("_patient") == F.col("_patient_id"), "left").join(
        medication_side, F.col("_medication") == F.col("_med_id"), "left"
    )
    gaps = F.filter("_required", lambda g: ~F.array_contains("_genes", g["key"]))
    hits = F.filter("_rules", lambda r: F.map_contains_key(F.col("_found"), r["pair"]))
    found = F.transform(
        hits,
        lambda r: F.struct(
            *[r[c].alias(c) for c in _match_struct()],
            F.try_element_at(F.col("_found"), r["pair"]).alias("pgx_result_id"),
        ),
    )
    return joined.select(
        *[c for c in requests.columns if c not in ("_patient", "_medication")],
        "_patient",
        "_medication",
        "_patient_id",
        "_med_id",
        "medication",
        F.coalesce("_n_rules", F.lit(0)).alias("_n_rules"),
        F.col("_genes").isNotNull().alias("_has_results"),
        F.transform("_required", lambda g: g["gene"]).alias("_all_genes"),
        F.transform(gaps, lambda g: g["gene"]).alias("_gaps"),
        found.alias("_matches"),
    )


def _numbered_pairs(named: DataFrame) -> DataFrame:
    """One row per gene key that rules use, with a number for each of its phenotype keys.

    A gene's numbers follow its `_low`, which stands for any other phenotype, up to `_high`.  This is the vocabulary of
    the curated rules and is sent to all tasks.
    """
    number = F.row_number().over(Window.orderBy("gene_key", "phenotype_key")) + F.dense_rank().over(Window.orderBy("gene_key"))
    used = (
        named.select("gene_key", "phenotype_key")
        .distinct()
        .withColumn("_no", number)
        .groupBy(F.col("gene_key").alias("_gene"))
        .agg(
            (F.min("_no") - 1).alias("_low"),
            F.max("_no").alias("_high"),
            F.map_from_entries(F.collect_list(F.struct("phenotype_key", "_no"))).alias("_numbers"),
        )
    )
    return F.broadcast(used)


def _numbered_results(pgx: DataFrame, used: DataFrame) -> DataFrame:
    """One row per patient with results: the numbers of those that rules use, and beside them the ids of the first ones."""
    pair = F.try_element_at("_numbers", F.col("phenotype_key"))
    reduced = (
        keyed_results(pgx)
        .join(used, F.col("gene_key") == F.col("_gene"), "left")
        .select("patient_id", F.coalesce(pair, "_low").alias("_no"), F.when(pair.isNotNull(), F.col("first_by")).alias("_by"))
        .groupBy("patient_id", "_no")
        .agg(F.min("_by")["id"].alias("_id"))
    )
    found = F.when(F.col("_no").isNotNull(), F.struct("_no", "_id"))
    grouped = reduced.groupBy(F.col("patient_id").alias("_owner")).agg(F.sort_array(F.collect_list(found)).alias("_first"))
    return grouped.select("_owner", F.col("_first._no").alias("_pairs"), F.col("_first._id").alias("_ids"))


def _rule_rows(rules: DataFrame, named: DataFrame, used: DataFrame) -> DataFrame:
    """What a medication asks of its pairs: a row per rule, and a row per gene that it needs."""
    rule = F.struct((-F.col("risk_rank")).alias("falling"), *_match_struct())
    of = F.col("medication_id").alias("_of")
    number = F.element_at("_numbers", F.col("phenotype_key")).alias("_no")
    known = F.col("gene_key") == F.col("_gene")
    by_rule = named.join(used, known).select(of, number, rule.alias("_rule"))
    by_gene = required_genes(rules).join(used, known).select(
        of, "_low", "_high", F.struct("first_rule_id", "gene").alias("_need")
    )
    return by_rule.unionByName(by_gene, allowMissingColumns=True)


def _spread(requests: DataFrame, key: Column) -> Column:
    """A second join key that spreads the rows without `key`, which find nothing anyway."""
    plain = [f.name for f in requests.schema if isinstance(f.dataType, T.AtomicType)]
    return F.when(key.isNull(), F.pmod(F.xxhash64(*plain), F.lit(SPREAD))).otherwise(F.lit(0))


def _facts_by_rows(requests, patients, meds, rules, pgx) -> DataFrame:
    """A request is moved to its patient and then to its medication, and nothing else that grows with requests is.

    It takes along the numbers of its patient's results, no more than rules use.  The first request of a pair meets the
    rows of its medication, of which those that tell something stay; a window gives them to the whole pair.
    """
    plain = [c for c in requests.columns if c not in ("_patient", "_medication")]
    requests = requests.select(*plain)
    # written out, not carried: a copy of an id would be shuffled beside it
    patient, medication = _clean(requests, "patient_id"), _clean(requests, "medication_id")
    no_patient, no_medication = _spread(requests, patient), _spread(requests, medication)
    none = lambda c: F.when(F.col(c).isNull(), 1).otherwise(0).cast("long")

    named = keyed_rules(rules).where("gene_key <> ''")
    used = _numbered_pairs(named)
    held = (
        patients.select(F.col("id").alias("_patient_id"))
        .join(_numbered_results(pgx, used), F.col("_patient_id") == F.col("_owner"), "left")
        .drop("_owner")
    )
    pair = [no_patient, patient, no_medication, medication]
    met = (
        requests.join(held, (patient == F.col("_patient_id")) & (no_patient == none("_patient_id")), "left")
        .withColumn("_leads", F.row_number().over(Window.partitionBy(*pair).orderBy(F.lit(0))) == 1)
        .select(*plain, "_leads", F.col("_patient_id").isNotNull().alias("_known"), "_pairs", "_ids")
    )

    hit = F.coalesce(F.array_contains("_pairs", F.col("_no")), F.lit(False))
    has_gene = F.exists("_pairs", lambda n: n.between(F.col("_low"), F.col("_high")))
    gap = F.col("_need").isNotNull() & ~F.coalesce(has_gene, F.lit(False))
    asked = _rule_rows(rules, named, used)
    on = (medication == F.col("_of")) & (no_medication == none("_of")) & F.col("_leads") & (hit | gap)
    told = met.join(asked, on, "left")
    same = Window.partitionBy(no_medication, medication, no_patient, patient).orderBy(F.desc("_leads"))
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    result = F.get("_ids", (F.array_position("_pairs", F.col("_no")) - 1).cast("int"))
    match = F.when(
        F.col("_rule").isNotNull(),
        F.struct("_rule.falling", *[f"_rule.{c}" for c in _match_struct()], result.alias("pgx_result_id")),
    )
    gathered = told.withColumns(
        {
            "_found": F.sort_array(F.collect_list(match).over(whole)),
            "_gap": F.sort_array(F.collect_list("_need").over(whole)),
            "_place": F.row_number().over(same),
        }
    ).where(~F.col("_leads") | (F.col("_place") == 1))

    n_rules = approved_rules(rules).groupBy("medication_id").agg(F.count(F.lit(1)).cast("int").alias("_n_rules"))
    stored = _medication_columns(meds).join(n_rules, F.col("_med_id") == F.col("medication_id"), "left").drop("medication_id")
    gaps = F.transform("_gap", lambda g: g["gene"])
    return gathered.join(
        stored, (medication == F.col("_med_id")) & (no_medication == none("_med_id")), "left"
    ).select(
        *plain,
        patient.alias("_patient"),
        medication.alias("_medication"),
        F.when(F.col("_known"), patient).alias("_patient_id"),
        "_med_id",
        "medication",
        F.coalesce("_n_rules", F.lit(0)).alias("_n_rules"),
        F.col("_pairs").isNotNull().alias("_has_results"),
        gaps.alias("_all_genes"),  # read only where a patient has no results, and so lacks every gene
        gaps.alias("_gaps"),
        F.transform(
            "_found",
            lambda m: F.struct(*[m[c].alias(c) for c in [*_match_struct(), "pgx_result_id"]]),
        ).alias("_matches"),
    )


def _decide(facts: DataFrame) -> DataFrame:
    """First true condition wins; the order of the conditions is part of the contract.

    The decision is a number from 1 to 8 (BRANCHES).  Texts come from constant
    arrays indexed by it, which keeps the generated code of a row small.
    """
    decision = (
        F.when(F.col("_patient").isNull() | F.col("_medication").isNull(), 1)
        .when(F.col("_med_id").isNull(), 2)
        .when(F.col("_patient_id").isNull(), 3)
        .when(F.col("_n_rules") == 0, 4)
        .when(~F.col("_has_results"), 5)
        .when(F.size("_gaps") > 0, 6)
        .when(F.coalesce(F.size("_matches"), F.lit(0)) <= 0, 7)
        .otherwise(8)
    )
    # The first three decisions need the ids only: a filter on them reaches the joins, and repeats no work on arrays.
    supported = reduce(and_, [F.col(c).isNotNull() for c in ("_patient", "_medication", "_med_id", "_patient_id")])
    plain = [c for c in facts.columns if not c.startswith("_") and c != "medication"]
    d = F.col("_decision")
    first = F.col("_primary")

    def by_decision(*values: str | None) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), d)

    def text(no_rules: str, no_results: str, otherwise: str, field: str) -> Column:
        fixed = by_decision(None, None, None, no_rules, no_results, otherwise, otherwise, None)
        return F.coalesce(first[field], fixed).alias(field)

    insufficient = ["insufficient_data"] * 4
    staged = facts.withColumn("_decision", decision).withColumn(
        "matches", F.when(d == 8, F.col("_matches"))
    ).withColumn("_primary", F.get(F.col("matches"), F.lit(0)))
    return staged.select(
        *plain,
        F.col("_patient").alias("decided_patient"),
        F.col("_medication").alias("decided_medication"),
        by_decision(*BRANCHES).alias("branch"),
        supported.alias("supported"),
        (d == 8).alias("matched"),
        by_decision(None, None, None, *insufficient, "matched").alias("status"),
        F.coalesce(first["risk_level"], by_decision(None, None, None, *insufficient, None)).alias("risk_level"),
        F.when(d > 3, F.col("medication")).alias("medication"),
        F.when(d == 6, missing_gene_message("_gaps"))
        .otherwise(
            by_decision(
                D.MISSING_IDS, D.UNSUPPORTED, D.PATIENT_NOT_FOUND, D.NO_RULES, D.NO_RESULTS, None, D.NO_MATCH, D.MATCHED
            )
        )
        .alias("message"),
        F.when(d == 5, F.col("_all_genes"))
        .when(d == 6, F.col("_gaps"))
        .otherwise(F.array().cast("array<string>"))
        .alias("missing_genes"),
        "matches",
        first["gene"].alias("gene"),
        first["phenotype"].alias("phenotype"),
        text(D.INSUFFICIENT_PATIENT, D.NO_RESULTS_PATIENT, D.INSUFFICIENT_PATIENT, "patient_summary"),
        text(D.NO_RULES, D.NO_RESULTS_CLINICIAN, D.INSUFFICIENT_CLINICIAN, "clinician_summary"),
        text(D.INSUFFICIENT_ACTION, D.NO_RESULTS_ACTION, D.INSUFFICIENT_ACTION, "recommended_action"),
        first["evidence_source"].alias("evidence_source"),
        first["rule_id"].alias("rule_id"),
        first["pgx_result_id"].alias("pgx_result_id"),
    )


def overall_risk(matches: DataFrame) -> DataFrame:
    """Highest risk per (patient, medication) over rows of `match_first`."""
    return matches.groupBy("patient_id", "medication_id").agg(
        F.max("risk_rank").alias("risk_rank"),
        F.max_by("risk_level", "risk_rank").alias("risk_level"),
        F.count(F.lit(1)).alias("n_matches"),
    )


def matches_by_risk(matches: DataFrame) -> DataFrame:
    """Rows of `match_first` by falling risk inside each pair; ties by rule id."""
    from allelegate.plans.skew import with_position

    falling = matches.withColumn("_falling", -F.col("risk_rank"))
    return with_position(falling, ["patient_id", "medication_id"], ["_falling", "rule_id"]).drop("_falling")


def risk_history_rows(decided: DataFrame, run_id: str, run_ts: Column, request: list[str]) -> DataFrame:
    """Rows to keep: one per match, or one without rule and result; none when unsupported.

    A missing gene is stored with the message as clinician text, which the
    returned result does not carry.  Patient and medication are the trimmed ids.  Ids derive from the run, the
    columns `request` that tell requests apart, and the rule, so a retried task writes the same rows and two
    requests for one pair have different ones.
    """
    rows = decided.where("supported").select(
        *[F.col(c).alias(f"_q{i}") for i, c in enumerate(request)],
        F.col("decided_patient").alias("patient_id"),
        F.col("decided_medication").alias("medication_id"),
        F.col("patient_summary").alias("_patient_text"),
        F.when(F.col("branch") == "missing_genes", F.col("message"))
        .otherwise(F.col("clinician_summary"))
        .alias("_clinician_text"),
        F.col("recommended_action").alias("_action"),
        F.explode_outer("matches").alias("m"),
    )
    hit = F.col("m").isNotNull()
    return rows.select(
        stable_id(F.lit(run_id), *[f"_q{i}" for i in range(len(request))], "patient_id", "medication_id", F.coalesce(F.col("m.rule_id").cast("string"), F.lit(""))).alias("id"),
        "patient_id",
        "medication_id",
        F.col("m.pgx_result_id").alias("pgx_result_id"),
        F.col("m.rule_id").alias("rule_id"),
        F.when(hit, F.col("m.risk_level")).otherwise("insufficient_data").alias("risk_level"),
        F.when(hit, F.col("m.patient_summary")).otherwise(F.col("_patient_text")).alias("patient_summary"),
        F.when(hit, F.col("m.clinician_summary")).otherwise(F.col("_clinician_text")).alias("clinician_summary"),
        F.when(hit, F.col("m.recommended_action")).otherwise(F.col("_action")).alias("recommended_action"),
        run_ts.alias("created_at"),
    )


def history_newest_first(history: DataFrame) -> DataFrame:
    """Kept rows in reading order: patient, then newest first."""
    return history.orderBy("patient_id", F.desc("created_at"), "id")


def latest_history(history: DataFrame, n: int) -> DataFrame:
    """The `n` newest rows of each patient; each task keeps `n` per patient before the shuffle."""
    newest = Window.partitionBy("patient_id").orderBy(F.desc("created_at"), F.asc("id"))
    return history.withColumn("position", F.row_number().over(newest).cast("bigint")).where(F.col("position") <= n)
