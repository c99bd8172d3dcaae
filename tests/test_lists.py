"""Medication lists, search and profiles."""

import hashlib
import itertools
import random
import shutil

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from allelegate.operators import lists as L
from allelegate.operators import search as S
from allelegate.operators import search_index as X
from allelegate.plans import domains as D
from allelegate.plans.item_scan import Held, held_before, item_map

ITEMS = "id string, patient_id string, medication_id string, status string, notes string, created_at int, updated_at int"
any_id = lambda c: F.col(c).isNotNull()


def meds(spark, rows):
    return spark.createDataFrame(rows, "id string, generic_name string, brand_name string, drug_class string, is_active boolean")


def folded(items, changes):
    """Codes by time and the list at the end, one change after the other, each by the id that it names."""
    held = {i[0]: [i[1], i[2], i[3], i[4], i[5]] for i in items}
    codes = {}
    for t, patient, med, item, op, status, notes in changes:
        clean, kept = (status or "").strip(), (notes or "").strip() or None
        own = item in held and held[item][0] == patient
        if op not in ("add", "update", "remove") or (op != "add" and item is None) or (op == "update" and clean not in ("active", "past", "considering")):
            codes[t] = "INVALID_INPUT"
        elif op == "add" and med != "m1" and med != "m2":
            codes[t] = "MEDICATION_NOT_FOUND"
        elif op == "add":
            there = any(h[0] == patient and h[1] == med for h in held.values())
            codes[t] = "DUPLICATE_MEDICATION" if there else "ADDED"
            if not there:
                held[md5(f"item|{patient}|{med}|{t}")] = [patient, med, "active", None, t]
        elif not own:
            codes[t] = "NOT_FOUND"
        elif op == "update":
            codes[t] = "UPDATED"
            held[item][2:4] = [clean, kept]
        else:
            codes[t] = "REMOVED"
            del held[item]
    return codes, held


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


CHANGE = "t int, patient_id string, medication_id string, item_id string, op string, status string, notes string"


def changed(spark, items, changes, segments):
    listed, asked = spark.createDataFrame(items, ITEMS), spark.createDataFrame(changes, CHANGE).repartition(3)
    known = meds(spark, [("m1", "a", None, None, True), ("m2", "b", None, None, True), ("off", "c", None, None, False)])
    out = L.change_outcomes(asked, listed, known, ["t"], any_id, segments=segments)
    final = L.apply_list_changes(listed, out, ["t"], "t").collect()
    return {r.t: r.code for r in out.collect()}, {r.id: [r.patient_id, r.medication_id, r.status, r.notes, r.created_at] for r in final}


@pytest.mark.parametrize("segments", [1, 7, 40])
def test_ordered_changes_equal_a_fold(spark, segments):
    rng = random.Random(4)
    pairs = [("p1", "m1"), ("p1", "m2"), ("p2", "m1"), ("p3", "off")]
    items = [("i1", "p1", "m1", "past", "n", 0, 0), ("i4", "p3", "off", "past", None, 0, 0)]
    changes, made = [], {}
    for t in range(1, 150):
        patient, med = pairs[0] if rng.random() < 0.4 else rng.choice(pairs)
        op, status, notes = rng.choice(["add", "update", "remove", "remove", "other"]), rng.choice([" active", "past", "gone", None]), rng.choice([None, " ", f" t{t} "])
        if op == "add":
            made.setdefault(patient, []).append(md5(f"item|{patient}|{med}|{t}"))
        own = made.get(patient, [])
        # a stored item, one of the last adds, an early one, one that is to come, another patient's, or none
        item = rng.choice(["i1", "i4", *own[-2:], *own[-2:], *own[:1], md5(f"item|{patient}|{med}|{t + 5}"), *made.get("p2", [])[:1], None])
        changes.append((t, patient, med, item, op, status, notes))
    codes, held = folded(items, changes)
    assert set(codes.values()) == {"INVALID_INPUT", "MEDICATION_NOT_FOUND", "ADDED", "DUPLICATE_MEDICATION", "NOT_FOUND", "UPDATED", "REMOVED"}
    assert changed(spark, items, changes, segments) == (codes, held)


@pytest.mark.parametrize("segments", [1, 3])
def test_an_old_id_finds_nothing_after_remove_and_add(spark, segments):
    """An item that was removed is gone, also when its medication is on the list again."""
    items = [("i1", "p1", "m1", "past", "n", 0, 0)]
    new = md5("item|p1|m1|2")
    changes = [
        (1, "p1", None, "i1", "remove", None, None), (2, "p1", "m1", None, "add", None, None),
        (3, "p1", None, "i1", "update", "active", "old"), (4, "p1", None, "i1", "remove", None, None),
        (5, "p2", None, new, "remove", None, None), (6, "p1", None, new, "update", "considering", "new"),
    ]
    codes, held = changed(spark, items, changes, segments)
    assert [codes[t] for t in range(1, 7)] == ["REMOVED", "ADDED", "NOT_FOUND", "NOT_FOUND", "NOT_FOUND", "UPDATED"]
    assert held == {new: ["p1", "m1", "considering", "new", 2]}


def test_changes_take_odd_rows(spark):
    items = [("i1", "p1", "m1", "past", "n", 0, 0)]
    changes = [(1, None, None, None, None, None, None), (2, None, "m1", None, "add", None, None), (3, "p1", "m1", None, "add", None, None)]
    codes, held = changed(spark, items, changes, 2)
    assert codes == {1: "INVALID_INPUT", 2: "INVALID_INPUT", 3: "DUPLICATE_MEDICATION"}
    assert held == {"i1": ["p1", "m1", "past", "n", 0]}
    assert changed(spark, items, [], 2) == ({}, {"i1": ["p1", "m1", "past", "n", 0]})


ids = st.sampled_from(["a", "b", "c", "d"])


@given(st.lists(st.tuples(ids, st.booleans()), max_size=40), st.sampled_from([None, "a", "b"]), st.randoms())
def test_maps_of_changes_compose_in_any_bracketing(ops, stored, rng):
    changes = [(i, None) if add else (None, i) for i, add in ops]
    after = lambda rows, held: held_before(held, [*rows, (None, None)])[-1]
    cuts = sorted(rng.sample(range(len(changes) + 1), min(len(changes), rng.randrange(5))))
    parts = [changes[a:b] for a, b in itertools.pairwise([0, *cuts, len(changes)])]
    maps = [item_map("k", "k", stored, p) for p in parts]

    def bracketed(some):
        if len(some) == 1:
            return some[0]
        cut = rng.randrange(1, len(some))
        return bracketed(some[:cut]).then(bracketed(some[cut:]))

    whole = bracketed(maps)
    for held in (None, "a", "b", "c", "z"):
        assert whole.after(Held("k", held)).id == after(changes, held)
    assert maps[0].after(None).id == after(parts[0], stored)
    other = item_map("j", "j", "c", changes[:3])
    assert maps[0].then(other).after(Held("k", "a")) == other.fresh


def test_adds_updates_removes(spark):
    uuid = lambda n: f"00000000-0000-4000-8000-{n:012d}"
    listed = spark.createDataFrame([(uuid(9), uuid(1), uuid(5), "active", None, 0, 0)], ITEMS)
    known = meds(spark, [(uuid(5), "a", None, None, True), (uuid(6), "b", None, None, True), (uuid(7), "c", None, None, False)])
    adds = spark.createDataFrame([(1, uuid(1), uuid(5)), (2, uuid(1), uuid(6)), (3, uuid(1), uuid(6)), (4, uuid(1), uuid(7)), (5, "x", uuid(6))],
                                 "t int, patient_id string, medication_id string")
    out = L.add_outcomes(adds, listed, known, ["t"])
    assert {r.t: r.code for r in out.collect()} == {1: "DUPLICATE_MEDICATION", 2: None, 3: "DUPLICATE_MEDICATION", 4: "MEDICATION_NOT_FOUND", 5: "INVALID_INPUT"}
    assert L.apply_list_adds(listed, out, F.lit(7)).count() == 2
    updates = spark.createDataFrame([(1, uuid(9), uuid(1), "past", " hi "), (2, uuid(9), uuid(1), "unknown", ""), (3, uuid(9), uuid(2), "past", ""),
                                     (4, uuid(9), uuid(1), "past", "x" * 501)], "t int, item_id string, patient_id string, status string, notes string")
    out = L.update_outcomes(updates, listed)
    assert {r.t: r.code for r in out.collect()} == {1: None, 2: "INVALID_INPUT", 3: "NOT_FOUND", 4: "INVALID_INPUT"}
    item = L.apply_list_updates(listed, out, ["t"], F.lit(7)).first()
    assert (item.status, item.notes, item.updated_at) == ("past", "hi", 7)
    removes = spark.createDataFrame([(2, uuid(9), uuid(1)), (1, uuid(9), uuid(1)), (3, uuid(9), uuid(2)), (4, "bad", uuid(1))], "t int, item_id string, patient_id string")
    out = L.remove_outcomes(removes, listed, ["t"])
    assert {r.t: r.code for r in out.collect()} == {1: None, 2: "NOT_FOUND", 3: "NOT_FOUND", 4: "INVALID_INPUT"}
    assert L.apply_list_removes(listed, out).count() == 0


def test_shown_list_claims_nothing(spark):
    listed = spark.createDataFrame([("i", "p", "off", "past", None, 0, 0)], ITEMS)
    got = L.medication_list(listed, meds(spark, [("off", "c", None, None, False)])).first()
    assert got.notes == "" and got.safety.status == "not_evaluated" and got.assessment.score is None
    assert got.assessment.level == "unknown" and got.assessment.factors[0].code == "VERIFIED_SAFETY_DATA_UNAVAILABLE"


def like(text, pattern):
    """`ilike` by hand; a backslash takes the next character as it is."""
    if not pattern:
        return not text
    if pattern[0] == "%":
        return any(like(text[i:], pattern[1:]) for i in range(len(text) + 1))
    if pattern[0] == "\\" and len(pattern) > 1:
        return bool(text) and text[0] == pattern[1] and like(text[1:], pattern[2:])
    return bool(text) and pattern[0] in ("_", text[0]) and like(text[1:], pattern[1:])


@pytest.mark.parametrize(("first", "rare"), [(64, 4096), (2, 0)])
def test_search_equals_brute_force(spark, first, rare, monkeypatch):
    monkeypatch.setattr(X, "FIRST", first)
    monkeypatch.setattr(X, "RARE", rare)
    rng = random.Random(2)
    rows = [(f"m{i:02d}", "".join(rng.choice("abC%_x1") for _ in range(rng.randrange(1, 9))), rng.choice([None, "Plavix", "a_b%"]), "c", i % 7 != 0)
            for i in range(60)]
    queries = ["PLAVIX", "Adderall", "   ", None, "%", "_", "a", "ab", "c_a", "a%b", r"\%", r"\_b", r"\a", "____", "%%", "abc", " x ", "_1", r"a\%", "x\\"]
    known, asked = meds(spark, rows), spark.createDataFrame([(q,) for q in queries], "query string")
    got = {}
    for r in S.search_medications(known, asked).orderBy("query", "position").collect():
        got.setdefault(r.query, []).append((r.id, r.message))
    for q in {(q or "").strip() for q in queries}:
        hits = sorted((n, i) for i, n, b, _, a in rows if a and (like(n.lower(), f"%{q}%".lower()) or like((b or "\0").lower(), f"%{q}%".lower())))
        want = [(i, None) for _, i in hits[:10]] or [(None, D.UNSUPPORTED)]
        assert got[q] == (want if q else [(None, D.EMPTY_QUERY)]), q
        if q:
            assert {r.id for r in S.name_contains(known, q).where("is_active").collect()} == {i for _, i in hits}


def test_a_wildcard_reads_the_head_of_the_name_order(spark, tmp_path, monkeypatch):
    """A search for anything costs the first segment, however many names there are, and its index may be kept."""
    monkeypatch.setattr(X, "RARE", 400)
    rows = [(f"m{i:05d}", f"name {i * 7919 % 3000:04d}", None, "c", True) for i in range(3000)]
    index = X.SearchIndex.built(meds(spark, rows), str(tmp_path))
    asked = lambda *qs: spark.createDataFrame([(q,) for q in qs], "query string")
    listed = index.search(asked("%", "_", "n", "99"), 10).orderBy("query", "position").collect()
    names = sorted(r[1] for r in rows)
    assert [r.generic_name for r in listed if r["query"] == "%"] == names[:10]
    assert [r.generic_name for r in listed if r["query"] == "99"] == [n for n in names if "99" in n][:10]
    assert index.tokens.where("token = ''").isEmpty()
    places = index.postings(0).groupBy("token").agg(F.sum(F.size("places")).alias("n"), F.max("block").alias("b"))
    assert places.agg(F.max("n"), F.max("b")).first() == (64, 0)
    assert max(r.n for r in index.postings(1).select(F.size("places").alias("n")).collect()) <= X.BLOCK
    # a wildcard needs the first segment's files only
    shutil.rmtree(f"{tmp_path}/postings/segment=1")
    again = index.search(asked("%", "_", "n"), 10).collect()
    assert sorted((r["query"], r.generic_name) for r in again) == sorted((q, n) for q in ("%", "_", "n") for n in names[:10])
    found = S.search_medications(meds(spark, rows), asked("%", " "), index=index).collect()
    assert len(found) == 11 and X.SearchIndex.built(meds(spark, rows[:0]), str(tmp_path / "none")).search(asked("%", "a"), 10).isEmpty()


def test_profiles_and_options(spark):
    pgx = spark.createDataFrame([("2", "p", "SLCO1B1", "odd", None), ("1", "p", "CYP2C19", "rapid metabolizer", "g")], "id string, patient_id string, gene string, phenotype string, genotype string")
    patients = spark.createDataFrame([("p",), ("q",)], "id string")
    asked = spark.createDataFrame([(" p ",), ("q",), ("x",), ("",)], "patient_id string")
    got = sorted(((r.patient_id or "", r.supported, r.message, r.gene, r.position) for r in S.gene_profile(asked, patients, pgx).collect()), key=repr)
    assert got == sorted([("", False, D.MISSING_PATIENT_ID, None, None), ("p", True, None, "CYP2C19", 1), ("p", True, None, "SLCO1B1", 2),
                          ("q", True, None, None, None), ("x", False, D.PATIENT_NOT_FOUND, None, None)], key=repr)
    domain = spark.createDataFrame([(g, i, p) for g, ps in D.PHENOTYPES.items() for i, p in enumerate(ps)], "gene string, idx int, phenotype string")
    choice = {r.id: (r.allowed, r.choice) for r in S.phenotype_options(pgx, domain).collect()}
    assert choice == {"1": (True, "rapid metabolizer"), "2": (False, "normal function")}
