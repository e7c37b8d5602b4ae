"""Queries on tables that hold what the given ones happen not to."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from attestra.operators import embedding


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def asked(spark, folder, name):
    return [r.asDict() for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]


def test_labels_of_cases_without_one(spark, tmp_path):
    """No element of document 105 applies: its rendered heading has no label to read."""
    put(spark, tmp_path, "documents", [(i, f"text {i}", "en", "src0", 6) for i in (4, 105, 106)], "doc_id long, text string, lang string, source string, n_chars long")
    put(spark, tmp_path, "labels", [(4, 1, 0), (105, 0, 1), (106, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["case_id"]: (r["derived"], r["written"], r["state"]) for r in asked(spark, tmp_path, "label_drift")}
    assert got == {"4": ("full", "full", "current"), "105": ("unknown", None, "missing"), "106": ("partial", "partial", "current")}


def test_runs_of_taken_ids(spark, tmp_path):
    """Events 3 to 5 take the id of the one before: all have that of event 2, so all four are duplicates. A run crosses two blocks."""
    taken = {3, 4, 5, *range(9_998, 10_003)}
    rows = [(i, 7, "view", 10.0, '{"k": %d}' % (1 if i in taken else 2)) for i in (*range(8), *range(9_990, 10_010))]
    put(spark, tmp_path, "events", rows, "event_id long, user_id long, event_type string, value double, props string")
    got = {(r["path"], r["rule"]): (r["n"], r["first"]) for r in asked(spark, tmp_path, "declaration_errors")}
    assert got == {("id", "pattern"): (20, 9_990), ("id", "duplicate"): (4 + 6, 2)}


def same_as_sql(spark, folder, name):
    """What the query's SQL and Spark give, as sorted rows; NaN is written out, since it equals nothing."""
    connection = duckdb.connect()
    for path in folder.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    rows = connection.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in rows.description]
    want = sorted(map(repr, rows.fetchall()))
    got = sorted(repr(tuple(r[c] for c in columns)) for r in asked(spark, folder, name))
    assert got == want
    return want


def search_tables(spark, folder, texts, questions):
    put(spark, folder, "documents", [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    put(spark, folder, "benchmark", list(enumerate(questions)), "item_id long, text string")


WORDY = [f"incident {w} of call {i}" for i, w in enumerate(["triage", "score", "model", "risk", "alert"] * 3)]


@pytest.mark.parametrize("texts,questions", [(["", "!?"], []), ([], ["", "—"]), ([""], ["!"])])
def test_sweep_of_texts_without_lexemes(spark, tmp_path, texts, questions):
    """The cosine with a text without lexemes is no number; SQL has it above all others, so it passes every gate."""
    search_tables(spark, tmp_path, [*WORDY, *texts], ["triage", "zzz yyy", "risk of call", *questions])
    assert len(same_as_sql(spark, tmp_path, "cosine_sweep")) == 16


def test_sweep_without_passages(spark, tmp_path):
    search_tables(spark, tmp_path, [], ["triage", "risk"])
    assert same_as_sql(spark, tmp_path, "cosine_sweep") == []


def test_dotted_capital_is_one_letter():
    """İ is i in lower case, as SQL sees it, not i and a dot that cuts the word."""
    embed = embedding.hashing(4096).embed
    assert embed(["İZMİR x"]) == embed(["izmir x"])


@pytest.mark.parametrize("texts,questions", [(["", "!?", "İZMİR incident", "izmir incident İX"], ["İzmir ix"]), ([], ["", "—"])])
def test_hybrid_of_texts_without_lexemes(spark, tmp_path, texts, questions):
    """They are the nearest by vectors and pass the gate, with a cosine that is no number; İ is an i in words too."""
    search_tables(spark, tmp_path, [*WORDY, *texts], ["triage of call", "zzz yyy", *questions])
    want = same_as_sql(spark, tmp_path, "hybrid_topk")
    assert any("nan" in row for row in want) and any("nan" not in row for row in want)


def test_hybrid_gate_of_just_so_much(spark, tmp_path):
    """6 / root of 2 * 50 is 0.6 and passes its gate, which 6 / (root of 2 * root of 50) does not."""
    search_tables(spark, tmp_path, ["triage " * 3 + "score " * 3 + "audit " * 4 + "risk " * 4], ["triage score"])
    assert len(set(tuple(v) for v in embedding.hashing(32).embed(["triage", "score", "audit", "risk"]))) == 4
    assert same_as_sql(spark, tmp_path, "hybrid_topk") and 6 / (2**0.5 * 50**0.5) < 0.6
