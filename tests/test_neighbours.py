"""Cards and foreign phones beside signs that Java and the grammars class differently, and beside each other."""

import duckdb
import pytest

from veilspark.plans import catalog

CARD = "4111111111111111"
#: An accent, a joiner, a variation selector and a tie: no word characters, so a value may stand beside them.
SIGNS = ["́", "‍", "️", "‿"]


def rows(spark, tmp_path, query, texts):
    """What ``query`` finds in ``texts``, and what its SQL does."""
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "it", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    mine = catalog.queries()[query](spark, str(tmp_path)).collect()
    return sorted(tuple(r) for r in mine), sorted(con.execute(catalog.oracle_sql()[query]).fetchall())


def test_cards_beside_marks(spark, tmp_path):
    texts = [f"a {CARD}{s} b" for s in SIGNS] + [f"a {s}{CARD} b" for s in SIGNS] + [f"a {CARD}² b", f"a ½{CARD} b", f"a {CARD}_ b"]
    got, sql = rows(spark, tmp_path, "card_findings", texts)
    want = [(i, "CREDIT_CARD", 2 + i // 4, 18 + i // 4, CARD) for i in range(8)]
    assert got == want and sql == want


def test_card_behind_a_phone(spark, tmp_path):
    """The digits of the phone are no part of the card. SQL takes 19 digits that begin in the phone and then nothing, so it is not compared."""
    got, _ = rows(spark, tmp_path, "card_findings", [f"+1 (208) 555-1177 {CARD} b"])
    assert got == [(0, "CREDIT_CARD", 18, 34, CARD)]


def test_foreign_phones_beside_marks(spark, tmp_path):
    phone = "+44 20 7946 0958"
    texts = [f"a {phone}{s} b" for s in SIGNS] + [f"a {s}{phone} b" for s in SIGNS]
    got, sql = rows(spark, tmp_path, "intl_phone_findings", texts)
    want = [(i, "PHONE_NUMBER", 2 + i // 4, 18 + i // 4, phone) for i in range(8)]
    assert got == want and sql == want


def test_foreign_phone_before_a_card(spark, tmp_path):
    """A phone ends before digits that it cannot take all of. SQL takes up to four of them in each group, counts too many digits and drops the phone, so it is not compared."""
    got, _ = rows(spark, tmp_path, "intl_phone_findings", [f"a +1 (208) 555-1177 {CARD} b"])
    assert got == [(0, "PHONE_NUMBER", 2, 19, "+1 (208) 555-1177")]


@pytest.mark.parametrize("query", ["mask_maximum", "reports", "findings_by_type", "findings_by_category", "reliability_levels"])
def test_marks_in_queries_on_all_three_rules(spark, tmp_path, query):
    texts = [f"b{i}@example.it {CARD}{s} e +44 20 7946 0958{s} fine" for i, s in enumerate(SIGNS)]
    got, sql = rows(spark, tmp_path, query, texts)
    assert got == sql
    if query == "mask_maximum":
        assert got == [(i, f"<EMAIL> <CARTA_PAGAMENTO>{s} e <TELEFONO>{s} fine") for i, s in enumerate(SIGNS)]
