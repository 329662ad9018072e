"""Kinds of bank movements and their drafts, on literal texts."""

from tallyspark.operators import movements
from tallyspark.operators.movements import MOVEMENTS, Movement

SCHEMA = "id long, text string, direction string, amount_kr long"


def test_the_longest_keyword_counts(spark):
    rows = [(1, "eft ücreti", "CIKIS", 5), (2, "EFT MTV", "CIKIS", 5), (3, "eft ücreti", "GIRIS", 5), (4, None, "GIRIS", 5), (5, "virman", None, 5), (6, "Kredi Taksit", "CIKIS", 5), (7, "masraf", "CIKIS", 0), (8, "masraf", "CIKIS", None), (9, "x " * 50_000 + "damga", "CIKIS", 7), (9, "damga", "CIKIS", 7)]
    typed = movements.classified(spark.createDataFrame(rows, SCHEMA), MOVEMENTS)
    assert sorted((r.id, r.type, r.keyword) for r in typed.where("id <> 4").collect()) == [
        (1, "banka_masrafi", "EFT UCRETI"), (2, "havale_eft_fast_odeme", "EFT"), (3, "havale_eft_fast_tahsilat", "EFT"), (5, "kendi_hesap_virman", "VIRMAN"), (6, "kredi_taksit_odeme", "KREDI TAKSIT"),
        (7, "banka_masrafi", "MASRAF"), (8, "banka_masrafi", "MASRAF"), (9, "damga_odeme", "DAMGA"), (9, "damga_odeme", "DAMGA"),
    ]
    assert [(r.type, r.keyword, r.evidence) for r in typed.where("id = 4").collect()] == [("DIGER", None, False)]
    got = sorted((r.id, r.status, r.line_no, r.account or "", r.debit_kr or 0, r.credit_kr or 0) for r in movements.drafted(typed, MOVEMENTS).collect())
    assert got == [
        (1, "OTOMATIK", 1, "770", 5, 0), (1, "OTOMATIK", 2, "102", 0, 5), (2, "ONAY", 1, "320", 5, 0), (2, "ONAY", 2, "102", 0, 5), (3, "ONAY", 1, "102", 5, 0), (3, "ONAY", 2, "120", 0, 5), (4, "YOK", 0, "", 0, 0),
        (5, "ONAY", 1, "102.hedef", 5, 0), (5, "ONAY", 2, "102.kaynak", 0, 5), (6, "AYRISTIRMA", 0, "", 0, 0), (7, "YOK", 0, "", 0, 0), (8, "YOK", 0, "", 0, 0),
        (9, "ONAY", 1, "360", 7, 0), (9, "ONAY", 1, "360", 7, 0), (9, "ONAY", 2, "102", 0, 7), (9, "ONAY", 2, "102", 0, 7),
    ]


def test_other_catalogues_and_empty_tables(spark):
    one = [Movement("kira", "CIKIS", "KIRA", "", "", "orta", False)]
    rows = spark.createDataFrame([(1, "kira", "CIKIS", 5), (2, "kira", "GIRIS", 5)], SCHEMA)
    assert sorted((r.id, r.status) for r in movements.drafted(movements.classified(rows, one), one).collect()) == [(1, "AYRISTIRMA"), (2, "YOK")]
    assert movements.drafted(movements.classified(rows.where("false"), MOVEMENTS), MOVEMENTS).count() == 0
