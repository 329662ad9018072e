"""What a bank movement is by its text, and the voucher that may be drafted for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import names

EITHER, UNKNOWN = "HER", "DIGER"
#: A draft is made without a question, after one, not before its parts are known, or not at all.
AUTOMATIC, ASKED, SPLIT, NONE = "OTOMATIK", "ONAY", "AYRISTIRMA", "YOK"


@dataclass(frozen=True)
class Movement:
    """A kind of movement; `debit` and `credit` take the whole amount, and are empty where parts of it go elsewhere."""

    name: str
    direction: str
    keywords: str
    debit: str
    credit: str
    confidence: str
    evidence: bool


#: Kinds of movements with their words and accounts, fixed values.
MOVEMENTS = [
    Movement("havale_eft_fast_tahsilat", "GIRIS", "HAVALE, EFT, FAST, GELEN TRANSFER, GONDEREN", "102", "120", "orta", True),
    Movement("havale_eft_fast_odeme", "CIKIS", "HAVALE, EFT, FAST, GIDEN TRANSFER, ALICI", "320", "102", "orta", True),
    Movement("banka_masrafi", "CIKIS", "MASRAF, KOMISYON, UCRET, HESAP ISLETIM, ISLETIM UCRETI, EFT UCRETI, HAVALE UCRETI", "770", "102", "yuksek", False),
    Movement("bsmv_ayri_satir", "CIKIS", "BSMV, B.S.M.V, GIDER VERGISI, GID.VER, BANKA VE SIGORTA MUAM", "780", "102", "orta", False),
    Movement("kkdf", "CIKIS", "KKDF", "153", "102", "dusuk", True),
    Movement("kredi_kullanim", "GIRIS", "KREDI KULLANIM, KREDI TAHSIS, SPOT KREDI, ROTATIF", "102", "300", "orta", True),
    Movement("kredi_taksit_odeme", "CIKIS", "KREDI TAKSIT, TAKSIT ODEME, KREDI GERI ODEME, ANAPARA", "", "", "dusuk", True),
    Movement("mevduat_faizi", "GIRIS", "FAIZ, VADELI FAIZ, MEVDUAT FAIZI, TEMETTU", "", "", "dusuk", True),
    Movement("vergi_sgk_odeme", "CIKIS", "GIB, VERGI DAIRESI, GELIR IDARESI, SGK, SOSYAL GUVENLIK, MTV, GECICI VERGI, KDV ODEME, MUHTASAR", "360", "102", "orta", False),
    Movement("damga_odeme", "CIKIS", "DAMGA", "360", "102", "dusuk", False),
    Movement("maas_odemesi", "CIKIS", "MAAS, UCRET ODEME, TOPLU MAAS, PERSONEL ODEME, BORDRO", "335", "102", "orta", False),
    Movement("kendi_hesap_virman", EITHER, "VIRMAN, HESABIMA, KENDI HESAP, VADELI ACILIS, VADELI KAPANIS", "102.hedef", "102.kaynak", "orta", False),
    Movement("pos_yatis", "GIRIS", "POS, SANAL POS, UYE ISYERI, KREDI KARTI HAKEDIS", "", "", "dusuk", True),
    Movement("doviz_kur_farki", EITHER, "DOVIZ, USD, EUR, KUR FARKI, ARBITRAJ", "", "", "dusuk", True),
]


def classified(texts: DataFrame, kinds: list[Movement]) -> DataFrame:
    """`texts` (id, text, direction, more) with type, keyword, confidence and evidence (a receipt is needed).

    The longest keyword of a kind of that direction counts, of equal ones the earlier kind's; without any, or without a text, the type
    is DIGER.  Kinds are a catalogue of bounded size, so all of it is one column expression.
    """
    folded = F.coalesce(names.fold("text"), F.lit(""))
    words = [(len(w), -i, k, w) for i, k in enumerate(kinds) for w in k.keywords.split(", ")]
    found = F.lit(None)
    for _, _, k, w in sorted(words, key=lambda x: x[:2]):  # the last that is tried goes first
        fits = F.contains(folded, F.lit(w)) if k.direction == EITHER else F.contains(folded, F.lit(w)) & (F.col("direction") == k.direction)
        found = F.when(fits, F.struct(F.lit(k.name).alias("type"), F.lit(w).alias("keyword"), F.lit(k.confidence).alias("confidence"), F.lit(k.evidence).alias("evidence"))).otherwise(found)
    out = texts.withColumn("_m", found)
    return out.select(*texts.columns, F.coalesce("_m.type", F.lit(UNKNOWN)).alias("type"), "_m.keyword", "_m.confidence", F.coalesce("_m.evidence", F.lit(False)).alias("evidence"))


def _of(kinds: list[Movement], value) -> Column:
    known = [F.when(F.col("type") == k.name, F.lit(value(k))) for k in kinds if value(k)]
    return F.coalesce(*known, F.lit(None)) if known else F.lit(None).cast("string")


def drafted(movements: DataFrame, kinds: list[Movement]) -> DataFrame:
    """`movements` (of `classified`, with amount_kr) to id, status, line_no, account, debit_kr, credit_kr: two lines for each draft, one without an account for the rest.

    High confidence needs no answer, any other one does.  What has to be split first (principal and interest, gross and commission,
    gain or loss), what is of no known kind and what has no amount above 0 is not drafted.
    """
    zero, amount = F.lit(0).cast("bigint"), F.col("amount_kr").cast("bigint")
    debit, credit = _of(kinds, lambda k: k.debit), _of(kinds, lambda k: k.credit)
    status = F.when((F.col("type") == UNKNOWN) | ~F.coalesce(amount > 0, F.lit(False)), NONE).when(debit.isNull(), SPLIT).when(F.col("confidence") == "yuksek", AUTOMATIC).otherwise(ASKED)
    line = lambda n, account, d, c: F.struct(F.lit(n).alias("line_no"), account.cast("string").alias("account"), d.cast("bigint").alias("debit_kr"), c.cast("bigint").alias("credit_kr"))
    none = F.lit(None)
    both = F.when(F.col("status").isin(AUTOMATIC, ASKED), F.array(line(1, debit, amount, zero), line(2, credit, zero, amount))).otherwise(F.array(line(0, none, none, none)))
    return movements.withColumn("status", status).select("id", "status", F.inline(both))
