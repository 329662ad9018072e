"""Templates and expense accounts on rows written by hand."""

from tallyspark.operators import expenses, templates


def test_templates(spark):
    rows = [
        (1, "Kira", 1, "B", "770"), (1, "Kira", 2, "A", "102"), (2, "  ", 1, "B", "770"), (2, "  ", 2, "A", "102"), (3, "k" * 61, 1, "B", "770"), (4, "Tek", 1, "B", "770"), (5, "Yan", 1, "B", "770"), (5, "Yan", 2, "B", "102"),
        (6, "Yok", 1, "B", "770"), (6, "Yok", 2, "A", "000"), (7, " Satis", 1, "B", "770"), (7, " Satis", 2, "A", "102"), (8, " Kira ", 1, "B", "632"), (8, " Kira ", 2, "A", "102"), (8, " Kira ", 3, "A", "102"), (9, "Kira", 1, "B", "000"),
        (9, "Kira", 2, "A", "102"), (10, "Bos", None, None, None), (11, None, 1, "B", "770"),
    ]
    saves = spark.createDataFrame(rows, "save long, name string, line_no int, side string, code string")
    chart = spark.createDataFrame([("770",), ("102",), ("632",), ("102",)], "code string")
    built = spark.createDataFrame([("Satis", 1, "B", "120"), ("Satis", 2, "A", "600")], "name string, line_no int, side string, code string")
    found = templates.template_findings(saves, chart, built)
    assert {r.save: (r.n, r.code) for r in found.collect()} == {1: (2, None), 2: (2, "T01"), 3: (1, "T01"), 4: (1, "T02"), 5: (2, "T03"), 6: (2, "T04"), 7: (2, "T05"), 8: (3, None), 9: (2, "T04"), 10: (0, "T02"), 11: (1, "T01")}
    kept = templates.current(saves, found)
    assert sorted((r.name, r.side, r.code) for r in kept.collect()) == [("Kira", "A", "102"), ("Kira", "A", "102"), ("Kira", "B", "632")]  # the later save of a name; the faulty third changes nothing
    lines = [(v, a, d, 1 - d) for v, legs in {1: [("632", 1), ("102.5", 0)], 2: [("102", 0), ("632.1", 1), ("102.2", 0)], 3: [("632", 0), ("102", 1)], 4: [("632", 1), ("102", 0), ("191", 1)], 5: [("120.7", 1), ("600", 0)]}.items() for a, d in legs]
    journal = spark.createDataFrame(lines, "voucher long, account string, debit_kr long, credit_kr long")
    got = {r.name: (r.user, r.n, r.usage) for r in templates.template_list(built, kept, journal).collect()}
    assert got == {"Kira": (True, 3, 2), "Satis": (False, 2, 1)}
    assert templates.template_list(built, kept.where("false"), journal.where("false")).select("usage").collect() == [(0,)]


def test_expense_accounts(spark):
    kinds = spark.createDataFrame([("yol", "760", "793, 796,", ["*"], None), ("arac", "770", "-", ["TIC"], 30), ("ham", "", "790", ["URT"], None), ("iki", "750/770", "", ["*"], None)], "kind string, a string, b string, sectors array<string>, refused_percent int")
    of = lambda sector, option: {r.kind: (r.account, r.alternatives, r.refused_account) for r in expenses.expense_catalogue(kinds, sector, option).collect()}
    assert of("TIC", "7B") == {"yol": ("793", ["796"], None), "arac": ("770", [], "770.99"), "iki": ("750/770", [], None)}
    assert of("URT", "7A") == {"yol": ("760", [], None), "ham": ("790", [], None), "iki": ("750/770", [], None)}
    assert of("TIC", "yok") == {"yol": ("631", [], None), "arac": ("632", [], "632.99"), "iki": ("630", [], None)} and of("URT", "yok")["ham"][0] == "790"
    spent = spark.createDataFrame([("arac", 101), ("arac", 9), ("yol", 50), ("ham", 7), (None, 1)], "kind string, amount_kr long")
    got = {r.account: (r.n, r.amount_kr) for r in expenses.booked_expenses(spent, expenses.expense_catalogue(kinds, "TIC", "7A")).collect()}
    assert got == {"770": (2, 71 + 7), "770.99": (0, 30 + 2), "760": (1, 50), None: (2, 8)}
    assert expenses.booked_expenses(spent.where("false"), kinds.select("kind", "a", "refused_percent").selectExpr("kind", "a account", "a refused_account", "refused_percent")).count() == 0
