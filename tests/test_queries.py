"""Every query over the model against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallyspark.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["trial_balance_named", "general_ledger", "rollup_hierarchy", "voucher_validation", "monthly_comparison", "ratios", "vat_return", "fifo_allocation", "prechecks", "balance_chain", "contrary_nature", "worksheet", "loan_schedule", "loan_entries", "equation_checks", "ledger_contras", "name_similarity", "reversal_pairs", "statement_carry", "bank_book", "ledger_page", "invariants", "instalment_match", "provenance_edges", "document_checks", "line_items", "layout_lines", "layout_grid", "label_values", "vat_offset_postings", "vat_return_sections", "vat_return_filed", "advance_tax_filed", "draft_vouchers", "draft_findings", "account_levels", "carry_forward", "entry_validation", "bank_text_types", "bank_movement_drafts", "cash_book", "cash_findings", "cash_transfers", "ageing", "invoice_search", "invoice_search_totals", "template_findings", "template_list", "expense_accounts", "decision_outcomes", "decision_effect"]


def plain(df):
    df = df[sorted(df.columns)]
    text = lambda x: "~" if x is None or x is pd.NaT or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(map(tuple, df.map(text).to_numpy().tolist()))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query(spark, db, name):
    assert plain(registry.QUERIES[name](spark, SF).toPandas()) == plain(db.sql(registry.ORACLES[name]).df())


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 90
