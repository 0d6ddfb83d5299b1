"""Schemas of the stored tables."""

from __future__ import annotations

CORPORATIONS = (
    "corp_code string, corp_name string, stock_code string, modify_date string, is_active boolean, "
    "first_seen_at timestamp, last_seen_at timestamp, deactivated_at timestamp"
)
STATEMENTS = (
    "id bigint, rcept_no string, reprt_code string, bsns_year string, corp_code string, fs_div string, fs_nm string, "
    "sj_div string, sj_nm string, account_id string, account_nm string, account_detail string, thstrm_nm string, "
    "thstrm_amount bigint, thstrm_add_amount bigint, frmtrm_nm string, frmtrm_amount bigint, frmtrm_q_nm string, "
    "frmtrm_q_amount bigint, frmtrm_add_amount bigint, bfefrmtrm_nm string, bfefrmtrm_amount bigint, ord int, "
    "currency string, created_at timestamp"
)
RATIOS = (
    "id bigint, corp_code string, bsns_year string, reprt_code string, fs_div string, ratio_code string, "
    "ratio_name string, ratio_value double, numerator_value double, denominator_value double, "
    "calculation_version string, calculated_at timestamp"
)
CHANGES = (
    "id bigint, financial_statement_id bigint, corp_code string, bsns_year string, reprt_code string, fs_div string, "
    "sj_div string, account_id string, account_nm string, account_detail string, change_amount bigint, "
    "change_rate double, calculation_version string, calculated_at timestamp"
)
INDUSTRY_GROUPS = "industry_id bigint, industry_code string, industry_name string, description string, created_at timestamp"
INDUSTRY_MEMBERS = "industry_id bigint, corp_code string, created_at timestamp"
COMMITS = "name string, commit bigint, last_id bigint"
