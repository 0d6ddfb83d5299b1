import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from ledgerloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


COLUMNS = (
    "id bigint, rcept_no string, reprt_code string, bsns_year string, corp_code string, fs_div string, fs_nm string, "
    "sj_div string, account_id string, account_nm string, account_detail string, thstrm_nm string, frmtrm_nm string, "
    "thstrm_amount bigint, frmtrm_amount bigint, ord int, currency string"
)


@pytest.fixture
def statement_rows(spark):
    """Frame of statement rows from ``(sj_div, account_id, name, current, previous, **overrides)``."""

    def build(*rows):
        values = []
        for number, row in enumerate(rows, start=1):
            sj_div, account_id, name, current, previous = row[:5]
            extra = row[5] if len(row) > 5 else {}
            values.append((
                extra.get("id", number), extra.get("rcept_no", "20260311000514"), "11011", extra.get("year", "2025"),
                extra.get("corp", "00126380"), extra.get("fs_div", "CFS"), "연결재무제표", sj_div, account_id, name,
                extra.get("detail", ""), "제57기", "제56기", current, previous, extra.get("ord", number),
                extra.get("currency", "KRW"),
            ))
        return spark.createDataFrame(values, COLUMNS)

    return build
