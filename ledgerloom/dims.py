"""Dimension rows: account aliases, screening rules, ratio definitions, code names.

Everything in this module is a set of fixed values; results depend on the exact words and their order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import plain_label

# ---- fixed values: accounts used by the general ratios -------------------------------------------
GENERAL_ALIASES = {
    "revenue": ("매출액", "수익(매출액)", "영업수익", "수익", "매출"),
    "operating_profit": ("영업이익", "영업이익(손실)", "영업손익", "영업순손익", "영업손실"),
    "net_income": (
        "당기순이익", "당기순이익(손실)", "당기순손익", "연결당기순이익", "연결순이익", "연결순이익(손실)",
        "지배주주당기순이익", "지배주주당기순이익(손실)", "지배기업소유주지분순이익",
        "지배기업소유주지분당기순이익", "당기순손실", "당기연결순이익", "당기연결순이익(손실)",
    ),
    "total_assets": ("자산총계", "자산총액", "총자산"),
    "total_liabilities": ("부채총계", "부채총액", "총부채"),
    "total_equity": ("자본총계", "자본총액", "총자본"),
    "current_assets": ("유동자산",),
    "current_liabilities": ("유동부채",),
    "cost_of_sales": ("매출원가",),
    "inventory": ("재고자산", "유동재고자산"),
    "receivables": (
        "매출채권", "단기매출채권", "유동매출채권", "유동매출채권및기타채권", "유동매출채권 및 기타채권",
        "매출채권및기타유동채권", "매출채권 및 기타유동채권", "매출채권및기타채권", "매출채권 및 기타채권",
        "매출채권 및 기타수취채권",
    ),
    "payables": (
        "매입채무", "단기매입채무", "유동매입채무", "유동매입채무및기타채무", "유동매입채무 및 기타채무",
        "매입채무및기타유동채무", "매입채무 및 기타유동채무", "매입채무및기타채무", "매입채무 및 기타채무",
        "매입채무및기타금융부채", "매입채무 및 기타지급채무",
    ),
}
# Statements an account may come from, best first.
INCOME_STATEMENTS = ("IS", "CIS")
BALANCE_SHEET = ("BS",)
GENERAL_STATEMENTS = {
    key: INCOME_STATEMENTS
    if key in ("revenue", "operating_profit", "net_income", "cost_of_sales")
    else BALANCE_SHEET
    for key in GENERAL_ALIASES
}

# ---- fixed values: accounts used by the bank ratios ----------------------------------------------
BANK_ALIASES = {
    "total_assets": ("자산총계", "자산총액", "총자산"),
    "total_liabilities": ("부채총계", "부채총액", "총부채"),
    "total_equity": ("자본총계", "자본총액", "총자본"),
    "cash_and_deposits": ("현금및예치금", "현금및상각후원가측정예치금", "현금및현금성자산"),
    "loans": (
        "상각후원가측정대출채권", "상각후원가측정대출채권및기타금융자산",
        "상각후원가측정대출채권및기타금융채권", "상각후원가측정대출채권및기타채권",
    ),
    "fvpl_assets": ("당기손익-공정가치측정금융자산",),
    "fvoci_assets": ("기타포괄손익-공정가치측정금융자산", "기타포괄손익-공정가치측정유가증권"),
    "amortized_cost_securities": ("상각후원가측정유가증권", "상각후원가측정금융자산"),
    "derivative_assets": ("파생상품자산", "파생상품자산(위험회피목적)", "위험회피회계파생상품자산"),
    "deposits": ("예수부채", "예수금"),
    "borrowings": ("차입부채",),
    "bonds": ("사채", "발행사채"),
    "fvpl_liabilities": ("당기손익-공정가치측정금융부채",),
    "derivative_liabilities": ("파생상품부채", "파생상품부채(위험회피목적)", "위험회피회계파생상품부채"),
    "net_interest_income": ("순이자손익", "순이자이익"),
    "net_fee_income": ("순수수료손익", "순수수료이익"),
    "credit_loss": (
        "신용손실충당금(전)환입액", "신용손실충당금전입액", "신용손실에대한손상차손", "신용손실에대한손상차손전입액",
    ),
    "net_income": ("당기순이익", "연결당기순이익", "연결순이익", "당기연결순이익"),
    "operating_profit": ("영업이익",),
}
BANK_PREFIXES = {"loans": ("상각후원가측정대출채권및기타",)}
BANK_STATEMENTS = {
    key: INCOME_STATEMENTS
    if key in ("net_interest_income", "net_fee_income", "credit_loss", "net_income", "operating_profit")
    else BALANCE_SHEET
    for key in BANK_ALIASES
}
BANK_KEYS_USED = (
    "net_income", "net_interest_income", "net_fee_income", "credit_loss", "total_assets", "total_equity",
    "total_liabilities", "loans", "deposits", "borrowings",
)

# ---- fixed values: ratio codes and names ---------------------------------------------------------
GENERAL_VERSION = "v2_average_balance"
GENERAL_RATIO_NAMES = {
    "OPERATING_MARGIN": "영업이익률",
    "NET_PROFIT_MARGIN": "순이익률",
    "ROA": "총자산이익률",
    "ROE": "자기자본이익률",
    "DEBT_RATIO": "부채비율",
    "CURRENT_RATIO": "유동비율",
    "INVENTORY_TURNOVER": "재고자산회전율",
    "DIO": "재고보유기간",
    "RECEIVABLE_TURNOVER": "매출채권회전율",
    "DSO": "매출채권회수기간",
    "PAYABLE_TURNOVER": "매입채무회전율",
    "DPO": "매입채무지급기간",
    "CCC": "현금전환주기",
}
RATIO_KINDS = {
    code: "turnover" if code.endswith("_TURNOVER") else "days" if code in ("DIO", "DSO", "DPO", "CCC") else "percentage"
    for code in GENERAL_RATIO_NAMES
}
BANK_VERSION = "bank_v1_average_balance"
BANK_RATIO_NAMES = {
    "BANK_ROA": "총자산이익률(은행)",
    "BANK_ROE": "자기자본이익률(은행)",
    "BANK_NET_INTEREST_ASSET_RATIO": "순이자손익/평균자산",
    "BANK_NET_FEE_ASSET_RATIO": "순수수료손익/평균자산",
    "BANK_LOAN_ASSET_RATIO": "대출채권(등) 비중",
    "BANK_DEPOSIT_LIABILITY_RATIO": "예수부채 비중",
    "BANK_BORROWING_LIABILITY_RATIO": "차입부채 비중",
    "BANK_CREDIT_COST_RATIO": "신용손실비용/평균대출채권(등)",
}

# ---- fixed values: change columns of the peer table ----------------------------------------------
CHANGE_ALIASES = {
    "REVENUE_CHANGE": ("매출액", "수익(매출액)", "영업수익", "수익", "매출"),
    "COST_OF_SALES_CHANGE": ("매출원가",),
    "OPERATING_PROFIT_CHANGE": ("영업이익", "영업이익(손실)", "영업손익", "영업순손익", "영업손실"),
    "RECEIVABLE_CHANGE": (
        "매출채권", "단기매출채권", "유동매출채권", "매출채권및기타채권", "매출채권 및 기타채권",
        "유동매출채권및기타채권", "유동매출채권 및 기타채권", "매출채권및기타유동채권",
        "매출채권 및 기타유동채권", "매출채권과기타채권", "매출채권 및 기타수취채권",
    ),
    "INVENTORY_CHANGE": ("재고자산", "유동재고자산"),
    "PPE_CHANGE": ("유형자산", "비유동유형자산"),
    "PAYABLE_CHANGE": (
        "매입채무", "단기매입채무", "유동매입채무", "매입채무및기타채무", "매입채무 및 기타채무",
        "유동매입채무및기타채무", "유동매입채무 및 기타채무", "매입채무및기타유동채무",
        "매입채무 및 기타유동채무", "매입채무및기타금융부채", "매입채무 및 기타지급채무",
    ),
}
CHANGE_STATEMENTS = {
    key: INCOME_STATEMENTS
    if key in ("REVENUE_CHANGE", "COST_OF_SALES_CHANGE", "OPERATING_PROFIT_CHANGE")
    else BALANCE_SHEET
    for key in CHANGE_ALIASES
}
CHANGE_SCOPED = ("RECEIVABLE_CHANGE", "INVENTORY_CHANGE", "PAYABLE_CHANGE")
PEER_METRICS = (
    *GENERAL_RATIO_NAMES,
    "REVENUE_CHANGE", "COST_OF_SALES_CHANGE", "OPERATING_PROFIT_CHANGE", "RECEIVABLE_CHANGE",
    "INVENTORY_CHANGE", "PAYABLE_CHANGE", "PPE_CHANGE",
)

# ---- fixed values: change screening --------------------------------------------------------------
SIGNIFICANT_CHANGE = 20.0
DIVERGENCE_POINTS = 10.0
DEFAULT_CHANGE_STATEMENTS = ("BS", "IS", "CIS", "CF")
COMBINED_STATEMENTS = ("BS", "IS", "CIS")
MAJOR_ACCOUNTS = {
    "BS": ("매출채권", "재고자산", "유형자산", "자산총계", "부채총계"),
    "IS": ("매출액", "영업이익", "당기순이익"),
}
SCREENING_RULES = {
    "매출액": (
        ("매출액", "영업수익", "수익(매출액)"),
        "매출 규모에 유의적인 변동이 발생했습니다. 사업 부문별 매출과 영업환경의 변화를 추가로 확인할 필요가 있습니다.",
    ),
    "영업이익": (
        ("영업이익", "영업이익(손실)"),
        "영업성과에 유의적인 변동이 발생했습니다. 매출과 주요 비용 항목의 변동을 함께 검토할 필요가 있습니다.",
    ),
    "당기순이익": (
        ("당기순이익", "당기순이익(손실)", "연결당기순이익"),
        "당기순이익에 유의적인 변동이 발생했습니다. 영업손익과 영업외손익, 법인세비용의 영향을 확인할 필요가 있습니다.",
    ),
    "자산총계": (
        ("자산총계",),
        "총자산 규모에 유의적인 변동이 발생했습니다. 변동에 영향을 준 주요 자산 항목을 확인할 필요가 있습니다.",
    ),
    "부채총계": (
        ("부채총계",),
        "총부채 규모에 유의적인 변동이 발생했습니다. 차입금과 영업 관련 부채의 변화를 확인할 필요가 있습니다.",
    ),
    "자본총계": (
        ("자본총계",),
        "자본 규모에 유의적인 변동이 발생했습니다. 당기손익, 배당 및 자본거래의 영향을 확인할 필요가 있습니다.",
    ),
    "재고자산": (
        ("재고자산",),
        "재고자산에 유의적인 변동이 발생했습니다. 재고 구성과 판매 추이, 평가손실 발생 여부를 확인할 필요가 있습니다.",
    ),
    "매출채권": (
        ("매출채권", "매출채권 및 기타채권", "매출채권및기타채권"),
        "매출채권에 유의적인 변동이 발생했습니다. 매출 변화와 채권 회수 현황을 함께 확인할 필요가 있습니다.",
    ),
}
DIVERGENCE_BASE = ("매출액", "수익(매출액)", "영업수익")
DIVERGENCE_TARGET = ("재고자산",)

# ---- fixed values: earnings per share ------------------------------------------------------------
EPS_IDS = {
    "basic": ("ifrs-full_BasicEarningsLossPerShare", "dart_BasicEarningsLossPerShare"),
    "diluted": ("ifrs-full_DilutedEarningsLossPerShare", "dart_DilutedEarningsLossPerShare"),
}
EPS_NAMES = {
    "basic": ("기본주당이익", "기본주당순이익", "기본주당손익", "주당이익", "주당순이익"),
    "diluted": ("희석주당이익", "희석주당순이익", "희석주당손익"),
}
DILUTED_WORD = "희석"
DEFAULT_CURRENCY = "KRW"

# ---- fixed values: income tax --------------------------------------------------------------------
TAX_EXPENSE_NAMES = (
    "법인세비용", "법인세비용(수익)", "법인세 비용", "법인세수익(비용)", "법인세 수익(비용)", "법인세 비용(수익)",
)
PRETAX_PROFIT_NAMES = (
    "법인세비용차감전순이익", "법인세비용차감전계속사업이익", "법인세비용차감전이익",
    "법인세비용차감전순이익(손실)", "법인세차감전순이익",
)
TAX_ACCOUNT_GROUPS = {
    "deferred_tax_asset": ("이연법인세자산", ("이연법인세자산", "비유동이연법인세자산")),
    "deferred_tax_liability": ("이연법인세부채", ("이연법인세부채", "비유동이연법인세부채")),
    "current_tax_asset": ("당기법인세자산", ("당기법인세자산", "미수법인세")),
    "current_tax_liability": ("당기법인세부채", ("당기법인세부채", "미지급법인세")),
}

# ---- fixed values: codes and their names ---------------------------------------------------------
STATEMENT_NAMES = {"BS": "재무상태표", "IS": "손익계산서", "CIS": "포괄손익계산서", "CF": "현금흐름표", "SCE": "자본변동표"}


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def rows_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A constant table. Its size is fixed by this module, so it is always safe to broadcast."""
    fields = [part.split() for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    columns = ", ".join(f"cast({name} as {kind}) as {name}" for name, kind in fields)
    names = ", ".join(name for name, _ in fields)
    return F.broadcast(spark.sql(f"select {columns} from values {values} as t({names})"))


def ranked_labels(aliases: Mapping[str, Sequence[str]], repeat_wins: str = "last") -> list[tuple[str, str, int]]:
    """``(account_key, label, rank)``. Two spellings may share one label; ``repeat_wins`` picks whose place counts."""
    rows = []
    for key, names in aliases.items():
        ranks: dict[str, int] = {}
        for position, name in enumerate(names):
            label = plain_label(name)
            if repeat_wins == "last" or label not in ranks:
                ranks[label] = position
        rows.extend((key, label, rank) for label, rank in ranks.items())
    return rows


def alias_frame(
    spark: SparkSession,
    aliases: Mapping[str, Sequence[str]],
    divisions: Mapping[str, Sequence[str]],
    repeat_wins: str = "last",
) -> DataFrame:
    """``(account_key, alias_label, alias_rank, sj_div, division_rank)`` for an equi-join on label and statement."""
    rows = [
        (key, label, rank, division, division_rank)
        for key, label, rank in ranked_labels(aliases, repeat_wins)
        for division_rank, division in enumerate(divisions[key])
    ]
    return rows_frame(
        spark, rows, "account_key string, alias_label string, alias_rank int, sj_div string, division_rank int"
    )
