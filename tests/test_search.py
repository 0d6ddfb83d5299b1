import random

import pytest

from ledgerloom.operators import quality, search

REGISTRY = "corp_code string, corp_name string, stock_code string, is_active boolean"


def registry(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        name = "".join(draw.choice("가나ab AB%_") for _ in range(draw.randint(0, 9))) if draw.random() < 0.9 else None
        rows.append((f"{i:08d}", name, f"{i * 7 % 1000:06d}" if i % 3 else None, i % 5 != 0))
    return rows


def brute(rows, queries, fields):
    found = set()
    for query in queries:
        word = query.strip().lower()
        for row in rows:
            if word and any(word in (row[f] or "").lower() for f in fields):
                found.add((query, row[0]))
    return found


QUERIES = ["a", "가", "ab", "AB ", "나가나", "b%", "_", "zzz", " ", "", "a b a b a", "000", "0000007", "12", "가나ab"]


def test_containing_equals_a_test_of_every_pair(spark):
    rows = registry(400)
    frame = spark.createDataFrame(rows, REGISTRY)
    queries = spark.createDataFrame([(q,) for q in QUERIES + QUERIES[:3]], "query string")
    got = {(r.query, r.corp_code) for r in search.containing(frame, ["corp_name"], queries).collect()}
    assert got == brute(rows, QUERIES, [1]) and len(got) > 50
    active = [r for r in rows if r[3]]
    wanted = {q: sum(q == found for found, _ in brute(active, QUERIES, [0, 1, 2])) for q in QUERIES}
    assert {r.query: r.total_count for r in search.count_matches(frame, queries).collect()} == wanted


def test_table_searches_equal_the_single_ones(spark):
    frame = spark.createDataFrame(registry(300, 4), REGISTRY)
    names = ["a", "ab", "나가", "zzz"]
    one = {(r.query, r.position, r.corp_code) for r in search.search_by_name(frame, names, limit=4).collect()}
    many = search.search_names(frame, spark.createDataFrame([(n,) for n in names], "query string"), limit=4)
    assert {(r.query, r.position, r.corp_code) for r in many.collect()} == one
    routed = ["000007", "00000012", "00000019", "a", "00001"]
    one = {(r.query, r.position, r.corp_code) for r in search.find_corporations(frame, routed, limit=3).collect()}
    many = search.route_queries(frame, spark.createDataFrame([(n,) for n in routed], "query string"), limit=3)
    assert {(r.query, r.position, r.corp_code) for r in many.collect()} == one


def test_a_code_is_not_found_inside_a_longer_one(spark):
    frame = spark.createDataFrame([("00000001", "x", "0000071", True), ("00000002", "000007", "000008", True)], REGISTRY)
    found = search.route_queries(frame, spark.createDataFrame([("000007",)], "query string"))
    assert found.collect() == []


def test_all_constraints_in_one_pass(spark):
    child = spark.createDataFrame([(1, 10, "2024"), (1, 10, "x"), (2, None, None), (3, 99, "2025"), (3, 99, "1")], "id long, parent long, y string")
    parent = spark.createDataFrame([(10,), (11,), (11,)], "key long")
    got = quality.integrity(
        {"child": child, "parent": parent}, unique={"child_id": ("child", ["id"]), "pair": ("child", ["id", "y"]), "key": ("parent", ["key"])},
        references={"child_parent": ("child", "parent", "parent", "key")}, rules={"child": {"year": quality.is_year("y")}},
    )
    assert {r.rule: r.violations for r in got.collect()} == {"child_id": 2, "pair": 0, "key": 1, "child_parent": 2, "year": 3}


@pytest.mark.parametrize("limit", [0, -1])
def test_limits_have_to_be_positive(spark, limit):
    with pytest.raises(ValueError):
        search.search_by_name(spark.createDataFrame([], REGISTRY), ["a"], limit=limit)


def test_an_index_lists_what_queries_hold_and_not_more(spark, monkeypatch):
    names = [f"Customer#{i:06d} {'AUTO' if i % 2 else 'ÉTÉ'}" for i in range(400)]
    rows = spark.createDataFrame([(f"{i:08d}", name, f"{i:06d}" if i % 3 else None) for i, name in enumerate(names)], "corp_code string, corp_name string, stock_code string")
    words = [*names, *[f"{i:08d}" for i in range(0, 500, 7)], *[f" {i:06d}" for i in range(50)], "été", "0", "#0001", "no 1", " ", "", None]
    queries = spark.createDataFrame([(w,) for w in words], "query string")
    fields = ["corp_name", "stock_code", "corp_code"]
    expected = sorted(
        (w, r.corp_code) for w in {w for w in words if w and w.strip()} for r in rows.collect()
        if any(w.strip().lower() in (r[f] or "").lower() for f in fields))
    written = []
    monkeypatch.setattr(search, "cut_lineage", lambda df: written.append(df.count()) or df.cache())
    for most in (16, 2, 1):  # with fewer lengths than the queries have, hits are verified
        monkeypatch.setattr(search, "GRAM_SIZES", most)
        written.clear()
        found = search.containing(rows, fields, queries).select("query", "corp_code")
        assert sorted(map(tuple, found.collect())) == expected
        if most == 16:
            assert max(written) <= len(expected)
