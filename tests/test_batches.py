"""Parsers work on pieces of a batch, and their shortcuts find what the long way finds."""

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from ledgerloom.catalog import documents
from ledgerloom.documents import markup, sections
from ledgerloom.functions import batches
from ledgerloom.sources import archives
from ledgerloom.xbrl import document
from ledgerloom.xbrl import parse as xbrl_parse


def test_pieces_are_bounded_and_whole():
    texts = pa.array(["a" * 10, None, "b" * 10, "", "c" * 50, None, "감" * 3])
    other = pa.array([None, "x", "y" * 12, "z", None, None, "w"])
    found = list(batches.pieces((texts, other), 25))
    assert [[a.to_pylist(), b.to_pylist()] for a, b in found] == [
        [["a" * 10, None], [None, "x"]], [["b" * 10, ""], ["y" * 12, "z"]], [["c" * 50], [None]], [[None, "감" * 3], [None, "w"]],
    ]
    assert list(batches.pieces((texts.slice(0, 0),))) == []


def test_a_batch_is_parsed_piece_by_piece(spark):
    # one batch of 60 texts of 100 kB: what is built at once is a piece, not the batch
    rows = spark.range(0, 60, 1, 1).select("id", F.when(F.col("id") != 7, F.repeat(F.lit("x"), 100_000)).alias("t"))
    size = batches.by_piece(lambda texts, kind: pa.array([len(texts)] * len(texts), kind), "int", F.col("t"))
    assert {r.n for r in rows.select(size.alias("n")).collect()} <= set(range(1, 12))
    html = rows.select("id", F.concat(F.lit("<p>"), F.col("id").cast("string"), F.lit("</p><p>"), "t", F.lit("</p>")).alias("html"))
    parsed = html.select("id", markup.parse_markup("html").alias("d")).select("id", "d.blocks.text", F.length("d.text").alias("n")).collect()
    assert sorted((r.id, [len(t) for t in r.text], r.n) for r in parsed) == [
        (i, [] if i == 7 else [len(str(i)), 100_000], 0 if i == 7 else len(str(i)) + 1 + 100_000) for i in range(60)
    ]


class _LongWay(markup._Reader):
    updatepos = HTMLParser.updatepos
    parse_starttag = HTMLParser.parse_starttag
    parse_endtag = HTMLParser.parse_endtag


def test_plain_tags_are_read_as_by_the_standard_parser():
    cases = [
        "<p>a</p><P>b</P><p >c</p ><p/>d<b>e</b></x>f<p>g", "<script>var x = '<p>no</p>';</script><p>a &amp; b</p>", "<style><p>a</p></style><p>b",
        "<div><p>a<p>b</div></p><td><b>계속기업</b> x<span style='font-weight:bold'>계속기업 y</span> z</td>", "<title>t<p>u</title>", "<p>a</p<p>b</p>",
        "<p a='>'>x</p><p usermark=B>y</p><h1>z</h1><hh>q</hh><p", "<textarea><p>a</p></textarea><p>b</p>", "<!-- <p>x</p> --><p>1 < 2</p><![CDATA[<p>y</p>]]>", "",
    ]
    for html in cases:
        reader = _LongWay()
        reader.feed(html)
        assert markup.read_markup(html) == reader.result()


def test_every_boundary_has_a_word_that_is_looked_for_first():
    for spec in (sections.EMPHASIS, sections.OTHER_MATTER, sections.GOING_CONCERN):
        assert all(any(word in boundary for word in sections.BOUNDARY_WORDS) for boundary in spec.boundaries)


def test_only_the_choice_taken_is_computed(spark):
    chosen = documents._pick(F.col("id"), ["a", F.raise_error(F.lit("computed")).cast("string"), "c"])
    assert [r.c for r in spark.range(3).where("id <> 1").select(chosen.alias("c")).collect()] == ["a", "c"]


def test_xml_and_archives_are_read_piece_by_piece(spark):
    # a batch as a whole, as the other iterator functions of pandas take it, is more than a worker holds
    parsers = [
        xbrl_parse.parse_facts("t"), xbrl_parse.parse_contexts("t"), xbrl_parse.parse_presentation("t"), xbrl_parse.parse_labels("t"),
        document.parse_document("t", "t", "t", ["A"]), document.parse_roles("t"),
    ]
    texts = spark.createDataFrame([(1, "<a/>"), (2, None), (3, ""), (4, "<a")], "id int, t string")
    frames = [texts.select("id", p.alias("p")) for p in parsers]
    frames.append(archives.xbrl_documents(texts.select("id", F.col("t").cast("binary").alias("content")), "id"))
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and f", {PythonEvalType.SQL_SCALAR_PANDAS_ITER_UDF}" not in plan
    assert [r.p.error for r in frames[0].orderBy("id").collect()][:3] == [None, "empty", "empty"]
    assert [(r.p.facts, r.p.tables, r.p.labels) for r in frames[4].collect()] == [([], [], [])] * 4
    assert [r.status for r in frames[6].orderBy("id").collect()] == ["not_a_zip", "empty", "empty", "not_a_zip"]
