import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions import display as D
from quillstream.operators import reads, render, store

REF = "array<struct<name:string,url:string,lean:string,reliability:string>>"
STORY = f"digest_date string, category string, rank int, headline string, what_happened string, why_it_matters string, relevant boolean, significance double, direction double, impacts array<struct<dimension:string,direction:int,confidence:double,rationale:string>>, claims array<struct<status:string,text:string>>, framing array<string>, uncertainty string, contrarian_read string, entities array<string>, explanation string, total double, refs {REF}"
FULL = ("2026-01-02", "a", 1, "A <b>", "It & that", "Because", True, 0.75, -1.0, [("rule_of_law", -1, 0.8, "why"), ("media_freedom", -1, 0.5, "so"), ("other", 0, 0.1, "x")], [("contested", "Said")], ["f1", "f2", "f3", "f4"], "Who", "Else", ["E"], "said", 0.5, [("N", "http://n/?a=1&b", "left", "high")] * 5)
BARE = ("2026-01-02", "a", 2, "B", None, None, False, 0.0, 0.0, [], [], None, None, None, [], None, 0.25, [])


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def stories(spark):
    return spark.createDataFrame([FULL, BARE], STORY)


def test_story_message(spark):
    df = stories(spark)
    s = F.struct(*df.columns)
    short, bare = [r.m for r in df.orderBy("rank").select(render.story_message(s).alias("m")).collect()]
    link = '<a href="http://n/?a=1&amp;b">N</a>'
    assert short == "<b>1. A &lt;b&gt;</b>\nIt &amp; that\n🔻 <i>Direction:</i> erosion; rule of law, media freedom; Significance: 0.8\n<i>Refs:</i> " + ", ".join([link] * 4)
    assert bare == "<b>2. B</b>"
    long = df.filter("rank = 1").select(render.story_message(s, compact=False).alias("m")).first().m
    assert "Why it matters:</i> Because" in long and "f1; f2; f3" in long and "f4" not in long and "Uncertainty:</i> Who" in long
    said = df.filter("rank = 1").select(render.story_message(s, False, {"uncertainty": "Open 100%", "refs": "See"}).alias("m")).first().m
    assert "<i>Open 100%:</i> Who" in said and "<i>See:</i> <a" in said


def test_category_messages(spark):
    rows = render.category_messages(stories(spark), {"a": "T", "b": "U"}).orderBy("category").collect()
    assert [(r.category, r.seq) for r in rows] == [("a", 0), ("b", 0)]
    assert rows[0].message.startswith("T\n\n<b>1.") and rows[1].message == "U\n<i>No stories.</i>"


def test_header_and_deep_dive(spark):
    stats = F.create_map(F.lit("fetched"), F.lit(420.0), F.lit("net_direction"), F.lit(0.5))
    assert one(spark, render.header_message("D", F.lit("2026-01-02"), F.lit("n<"), stats)) == "<b>D — 2026-01-02</b>\n\n<i>n&lt;</i>\n\n<code>Fetched: 420, Clusters: 0, Net direction: +0.50</code>"
    d = spark.createDataFrame([("T", "S", "B", "", None, "P", [("x", 0.25, "d")], ["w"], "C", 0.6)], "title string, executive_summary string, background string, mechanisms string, democracy_analysis string, comparative_precedent string, scenarios array<struct<name:string,probability:double,description:string>>, what_to_watch array<string>, counterargument string, confidence double")
    blocks = d.select(render.deep_dive_blocks(F.struct(*d.columns)).alias("b")).first().b
    assert blocks == ["<b>T</b>\n\nS", "<b>Background</b>\nB", "<b>Comparative precedent</b>\nP", "<b>Scenarios</b>\n• x (25%): d", "<b>What to watch</b>\n• w", "<b>Counterargument</b>\nC", "<b>Confidence</b>\n60%"]


def test_notes(spark, tmp_path):
    df = stories(spark)
    full, bare = [r.n for r in df.orderBy("rank").select(render.story_note(F.struct(*df.columns)).alias("n")).collect()]
    assert "> **Direction:** erosion; Significance: 0.75\n> - rule of law -1 (80%): why" in full
    assert "- `contested` Said" in full and "[[E]]" in full and "(left, high)" in full and "**Total:** 0.500 (said)" in full
    assert bare == "### 2. B\n\n**Total:** 0.250"
    notes = lambda rows: spark.createDataFrame(rows, "digest_date string, note string")
    render.write_notes(notes([("2026-01-01", "a"), ("2026-01-02", "b")]), str(tmp_path / "n"))
    render.write_notes(notes([("2026-01-02", "c\nd")]), str(tmp_path / "n"))
    got = {(str(r.digest_date), r.value) for r in spark.read.text(str(tmp_path / "n"), wholetext=True).collect()}
    assert {(d, v.strip()) for d, v in got} == {("2026-01-01", "a"), ("2026-01-02", "c\nd")}
    assert one(spark, render.tag_line(F.array(F.lit("A b")), "d")) == "tags: [d, topic/a-b]"


def test_prompt_takes_seven_earlier_stories(spark):
    prior = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct(i.alias("date"), F.lit("h").alias("headline"), F.repeat(F.lit("x"), 400).alias("what_happened")))
    ref = F.array().cast("array<struct<source_name:string,lean:string,reliability:string,published_at:timestamp,title:string,url:string,body:string>>")
    text = one(spark, render.prompt({"K": F.lit(1)}, ref, "do", prior))
    assert text.count("- ") == 7 and "x" * 300 in text and "x" * 301 not in text and text.endswith("=== TASK ===\ndo")


def test_gauges_and_commands(spark):
    assert one(spark, D.needle(F.lit(-3.0), F.lit(0.5))).asDict() == {"side": "left", "length": 1.0, "solid": 0.5}
    assert [one(spark, D.rounded_mean(F.array(*map(F.lit, v)))) for v in ([-1.0, -2.0], [1.0, 2.0])] == [-1, 2]
    one_point = spark.createDataFrame([("s", 1, 0.1)], "s string, o int, v double")
    assert D.trace(one_point, "s", "o", "v").select("x", "place").first() == (12.0, 0)
    assert one(spark, D.command(F.lit("/More@bot  AI  Act"))).asDict() == {"name": "More", "argument": "ai act"} and one(spark, D.command(F.lit("hi"))) is None
    assert one(spark, D.callback(F.lit("fb:more:2026-01-02"))).digest_date == dt.date(2026, 1, 2) and one(spark, D.callback(F.lit("x"))) is None
    assert [one(spark, D.admitted(F.lit(5), F.lit(v))) for v in ("", None, "4, 5", "4")] == [True, True, True, False]


def test_interests_hold_each_step(spark):
    t = dt.datetime(2026, 1, 10)
    at = lambda h: t + dt.timedelta(hours=h)
    steps = [("a", "irrelevant", at(i // 3), i) for i in range(6)] + [("a", "more", at(3), 6), ("a", "nonsense", at(4), 7), (None, "more", t, 8), ("old", "more", t - dt.timedelta(days=70), 9)]
    got = reads.interests(spark.createDataFrame(steps, "tag string, signal string, created_at timestamp, id int"), F.lit("2026-01-11").cast("timestamp")).collect()
    assert [(r.tag, round(r.weight, 6)) for r in got] == [("a", -0.85)]


def test_contract_schema():
    t = T.StructType([T.StructField("a", T.ArrayType(T.IntegerType()), False), T.StructField("b", T.DateType()), T.StructField("c", T.MapType(T.StringType(), T.DoubleType())), T.StructField("d", T.BooleanType())])
    got = store.contract_schema(t)
    assert got["required"] == ["a"] and got["additionalProperties"] is False
    assert got["properties"] == {"a": {"type": "array", "items": {"type": "integer"}}, "b": {"type": "string", "format": "date"}, "c": {"type": "object", "additionalProperties": {"type": "number"}}, "d": {"type": "boolean"}}


def test_bars_minutes_and_small_parts(spark):
    import datetime as dt

    from quillstream.operators import routing, stories

    rows = [(0.0,), (None,), (0.04,), (-0.55,), (1.0,)]
    got = [r.b for r in spark.createDataFrame(rows, "v double").select(D.bar(F.col("v")).alias("b")).collect()]
    assert got == ["▪️", "▪️", "🟩", "🟥" * 5, "🟩" * 10]
    one = spark.createDataFrame([(dt.datetime(2026, 1, 5, 7, 3, 59), 10, -1)], "t timestamp, a long, b long")
    r = one.select(D.minute(F.col("t")).alias("m"), stories.simhash_hex(F.col("a")).alias("a"), stories.simhash_hex(F.col("b")).alias("b")).first()
    assert tuple(r) == ("2026-01-05 07:03 UTC", "0" * 15 + "a", "f" * 16)
    registry = spark.createDataFrame([("x", "X", "left", "high", 2.0)], "slug string, name string, lean string, reliability string, weight double")
    assert [tuple(r) for r in routing.from_known_sources(spark.createDataFrame([("x",), ("y",), (None,)], "source_slug string"), registry).select("source_slug", "name").collect()] == [("x", "X")]
    assert routing.vocabulary_union({"a": ["B", "c "]}, {"a": ["b", ""], "d": []}) == {"a": ["b", "c"], "d": []}
