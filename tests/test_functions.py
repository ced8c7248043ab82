import pytest
from pyspark.sql import functions as F

from quillstream.functions import scoring as S
from quillstream.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, X.normalize(F.col("t"), ["the"]), t="The Parliament, in Sofia!") == "parliament sofia"
    assert one(spark, X.normalize(F.col("t"), compatibility=True), t="ﬁne ①") == "fine"
    assert one(spark, X.normalize(F.col("t")), t="") == ""


def test_vocabulary_is_boundary_aware(spark):
    hits = lambda text, terms: one(spark, X.vocabulary_hits(F.lower("t"), terms), t=text)
    assert hits("chips and iranian india", ["chip", "iran", "india"]) == 1
    assert hits("indiana", ["india"]) == 1
    assert hits("ai act now", ["ai act", "ai"]) == 1
    assert hits("rule of law", ["rule of law", "law"]) == 1
    assert hits("нато, НАТО", ["нато"]) == 1
    assert hits("anything", []) == 0


def test_ngrams_and_similarity(spark):
    assert sorted(one(spark, X.char_ngrams(F.col("t")), t="ab cde")) == ["abcd", "bcde"]
    assert one(spark, X.char_ngrams(F.col("t")), t="ab") == ["ab"]
    assert one(spark, X.char_ngrams(F.col("t")), t=" ") == []
    a = F.array(*map(F.lit, "abcd"))
    b = F.array(*map(F.lit, "abcx"))
    assert one(spark, X.jaccard(a, b)) == pytest.approx(0.6)
    assert one(spark, X.containment(a, b)) == pytest.approx(0.75)
    assert one(spark, X.containment(F.slice(a, 1, 2), b)) == 0


def test_transliteration_and_signature(spark):
    letters = {"щ": "sht", "а": "a", "с": "s", "т": "t", "и": "i", "е": "e", "з": "z", "л": "l", "н": "n", "к": "k"}
    assert one(spark, X.transliterate(F.col("t"), letters), t="Щастие") == "shtastie"
    assert one(spark, X.signature(F.col("t"), {"съд": "court"}, letters), t="съд Зеленски") == "court zelenski"


def test_html_slug_escape(spark):
    html = '<html><head><title>x</title></head><nav>menu</nav><script>a("</p>")</script><p>Hi &amp; <b>bye</b></p><!-- no --></html>'
    assert one(spark, X.html_to_text(F.col("t")), t=html) == "Hi & bye"
    for html, text in {
        "<div>ad</div><article><p>a</p></article>x<article id='2'>b</article><p>foot": "a x b",
        "<div>ad</div><main><b>m</b></main>": "m", "<article> <br></article><main>m</main>": "m", "<article></article>all": "all", "<article>open": "open", "": "",
    }.items():
        assert one(spark, X.html_to_text(F.col("t")), t=html) == text
    assert one(spark, X.html_to_text(F.lit(None).cast("string"))) is None
    assert one(spark, X.slug(F.col("t")), t="--A b/C--") == "a-b-c"
    assert one(spark, X.escape_html(F.col("t")), t="<a & 'b'>") == "&lt;a &amp; 'b'&gt;"
    assert one(spark, X.safe_filename(F.col("t")), t=' a/b:c ') == "a-b-c"


def test_extract_json(spark):
    assert one(spark, X.extract_json(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, X.extract_json(F.col("t")), t='Sure: {"a": {"b": 2}} done') == '{"a": {"b": 2}}'
    assert one(spark, X.extract_json(F.col("t")), t="none") is None


def test_chunks():
    text = "\n\n".join(["a" * 30, "b" * 30, "c" * 150])
    parts = X.chunks(text, 70)
    assert all(len(p) <= 70 for p in parts) and "".join(parts).replace("\n", "") == text.replace("\n", "")
    assert X.chunks("", 10) == [""] and X.chunks(None) == [""] and X.chunks("a\n\n\nb", 10) == ["a\n\n\nb"]


IMPACTS = "array<struct<dimension:string,direction:int,confidence:double,rationale:string>>"


def impacts(*rows):
    values = ", ".join(f"named_struct('dimension', '{d}', 'direction', {x}, 'confidence', double({c}), 'rationale', '{r}')" for d, x, c, r in rows)
    return F.expr(f"cast(array({values}) as {IMPACTS})")


def test_rubric_of_the_default_story(spark):
    i = impacts(("rule_of_law", -1, 0.7, "one two three four five six seven"))
    wd = S.weighted_direction(F.lit(True), i)
    assert one(spark, wd) == pytest.approx(-1.0)
    assert one(spark, S.weighted_direction(F.lit(False), i)) == 0
    assert one(spark, S.weighted_direction(F.lit(True), impacts())) == 0
    dem = S.democracy_score(F.lit(True), F.lit(0.8), wd)
    assert one(spark, dem) == pytest.approx(0.695)
    cred = S.source_credibility(F.array(F.lit("high"), F.lit("high")), F.array(F.lit("a"), F.lit("b")))
    assert one(spark, cred) == pytest.approx(0.8)
    none = F.array().cast("array<string>")
    pen = S.penalties(F.lit(2), F.array(F.lit("center"), F.lit("center")), none, F.lit(False), F.lit(0.7))
    assert one(spark, pen) == pytest.approx(0.06)
    total = S.selection_total(dem, F.lit(0.6), F.lit(0.7), F.lit(0.8), F.lit(0.5), pen)
    assert one(spark, total) == pytest.approx(0.6085)
    flags = S.sanity_flags(F.lit(0.8), F.lit(0.8), F.lit(True), i, F.lit(-1), F.lit(0.7), F.lit("other view"))
    assert one(spark, flags) == []
    assert one(spark, S.sanity_flags(F.lit(0.8), F.lit(0.2), F.lit(True), impacts(), F.lit(2), F.lit(0.1), F.lit(None).cast("string"))) == [
        "high_significance_low_credibility", "relevant_but_no_dimensions", "strong_verdict_thin_sourcing", "no_counterview",
    ]


def test_penalty_grows(spark):
    none = F.array().cast("array<string>")
    pen = lambda n, again, nov: one(spark, S.penalties(F.lit(n), F.array(F.lit("a"), F.lit("b")), none, F.lit(again), F.lit(nov)))
    assert pen(1, False, 0.9) > pen(2, False, 0.9) and pen(2, True, 0.1) > pen(2, True, 0.9)


def test_probabilities_and_interests(spark):
    arr = lambda *p: F.array(*[F.lit(float(x)) for x in p])
    assert one(spark, S.normalize_probabilities(arr(0.4, 0.6))) == [0.4, 0.6]
    assert one(spark, S.normalize_probabilities(arr(1, 1))) == [0.5, 0.5]
    assert one(spark, S.normalize_probabilities(arr(0, 0))) == [0.0, 0.0]
    interests = F.create_map(F.lit("eu"), F.lit(0.4))
    assert one(spark, S.personal(F.array(F.lit("eu"), F.lit("x")), interests)) == pytest.approx(0.9)
    assert one(spark, S.personal(F.array(F.lit("EU")), interests)) == 0.5


def test_tone_and_severity(spark):
    assert [one(spark, X.severity(F.lit(v))) for v in (0.5, 1.5, -0.5, -2.0)] == [0, 2, 0, -2]
    assert [one(spark, X.tone(F.lit(v))) for v in (-0.2, 0.0, 0.2)] == ["erosion", "neutral", "strengthening"]
