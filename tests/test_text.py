import regex
from pyspark.sql import functions as F

from claimsift.fixed_values import ALLOWED_TAGS, TAXONOMY
from claimsift.functions import answers, text
from claimsift.operators.cleaning import harmonise_tag

HOSTILE = [
    "", " ", "\n a \t", " Ünïcode  words　here ", "a", "ab", "snake_case 42 x", "l'été déjà-vu",
    "\x1c\x1dcontrol\x1e", "ΑΒΓ δεζ", "日本語 テキスト", "tab\tnew\nline\r\nend", "\x85nel\x85", "!!! ... ??", "²³ ½½ ⅫⅫ",
]


def test_strip_and_word_count_follow_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HOSTILE)], "i int, t string")
    rows = df.select("t", text.strip_text("t").alias("s"), text.word_count("t").alias("n")).collect()
    for r in rows:
        assert r["s"] == r["t"].strip()
        assert r["n"] == len(r["t"].split())


def test_tokens_are_runs_of_word_characters(spark):
    df = spark.createDataFrame([(t,) for t in [*HOSTILE, None]], "t string")
    for r in df.select("t", text.tokenise("t").alias("tokens")).collect():
        assert r["tokens"] == regex.findall(r"[\p{L}\p{N}_]{2,}", (r["t"] or "").lower())


def test_ngrams_span_removed_words_and_short_rows(spark):
    df = spark.createDataFrame([("the cat of the house",), ("cat",), ("",), ("the of",)], "claim string")
    tokens = text.with_tokens(df, "claim", "tokens", ["the", "of"])
    rows = text.with_ngrams(tokens, "tokens", "terms", 1, 2).collect()
    assert [r["terms"] for r in rows] == [["cat", "house", "cat house"], ["cat"], [], []]
    pairs = text.with_ngrams(tokens, "tokens", "terms", 2, 2).collect()
    assert [r["terms"] for r in pairs] == [["cat house"], [], [], []]


def test_default_stop_words_are_tokens():
    words = text.default_stop_words()
    assert "the" in words and "ll" in words and not [w for w in words if "'" in w or len(w) < 2]


GOLDEN_ANSWERS = [
    # answer, alphabetical containment, application rule
    ("Mortgage", "Mortgage", "Mortgage"),
    ("mortgage", "Mortgage", "Mortgage"),
    ("  Mortgage \n", "Mortgage", "Mortgage"),
    ("Mortgage.", "Mortgage", "Mortgage"),
    ("STUDENT LOAN", "Student loan", "Student loan"),
    ("Student loan or Mortgage", "Mortgage", "Mortgage"),
    ("Vehicle loan / Lease, Debt collection", "Debt collection", "Debt collection"),
    ("Mortgage and Credit reporting", "Credit reporting", "Credit reporting"),
    ("Bank account / Savings then Credit card / Prepaid card", "Bank account / Savings", "Credit card / Prepaid card"),
    ("Erreur", "Autre / Inconnu", "Credit reporting"),
    ("Erreur (Quota dépassé)", "Autre / Inconnu", "Credit reporting"),
    ("Credit", "Autre / Inconnu", "Credit reporting"),
    ("card", "Autre / Inconnu", "Credit card / Prepaid card"),
    ("loan", "Autre / Inconnu", "Student loan"),
    ("Savings", "Autre / Inconnu", "Bank account / Savings"),
    ("crypto", "Autre / Inconnu", "Money transfer / Crypto"),
    ("", "Autre / Inconnu", "Credit reporting"),
    ("   ", "Autre / Inconnu", "Credit reporting"),
    (None, "Autre / Inconnu", "Credit reporting"),
    ("nonsense", "Autre / Inconnu", "Credit reporting"),
]


def test_both_normalisers(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in GOLDEN_ANSWERS], "a string")
    rows = df.select(
        answers.normalise_prediction("a", ALLOWED_TAGS).alias("p"), answers.normalise_tag("a").alias("t")
    ).collect()
    assert [(r["p"], r["t"]) for r in rows] == [(p, t) for _, p, t in GOLDEN_ANSWERS]


def test_a_category_absent_from_the_list_is_never_returned(spark):
    df = spark.createDataFrame([("Mortgage",)], "a string")
    assert df.select(answers.normalise_prediction("a", ["Student loan"])).first()[0] == "Autre / Inconnu"


def test_manual_tags_and_ids(spark):
    tags = spark.createDataFrame([(" a\t",), ("",), (None,), ("  ",)], "t string")
    assert [r[0] for r in tags.select(answers.clean_manual_tag("t")).collect()] == ["a", None, None, ""]
    cases = {"12abc": 12, " 7": 7, "-3.9": -3, "+5": 5, "abc": None, "": None, None: None, "9" * 30: None, "a1": None}
    ids = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in ids.select(answers.parse_claim_id("t")).collect()] == list(cases.values())


def test_request_status(spark):
    cases = {"ab": "too_short", None: "too_short", "": "too_short", "   ": "empty", "\n\t\x0b ": "empty", "abc": "valid", " a ": "valid"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(answers.request_status("t")).collect()] == list(cases.values())


def test_prompt(spark):
    df = spark.createDataFrame([("x\ny",)], "t string")
    assert df.select(answers.build_prompt("t")).first()[0] == 'Réclamation client :\n"""\nx\ny\n"""\n\nCatégorie :'


def test_taxonomy(spark):
    rows = [(t,) for t in [*TAXONOMY, "Something new", None]]
    out = harmonise_tag(spark.createDataFrame(rows, "tag string"))
    found = {r["tag"]: r["tag_clean"] for r in out.collect()}
    assert found == {**TAXONOMY, "Something new": "Something new", None: None}
    assert len(set(TAXONOMY.values())) == 10 and set(TAXONOMY.values()) == set(ALLOWED_TAGS)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_confidence(spark):
    df = spark.createDataFrame([([0.1, 0.899951], 1)], "p array<double>, k int")
    assert df.select(answers.confidence("p", "k")).first()[0] == 0.9
    assert df.select(F.lit(1)).count() == 1
