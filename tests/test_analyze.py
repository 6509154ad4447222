"""The morphological analyzer over the small rule book."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from morphlake.functions.surface import BOUNDARIES, lex, render, tokenize
from morphlake.operators import lines, rulebook
from morphlake.operators.analyze import Options
from morphlake.operators.recover import Analyzer, trimmed
from morphlake.sources import grammar

WORDS = (
    "puella puellam puellamque rosae regem bonus melior maxime amat amabat amavisti amasti implessem audii quis cuius aliquis quicumque quidam ecquis poetane adportat "
    "audit amator puellulam inplet puelle rossa poëta xiv poetha resmagna hortat hortatur duc reg pluunt audetur iam pulchralius dominusque saepe in puellā puellă rōsa"
).split()


@pytest.fixture(scope="module")
def book(spark):
    return rulebook.RuleBook.of_rows(spark, grammar.rows())


def questions(spark, words):
    rows = [(s.normalized, s.orthography, s.lookup, s.known, s.long, w[:1].isupper()) for w in words if (s := lex(w)).status == "ok"]
    return spark.createDataFrame(rows, "normalized string, orthography string, lookup string, known long, long long, titled boolean")


@pytest.fixture(scope="module")
def readings(spark, book):
    out = Analyzer(book).analyze(questions(spark, WORDS))
    lemma = lines.citation_lemma(book)
    found = out.join(lemma, "lexeme_id", "left").collect()
    by = {}
    for r in found:
        by.setdefault(r["normalized"], []).append(r)
    return by


def test_rulebook_is_sound(book):
    assert [r for r in rulebook.validate(book).collect() if r["violations"]] == []


def test_rulebook_faults_are_found(spark, book):
    rows = grammar.rows()
    rows["stems"] = [*rows["stems"], (9999, 1, 1, "xjv")]
    bad = {r["check"]: r["violations"] for r in rulebook.validate(rulebook.RuleBook.of_rows(spark, rows)).collect()}
    assert bad["reference stems.lexeme_id"] == 1 and bad["spelling stem"] == 1


def features(rows, *names):
    return {tuple(r[n] for n in names) for r in rows}


def test_regular(readings):
    assert features(readings["puella"], "lemma", "case", "number") == {("puella", "NOM", "S"), ("puella", "VOC", "S"), ("puella", "ABL", "S")}
    assert features(readings["regem"], "lemma", "case", "kind") >= {("rex", "ACC", "N")}
    assert ("bonus", "COMP") in features(readings["melior"], "lemma", "degree")
    assert features(readings["amabat"], "tense", "mood", "person", "number") == {("IMPF", "IND", 3, "S")}
    assert {r["governs"] for r in readings["in"]} == {"ABL"}


def test_fourth_conjugation_is_shown_as_such(readings):
    assert {(r["declension"], r["variant"]) for r in readings["audit"] if r["tense"] == "PRES"} == {(4, 1)}


def test_enclitic(readings):
    assert {r["stage"] for r in readings["puellamque"]} == {"tackon"}
    assert features(readings["puellamque"], "lemma", "case") == {("puella", "ACC")}
    assert "tackon" in {r["stage"] for r in readings["poetane"]}


def test_pronouns_and_packs(readings):
    assert {r["stage"] for r in readings["quis"]} >= {"qu_pronoun"}
    assert {r["case"] for r in readings["cuius"]} == {"GEN"}
    assert {r["lemma"] for r in readings["aliquis"]} == {"aliqu"}
    assert {r["stage"] for r in readings["quicumque"]} == {"packon"} and {r["stage"] for r in readings["quidam"]} == {"packon"}
    assert {r["stage"] for r in readings["ecquis"]} == {"tickon"}


def test_affixes(readings):
    assert features(readings["adportat"], "lemma", "stage") == {("porto", "prefix")}
    assert ("amo", "suffix", "N") in features(readings["amator"], "lemma", "stage", "kind")
    assert features(readings["puellulam"], "lemma", "stage", "case") == {("puella", "suffix", "ACC")}
    # a suffix that may stand beside regular readings
    assert ("magnus", "suffix", "ADV") in features(readings["maxime"], "lemma", "stage", "kind") or {r["stage"] for r in readings["maxime"]} == {"regular"}


def test_contraction(readings):
    assert features(readings["amasti"], "stage", "lemma", "tense", "person") == {("syncope", "amo", "PERF", 2)}
    assert {r["tense"] for r in readings["implessem"]} == {"PLUP"}
    assert ("audio", "syncope") in features(readings["audii"], "lemma", "stage")


def test_respelling(readings):
    assert features(readings["inplet"], "lemma", "stage") == {("impleo", "orthography")}
    assert {r["stage"] for r in readings["puelle"]} == {"orthography"} and {r["lemma"] for r in readings["puelle"]} == {"puella"}
    assert {r["lemma"] for r in readings["poetha"]} == {"poeta"}


def test_numeral_and_unknown(readings):
    assert [r["roman"] for r in readings["xiv"]] == [14]
    assert "pulchralius" not in readings and "resmagna" not in readings


def test_marked_vowels(readings):
    assert features(readings["puellā"], "case", "quantity_match") == {("ABL", "exact")}
    assert features(readings["puellă"], "case") == {("NOM",), ("VOC",)}
    assert "rōsa" not in readings or not {r["stage"] for r in readings["rōsa"]} & {"regular"}


def test_trim(spark, readings):
    assert ["deponent_active_form"] in [r["trim"] for r in readings["hortat"]]
    assert all(r["trim"] == [] for r in readings["hortatur"])
    assert all(r["trim"] == [] for r in readings["duc"]) and any(r["trim"] == ["unsupported_short_imperative"] for r in readings["reg"])
    assert any("source_disagreement" in r["notices"] for r in readings["pluunt"])
    assert any("related_passive_usage_attested" in r["notices"] for r in readings["audetur"])
    rows = spark.createDataFrame([("hortat", ["deponent_active_form"]), ("amat", [])], "normalized string, trim array<string>")
    assert {r["normalized"] for r in trimmed(rows, ["deponent_active_form"]).collect()} == {"amat"}


@pytest.mark.parametrize(
    ("options", "words"),
    [
        (Options(prefixes=False, tackons=False), ["adportat", "puellamque"]), (Options(suffixes=False, packons=False, tickons=False), ["puellulam", "quicumque", "ecquis"]),
        (Options(syncope=False, orthography="disabled"), ["amasti", "inplet"]), (Options(orthography="classical"), ["puelle"]),
    ],
)
def test_switches(spark, book, options, words):
    assert Analyzer(book, options).analyze(questions(spark, words)).count() == 0


def test_two_words(spark, book):
    a = Analyzer(book)
    q = questions(spark, ["resmagna", "Resmagna", "inrosa"])
    found = a.two_words(q, a.analyze(q)).collect()
    assert {(r["normalized"], r["left_part"], r["right_part"], r["classification"]) for r in found} == {("resmagna", "res", "magna", "two-words")}


def test_lines(spark, book):
    text = [(0, "Puella amata est, et poeta."), (1, "amatum iri; amata, est"), (2, None), (3, "  ")]
    found, rows = lines.analyze_lines(spark.createDataFrame(text, "line_id long, text string"), book)
    pairs = lines.compounds(found, rows, book).collect()
    assert {(r["line_id"], r["pos"], r["compound"], r["tense"], r["voice"], r["mood"]) for r in pairs} == {(0, 1, "finite_sum", "PERF", "PASSIVE", "IND"), (1, 0, "iri", "FUT", "PASSIVE", "INF")}
    docs = {(r["line_id"], r["pos"]): r["document"] for r in lines.documents(found, rows, book).collect()}
    assert len(docs) == 9 and '"status":"analyzed"' in docs[0, 0] and '"lemma":"puella"' in docs[0, 0]
    assert lines.hits(rows).count() > 0
    compact = lines.compact_rows(found, rows, book)
    assert compact.where("unit = 'token:0' and result = 0").agg(F.max("reading")).first()[0] >= 3


def test_surface():
    assert lex("Jūlia").lookup == "iulia" and lex("Jūlia").known == 2 and lex("Jūlia").long == 2
    assert lex("æther").orthography == "aether" and lex("").status == "empty-input"
    assert lex("b̄").status == "invalid-vowel-quantity" and lex("a1").status == "unsupported-character"
    assert render("puella", 0b100000, 0b100000) == "puellā"
    t = tokenize("Arma, virum—cano!")
    assert [x.text for x in t] == ["Arma", "virum", "cano"] and t[0].boundary == BOUNDARIES["comma"] + BOUNDARIES["whitespace"] and t[1].boundary == BOUNDARIES["dash"]
    assert t[2].begin == 14


def test_dictionary(spark, book):
    from morphlake.operators import dictionary

    forms = {r["form"] for r in dictionary.dictionary_form(book).collect()}
    assert {"puella, puellae f", "bonus, bona, bonum", "amo, amare, amaui, amatus", "hortor, hortari, hortatus sum", "et"} <= forms
    index = dictionary.gloss_index(book)
    asked = spark.createDataFrame([("girl", "X"), ("WARN", "V"), ("warn", "N")], "word string, part string")
    lemma = {r["lexeme_id"]: r["lemma"] for r in lines.citation_lemma(book).collect()}
    assert {(r["word"], lemma[r["lexeme_id"]]) for r in dictionary.reverse_lookup(index, asked).collect()} == {("girl", "puella"), ("warn", "moneo")}
    near = dictionary.neighbours(book, spark.createDataFrame([("puelx",)], "form string")).collect()
    assert {(r["stem"], r["after"]) for r in near} == {("puell", False), ("puer", True)}
    rows = spark.createDataFrame([("a", "A", "X"), ("a", "F", "X"), ("b", "F", "X")], "q string, freq string, age string")
    assert sorted((r["q"], r["freq"]) for r in dictionary.swept(rows, ["q"], ["F"], ["H"]).collect()) == [("a", "A"), ("b", "F")]


def test_plans_stay_small(spark, monkeypatch):
    """No lookup is planned together with the next ones: the driver holds few tables that are sent out at once."""
    from morphlake.operators import analyze, lines

    joins = {}

    def counted(df, name, write=analyze.materialize):
        joins[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return write(df, name)

    monkeypatch.setattr(analyze, "materialize", counted)
    text = spark.createDataFrame([(1, "puella puella, amicusque Puella"), (2, None), (3, "x1 pu\u0113lla")], "line_id long, text string")
    forms = lines.forms(text)
    want = lines.tokens(text).where("status = 'ok'").selectExpr("lookup as form", "known", "long").distinct()
    assert sorted(map(tuple, forms.collect())) == sorted(map(tuple, want.collect()))
    rows = analyze.Core(rulebook.RuleBook.of_rows(spark, grammar.rows()).kept()).analyze(forms)
    assert {r["form"] for r in rows.select("form").collect()} == {"puella", "amicusque"}
    assert max(joins.values()) <= 15, joins
