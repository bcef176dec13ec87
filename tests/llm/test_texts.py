from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.llm import abuse as A
from trackloom.llm import pairs as P
from trackloom.llm import residue as R
from trackloom.llm import truncation as T

PREDS = "delivery_id bigint, delivered_at timestamp, qa_id string, model string, format string, raw_response string, extracted_answer array<string>, error string, score double"
ITEMS = "qa_id string, video_id string, dim string, format string, verification_passed boolean, question string, polished_question string, option_a string, option_b string, polished_option_a string, polished_statement_a string"
QUESTION = "When does the red cup first leave the frame in this clip?"
FULL = "First I look at the cup. The camera hardly moves during this part. One option can be ruled out because the lamp never crosses the cup. So the answer is B."

CASES = {
    "": "empty", None: "empty", "  \n": "empty", "​": "empty", "N/A": "empty", "null": "empty", "**Answer:** ": "empty", "```\n```": "empty", "<think>I look at it.</think>\n": "empty", "<answer></answer>": "empty", '""': "empty",
    "<think>First I look at the cup. It leaves": "truncated", '{"answer": "B", "reason": "The cup is vis': "truncated", "First I look at the cup. The camera hardly mo": "truncated", "The cup stays close to the lamp and then\\u00": "truncated", "The first frames show the cup next to&am": "truncated", FULL[:90]: "truncated",
    "I'm sorry, but I can't help with that.": "refusal", "I don't have access to the video, and therefore can't choose an option.": "refusal", "I refuse to take a guess here!": "refusal",
    QUESTION: "echo", QUESTION.upper(): "echo", "Q: " + QUESTION: "echo", QUESTION.lower()[:-1]: "echo", QUESTION + "\n" + QUESTION: "echo",
    "Die Antwort lautet B, weil der Gegenstand erst am Ende wieder auftaucht.": "other_language", "选B。": "other_language", "Правильный вариант — D.": "other_language", "Réponse : A": "other_language", "Odpowiedź to D, ponieważ przedmiot znika z kadru pod koniec.": "other_language",
    "B": None, "**C**": None, "Sorry, short on time: A": None, FULL: None, "for several seconds": None, QUESTION + " Answer: B": None, '{"answer": "B", "reason": "The cup is visible."}': None, 'A poster says "ouvert tous les jours", but nobody looks at it. (so: C)': None,
    "I cannot tell what the cup is made of, yet that is not asked. Hence A.": None, "<think>It leaves.</think>\nMy answer is D!": None, "Hmm... A 🙂": None, "Option 3": None, " 5 or more": None,
}


@pytest.fixture(scope="module")
def log(spark):
    rows = []
    for i, t in enumerate(CASES):
        rows.append((i, datetime(2026, 1, 1), "q1", f"m{i}", "mcq_4", t, None, None, 1.0))
        rows.append((1000 + i, datetime(2026, 1, 2), " Q1", f"M{i} ", "mcq_4", t, None, None, 2.0))
    # sound answers around them, so that the label model sees the usual case
    rows += [(5000 + k, datetime(2026, 1, 1), f"q{k % 40}", f"s{k}", "mcq_4", f"{'ABCD'[k % 4]}" if k % 2 else f"The cup number {k} stays near the lamp in this part. Hence {'ABCD'[k % 4]}.", ["A"], None, None) for k in range(600)]
    rows += [(9000, None, None, "m", None, None, None, None, None), (9001, None, "q9", None, None, "x", None, None, None)]
    return spark.createDataFrame(rows, PREDS)


@pytest.fixture(scope="module")
def items(spark):
    row = ("q1", "v", "d", "mcq_4", True, "When does the red cup leave the frame?", QUESTION, "early", "for several seconds", "early", None)
    return spark.createDataFrame([row, row, (None,) * 11], ITEMS)


def test_defects(log, items):
    got = {r["model"]: r["defect"] for r in P.found(log, items).where("model like 'm%'").collect()}
    wrong = {t: (got.get(f"m{i}"), want) for i, (t, want) in enumerate(CASES.items()) if got.get(f"m{i}") != want}
    assert wrong == {}
    assert P.found(log, items).where("model like 's%'").count() == 0


def test_truncated_messages_and_rates(log, items):
    got = {r["model"] for r in T.judged(log, items).where("truncated").collect()}
    assert got == {f"m{i}" for i, want in enumerate(CASES.values()) if want == "truncated"}
    rates = {r["model"]: r["share"] for r in T.rates(log, items).collect()}
    assert rates["m11"] == 1.0 and rates["s1"] == 0.0


def test_empty_predictions_and_items(log, items):
    assert T.judged(log.limit(0), items).count() == 0
    assert P.found(log.limit(0), items.limit(0)).count() == 0
    assert T.judged(log, items.limit(0)).where("truncated").count() >= 6


def test_near_copies(spark):
    words = " ".join(f"w{i}" for i in range(60))
    texts = spark.createDataFrame([(1, words, False), (2, " ".join(words.split()[:54]) + " w5", True), (3, "something else " * 8, True), (4, "a b", True)], "tid bigint, text string, unfinished boolean")
    assert [r["tid"] for r in T.early_ends(texts).collect()] == [2]


def test_expectation_maximisation_and_cutoff():
    post, share = P.fit(["111", "000", "xxx", "100"], np.array([50.0, 900.0, 40.0, 10.0]))
    assert post[0] > 0.99 and post[1] < 0.01 and post[3] < 0.5 and 0.02 < share < 0.12
    bad, good = np.array([40.0, 0.0, 0.0, 10.0]), np.array([0.0, 90.0, 10.0, 0.0])
    count = np.array([50.0, 900.0, 40.0, 10.0])
    at = P.cutoff(post, count, bad, good, share)
    assert (post >= at).tolist() == [True, False, False, bool(post[3] >= 0.05)] and P.cutoff(post, count, bad * 0, good, share) <= post[0] and P.expected_cutoff(np.array([]), np.array([])) == 0.5


def test_residue(spark):
    dirty = ["When does the {{label}} leave the frame?", "404 Not Found", "early Please enable JavaScript to continue.", "lorem ipsum dolor", "TODO: write the question", "for [OBJ_A] seconds", "at %s end", "LATE TBD", "x " * 3000 + "Internal Server Error"]
    clean = ["When does the red cup labelled \"sample\" leave the frame?", "early", "for several seconds", "How long does the script binder with the tag [blue] stay hidden?", "the cup (the one marked 50%) holding page 404 of the binder leaves the frame", "What is next to the error message on the screen?", "the error lamp never comes back", "", None, "  "]
    base = [(f"c{i}", f"v{i}", "d", "mcq_4", True, "q", f"When does the {c} {o} leave the frame in this clip?", None, None, "late" if i % 2 else "early", f"the {c} {o} never comes back") for i in range(60) for c, o in [(["red", "blue", "wooden"][i % 3], ["cup", "lamp", "script binder", "error lamp"][i % 4])]]
    rows = base + [(f"d{i}", f"w{i}", "d", "mcq_4", True, "q", t, None, None, "early", None) for i, t in enumerate(dirty)] + [(f"k{i}", f"w{i}", "d", "mcq_4", None, "q", t, None, None, "early", None) for i, t in enumerate(clean)]
    df = spark.createDataFrame([*rows, rows[-1], rows[61]], ITEMS)
    assert {r["qa_id"] for r in R.found(df).collect()} == {f"d{i}" for i in range(len(dirty))}
    assert R.found(df.limit(0)).count() == 0
    assert R.validation(df, 500).count() >= 1


OFFENDING = ["You are a brainless idiot.", "Shut up, you m0r0n, nobody asked you.", "i will find you and b-e-a-t you up", "Keep foreigners away from decent people, they are animals.", "Send me your nuuuuudes, I am so horny right now.", "Halt die Fresse, du Arschloch.", "You p.a.t.h.e.t.i.c l*s*r, go to hell", "Eres un idiota de mierda."]
HARMLESS = ["The camera pans slowly across the yard.", "Kill the stuck worker and retry; the master process hangs otherwise.", "I hate how slow the export is.", "The sculpture of a nude woman is covered by the towel.", "I disagree with this key, please check the item again.", "Die Kamera schwenkt langsam über den Hof.", "La taza vuelve a aparecer por la izquierda."]


@pytest.fixture(scope="module")
def machine():
    filler = ["The red cup moves to the left side of the table.", "Two annotators chose B, one left the field empty.", "Please attach the log of the last run.", "Le chien traverse la rue.", "Es fehlen noch zehn Fragen."] + HARMLESS
    rows = [(" ".join(filler[(k + j) % len(filler)] for j in range(4)), 0) for k in range(24)] + [(filler[k % 5] + " " + OFFENDING[k % 4], 1) for k in range(8)]
    return A.train(pd.DataFrame(rows, columns=["text", "verdict"]), most_negative=600)


def test_offending_passages(machine):
    bad, good = machine.score(OFFENDING), machine.score(HARMLESS)
    assert (good <= machine.cutoff).all(), good
    assert (bad > machine.cutoff).sum() >= len(OFFENDING) - 1, bad
    hidden = "The red cup moves to the left side of the table. " * 200 + OFFENDING[0] + " Please attach the log of the last run. " * 200
    assert machine.score([hidden])[0] > machine.cutoff
    assert machine.score(["", "   ", "​"]).tolist() == [-9.0] * 3


def test_scores_of_a_table(spark, machine):
    df = spark.createDataFrame([(1, OFFENDING[0], "s", 3), (2, None, None, 3), (3, "", "s", 3), (4, HARMLESS[0], None, 3)], "doc_id bigint, text string, source string, score int")
    got = {r["doc_id"]: r["p"] for r in df.select("doc_id", A.scores(F.col("text"), machine).alias("p")).collect()}
    assert got[1] > machine.cutoff and got[2] == got[3] == -9.0 and got[4] <= machine.cutoff
    reviews = spark.createDataFrame([(1, 1, "a"), (4, 0, "a"), (2, 1, "a"), (3, 1, "a"), (3, 0, "b"), (None, 1, "a")], "doc_id bigint, offensive int, reviewer string")
    assert len(A.reviewed(df, reviews)) == 2


def test_spelling_is_undone():
    assert A.normalise("h a r d c o r e") == "hardcore" and A.normalise("p.a.t.h.e.t.i.c") == "pathetic" and A.normalise("1d10t") == "idiot" and A.normalise("IDІОT") == "idiot"
    assert A.normalise("fооl") == "fool" and A.normalise("no​body") == "nobody" and A.normalise("&#39;<b>x</b>") == "' x" and A.normalise("ee3ba91f9732") == "ee3ba91f9732"
