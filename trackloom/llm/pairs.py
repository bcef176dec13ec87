"""Defective answers: empty, truncated, refusal, echo of the question, other language.

Method: several noisy labelling functions for every defect vote 1 (defect), 0 (no defect) or abstain. The votes of all messages
are counted by pattern; a label model with one hidden class per defect is fitted to the counts by expectation
maximisation (a pattern is at most a few votes long, so the counts are a small table whatever the number of messages), and
gives each pattern its posterior. A defect is kept where the posterior reaches a cutoff, which is validated on held-out messages of known
state: sound ones, whose answer is their item's, and defects planted in such messages. Several defects may be kept; p3_found then takes the likeliest.

The texts stay where they are: votes that need the text alone are given in one scan, items are joined only to texts without an answer in them
(the only ones that can be echoes), and copies of a message are merged afterwards, by votes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.text import key_text
from trackloom.llm import truncation
from trackloom.session import cut

#: In order of precedence at equal posterior.
DEFECTS = ["empty", "other_language", "refusal", "echo", "truncated"]

#: Function words; those that two of these languages share are left out.
ENGLISH = "the of and is it that this be was with are by from which not so have its my after before only while there during but cannot can't i'm i what here must since were take guess".split()
OTHER = (
    "der die das und ist nicht ein eine ich dass weil auf dem den mit wird bleibt ins dann hinter anhand würde lautet erst "
    "le la les des et est une que qui dans pas je puis car mais avec même d'abord d'après c'est l'objet l'image réponse dirais "
    "el los las una que por para con pero lo del según creo diría porque aunque después respuesta "
    "il di che è un lo gli della perché anche poi dopo secondo resta risposta direi l'oggetto "
    "os um uma não é porque mas depois acho objeto resposta embora diria "
    "het een niet en ik maar omdat dan antwoord jest nie się przez potem odpowiedź ponieważ pod że att det som inte är jag svar og ikke jeg "
    "bir ve bu için ama çünkü sonra cevap ja ei mutta koska sitten vastaus"
).split()
#: What announces an answer in other languages.
ANNOUNCED = r"(?i)\b(?:antwort|réponse|respuesta|risposta|resposta|odpowiedź|ответ|вариант|antwoord|svar|vastaus|cevap|javob|відповідь)\b"

CANNOT = r"(?:can(?:no|'|’)t|can not|cannot|could not|couldn't|am unable|are unable|unable|not able|not possible(?: for me)?|won't be able|will not be able|lack the (?:capability|capacity|ability|means)|don't have the ability|incapable)"
REFUSES = [
    # inability to do the task itself
    rf"(?i){CANNOT}\b[^.!?]{{0,40}}?\b(?:help|assist|answer|respond|comply|provide|give|choose|process|interpret|analy[sz]e|look at moving|watch|view|open|access|evaluate|judge|determine an? answer|fulfil+|complete this)\b|beyond (?:what i can|my)|no answer can be given|outside (?:of )?(?:my|what i)\b",
    # declines
    r"(?i)\b(?:i will not|i won't|i refuse|i decline|i must decline|i have to decline|have to pass|need to pass|i'd rather not|would rather not|prefer not to|not (?:feel )?comfortable|not allowed|not permitted|am permitted to|(?:do|does|would) not (?:allow|permit|let) me|not be appropriate|not appropriate for me|inappropriate for me|policy (?:prevents|forbids|does not)|against my (?:policy|guidelines)|refuse to|decline to|not willing)\b",
    # no access to the material
    r"(?i)\b(?:(?:don't|do not) have (?:access|the (?:video|footage|frames))|(?:have not|haven't|wasn't|was not) (?:been )?(?:given|shown|provided)|(?:did not|didn't|never) (?:receive|reached|get|got)|no (?:video|footage|images?|frames?) (?:was|were|has|have|is|are)|only (?:work|handle|process|deal) (?:with )?(?:written )?text|text[- ]only|as an? (?:ai|language model))\b",
]
APOLOGY = r"(?i)^\W*(?:(?:hmm|hello|hi|well|please note(?: that)?|to be honest)\W+)*(?:i'm sorry|i am sorry|sorry|unfortunately|regrettably|i apologi[sz]e|apologies|my apologies|thank you for)\b"
#: What frames an answer without being one.
FRAME = r"(?i)</?(?:answer|response|final|output|think|result)>|\b(?:final answer|the answer is|my answer is|answer|response|option|output|result|reasoning)\b"

#: Seeds of planted defects, and most sound messages that defects are planted in (validation only).
EMPTY_SEEDS = ["", "   ", "N/A", "null", "**Answer:**", "```\n```", "<answer></answer>", "..."]
OTHER_SEEDS = ["Die Antwort ist B, weil der Gegenstand dann nicht mehr im Bild ist.", "La réponse est C, car l'objet sort du cadre avant la fin.", "La respuesta es A porque el objeto vuelve a aparecer.", "La risposta è D, perché l'oggetto resta visibile.", "答案是B。", "Правильный ответ — A.", "回答はCです。", "A resposta é B porque o objeto desaparece."]
REFUSAL_SEEDS = ["I'm sorry, but I can't help with that.", "I am unable to view the video, so I cannot answer this question.", "As an AI language model I do not have access to the footage.", "I'd rather not answer this.", "Unfortunately I cannot determine an answer from this.", "I must decline to answer this request.", "I won't be able to assist with this question."]
MOST_PLANTED = 3000


def content(text: Column) -> Column:
    """The text without closed reasoning, tags and labels, letters and digits only."""
    inner = F.regexp_replace(F.regexp_replace(truncation.body(text), FRAME, " "), r"[\x{200B}-\x{200F}\x{FEFF}\x{2060}]", "")
    return F.trim(F.regexp_replace(inner, r"[^\p{L}\p{N}]+", " "))


def _vote(yes: Column | None, no: Column | None) -> Column:
    """'1', '0' or 'x' (abstains); a null condition doesn't hold."""
    out = F.lit("x")
    if no is not None:
        out = F.when(F.coalesce(no, F.lit(False)), "0").otherwise(out)
    return F.when(F.coalesce(yes, F.lit(False)), "1").otherwise(out) if yes is not None else out


def _features(rows: DataFrame) -> DataFrame:
    """rows (qa_id, model, text, extracted) with what the votes need of the text alone. Costly patterns are tried only where they can matter."""
    text = F.coalesce("text", F.lit(""))
    c = F.col
    ascii_only = F.octet_length(text) == F.length(text)
    m = rows.withColumns({"t": text, "main": truncation.body(text), "plain": ascii_only})
    bare = F.regexp_replace(F.translate("t", "’", "'"), r"[\"“”„«»][^\"“”„«»\n]{0,80}[\"“”„«»]|</?think>", " ")
    # of a long text the frame is a small part, so that only its signs are taken off
    m = m.withColumn("core", F.when(F.length("main") <= 200, content(c("t"))).otherwise(F.trim(F.regexp_replace("main", r"[^\p{L}\p{N}]+", " "))))
    m = m.withColumn("words", F.array_distinct(F.split(F.lower(bare), r"[^\p{L}\p{M}']+")))
    m = m.withColumn("english", F.size(F.array_intersect("words", F.array(*map(F.lit, ENGLISH)))))
    # a text with so many different English function words is English
    m = m.withColumn("foreign", F.when(c("english") >= 5, 0).otherwise(F.size(F.array_intersect("words", F.array(*map(F.lit, OTHER))))))
    m = m.withColumns({"n": F.size(F.filter("words", lambda w: F.length(w) > 1)), "letters": F.when(c("plain"), F.length("t")).otherwise(F.length(F.regexp_replace("t", r"[^\p{L}]", ""))), "latin": F.when(c("plain"), F.length("t")).otherwise(F.length(F.regexp_replace("t", r"[^\p{IsLatin}]", "")))})
    answers = truncation.answer_end(F.rtrim("main", F.lit(truncation._SPACE))) | F.col("main").rlike(r"(?s)^\s*[A-H][.):]\s+\S|\b(?i:answer|option|choose|hence|leaves)\b(?: is)?[:\s]+(?:[A-H]|\d+)\b|\"answer\":\s*\"[^\"]+\"")
    m = m.withColumn("answers", answers)
    m = m.withColumns({f"refuses{i}": F.when(F.col("answers"), False).otherwise(F.col("t").rlike(p)) for i, p in enumerate(REFUSES)})
    return m.withColumns({"apology": F.when(F.col("answers"), False).otherwise(F.col("t").rlike(APOLOGY)), "announces": F.when(F.col("english") >= 2, False).otherwise(F.col("t").rlike(ANNOUNCED)), "asks": F.when(F.col("answers"), False).otherwise(F.regexp_replace("main", r"\s+", " ").rlike(truncation.ASKS))})


def text_votes(rows: DataFrame) -> DataFrame:
    """rows (qa_id, model, text, extracted) with a string of votes for empty, other_language and refusal; open: the text holds no answer."""
    m = _features(rows)
    c = F.col
    some = c("refuses0") | c("refuses1") | c("refuses2")
    strange = (c("letters") > 0) & (c("latin") < 0.7 * c("letters"))
    announced = c("announces") & (c("english") == 0)
    marked = ~c("plain") & c("t").rlike(r"[\u00C0-\u024F]")
    blank = (c("core") == "") | c("core").rlike(r"(?i)^(?:null|none|n a|na|nil|nan|undefined|empty|unknown|not available|no answer|no response|blank|tbd)$")
    substance = F.size(F.split("core", " ")) >= 3
    nothing = F.coalesce(F.size("extracted"), F.lit(0)) <= 0
    return m.select(
        "qa_id",
        "model",
        F.concat(
            _vote(c("core") == "", c("core") != ""),
            _vote(blank, c("answers") | substance),
            _vote(c("text").isNull() | ~c("t").rlike(r"[\p{L}\p{N}]"), substance),
            _vote(blank & nothing, c("answers")),
        ).alias("empty"),
        F.concat(
            _vote(strange, (c("latin") >= 0.9 * c("letters")) & (c("english") >= 1)),
            _vote(strange | ((c("foreign") >= 2) & (c("foreign") > 2 * c("english"))), (c("english") > 0) & (c("english") >= c("foreign"))),
            _vote(c("announces") | strange, c("english") >= 2),
            _vote(strange | announced | ((c("n") >= 4) & (c("english") == 0) & (marked | (c("foreign") > 0) | ~c("answers"))), c("n") < 2),
            _vote(strange | announced | ((c("n") >= 3) & (c("foreign") > c("english"))), (c("n") == 0) | (c("english") > 0.2 * c("n"))),
        ).alias("other_language"),
        F.concat(
            *(_vote(c(f"refuses{i}"), ~some) for i in range(len(REFUSES))),
            _vote(c("apology"), c("answers")),
            _vote(nothing & some, c("answers") | (c("n") > 45)),
            _vote((c("n") <= 40) & some, c("answers") | c("asks") | ~some),
        ).alias("refusal"),
        F.when(~c("answers") & (c("core") != ""), c("main")).alias("open"),
        "asks",
    )


def echo_votes(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows (open, asks, qa_id, ...) with votes for echo. A text with an answer in it is none, whatever its item; only the others meet their items."""
    c = F.col
    closed = rows.where("open is null").withColumn("echo", F.lit("0000"))
    m = rows.where("open is not null").join(truncation.item_texts(items).withColumnRenamed("qa", "qa_id"), "qa_id", "left").withColumn("plain", truncation.plain(c("open")))
    response = F.split(F.regexp_replace("plain", r"^(?:q|question|you asked|the question is|prompt) ", ""), " ")
    question = F.split("asked", " ")
    rest = F.size(F.array_except(response, F.split(F.concat_ws(" ", "said", F.lit("a b c d q question you asked options option")), " ")))
    m = m.withColumns({"left": rest, "own": F.size(F.array_distinct(response)), "shared": F.size(F.array_intersect(response, question)), "of": F.size(F.array_distinct(question))})
    known = c("asked").isNotNull() & (c("asked") != "")
    one = ~F.regexp_replace("open", r"(?s)[?.!\s\"'*]+$", "").rlike(r"[.!]\s+\p{Lu}")
    echo = F.concat(
        _vote(known & (c("left") == 0) & (c("own") >= 4), known & (c("left") > 0.34 * c("own"))),
        _vote(known & (c("shared") >= 0.7 * c("of")) & (c("left") <= 1) & (c("own") >= 4), known & (c("shared") < 0.4 * c("of"))),
        _vote(c("asks") & one & (c("own") >= 4), ~c("asks")),
        _vote(c("asks"), None),
    )
    return closed.unionByName(m.select(*rows.columns, echo.alias("echo")))


def truncation_votes(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """rows with votes for truncated, each from a signal of its own: structure, closing word, style of the other sentences, near-copies."""
    c = F.col
    evidence = judged.select("qa_id", "model", "structural", "copied", "word", "style", "repeats", F.lit(True).alias("ends_open"))
    m = rows.join(evidence, ["qa_id", "model"], "left")
    known = c("ends_open").isNotNull()
    open_end = known & ~c("structural") & ~c("repeats")
    votes = F.concat(
        _vote(c("structural"), ~known),
        _vote(open_end & (c("word") > 0), ~known | c("repeats") | (c("word") < -1)),
        _vote(open_end & (c("style") > 0), ~known | c("repeats")),
        _vote(open_end & c("copied"), ~known),
    )
    return m.select(*rows.columns, votes.alias("truncated"))


def fit(patterns: list[str], count: np.ndarray, rounds: int = 50, prior: float = 0.02, strength: float = 0.05) -> tuple[np.ndarray, float]:
    """Posterior of the defect for each pattern of votes, and the fitted share of the defect.

    Votes are independent given the class. Each function starts as mostly right (a vote for the defect is rare among sound answers) and
    is held near that by pseudo counts of `strength` of all messages, so that classes can't change places.
    """
    n = count.sum()
    votes = np.array([[("x10").index(v) for v in p] for p in patterns])
    start = np.array([[0.45, 0.02, 0.53], [0.295, 0.70, 0.005]])  # sound, defective: x, 1, 0
    table = np.repeat(start[:, None, :], votes.shape[1], axis=1)
    post = np.zeros(len(patterns))
    share = prior
    for _ in range(rounds):
        log = np.log(table[:, np.arange(votes.shape[1])[None, :], votes])  # class x pattern x function
        odds = log[1].sum(1) - log[0].sum(1) + np.log(share / (1 - share))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        share = float(np.clip((post * count).sum() / n, 1e-4, 0.4))
        for k, w in ((1, post * count), (0, (1 - post) * count)):
            pseudo = max(1.0, strength * w.sum())
            for j in range(votes.shape[1]):
                seen = np.bincount(votes[:, j], weights=w, minlength=3)
                table[k, j] = (seen + pseudo * start[k]) / (w.sum() + pseudo)
    return post, share


def expected_cutoff(post: np.ndarray, count: np.ndarray) -> float:
    """Posterior from which a label is kept where no message's state is known: the best F1 that the model itself expects, 0.5 without counts."""
    best, at = -1.0, 0.5
    whole = (post * count).sum()
    for c in np.unique(post[post > 0.3]):
        kept = post >= c
        f1 = 2 * (post * count)[kept].sum() / max(count[kept].sum() + whole, 1e-9)
        if f1 > best:
            best, at = f1, float(c)
    return min(at, 0.95)


def cutoff(post: np.ndarray, count: np.ndarray, bad: np.ndarray, good: np.ndarray, share: float) -> float:
    """Posterior from which a label is kept: the best F1 over messages of known state, the expected one where there are none.

    count, bad and good: all messages, known defects and known sound messages by pattern; the known ones are weighted so that defects have the fitted share.
    """
    if bad.sum() == 0 or good.sum() == 0:
        return expected_cutoff(post, count)
    hit, miss = share * bad / bad.sum(), (1 - share) * good / good.sum()
    best, at = -1.0, 0.5
    levels = np.unique(post[(post > 0.05) & (bad + good > 0)])
    for low, c in zip(np.append(0.0, levels[:-1]), levels):
        kept = post >= c
        f1 = 2 * hit[kept].sum() / (hit[kept].sum() + miss[kept].sum() + share)
        if f1 > best + 1e-9:
            best, at = f1, float(max((low + c) / 2, 0.05))
    return at


def messages(preds: DataFrame) -> DataFrame:
    """qa_id, model (trimmed, in lower case, nulls left out), text, extracted of every row."""
    rows = preds.select(key_text(preds["qa_id"]).alias("qa_id"), key_text(preds["model"]).alias("model"), F.col("raw_response").alias("text"), F.col("extracted_answer").alias("extracted"))
    return rows.where("qa_id is not null and model is not null")


def voted(preds: DataFrame, items: DataFrame, judged: DataFrame) -> DataFrame:
    """qa_id, model and a string of votes for every defect; one row a message (of copies that differ the greatest string)."""
    rows = text_votes(messages(preds))
    one = rows.groupBy("qa_id", "model").agg(F.max(F.struct("open", "asks", *DEFECTS[:3])).alias("m")).select("qa_id", "model", "m.*")
    return truncation_votes(echo_votes(one, items), judged).select("qa_id", "model", *DEFECTS)


def planted(preds: DataFrame, items: DataFrame, most: int = MOST_PLANTED) -> tuple[DataFrame, DataFrame]:
    """Log and kinds (qa_id, model, kind) of messages of known state: at most `most` sound ones of two sentences or more, each left as it is or given one defect.

    Sound: the extracted answer is the item's. truncated: the first part of the text, cut anywhere; echo: the item's question in several forms; the rest from seeds.
    """
    keyed = messages(preds).where("size(extracted) = 1")
    key = F.col("correct_answer") if "correct_answer" in items.columns else F.lit(None).cast("string")
    answers = items.select(key_text(items["qa_id"]).alias("qa_id"), key.alias("correct_answer"), "question").where("correct_answer is not null and question is not null").dropDuplicates(["qa_id"])
    # only sound messages of held-out identifiers: few enough before the join
    h = F.xxhash64("qa_id", "model")
    some = keyed.where((F.pmod(h, F.lit(5)) == 0) & F.col("text").rlike(r"(?s)[.!?]\s.*[.!?]\s"))
    sound = some.join(answers, "qa_id").where(F.col("extracted")[0] == F.col("correct_answer")).orderBy(h, "qa_id", "model").limit(most)
    sound = cut(sound.select("qa_id", "model", "text", "extracted", "question").dropDuplicates(["qa_id", "model"]))
    pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (F.pmod(h, F.lit(len(texts))) + 1).cast("int"))
    at = F.greatest(F.lit(8), (F.length("text") * (0.15 + F.pmod(h, F.lit(61)) / 100)).cast("int"))
    forms = [F.col("question"), F.upper("question"), F.concat(F.lit("Q: "), "question"), F.regexp_replace("question", r"[?.]\s*$", ""), F.regexp_replace("question", " ", "  "), F.concat("question", F.lit("\n"), "question")]
    echo = F.element_at(F.array(*forms), (F.pmod(h, F.lit(len(forms))) + 1).cast("int"))
    made = {"sound": F.col("text"), "empty": pick(EMPTY_SEEDS), "other_language": pick(OTHER_SEEDS), "refusal": pick(REFUSAL_SEEDS), "echo": echo, "truncated": F.substring("text", F.lit(1), at)}
    kinds = F.element_at(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in made.items())), (F.pmod(F.xxhash64(F.lit(1), "qa_id", "model"), F.lit(len(made))) + 1).cast("int")).alias("p")
    rows = sound.select("qa_id", F.col("model").alias("of"), "extracted", kinds).select("qa_id", F.concat("of", F.lit(" "), "p.kind").alias("model"), "p.kind", "p.text", F.when(F.col("p.kind") == "sound", F.col("extracted")).alias("extracted"))
    rows = cut(rows)
    log = rows.select("qa_id", "model", F.col("text").alias("raw_response"), F.col("extracted").alias("extracted_answer"))
    return log, rows.select("qa_id", "model", "kind")


def labelled(preds: DataFrame, items: DataFrame) -> DataFrame:
    """qa_id, model, defect, posterior: every label whose posterior reaches its defect's cutoff; a message can have several.

    Messages without an item are judged by their text alone. Sound messages give no row.
    """
    spark = preds.sparkSession
    stats = cut(truncation.closing_words(preds.where("raw_response is not null"), "raw_response"))
    votes = cut(voted(preds, items, truncation.judged(preds, items, stats)))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS))).alias("v")
    stacked = votes.select("qa_id", "model", each).select("qa_id", "model", "v.*")
    held = F.pmod(F.xxhash64("qa_id", "model"), F.lit(5)) == 0
    counts = stacked.groupBy("defect", "pattern").agg(F.count_if(~held).alias("n"), F.count(F.lit(1)).alias("all")).toPandas()
    log, kinds = planted(preds, items)
    known = kinds.join(voted(log, items, truncation.judged(log, items, stats, match=False)), ["qa_id", "model"]).select("kind", each).groupBy("kind", "v.defect", "v.pattern").agg(F.count(F.lit(1)).alias("n")).toPandas()
    rows = []
    for d in DEFECTS:
        own, every, seen = *(counts[counts["defect"] == d].set_index("pattern")[x] for x in ("n", "all")), known[known["defect"] == d]
        bad, good = seen[seen["kind"] == d].set_index("pattern")["n"], seen[seen["kind"] == "sound"].set_index("pattern")["n"]
        patterns = sorted({*own.index, *bad.index, *good.index})
        if not patterns:
            continue
        number = lambda x: np.array([float(x.get(p, 0)) for p in patterns])
        post, share = fit(patterns, np.maximum(number(own), 1e-3))
        at = cutoff(post, number(every), number(bad), number(good), share)
        rows += [(d, p, float(x), DEFECTS.index(d)) for p, x in zip(patterns, post) if x >= at]
    kept = spark.createDataFrame(rows, "defect string, pattern string, posterior double, rank int")
    # at most 3 ** (votes of a defect) rows
    return stacked.join(F.broadcast(kept), ["defect", "pattern"]).select("qa_id", "model", "defect", "posterior", "rank")


def found(preds: DataFrame, items: DataFrame) -> DataFrame:
    """qa_id, model, defect: the likeliest defect of each defective message, ties by the order of DEFECTS."""
    best = labelled(preds, items).groupBy("qa_id", "model").agg(F.max(F.struct(F.round("posterior", 6).alias("p"), (-F.col("rank")).alias("r"), "defect")).alias("b"))
    return best.select("qa_id", "model", "b.defect")
