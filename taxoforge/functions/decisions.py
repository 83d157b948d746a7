"""Reading judges' answers and turning them into verdicts on edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBSUME, EQUIVALENT, REVERSE, IRRELEVANT = "[SUBSUME]", "[EQUIVALENT]", "[REVERSE]", "[IRRELEVANT]"
THRESHOLD = 0.5


def answer_part(text: Column) -> Column:
    """From the last "Answer" on; else from **False**, else from **True**, else null."""
    at = F.length(text) - F.locate("rewsnA", F.reverse(text)) - 5
    marked = F.when(text.contains("**False**"), F.substring(text, F.locate("**False**", text), F.length(text)))
    marked = F.coalesce(marked, F.when(text.contains("**True**"), F.substring(text, F.locate("**True**", text), F.length(text))))
    return F.when(text.contains("Answer"), F.substring(text, at + 1, F.length(text))).otherwise(marked)


def answer_word(part: Column) -> Column:
    """The first true or false, else the first yes or no, as True or False; None where there is neither."""
    truth = F.lower(F.regexp_extract(part, r"(?i)\b(true|false)\b", 1))
    assent = F.lower(F.regexp_extract(part, r"(?i)\b(yes|no)\b", 1))
    found = F.when(truth != "", truth).when(assent == "yes", "true").when(assent == "no", "false")
    return F.coalesce(F.initcap(found), F.lit("None"))


def conclusion(plabel: Column, clabel: Column, answer: Column, inverse: Column, confidence: Column, confidence_inverse: Column, t: float = THRESHOLD) -> tuple[Column, Column]:
    """Verdict and confidence of one model on one edge; null answers count as none, null confidences as 0."""
    low = F.least(F.coalesce(confidence, F.lit(0.0)), F.coalesce(confidence_inverse, F.lit(0.0)))
    same = F.coalesce(F.lower(plabel) == F.lower(clabel), F.lit(False))
    a, b = (F.initcap(F.coalesce(x, F.lit("None"))) for x in (answer, inverse))
    sure = low >= t
    verdict = (
        F.when(same, EQUIVALENT)
        .when((a == "True") & (b == "False"), SUBSUME)
        .when((a == "True") & (b == "True") & sure, EQUIVALENT)
        .when((a == "False") & (b == "True") & sure, REVERSE)
        .when((a == "False") & (b == "False") & sure, IRRELEVANT)
        .otherwise(SUBSUME)
    )
    return verdict, F.when(same, F.lit(1.0)).otherwise(low)


def token_confidence(answer_tokens: Column, tokens: Column, probabilities: Column, word: Column) -> Column:
    """Probability of the token that says the answer: of ``answer_tokens``, the tokens of the answer's part, the first that
    is the word or holds true, false, yes or no, at its first place in all generated ``tokens``; 0 without any."""
    # The word is found once, not for each token that it is compared with.
    said = F.get(F.transform(F.array(F.trim(word)), lambda w: F.filter(answer_tokens, lambda x: (F.trim(x) == w) | F.lower(x).rlike("true|false|yes|no"))), F.lit(0))
    at = F.array_position(tokens, F.get(said, F.lit(0)))
    return F.coalesce(F.when(at > 0, F.get(probabilities, (at - 1).cast("int"))), F.lit(0.0)).cast("double")
