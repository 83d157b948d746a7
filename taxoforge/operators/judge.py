"""Judging edges and embedding labels by models that plug in; a deterministic stand-in works offline."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoforge.functions.decisions import answer_part, answer_word
from taxoforge.functions.vectors import mean_pool

# The question put to a judge, and how it is introduced.
TEMPLATE = (
    "Your task is to determine whether a given hierarchical relationship holds between two concepts. "
    "We define 'class A is a subclass of class B' if every instance of A is also an instance of B. "
    "Here are the descriptions of two concepts: {child_label} ({child_desc}); {parent_label} ({parent_desc}). \n"
    "Question: Is '{child_label}' a subclass of '{parent_label}'?\n"
    "Please format your answer directly as follows: **Answer: True/False**."
)
# Fixed value: the question whether an entity is of a type, with its examples.
TYPE_TEMPLATE = """Your task is to provide "True" or "False" for the type statement based on the context, True if the entity type statement is correct, otherwise False. The entity (marked with *) is given within a sentence, followed by a statement that specifies its type (marked within []). 
Some examples are provided as follows:
'''
context: *Paris* is described as "capital of France". [city or town] is described as "large human settlement".
type statement: *Paris* is a [city or town].
Answer: True.

context: *Paris* is described as "capital of France". [mathematical object] is described as "abstract object in mathematics".
type statement: *Paris* is a [mathematical object].
Answer: False.

context: *Motokazu Mori* is described as "Japanese surgeon and tanka poet". [corporate body] is described as "entity that may be assigned authorship, including persons, organizations, events, and physical objects".
type statement: *Motokazu Mori* is a [corporate body].
Answer: True.
''' 

Now it's your turn to judge. Here are the "context" and "type statement":
context: *{child_label}* is/are described as "{child_desc}". [{parent_label}] is/are described as "{parent_desc}".
type statement: *{child_label}* is a/an [{parent_label}].

Please provide your answer directly as True or False for the type statement.
Answer:::"""
SYSTEM = "You are an ontological expert in hierarchical concept analysis."
FAMILIES = {"plain": (False, False), "system": (True, False), "parts": (True, True)}

@dataclass(frozen=True)
class Generation:
    """How a judge is to generate; a judge that cannot must say so by a ValueError."""

    temperature: float = 0.01
    max_tokens: int = 50
    repetition_penalty: float = 1.1
    batch: int = 16


#: A judge answers a batch of conversations, each a list of messages (role, content), with (text, confidence) each. Where a
#: model gives token probabilities, ``decisions.token_confidence`` or its like makes the confidence of them.
Judge = Callable[[list[list[dict]]], list[tuple[str, float]]]
_judges: dict[str, Callable[[Generation], Judge]] = {}


def register_judge(name: str, make: Callable[[Generation], Judge]) -> None:
    """Make a judge known by name; ``make`` is called once per Python worker and task, to load a model there."""
    _judges[name] = make


def known_judges() -> list[str]:
    return sorted(_judges)


def stub_judge(generation: Generation = Generation()) -> Judge:
    """Answers by the hash of the last message: the same on every machine and run."""

    def answer(conversations: list[list[dict]]) -> list[tuple[str, float]]:
        out = []
        for m in conversations:
            p = m[-1]["content"]
            h = hashlib.md5(p.encode()).digest()
            out.append((f"**Answer: {'True' if h[0] % 2 else 'False'}**", round(h[1] / 255, 5)))
        return out

    return answer


register_judge("stub", stub_judge)


def prompt(child_label: Column, child_desc: Column, parent_label: Column, parent_desc: Column, template: str = TEMPLATE) -> Column:
    """The template filled in, piece by piece, so that braces in labels stay as they are."""
    pieces: list[Column] = []
    fields = {"{child_label}": child_label, "{child_desc}": child_desc, "{parent_label}": parent_label, "{parent_desc}": parent_desc}
    rest = template
    while rest:
        at = min(((rest.find(k), k) for k in fields if k in rest), default=(-1, ""))
        if at[0] < 0:
            pieces.append(F.lit(rest))
            break
        pieces += [F.lit(rest[: at[0]]), F.coalesce(fields[at[1]], F.lit(""))]
        rest = rest[at[0] + len(at[1]) :]
    return F.concat(*pieces)


def messages(text: Column, family: str = "plain") -> Column:
    """Chat messages, array of (role, content), as a family of models wants them."""
    system, parts = FAMILIES[family]

    def content(x: Column) -> Column:
        return F.to_json(F.array(F.struct(F.lit("text").alias("type"), x.alias("text")))) if parts else x

    own = [F.struct(F.lit("user").alias("role"), content(text).alias("content"))]
    return F.array(*([F.struct(F.lit("system").alias("role"), content(F.lit(SYSTEM)).alias("content"))] if system else []), *own)


def judge_edges(edges: DataFrame, judge: str | Callable[[Generation], Judge] = "stub", model: str = "stub", family: str = "plain", generation: Generation = Generation(), template: str = TEMPLATE) -> DataFrame:
    """model, child, parent, plabel, clabel, original_answer(_inverse), answer(_inverse), confidence(_inverse).

    edges: child, parent, clabel, cdesc, plabel, pdesc. Each edge is asked forth and back, as the family's chat messages,
    in batches, one model per task; invalid answers are None with confidence 0.
    """
    make = _judges[judge] if isinstance(judge, str) else judge
    fw = prompt(F.col("clabel"), F.col("cdesc"), F.col("plabel"), F.col("pdesc"), template)
    bw = prompt(F.col("plabel"), F.col("pdesc"), F.col("clabel"), F.col("cdesc"), template)
    asked = edges.select("child", "parent", "plabel", "clabel", messages(fw, family).alias("fw"), messages(bw, family).alias("bw"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make(generation)
        for pdf in batches:
            out = {}
            for c in ("fw", "bw"):
                talks = [[{"role": m["role"], "content": m["content"]} for m in t] for t in pdf[c]]
                out[c] = [a for lo in range(0, len(talks), generation.batch) for a in ask(talks[lo : lo + generation.batch])]
            got = pdf[["child", "parent", "plabel", "clabel"]].copy()
            for c, name in (("fw", ""), ("bw", "_inverse")):
                got["original_answer" + name] = [a for a, _ in out[c]]
                got["raw" + name] = [float(x) for _, x in out[c]]
            yield got

    said = asked.mapInPandas(run, "child string, parent string, plabel string, clabel string, original_answer string, raw double, original_answer_inverse string, raw_inverse double")
    for name in ("", "_inverse"):
        word = answer_word(answer_part(F.col("original_answer" + name)))
        said = said.withColumn("answer" + name, word).withColumn("confidence" + name, F.when(F.col("answer" + name) == "None", F.lit(0.0)).otherwise(F.round("raw" + name, 5)))
    return said.select(F.lit(model).alias("model"), "child", "parent", "plabel", "clabel", "original_answer", "original_answer_inverse", "answer", "answer_inverse", "confidence", "confidence_inverse")


def hashed_token_vector(token: str, dim: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "little")
    return np.random.default_rng(seed).normal(size=dim)


def embed_labels(labels: DataFrame, dim: int = 64, max_tokens: int = 512) -> DataFrame:
    """node, vec: mean of the labels' token vectors, normalised; the stand-in embedder, deterministic. A model's token
    vectors take the place of ``token_vectors`` in the same plan."""

    def token_vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = pdf["label"].map(lambda t: ((t or "").lower().split() or [""])[:max_tokens])
            yield pd.DataFrame({"node": pdf["node"], "vectors": words.map(lambda ws: [hashed_token_vector(x, dim).tolist() for x in ws])})

    got = labels.select("node", "label").mapInPandas(token_vectors, "node string, vectors array<array<double>>")
    return got.select("node", mean_pool(F.col("vectors")).alias("vec"))
