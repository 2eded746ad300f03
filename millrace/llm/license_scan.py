"""License scans: a positional rare-token index over licence texts.

Base: places where the words of a phrase of PHRASES stand consecutively.  Method: the inverse document frequency of the
words of the licences' key phrases is counted over the whole corpus; every licence text is looked up by the rarest word of its
key phrase, whose posting (text, position) turns every occurrence into a relative position of the text in the file; the text's
words are looked for at their own positions from there, up to `drift` words off (a word in DRIFT, so that words put in or left
out break nothing); a text is found where its key phrase stands in full and at least MATCH of its words do.  No such place is
missed, however common the words are, and every text has a look-up word of its own.

Plan.  DataFrame functions only.  One pass counts the document frequencies of the key words (a vocabulary of fixed size), a
second judges each row by itself: no shuffle of text, no join, so hot sources and long files need no care.

Defined results.  Null and empty texts have no words, no places, no labels and score 0.0.  score is 1.0 where a base phrase
stands, else the best share of a found text's words that stand at their places.
"""

from __future__ import annotations

import json
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.license_texts import TEXTS

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
MATCH = 0.75
#: Words of a text that allow its words to stand one place further off.
DRIFT = 16


def split_words(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


#: Label, words and words of the key phrase of each text.
TEMPLATES = tuple((label, split_words(text), split_words(key)) for label, text, key in TEXTS)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def lowered(text: Column) -> Column:
    """A-Z in lower case; the cheaper function where the text is all ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, cut at what stands between them: a class without negation is 20 times as fast."""
    return F.array_remove(F.split(lowered(text), GAP), "")


def stands(words: Column, at: Column, phrase: list[str], begin: int = 0) -> Column:
    """Whether the words of a phrase stand at place `at` + begin and on."""
    out = F.lit(True)
    for j, w in enumerate(phrase):
        out = out & F.coalesce(F.get(words, at + (begin + j)) == w, F.lit(False))
    return out


def places(words: Column, phrase: str) -> Column:
    """Places of the first word of each occurrence of a phrase."""
    parts = phrase.split()
    everywhere = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.when(F.array_contains(words, parts[-1]), F.filter(everywhere, lambda i: stands(words, i, parts))).otherwise(F.array().cast("array<int>"))


def key_place(words: list[str], key: list[str]) -> int:
    """Position of a key phrase's first word among the words of its text."""
    return next(j for j in range(len(words)) if words[j : j + len(key)] == key)


def document_frequencies(worded: DataFrame) -> dict[str, int]:
    """Documents with each key word that stands in any."""
    vocabulary = sorted({w for _, _, key in TEMPLATES for w in key})
    present = worded.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col("words"))).alias("word"))
    return {r.word: r.n for r in present.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary


def anchors(frequency: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """(text, position) of the rarest word of each text's key phrase, by word.

    The key phrase of a found text stands in full, so none is found without this word at its position.
    """
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, key) in enumerate(TEMPLATES):
        word = min(key, key=lambda w: (frequency.get(w, 0), w))
        out.setdefault(word, []).append((t, key_place(words, key) + key.index(word)))
    return out


def found_templates(words: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """array<struct<label, score>> of the texts that align with the words at one of the postings."""
    kind = "array<struct<label:string,score:double>>"
    listed = json.dumps([{"label": label, "words": w, "key": key, "at": key_place(w, key), "drift": -(-len(w) // DRIFT)} for label, w, key in TEMPLATES])
    templates = F.from_json(F.lit(listed), "array<struct<label:string,words:array<string>,key:array<string>,at:int,drift:int>>")
    post = F.from_json(F.lit(json.dumps({w: [{"t": t, "at": j} for t, j in places] for w, places in postings.items()})), "map<string,array<struct<t:int,at:int>>>")
    known = F.array(*map(F.lit, postings))

    def near(begin: Column, j: Column, t: Column) -> Column:
        """Whether word j of the text stands at its position, or up to drift words off."""
        low = F.greatest(begin + j - t["drift"], F.lit(0))
        return F.array_contains(F.slice(words, low + 1, F.greatest(begin + j + t["drift"] + 1 - low, F.lit(0))), F.get(t["words"], j))

    def aligned(c: Column, t: Column) -> Column:
        size = F.size(t["words"])
        hits = F.size(F.filter(F.sequence(F.lit(0), size - 1), lambda j: near(c["begin"], j, t)))
        at = c["begin"] + t["at"]
        full = (at >= 0) & (F.slice(words, F.greatest(at, F.lit(0)) + 1, F.size(t["key"])) == t["key"])
        return F.when(full, F.struct(t["label"].alias("label"), (hits / size).alias("score")))

    spots = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_contains(known, s["w"]))
    begins = F.flatten(F.transform(spots, lambda s: F.transform(F.element_at(post, s["w"]), lambda p: F.struct(p["t"].alias("t"), (s["i"] - p["at"]).alias("begin")))))
    looked_up = F.filter(F.transform(begins, lambda c: let(F.get(templates, c["t"]), lambda t: aligned(c, t))), lambda a: a.isNotNull() & (a["score"] >= MATCH))
    return F.when(F.arrays_overlap(words, known), looked_up).otherwise(F.array()).cast(kind)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    postings = anchors(document_frequencies(worded))
    base = [places(F.col("words"), phrase).alias(f"p{i}") for i, (phrase, _) in enumerate(PHRASES)]
    out = worded.select("doc_id", F.size("words").cast("long").alias("n_words"), *base, found_templates(F.col("words"), postings).alias("found"))
    every = F.concat(*(F.col(f"p{i}") for i in range(len(PHRASES))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES))))
    labels = F.array_union(base_labels, F.transform("found", lambda f: f["label"]))
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.round(best, 6)).alias("score"),
    )
