"""Grouping of spelling variants, found over a reduced alphabet.

Letters are hashed to a few symbols. A word that differs from another by one inserted, deleted or replaced
letter has a reduced form that is equal or differs by one symbol. Each word generates the
whole one-edit neighbourhood of its reduced form, which is joined with the reduced forms of the
vocabulary, and what meets is verified on the words themselves. A neighbourhood is small because the alphabet
is, and the alphabet grows with the eighth root of the vocabulary, so that a reduced form keeps few words however
many there are. Of a neighbourhood only what does not sort below the form itself is sent: each pair meets once.

Everything is DataFrame work: occurrences are combined before their shuffle, a pair of words is a row,
and no list of words is gathered anywhere. Joins are by shuffle: Spark sizes an exploded neighbourhood like the
single row it came from, and a table of words by its compressed file, so it would broadcast tables of any number of rows
(0.5 GB of documents: over 500 MB of neighbourhoods on the driver). A form has at least ``ratio`` times its word's occurrences, so
the way to the root takes at most log(largest count) steps, which are doubled in each round.

Null and empty texts have no words; a null id counts as an empty one. An empty table gives an empty
result. Repeated rows count each. Of other columns nothing is read.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import keep

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
SLIP = 199


def occurrences(documents: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """(doc_id, run): maximal runs of letters, A-Z lower-cased, of at least ``least`` code points."""
    run = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    upper = LETTERS[:26].upper()
    return (documents.select("doc_id", F.explode(run).alias("run"))
            .select("doc_id", F.translate("run", upper, LETTERS[:26]).alias("run")))


def slipped(runs: DataFrame, every: int = SLIP) -> DataFrame:
    """(word): runs, of which those whose hash ``every`` divides have lost a letter."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select("run", h.alias("h")).select(
        F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least: int = LEAST_LETTERS, at_least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of enough letters that occur often enough."""
    return (words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= at_least))


def reduced(word: Column, symbols: int) -> Column:
    """A word over ``symbols`` symbols; what is no known letter becomes the first."""
    to = "".join(_symbol(zlib.crc32(c.encode()) % symbols) for c in LETTERS)
    other = F.regexp_replace(word, f"[^{LETTERS}]", LETTERS[0])
    return F.translate(other, LETTERS, to)


def _symbol(i: int) -> str:
    return chr(ord("0") + i)


def neighbourhood(form: Column, symbols: int) -> Column:
    """All strings over the symbols that differ from a form by one edit at most, the form among them."""
    alphabet = F.array(*(F.lit(_symbol(i)) for i in range(symbols)))
    n = F.length(form)
    left = lambda i: F.substring(form, F.lit(1), i)
    right = lambda i: F.substring(form, i + 1, n)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(left(i - 1), right(i)))
    other = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        alphabet, lambda s: F.concat(left(i - 1), s, right(i)))))
    more = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(
        alphabet, lambda s: F.concat(left(i), s, right(i)))))
    return F.array_distinct(F.concat(F.array(form), cut, other, more))


def near_pairs(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """(word, n, near, near_n): words that one edit turns into each other, each pair once."""
    own = vocabulary.select("word", "n", reduced(F.col("word"), symbols).alias("form"))
    sent = (own.select("word", "n", "form", F.explode(neighbourhood(F.col("form"), symbols)).alias("meets"))
            .where("meets >= form").select("word", "n", "meets", (F.col("meets") == F.col("form")).alias("same")))
    other = own.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("form").alias("meets"))
    return (sent.join(other.hint("merge"), "meets")
            .where((~F.col("same") | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1))
            .select("word", "n", "near", "near_n"))


def group(vocabulary: DataFrame, ratio: int = RATIO, symbols: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary of different words (word, n).

    A word's form is its near word of largest n (of equal ones the first in code-point order) if that n is
    at least ``ratio`` times its own; its root is where the forms lead.
    """
    if ratio < 2:
        raise ValueError("forms lead to a root only if each is at least twice as frequent")
    vocabulary = keep(vocabulary.select("word", "n"))
    size = vocabulary.agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    if symbols is None:
        symbols = max(2, math.ceil(size["words"] ** 0.125))
    pairs = near_pairs(vocabulary, symbols)
    both = pairs.select(F.explode(F.array(
        F.struct("word", F.col("near"), F.col("near_n")),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = keep(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    root = roots(formed.where("form is not null").select("word", "form"), size["low"], size["high"], ratio)
    return formed.join(root.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame, low: int | None, high: int | None, ratio: int) -> DataFrame:
    """(word, root) for words that have a form; each round doubles the steps taken."""
    steps = math.log((high or 1) / (low or 1), ratio) if low else 0
    reach = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(steps, 1)) + 1e-9)):
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reach = keep(reach.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return reach


def report(documents: DataFrame) -> DataFrame:
    """The grouping of all words of the documents, some of which have lost a letter."""
    return group(counted(slipped(occurrences(documents))))
