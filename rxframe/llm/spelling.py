"""Spelling variants: words at one edit from each other, grouped under the frequent form.

Near words are found by an index of variable-length grams (``variable_grams``).  The gram
dictionary is pruned by frequency: what it prolongs occurs more often than a bound that grows
with the vocabulary, so that at most ``max_frequent`` grams are known to driver and tasks.
Every word sends its grams to the index, and asks for two of them, of which one edit leaves
at least one: the merged lists of both hold all words near it.  An entry of a list is one
gram at one position of words of one length, so a frequent gram is spread over many tasks;
lists join the asking words by key, and only pairs that are verified leave the join (a
comparison of letter sets first, then the edit distance).

The shorter word of a pair asks.  As the longest gram depends on the length of the shorter
word, a word is in the index for its own length and for one less.

Nothing that grows with the vocabulary is broadcast: all joins are asked to merge.  Spark
would size both sides of the gram join by the compressed file of the vocabulary, as if a word
were not exploded to its grams, and the forms by their files, some times too low.

Defined results: null and empty texts have no words; a null id counts as the empty string.
Counts are over all rows, repeated rows included.  Ties of the frequency go to the smallest
word in code-point order.  An empty table gives an empty table.  Only the id and the text
are read: other columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.llm.text import ascii_lower
from rxframe.llm.variable_grams import BEGIN, END, GramDictionary, letters
from rxframe.session import materialize, ship_package

LETTERS = r"[a-zÀ-ÿ]+"


@dataclass(frozen=True)
class GramSettings:
    """Lengths of grams; a gram is prolonged when it occurs more than ``least_frequent`` times,
    or more often where ``max_frequent`` grams could not be kept."""
    shortest: int = 2
    longest: int = 7
    least_frequent: int = 50
    max_frequent: int = 200_000


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5) -> DataFrame:
    """(id, word) of every maximal run of letters, A-Z in lower case; shorter runs are left out."""
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("word")) \
        .where(F.length("word") >= least_chars)


def with_slips(runs: DataFrame, every: int = 97) -> DataFrame:
    """The words with slips that hashes choose: of one word in ``every`` a letter is left out."""
    word, size = F.col("word"), F.length("word")
    h = F.crc32(F.concat("id", F.lit(":"), word))
    at = (h % size).cast("int")
    slipped = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, size))
    return runs.select("id", F.when(h % every == 0, slipped).otherwise(word).alias("word"))


def vocabulary(words: DataFrame, least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of the distinct words that are long and frequent enough."""
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") >= least_n)


def gram_dictionary(vocab: DataFrame, settings: GramSettings = GramSettings()) -> GramDictionary:
    """The dictionary of the vocabulary's grams, each word counted once.

    Of all occurrences only ``max_frequent`` grams can have more than their share, so what
    is collected is bounded whatever the vocabulary's size."""
    sizes = range(settings.shortest, settings.longest)
    marked = F.concat(F.lit(BEGIN), F.col("word"), F.lit(END))
    room = sum(F.greatest(F.length(marked) - size + 1, F.lit(0)) for size in sizes) if sizes else F.lit(0)
    total = vocab.agg(F.coalesce(F.sum(room), F.lit(0)).alias("n")).first()["n"]
    bound = max(settings.least_frequent, -(-total // settings.max_frequent))
    if not total:
        return GramDictionary(settings.shortest, settings.longest, {})

    def of(size: int):
        starts = F.sequence(F.lit(1), F.greatest(F.length("s") - size + 1, F.lit(1)))
        return F.transform(starts, lambda p: F.substring(F.col("s"), p, F.lit(size)))

    grams = vocab.select(marked.alias("s")).select(F.explode(F.flatten(F.array(*map(of, sizes)))).alias("gram"))
    frequent = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).collect()
    return GramDictionary(settings.shortest, settings.longest, {r["gram"]: r["n"] for r in frequent})


def near_pairs(vocab: DataFrame, dictionary: GramDictionary) -> DataFrame:
    """(word, n, near, near_n) of all ordered pairs of words at edit distance one."""
    ship_package(vocab.sparkSession)
    entry = "word string, n bigint, letters bigint, size int, grams array<string>, sizes array<int>, places array<int>"

    def entries(of):
        def run(batches):
            for b in batches:
                words = b.column(0).to_pylist()
                lists = [[*zip(*of(w))] for w in words]
                grams, sizes, places = ([x[c] for x in lists] for c in range(3))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(map(letters, words), pa.int64()),
                     pa.array(map(len, words), pa.int32()), pa.array(grams, pa.list_(pa.string())),
                     pa.array(sizes, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))],
                    names=["word", "n", "letters", "size", "grams", "sizes", "places"])
        return run

    def listed(word):
        return [(g, size, p) for size in (len(word), len(word) - 1) for p, g in dictionary.grams(word, size)]

    def asked(word):
        return [(g, len(word), p) for p, g in dictionary.cheapest_pair(word)]

    def exploded(of):
        d = vocab.select("word", "n").mapInArrow(entries(of), entry)
        return d.select("word", "n", "letters", "size", F.explode(F.arrays_zip("grams", "sizes", "places")).alias("e"))

    # one gram, the length of the asking word, the position, the length of the listed word
    index = exploded(listed).select(
        F.xxhash64("e.grams", "e.sizes", "e.places", "size").alias("key"), F.col("word").alias("near"),
        F.col("n").alias("near_n"), F.col("letters").alias("near_letters"))
    shifts = [F.struct(F.lit(more).alias("more"), F.lit(by).alias("by")) for more, by in ((0, 0), (1, 0), (1, 1))]
    probes = exploded(asked).select("word", "n", "letters", "size", "e", F.explode(F.array(*shifts)).alias("x")).select(
        F.xxhash64("e.grams", "e.sizes", F.col("e.places") + F.col("x.by"), F.col("size") + F.col("x.more")).alias("key"),
        "word", "n", "letters")
    other = F.bit_count(F.col("letters").bitwiseXOR(F.col("near_letters"))) <= 2
    once = (F.length("word") < F.length("near")) | (F.col("word") < F.col("near"))
    on = (F.col("key") == F.col("asked")) & other & once & (F.levenshtein("word", "near", 1) == 1)
    pairs = probes.withColumnRenamed("key", "asked").join(index.hint("merge"), on).select("word", "n", "near", "near_n").distinct()
    both = F.array(F.struct("word", "n", "near", "near_n"),
                   F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
                            F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def forms(vocab: DataFrame, pairs: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, where that is ``ratio`` times the word's."""
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                     F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    d = vocab.join(best.hint("merge"), "word", "left")
    holds = -F.col("best.m") >= F.col("n") * ratio
    return d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.m")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed`` with ``root``: where the forms lead to, the word itself if it has none.

    A form is at least twice as frequent as its word, so there are no cycles, and pointers
    are doubled: after r rounds each word knows its 2^r-th form."""
    links = materialize(formed.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("via"), F.col("root").alias("further")).hint("merge")
        step = links.join(ahead, links["root"] == ahead["via"], "left")
        links = materialize(step.select("word", F.coalesce("further", "root").alias("root"),
                                        F.col("further").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    return formed.join(links.select("word", "root").hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(vocab: DataFrame, ratio: int = 2, settings: GramSettings = GramSettings()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary (word, n).

    Words need at least ``2 * shortest - 2`` characters."""
    vocab = materialize(vocab.select("word", "n"), "vocabulary")
    formed = materialize(forms(vocab, near_pairs(vocab, gram_dictionary(vocab, settings)), ratio), "formed")
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
