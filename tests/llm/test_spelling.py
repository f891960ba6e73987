import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edge_rows import EDGE
from rxframe.llm import queries, spelling
from rxframe.llm.variable_grams import BEGIN, END, GramDictionary, letters


def near_by_hand(words):
    """Near words by patterns with one character left open or out."""
    groups = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            groups["open", i, w[:i], w[i + 1:]].add(w)
            groups["out", w[:i] + w[i + 1:]].add(w)
        groups["out", w].add(w)
    near = {w: set() for w in words}
    for k, g in groups.items():
        if k[0] == "open":
            for w in g:
                near[w] |= g - {w}
        elif k[1] in g:
            near[k[1]] |= g - {k[1]}
            for w in g - {k[1]}:
                near[w].add(k[1])
    return near


def table_by_hand(n, ratio=2):
    near, out, form = near_by_hand(n), {}, {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return sorted(out.values())


def words_by_hand(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def dictionary(words, shortest, longest, least):
    count = Counter(s[p:p + k] for s in (BEGIN + w + END for w in words)
                    for k in range(shortest, longest) for p in range(len(s) - k + 1))
    return GramDictionary(shortest, longest, {g: n for g, n in count.items() if n > least})


vocabularies = st.lists(st.text(st.sampled_from("abé"), min_size=5, max_size=12), max_size=60, unique=True)


@given(vocabularies, st.integers(2, 3), st.integers(0, 5), st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_two_lists_hold_all_near_words(words, shortest, more, least):
    d = dictionary(words, shortest, shortest + more, least)
    lists = defaultdict(set)
    for w in words:
        for size in (len(w), len(w) - 1):
            for p, g in d.grams(w, size):
                lists[g, size, p, len(w)].add(w)
    for w, near in near_by_hand(words).items():
        pair = d.cheapest_pair(w)
        found = set().union(*(lists[g, len(w), p + by, len(w) + longer] for p, g in pair for longer, by in ((0, 0), (1, 0), (1, 1))))
        want = {x for x in near if len(x) >= len(w)}
        assert want <= found
        assert all(bin(letters(w) ^ letters(x)).count("1") <= 2 for x in want)


@given(st.text(st.sampled_from("ab"), min_size=5, max_size=14), vocabularies, st.integers(0, 20), st.sampled_from("abz"))
@settings(max_examples=300, deadline=None)
def test_ranges_of_edits(word, words, at, c):
    """A gram whose range an edit is outside of is found in the edited word again."""
    d = dictionary([*words, word, word + "a"], 2, 6, 1)
    i = at % len(word)
    edits = [(2 * (i + 1), word[:i] + word[i + 1:], -1), (2 * (i + 1), word[:i] + c + word[i + 1:], 0),
             (2 * (i + 1) - 1, word[:i] + c + word[i:], 1)]
    s, size = BEGIN + word + END, len(word)
    for number, edited, shift in edits:
        grams = set(d.grams(edited, size))
        for p, g in d.grams(word, size):
            first, last = d.affected_by(s, p, g, d.limit(size))
            if number < first:
                assert (p + shift, g) in grams
            elif number > last:
                assert (p, g) in grams


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


SMALL = spelling.GramSettings(least_frequent=2)


@pytest.mark.parametrize("how", [spelling.GramSettings(), SMALL, spelling.GramSettings(3, 5, 1, 40), spelling.GramSettings(2, 2)])
def test_variants_of_a_vocabulary(spark, how):
    import random
    r = random.Random(5)
    base = ["".join(r.choice("aeioursté") for _ in range(r.randint(5, 11))) for _ in range(60)]
    n = {}
    for w in base:
        for _ in range(12):
            v = w
            for _ in range(r.randint(0, 2)):
                i = r.randrange(len(v))
                v = r.choice((v[:i] + v[i + 1:], v[:i] + r.choice("aest") + v[i:], v[:i] + r.choice("aest") + v[i + 1:]))
            if len(v) >= 5:
                n[v] = r.choice((3, 3, 4, 6, 12, 12, 25, 50, 100, 200))
    n |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48, "x" * 3000: 5, "x" * 3001: 10,
          "ÿ" * 5: 3, "ÿ" * 6: 3}
    vocab = spark.createDataFrame([*n.items()], "word string, n bigint")
    assert rows_of(spelling.group_variants(vocab, settings=how)) == table_by_hand(n)


def test_nothing_of_the_vocabulary_is_broadcast(spark, monkeypatch):
    """Spark sizes what is read back, and what is exploded from it, by the small compressed files."""
    plans, written = [], spelling.materialize

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(spelling, "materialize", lambda df, name: written(planned(df), name))
    n = {"wordy" + c * k: 3 * 2 ** k for c in "abc" for k in range(6)}
    vocab = spark.createDataFrame([*n.items()], "word string, n bigint")
    assert rows_of(planned(spelling.group_variants(vocab))) == table_by_hand(n)
    assert sum("Join" in p for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)


def test_dictionary_is_bounded(spark):
    vocab = spark.createDataFrame([(f"{a}{b}word{c}", 3) for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"], "word string, n bigint")
    d = spelling.gram_dictionary(vocab, spelling.GramSettings(2, 6, 0, 30))
    assert 0 < len(d.frequent) <= 30
    assert all(g[:-1] in d.frequent for g in d.frequent if len(g) > 2)


def query(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    return rows_of(queries.op13_spelling(spark, ""))


def test_query(spark, sf_docs, make_docs, monkeypatch):
    more = [(60, "Straße STRAßE straße stràsse ×÷×÷× İzmir " * 3), (61, "letter " * 20_000),
            (62, "lettr " * 400), (63, "École école " * 5), (64, "z" * 20_000)]
    for docs in (sf_docs, make_docs([*EDGE, *more]).withColumn("word", F.lit(1))):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = table_by_hand(words_by_hand(rows))
        assert want and query(spark, docs, monkeypatch) == want
    assert query(spark, make_docs([]), monkeypatch) == []
