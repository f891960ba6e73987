import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_rows import EDGE
from rxframe.llm import fill_middle as fm

HOW = fm.FillMiddle()


def by_hand(doc_id, text, seed=7, rate=100, spm_rate=50):
    """The transformation by a plain list of units."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


PIECES = ["a", "\n", "<P", ">", "<", "P>", "<S>", "é", "\U0001F600", "\r", " ", "word ", "\n\n", "M>"]


@given(st.integers(0, 10**6), st.lists(st.sampled_from(PIECES), max_size=20).map("".join))
@settings(max_examples=500, deadline=None)
def test_round_trip_and_plain_version(doc_id, text):
    got = HOW.transform(doc_id, text)
    assert got == by_hand(doc_id, text)
    assert HOW.restore(got[4], got[1]) == text


def test_all_forms_and_rates():
    forms = {HOW.transform(i, "a\nb\nc\n")[1] for i in range(200)}
    assert forms == {"psm", "spm"}
    assert {fm.FillMiddle(rate=0).transform(i, "a\nb\n")[1] for i in range(50)} == {"plain"}
    half = fm.FillMiddle(rate=50, spm_rate=100)
    assert {half.transform(i, "a\nb\n")[1] for i in range(200)} == {"plain", "spm"}
    words = fm.FillMiddle(unit=r"\S+\s*|\s+", seed=1, prefix_mark="[pre]", suffix_mark="[suf]", middle_mark="[mid]")
    for i in range(50):
        n, form, _, _, out = words.transform(i, " one two  three four")
        assert n == 5 and words.restore(out, form) == " one two  three four"


def test_marks_that_overlap_are_refused():
    for marks in (("aa", "b", "c"), ("ab", "bc", "d"), ("<P>", "<P>", "<M>"), ("", "b", "c"), ("x<P>y", "<P>", "z")):
        with pytest.raises(ValueError):
            fm.FillMiddle(prefix_mark=marks[0], suffix_mark=marks[1], middle_mark=marks[2])


def test_more_units_than_one_match_keeps(monkeypatch):
    monkeypatch.setattr(fm, "RUN", 3)
    for text in ("", "a\n" * 3, "a\n" * 6, "a\n" * 7 + "end", "\n" * 100):
        assert fm.unit_ends(fm.LINES, text) == [m.end() for m in re.finditer(fm.LINES, text)]
    monkeypatch.undo()
    assert len(fm.unit_ends(fm.LINES, "\n" * 2_500_000)) == 2_500_000


def test_units_must_cover_the_text():
    with pytest.raises(ValueError):
        fm.unit_ends("a", "aab")


def test_table(make_docs, sf_docs, spark):
    long = [(40, "line of text\n" * 30_000), (41, "x" * 300_000), (42, "has <M> inside\nyes"), (43, "\r\n\r\n")]
    for docs in (sf_docs, make_docs([*EDGE, *long])):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = sorted(((i, *by_hand(i, t), t or "") for i, t in rows), key=str)
        got = fm.restore(fm.fill_middle(docs))
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        digests = sorted(((i, n, f, p, m, *(hashlib.sha256(x.encode()).hexdigest() for x in (o, t)))
                          for i, n, f, p, m, o, t in want), key=str)
        assert sorted((tuple(r) for r in fm.digest_table(docs).collect()), key=str) == digests
    assert fm.digest_table(make_docs([])).count() == 0


def test_other_columns_do_not_clash(make_docs):
    docs = make_docs([(1, "a\nb"), (2, None)])
    for c in ("n", "form", "output", "restored", "prefix_chars", "middle_chars", "output_sha256"):
        docs = docs.withColumn(c, docs["source"])
    assert fm.digest_table(docs).count() == 2
    renamed = docs.withColumnRenamed("text", "output_text").withColumnRenamed("doc_id", "key")
    assert fm.fill_middle(renamed, id_col="key", text_col="output_text").columns[0] == "key"
