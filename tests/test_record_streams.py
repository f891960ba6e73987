"""Resumable record stream and consult over a changing master."""

import os

import pytest
from pyspark.sql import functions as F

from rxframe.operators.context import MasterColumns
from rxframe.plans.consult import VersionedConsult
from rxframe.session import ScratchGroup, materialize, scratch_root
from rxframe.sources import versions as vs
from rxframe.streaming import streams as st

PAGES = "name string, url string, html string"


def page(name, text, url="u"):
    return name, url, (f'<div id="D-div"><label class="form-label">K</label><div class="form-line">{name}</div></div>'
                       f'<div id="A-div"><p>{text}</p></div>')


def land(spark, path, *files):
    for n, rows in enumerate(files):
        spark.createDataFrame([*rows], PAGES).coalesce(1).write.mode("append").parquet(f"{path}/part{n}")


def run(spark, tmp, folder, checkpoint, **kw):
    st.record_stream(spark, f"{tmp}/{folder}", PAGES, f"{tmp}/out", f"{tmp}/{checkpoint}", name_col="name", url_col="url", **kw)
    v = vs.current(spark, f"{tmp}/out")
    rows = sorted((r["search_key"], r["url"], r["leaflet"]) for r in v.read(spark, st.RECORDS).collect()) if v else []
    return v.number if v else 0, rows


def test_records_resume_by_name(spark, tmp_path, monkeypatch):
    tmp = str(tmp_path)
    long = "text of more than ten characters"
    a, b, c = page("a", long + " a"), page("b", "short"), page("c", long + " c")
    a2 = page("a", long + " second", "u2")
    land(spark, f"{tmp}/one", [a, a2], [b, (None, "u", "<p>no name</p>")])
    want = [("a", "u", long + " a"), ("a", "u2", long + " second"), ("b", "u", None)]
    assert run(spark, tmp, "one", "ck1") == (2, want)
    # the same pages under other names, by a new checkpoint; nothing twice
    land(spark, f"{tmp}/two", [b], [a2, a])
    assert run(spark, tmp, "two", "ck2") == (2, want)
    # a batch that fails before its version is published is done by the next start
    land(spark, f"{tmp}/three", [c, a], [page("d", long)])
    publish = vs._publish
    monkeypatch.setattr(vs, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception):
        run(spark, tmp, "three", "ck3")
    assert vs.current(spark, f"{tmp}/out").number == 2
    monkeypatch.setattr(vs, "_publish", publish)
    more = sorted([*want, ("c", "u", long + " c"), ("d", "u", long)])
    assert run(spark, tmp, "three", "ck3") == (4, more)
    # replayed from the start: the checkpoint is gone, the done names are not
    assert run(spark, tmp, "three", "ck4") == (4, more)
    done = [r["name"] for r in vs.current(spark, f"{tmp}/out").read(spark, st.DONE).collect()]
    assert sorted(done) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("bound", [0, st.BROADCAST_BYTES])
def test_batch_against_done_names(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(st, "BROADCAST_BYTES", bound)
    base, how = str(tmp_path / "out"), dict(name_col="name", url_col="url")
    first = spark.createDataFrame([page(n, "some text that is long") for n in "abc"], PAGES)
    assert st.record_batch(first, base, **how) == 1
    assert st.record_batch(first, base, **how) is None
    assert st.record_batch(first.limit(0), base, **how) is None
    more = spark.createDataFrame([page(n, "some text that is long") for n in "bcdd"], PAGES)
    assert st.record_batch(more, base, **how) == 2
    assert sorted(r["search_key"] for r in vs.current(spark, base).read(spark, st.RECORDS).collect()) == list("abcdd")


COLS = MasterColumns(trade="trade", sci="sci", form="form", strength="strength", price="price", route="route",
                     route_ar="route_ar", leaflet="leaflet", intl_dosage="dosage")


def master(spark, price, n):
    return spark.createDataFrame([(k, f"trade {k}", f"sci {k}", "f", "s", price, "r", None, None, "") for k in range(n)],
                                 "ord long, trade string, sci string, form string, strength string, price double, route string, "
                                 "route_ar string, leaflet string, dosage string")


def test_consult_across_a_switch_of_the_master(spark, tmp_path):
    tmp, seen = str(tmp_path), []
    vs.write_new_version(master(spark, 1.5, 3), f"{tmp}/master")
    for n in range(30):
        spark.createDataFrame([(n,)], "req_id long").coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    consult = VersionedConsult(spark, f"{tmp}/master", COLS)
    # folders counted below the scratch root: what batches and old bases leave behind
    root = scratch_root(spark).removeprefix("file:")
    before = len(os.listdir(root)) if os.path.isdir(root) else 0

    def per_batch(batch, table, base):
        if len(seen) == 14:
            vs.write_new_version(master(spark, 2.5, 5), f"{tmp}/master")
        lines = base.lines.agg(F.count(F.lit(1)).alias("lines"))
        own = materialize(batch, "own")
        seen.append((consult.version, len(os.listdir(root)) - before))
        return own.crossJoin(lines).crossJoin(table.agg(F.max("price").alias("price")))

    st.versioned_consult_stream(spark, f"{tmp}/in", "req_id long", f"{tmp}/out", f"{tmp}/ck", consult, per_batch)
    rows = spark.read.parquet(f"{tmp}/out").orderBy("batch").collect()
    assert [(r["lines"], r["price"]) for r in rows] == [(3, 1.5)] * 15 + [(5, 2.5)] * 15
    assert [v for v, _ in seen] == [1] * 15 + [2] * 15
    assert len({n for _, n in seen}) == 1            # a batch's own table and one base, never more
    assert len(os.listdir(root)) == before and consult.version is None
    with pytest.raises(ValueError):
        VersionedConsult(spark, f"{tmp}/none", COLS).use()


def test_scratch_group(spark):
    with ScratchGroup(spark) as outer:
        a = materialize(spark.range(2), "a")
        with ScratchGroup(spark) as inner:
            b = materialize(spark.range(3), "b")
    assert (len(outer.paths), len(inner.paths)) == (1, 1)
    outer.release()
    assert b.count() == 3
    inner.release()
    with pytest.raises(RuntimeError), ScratchGroup(spark) as failed:
        materialize(spark.range(2), "c")
        raise RuntimeError
    assert failed.paths == [] and a is not None
