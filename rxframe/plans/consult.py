"""C4: bulk consult, requests -> entities -> retrieval -> context -> prompts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rxframe.operators.context import (MasterColumns, consult_context, context_keys, context_lines, line_table,
                                       prompt_columns, prompt_table, used_lines, with_context)
from rxframe.operators.link import extract_entities, search_terms
from rxframe.operators.retrieve import RetrievalIndex, build_index, retrieve_topk
from rxframe.session import ScratchGroup, materialize
from rxframe.sources.versions import current


@dataclass(frozen=True)
class ConsultBase:
    """What every consult over one master version shares: the retrieval index and the
    context line of every row, both stored."""
    index: RetrievalIndex
    lines: DataFrame


def prepare_consult(master: DataFrame, cols: MasterColumns, *, ord_col: str = "ord") -> ConsultBase:
    """Index and lines, built once per master version and passed to every batch."""
    return ConsultBase(build_index(master, ord_col, cols.trade, cols.sci),
                       materialize(line_table(master, cols, ord_col), "lines"))


class VersionedConsult:
    """The consult base of the newest master version (R1 over a changing master).

    ``use`` gives the master and its base to one batch.  The base is built when a version is
    first seen; the one before, and its master version if nobody else needs it, is no longer
    read by then, since batches run one after another, and its tables are deleted.
    """

    def __init__(self, spark: SparkSession, base: str, cols: MasterColumns, *, ord_col: str = "ord"):
        self.spark, self.base, self.cols, self.ord_col = spark, base, cols, ord_col
        self.version: int | None = None
        self._held: tuple[DataFrame, ConsultBase, ScratchGroup] | None = None

    def use(self) -> tuple[DataFrame, ConsultBase]:
        v = current(self.spark, self.base)
        if v is None:
            raise ValueError(f"{self.base} has no version yet")
        if v.number != self.version:
            master = v.read(self.spark)
            with ScratchGroup(self.spark) as group:
                prepared = prepare_consult(master, self.cols, ord_col=self.ord_col)
            self.release()
            self.version, self._held = v.number, (master, prepared, group)
        return self._held[:2]

    def release(self) -> None:
        """Delete the tables of the base in use."""
        if self._held:
            self._held[2].release()
        self.version, self._held = None, None


def _retrieved(requests: DataFrame, master: DataFrame, symptom_dict: DataFrame, link_dict: DataFrame, cols: MasterColumns,
               *, ord_col: str, req_col: str, k: int, base: ConsultBase | None) -> tuple[DataFrame, DataFrame, ConsultBase]:
    """``(ranked, links, base)``: the retrieved rows ``(req, rn, ord)``, stored, and the linked names.

    ``base`` comes from ``prepare_consult``; without it the master is indexed for this call and its
    lines, needed once, are not stored.  The entity rows feed several branches and are stored once.
    """
    base = base or ConsultBase(build_index(master, ord_col, cols.trade, cols.sci), line_table(master, cols, ord_col))
    terms, links = extract_entities(requests, symptom_dict, link_dict, req_col=req_col)
    st = search_terms(terms, links, req_col)
    ranked = retrieve_topk(st, master, req_col=req_col, term_col="term", ord_col=ord_col,
                           trade_col=cols.trade, sci_col=cols.sci, k=k, index=base.index)
    return materialize(ranked, "ranked"), links, base


def consult_lines(requests: DataFrame, master: DataFrame, symptom_dict: DataFrame,
                  link_dict: DataFrame, cols: MasterColumns, *, ord_col: str = "ord",
                  req_col: str = "req_id", k: int = 4, base: ConsultBase | None = None) -> tuple[DataFrame, DataFrame]:
    """``(lines, links)``: the context line of every retrieved row ``(req, rn,
    line)`` and the linked names ``(req, brand, ingredient, link_rank)``."""
    ranked, links, base = _retrieved(requests, master, symptom_dict, link_dict, cols, ord_col=ord_col, req_col=req_col,
                                     k=k, base=base)
    return context_lines(ranked, base.lines, req_col=req_col, ord_col=ord_col), links


def _keys_and_lines(requests, master, symptom_dict, link_dict, cols, *, ord_col: str = "ord", req_col: str = "req_id",
                    k: int = 4, base: ConsultBase | None = None) -> tuple[DataFrame | None, DataFrame]:
    """``context_keys`` and the lines they name; where these are too large to be broadcast, no keys
    and the contexts instead."""
    ranked, links, base = _retrieved(requests, master, symptom_dict, link_dict, cols, ord_col=ord_col, req_col=req_col,
                                     k=k, base=base)
    used, small = used_lines(ranked, base.lines, ord_col=ord_col)
    if small:
        return context_keys(requests, ranked, links, req_col=req_col, ord_col=ord_col), used
    lines = context_lines(ranked, used, req_col=req_col, ord_col=ord_col)
    return None, consult_context(requests, lines, links, req_col=req_col)


def consult_contexts(requests: DataFrame, master: DataFrame, symptom_dict: DataFrame,
                     link_dict: DataFrame, cols: MasterColumns, *, ord_col: str = "ord",
                     req_col: str = "req_id", k: int = 4, base: ConsultBase | None = None) -> DataFrame:
    """``(req, context)`` for every request."""
    keys, found = _keys_and_lines(requests, master, symptom_dict, link_dict, cols, ord_col=ord_col, req_col=req_col,
                                  k=k, base=base)
    return found if keys is None else with_context(keys, found, ord_col=ord_col, k=k)


def consult_prompts(requests: DataFrame, master: DataFrame, symptom_dict: DataFrame,
                    link_dict: DataFrame, cols: MasterColumns, *, ord_col: str = "ord",
                    req_col: str = "req_id", k: int = 4, base: ConsultBase | None = None) -> DataFrame:
    """``(req, system_prompt, user_message)`` for every request.  Requests meet the keys of their
    contexts, and only then the texts."""
    keys, found = _keys_and_lines(requests, master, symptom_dict, link_dict, cols, ord_col=ord_col, req_col=req_col,
                                  k=k, base=base)
    if keys is None:
        return prompt_table(requests, found, req_col=req_col)
    return with_context(requests.join(keys, req_col), found, ord_col=ord_col, k=k).select(*prompt_columns(req_col))
