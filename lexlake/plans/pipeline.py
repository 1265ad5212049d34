"""The entity pipeline over judgments: records, rule and model entities, cleaning, order, relations, result documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import entities as E
from ..operators import segment as S
from ..operators import tagger


@dataclass(frozen=True)
class Analysis:
    records: DataFrame
    entities: DataFrame
    relations: DataFrame
    results: DataFrame


def ordered_entities(records: DataFrame, tag=None, zero_last: bool = False, by_text: bool = False) -> DataFrame:
    """Entities of records by rules and, with a tagger, by a model, cleaned, without doubles, in order.

    by_text: equal texts are searched once; records, which are read several times then, should be stored.
    """
    found = E.rule_entities_by_text(records) if by_text else E.rule_entities(records)
    if tag is not None:
        found = E.clean_entities(tagger.score_records(records, tag)).unionByName(found)
    return E.order_entities(E.dedupe_entities(found), zero_last)


def analyse(docs: DataFrame, tag=None, mode: str = "raw", keep: Callable[[DataFrame], DataFrame] | None = None) -> Analysis:
    """All tables of docs (doc_id, source, text); every one of docs has a result. Without keep nothing runs until one of them is used.

    keep: what is done with records and with entities before others read them, several times each; fixture.stored computes them once, at once.
    """
    records = S.build_records(docs, mode)
    if keep is not None:
        records = keep(records)
    ordered = ordered_entities(records, tag, by_text=keep is not None)
    if keep is not None:
        ordered = keep(ordered)
    return Analysis(records, ordered, E.relations(ordered), E.result_documents(records, ordered, docs))
