"""Corpus pipeline: documents without toxic texts, later copies of line runs, near copies and benchmark passages, packed.

Each stage takes (spark, docs, sf_dir). What it returns is written as Parquet in the shared folder and read again as
the next stage's docs. All stages but the last return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from tidewater.llm.common import stash, table
from tidewater.llm.decontaminate import without_contaminated
from tidewater.llm.line_dedup import without_later_copies
from tidewater.llm.near_dedup import one_of_each_group
from tidewater.llm.packing import pack
from tidewater.llm.toxicity import without_toxic

#: SQL can't express the network of the first stage.
ORACLE_SQL = None


def toxicity(spark, docs, sf_dir):
    """Documents that the network doesn't predict as toxic.

    Null and empty texts have one empty window and stay; very long texts are scored in all of their windows. Repeated
    rows are scored alike. A score on the threshold (a tie) rejects. Extra columns keep their values, whatever their names. An empty
    table gives an empty one; without labels nothing is rejected.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Later copies of repeated line runs and of long single lines go, and documents that lose all of their lines.

    Null and empty texts have no lines and stay; very long texts are taken whole. Of repeated rows (one id, one text)
    one stays if it has lines. Ties in the order of places are broken by id, then row, then line. Extra columns keep their
    values, whatever their names; n_chars is that of the new text. An empty table gives an empty one.
    """
    return without_later_copies(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies: the one with the least id.

    Null and empty texts, and rows without an id, are no copies and stay; very long texts are taken whole. Of repeated
    rows, and of rows that share an id, one stays: that whose text has the least hash, then (a tie) the first as JSON. Extra
    columns keep their values, whatever their names. An empty table gives an empty one.
    """
    return one_of_each_group(docs)


def decontamination(spark, docs, sf_dir):
    """Documents in which no passage of a benchmark item is found.

    Null and empty texts hold none and stay, and null or empty items match nothing; very long texts are searched whole.
    Repeated rows share their fate; there are no ties. Extra columns keep their values, whatever their names. An empty
    table gives an empty one.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """What is left, in sequences of tokens.

    Null and empty texts are one end token; very long texts are cut into pieces. Repeated rows each have pieces. Pieces
    of one length (ties) may stand in any order. Extra columns play no part, whatever their names. An empty table gives no rows.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
