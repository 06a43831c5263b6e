"""Where given passages stand: many patterns at once, in one pass over the documents.

Passages go in blocks of BLOCK_CHARS characters, whatever their number: one pass over the documents for each block. A task
builds the block's Aho-Corasick automaton once and reads its documents' characters once; only hits leave it, no text does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions import text as T
from siltstone.session import on_workers, stored

BLOCK_CHARS, PREFIX, LEAST_PREFIX = 1 << 21, 60, 20


@lru_cache(maxsize=1)
def _automaton(needles: tuple[str, ...], prefix: int) -> ahocorasick.Automaton:
    """The needles' beginnings; each tells which needles have it."""
    by_start: dict[str, list[int]] = {}
    for i, needle in enumerate(needles):
        by_start.setdefault(needle[:prefix], []).append(i)
    made = ahocorasick.Automaton()
    for start, own in by_start.items():
        made.add_word(start, (len(start), own))
    made.make_automaton()
    return made


def found_in(hay: str, needles: tuple[str, ...], prefix: int = PREFIX) -> dict[int, bool]:
    """Numbers of the needles whose beginning stands in ``hay``, and whether the whole needle does."""
    hits: dict[int, bool] = {}
    if not needles:
        return hits
    for end, (size, own) in _automaton(needles, prefix).iter(hay):
        for i in own:
            if not hits.get(i):
                hits[i] = len(needles[i]) == size or hay.startswith(needles[i], end + 1 - size)
    return hits


def _scan(batches: Iterator[pa.RecordBatch], ids: list, needles: tuple[str, ...], prefix: int, types: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        refs, docs, exact, long = [], [], [], []
        for doc, hay in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for i, whole in found_in(hay.as_py(), needles, prefix).items():
                refs.append(ids[i])
                docs.append(doc)
                exact.append(whole)
                long.append(min(len(needles[i]), prefix) >= LEAST_PREFIX)
        yield pa.RecordBatch.from_arrays([pa.array(refs, types[0]), pa.array(docs, types[1]), pa.array(exact, pa.bool_()), pa.array(long, pa.bool_())], names=["ref_id", "doc_id", "exact", "long"])


def located(references: DataFrame, docs: DataFrame, ref_id: str, ref_text: str, id_col: str, text_col: str, prefix: int = PREFIX, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(ref_id, doc_id, method) of the documents that hold a passage: exact, else, where no document holds it whole, by its first ``prefix`` characters if 20 or more.

    Both sides are normalised; a passage that is then empty stands nowhere.
    """
    on_workers(docs.sparkSession)
    refs = stored(references.select(F.col(ref_id).alias("ref_id"), T.normalize(F.col(ref_text)).alias("needle")).where("needle <> '' and ref_id is not null"), "needles")
    texts = docs.select(F.col(id_col).alias("doc_id"), T.normalize(F.col(text_col)).alias("hay"))
    types = (to_arrow_type(refs.schema["ref_id"].dataType), to_arrow_type(texts.schema["doc_id"].dataType))
    schema = f"ref_id {refs.schema['ref_id'].dataType.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}, exact boolean, long boolean"
    blocks = max(1, -(-(refs.agg(F.sum(F.length("needle"))).first()[0] or 0) // block_chars))

    def hits_of(b: int) -> DataFrame:
        own = sorted(refs.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).collect(), key=lambda r: r["needle"])  # a block, of bounded size
        ids, needles = [r["ref_id"] for r in own], tuple(r["needle"] for r in own)
        return texts.mapInArrow(lambda batches: _scan(batches, ids, needles, prefix, types), schema)

    hits = stored(reduce(DataFrame.unionByName, map(hits_of, range(blocks))), "passages")
    whole = hits.where("exact").select("ref_id").distinct()
    exact = hits.where("exact").select("ref_id", "doc_id", F.lit("exact").alias("method"))
    begun = hits.where("not exact and long").join(whole, "ref_id", "left_anti").select("ref_id", "doc_id", F.lit("prefix").alias("method"))
    return exact.unionByName(begun)
