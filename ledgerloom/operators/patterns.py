"""Which texts hold which of many fixed strings, by one automaton over all of them instead of a comparison of every pair."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.batches import in_arrow

#: Strings of one automaton, which every task gets; more of them take several passes over the texts.
BLOCK = 50_000


def holding(texts: DataFrame, item: str, content: Column, needles: DataFrame, needle: str, string: Column, block: int = BLOCK) -> DataFrame:
    """(item, needle): each pair of a text and a string's id where the text holds the string, once.

    Null and empty strings are held by no text, null texts hold none. A pass over the texts finds all strings of a block
    at once, in time that grows with the text and what is found; nothing is shuffled or joined.
    """
    asked = needles.select(F.col(needle).alias("id"), string.alias("s")).filter("s is not null and s <> ''").distinct()
    parts = max(1, -(-asked.count() // block))
    rows = texts.select(F.col(item), content.cast("string").alias("_text")).filter("_text is not null")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name == item] + [f"{needle} {asked.schema['id'].dataType.simpleString()}"]
    found = [in_arrow(rows, _search(asked.filter(F.pmod(F.xxhash64("s"), F.lit(parts)) == i).toArrow(), item, needle), ", ".join(kinds)) for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _search(asked: pa.Table, item: str, needle: str):
    words: dict[str, list[int]] = {}
    for i, s in enumerate(asked["s"].to_pylist()):
        words.setdefault(s, []).append(i)
    ids = asked["id"].combine_chunks()

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for s, own in words.items():
            automaton.add_word(s, own)
        automaton.make_automaton()
        for b in batches:
            at, which = [], []
            for i, t in enumerate(b.column(1).to_pylist() if words else []):
                own = {k for _, ks in automaton.iter(t) for k in ks}
                at += [i] * len(own)
                which += sorted(own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), ids.take(pa.array(which, pa.int64()))], [item, needle])

    return run
