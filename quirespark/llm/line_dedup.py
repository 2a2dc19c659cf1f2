"""Substring dedup by line or paragraph hashing.

A text's units are its lines (or paragraphs, parted by blank lines). So that a passage is also found where it stands
inside a longer line, the sentences of a unit are hashed as its parts: a sentence ends with a word that ends with a
full stop, exclamation or question mark. Units and parts are normalised to their words, A-Z lower-cased, and hashed to
128 bits. Of equal ones in the whole corpus that in the document with the smallest rank stays, and in that document
the first; the others are repeats. Units of fewer than min_words words and parts of fewer than min_part_words are not
looked at; the parts of a repeated unit go with it. What is removed are passages: repeats that follow each other, with
nothing looked at between them, and have min_passage_words words or more together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, names
from .kernel import Words, iter_words, mix, separators, text_buffer

_SCHEMA = "doc_id long, text_key long, d1 long, d2 long, unit long, part long, place long, last_place long, start_char long, end_char long, n_words long, again boolean"
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _unit_starts(buf: np.ndarray, w: Words, paragraphs: bool) -> np.ndarray:
    """Index of the first word of every unit that has words."""
    feeds = np.concatenate([[0], np.cumsum(buf == 10)])
    if len(w.starts) == 0:
        return np.zeros(0, np.int64)
    between = feeds[w.starts[1:]] - feeds[w.ends[:-1]]
    new = np.concatenate([[True], between >= (2 if paragraphs else 1)])
    firsts = w.bounds[:-1]
    new[firsts[firsts < len(new)]] = True
    return np.flatnonzero(new)


def _units(batches: Iterator[pa.RecordBatch], min_words: int, min_part_words: int, paragraphs: bool) -> Iterator[pa.RecordBatch]:
    sep = separators()
    stops = np.zeros(256, bool)
    stops[[ord(c) for c in ".!?"]] = True
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for w in iter_words(batch.column(1), sep):
            base = int(offsets[w.first])
            buf = data[base : base + int(w.text_starts[-1])]
            lines = _unit_starts(buf, w, paragraphs)
            if not len(lines):
                continue
            n = len(w.hashes)
            new = np.zeros(n, bool)
            new[lines] = True
            new[1:] |= stops[buf[w.ends[:-1] - 1]]
            parts = np.flatnonzero(new)
            line_of = np.searchsorted(lines, parts, "right") - 1
            line_sizes, part_sizes = np.diff(np.concatenate([lines, [n]])), np.diff(np.concatenate([parts, [n]]))
            inner = part_sizes < line_sizes[line_of]  # a line of one sentence is its own only part
            doc_of_line = np.searchsorted(w.bounds, lines, "right") - 1
            unit = np.arange(len(lines)) - np.searchsorted(doc_of_line, doc_of_line)
            part_no = np.arange(len(parts)) - np.searchsorted(line_of, line_of)

            def digests(at: np.ndarray, sizes: np.ndarray, w: Words = w) -> list[np.ndarray]:
                inside = (np.arange(len(w.hashes)) - np.repeat(at, sizes) + 1).astype(np.uint64)
                return [mix(np.add.reduceat(mix(w.hashes + inside * s), at) + sizes.astype(np.uint64) * s) for s in _SALTS]

            of_lines, of_parts = digests(lines, line_sizes), digests(parts, part_sizes)
            ok, ok_part = line_sizes >= min_words, inner & (part_sizes >= min_part_words)
            # places count what is looked at in a document: a unit's parts, or the unit where it has none
            of_line = np.bincount(line_of[ok_part], minlength=len(lines))
            held = np.where(of_line > 0, of_line, ok)
            before = np.cumsum(held) - held
            begins = before - before[np.searchsorted(doc_of_line, doc_of_line)]
            rank = np.cumsum(ok_part) - 1
            part_place = begins[line_of] + rank - (np.cumsum(of_line) - of_line)[line_of]
            both = lambda x, y: np.concatenate([x[ok], y[ok_part]])
            d1, d2 = both(of_lines[0], of_parts[0]), both(of_lines[1], of_parts[1])
            at, sizes, doc = both(lines, parts), both(line_sizes, part_sizes), both(doc_of_line, doc_of_line[line_of])
            chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            begin, end = (chars[x] - chars[w.text_starts[doc]] for x in (w.starts[at], w.ends[at + sizes - 1]))
            # what repeats in its own document is marked here, so that only one a document is compared globally
            order = np.lexsort((at, d2, d1, doc))
            again = np.zeros(len(at), bool)
            o, p = order[1:], order[:-1]
            again[o] = (doc[o] == doc[p]) & (d1[o] == d1[p]) & (d2[o] == d2[p])
            rows = pa.array(w.first + doc)
            columns = [batch.column(0).take(rows), batch.column(2).take(rows), d1.view(np.int64), d2.view(np.int64), both(unit, unit[line_of]), both(np.full(len(lines), -1), part_no)]
            columns += [both(begins, part_place), both(begins + held - 1, part_place), begin, end, sizes, again]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in _SCHEMA.split(", ")])


def _repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int, min_part_words: int, min_passage_words: int, paragraphs: bool) -> DataFrame:
    """Rows of repeated_units with text_key, the hash of the text."""
    ws = Workspace(docs.sparkSession, "line_dedup")
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).where("doc_id is not null")
    units = ws.write(slim.mapInArrow(lambda it: _units(it, min_words, min_part_words, paragraphs), _SCHEMA), "units")
    # counts and minima are combined before the shuffle, so that a line of a third of all documents is no hot group
    seen = units.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    kept = ws.write(seen, "repeated")
    gone = ws.write(units.join(kept, ["d1", "d2"]).where("again or doc_id <> first_doc_id").drop("d1", "d2", "again"), "repeats")
    ws.drop(units, kept)
    w = Window.partitionBy("doc_id", "text_key").orderBy("place", "part")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # rows that repeat in a whole stand side by side; a part lies in a unit that goes where that reaches its place
    same = (F.lag("place").over(w) == F.col("place")) & (F.lag("part").over(w) == F.col("part"))
    inside = (F.col("part") >= 0) & (F.coalesce(F.max(F.when(F.col("part") < 0, F.col("last_place"))).over(so_far), F.lit(-1)) >= F.col("place"))
    gone = gone.withColumn("drop_", F.coalesce(same, F.lit(False)) | inside).where("not drop_")
    gone = gone.withColumn("new_", (F.col("place") > F.coalesce(F.lag("last_place").over(w), F.lit(-2)) + 1).cast("int")).withColumn("passage", F.sum("new_").over(so_far))
    long = F.sum("n_words").over(Window.partitionBy("doc_id", "text_key", "passage"))
    return gone.withColumn("long_", long).where(F.col("long_") >= min_passage_words).select("doc_id", "text_key", "unit", "part", "start_char", "end_char", "n_words", "first_doc_id")


def repeated_units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, min_part_words: int = 8, min_passage_words: int = 15, paragraphs: bool = False) -> DataFrame:
    """One row per unit or part to remove: doc_id, unit, part, start_char, end_char, n_words, first_doc_id.

    start_char and end_char are code point offsets into the original text, from the first to the last word.
    first_doc_id has the occurrence that stays: the smallest doc_id is the earliest rank. unit counts the units with
    words of a text from 0; part counts the sentences of a unit from 0, and is -1 for a whole unit. Null, empty and blank
    texts have no units; documents with a null doc_id are ignored. Rows that repeat a doc_id have the same rank, so that
    both keep their units; rows that repeat doc_id and text give their repeats once. Other columns are ignored, whatever
    their names; an empty table gives an empty result. A part that is long enough is looked at beside its unit; a line of
    one sentence is its own only part. Jobs run when this is called.
    """
    return _repeats(docs, id_col, text_col, min_words, min_part_words, min_passage_words, paragraphs).drop("text_key")


def drop_repeated_units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, min_part_words: int = 8, min_passage_words: int = 15, paragraphs: bool = False) -> DataFrame:
    """docs with the repeated passages cut out of the text, and `removed_spans`: array of (start_char, end_char) in the original.

    A cut takes the line feeds after the unit with it. Documents without repeats, with a null id or a null text are
    unchanged (empty array). Rows that repeat id and text are cut alike. Columns of docs may have any names; where there
    is a removed_spans already, the added one ends in an underscore.
    """
    gone = _repeats(docs, id_col, text_col, min_words, min_part_words, min_passage_words, paragraphs)
    doc, key, spans, added = names(docs, "doc_", "key_", "spans_", "removed_spans")
    table = gone.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias(spans))

    @F.pandas_udf("string")
    def cut(text, spans):
        def one(t, ss):
            if ss is None or t is None or not len(ss):
                return t
            out, at = [], 0
            for s in ss:
                out.append(t[at : s["start_char"]])
                at = s["end_char"]
                while at < len(t) and t[at] in "\r\n":
                    at += 1
            return "".join([*out, t[at:]])

        return text.combine(spans, one)

    joined = docs.join(table, (F.col(id_col).cast("long") == F.col(doc)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(key)), "left")
    empty = F.array().cast("array<struct<start_char:bigint,end_char:bigint>>")
    columns = [cut(F.col(text_col), F.col(spans)).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(spans, empty).alias(added))
