"""Token-id files in Simple-8b: word-aligned coding with escapes, and per-block offsets for vectorised decoding.

A file holds blocks of 4096 ids (the last one may be short). Every 64-bit little-endian word has a selector in its top
four bits and packs as many ids as the selector says into the other 60; the last word of a block may be part empty.
An id of 2**60 or more takes two words: selector 14 carries its low 32 bits and selector 15 its high 32 bits.
After the words come the block offsets (in words), the document table (doc_id, ids before it in the file) and a footer:

    words | uint64 block offsets [blocks + 1] | int64 doc ids | uint64 doc starts [docs + 1] | footer (5 x uint64)

so that any block or document can be decoded alone.
"""

from __future__ import annotations

import gc
import os
import posixpath
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace
from .kernel import text_buffer

BLOCK = 4096
MAGIC = 0x5138_4231_0000_0001
#: Ids in a word and bits of each, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE_LOW, ESCAPE_HIGH = 14, 15
_LIMITS = np.array([(1 << w) - 1 for w in WIDTHS], np.uint64)
_LEVELS = np.searchsorted(_LIMITS, np.arange(1 << 18, dtype=np.uint64)).astype(np.uint8)
# byte-level files write a byte as its Latin-1 character where that is printable, and the others from code point 256 on
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_NULL_ID = -(2**63)
_U = np.uint64


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, one after the other, and the number of words of each block. All blocks are packed in step."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    padded = np.zeros(blocks * BLOCK + 64, np.uint64)
    padded[:n] = ids
    values = padded[: blocks * BLOCK]
    level = (_LEVELS[values] if int(values.max()) < len(_LEVELS) else np.searchsorted(_LIMITS, values).astype(np.uint8)).reshape(blocks, BLOCK)
    level[-1, lengths[-1] :] = 0
    best = np.full((blocks, BLOCK), ESCAPE_LOW, np.uint8)
    window, covered = level.copy(), 1  # window[i]: highest level of the next `covered` ids
    for s in range(len(COUNTS) - 1, -1, -1):
        while covered < COUNTS[s]:
            step = min(covered, COUNTS[s] - covered)
            np.maximum(window[:, :-step], window[:, step:], out=window[:, :-step])
            covered += step
        np.copyto(best, np.uint8(s), where=window <= s)
    taken = np.array([*COUNTS, 1], np.int64)
    at, base = np.zeros(blocks, np.int64), np.arange(blocks) * BLOCK
    flat = best.ravel()
    steps_at, steps_sel, steps_live = [], [], []
    live = np.ones(blocks, bool)
    while live.any():
        where = base + np.minimum(at, BLOCK - 1)
        sel = flat[where]
        steps_at.append(where)
        steps_sel.append(sel)
        steps_live.append(live)
        at = at + taken[sel]
        live = at < lengths
    keep = np.array(steps_live).T
    where, sel = np.array(steps_at).T[keep], np.array(steps_sel).T[keep]
    escaped = sel == ESCAPE_LOW
    place = np.arange(len(sel)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(sel) + int(escaped.sum()), np.uint64)
    for s in range(len(COUNTS)):
        pick = np.flatnonzero(sel == s)
        if not len(pick):
            continue
        p, word = where[pick], np.full(len(pick), s << 60, np.uint64)
        for j in range(COUNTS[s]):
            word |= padded[p + j] << _U(j * WIDTHS[s])
        for i in np.flatnonzero(BLOCK - p % BLOCK < COUNTS[s]):  # what follows a block's end is not its own
            room = BLOCK - int(p[i]) % BLOCK
            word[i] = int(word[i]) & ((1 << (room * WIDTHS[s])) - 1) | s << 60
        words[place[pick]] = word
    if escaped.any():
        value, p = padded[where[escaped]], place[escaped]
        words[p] = _U(ESCAPE_LOW << 60) | (value & _U(0xFFFFFFFF))
        words[p + 1] = _U(ESCAPE_HIGH << 60) | (value >> _U(32))
    per_block = keep.sum(axis=1)
    block_of = np.repeat(np.arange(blocks), per_block)
    return words, per_block + np.bincount(block_of[escaped], minlength=blocks)


def decode_blocks(words: np.ndarray, block_words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of blocks with the given numbers of words and ids."""
    sel = (words >> _U(60)).astype(np.int64)
    count = np.array([*COUNTS, 1, 0])[sel]
    stop = np.cumsum(block_words)
    total = np.cumsum(count)
    before = np.concatenate([[0], total])[np.concatenate([[0], stop[:-1]])]
    over = total[stop - 1] - before - lengths  # empty places in the last words
    count[stop - 1] -= over
    start = np.cumsum(count) - count
    out = np.zeros(int(lengths.sum()) + 64, np.uint64)
    last = np.zeros(len(words), bool)
    last[stop - 1] = True
    for s in range(len(COUNTS)):
        mine = sel == s
        for pick, whole in ((np.flatnonzero(mine & ~last), True), (np.flatnonzero(mine & last), False)):
            if not len(pick):
                continue
            at, packed = start[pick], words[pick]
            for j in range(COUNTS[s]):
                value = (packed >> _U(j * WIDTHS[s])) & _LIMITS[s]
                if whole:
                    out[at + j] = value
                else:
                    has = count[pick] > j
                    out[at[has] + j] = value[has]
    low = np.flatnonzero(sel == ESCAPE_LOW)
    if len(low):
        out[start[low]] = (words[low] & _U(0xFFFFFFFF)) | ((words[low + 1] & _U(0xFFFFFFFF)) << _U(32))
    return out[: int(lengths.sum())]


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder's URI; a path without a scheme is local."""
    if "://" not in uri:
        uri = "file://" + re.sub(r"^file:", "", uri)
    return pa.fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file. Every attempt has a name of its own; the manifest tells which attempt's file counts."""

    def __init__(self, folder: str, name: str):
        self.fs, root = open_folder(folder)
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(posixpath.join(root, name))
        self.pending: list[np.ndarray] = []
        self.waiting = self.n_ids = self.n_words = 0
        self.block_words: list[np.ndarray] = []
        self.doc_ids: list[int] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(_NULL_ID if doc_id is None else doc_id)
        self.starts.append(self.n_ids)
        self.pending.append(ids)
        self.n_ids += len(ids)
        self.waiting += len(ids)
        if self.waiting >= 512 * BLOCK:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        words, per_block = encode_blocks(ids[:n])
        self.out.write(words.astype("<u8").tobytes())
        self.block_words.append(per_block)
        self.n_words += len(words)
        self.pending, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.waiting)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.block_words))])
        tail = [offsets.astype("<u8"), np.array(self.doc_ids, "<i8"), np.array([*self.starts, self.n_ids], "<u8")]
        footer = np.array([self.n_words, len(offsets) - 1, len(self.doc_ids), self.n_ids, MAGIC], "<u8")
        self.out.write(b"".join(x.tobytes() for x in [*tail, footer]))
        self.out.close()


class Reader:
    """Random access to a file's documents and blocks."""

    def __init__(self, folder: str, name: str):
        fs, root = open_folder(folder)
        self.file = fs.open_input_file(posixpath.join(root, name))
        size = self.file.size()
        self.n_words, blocks, docs, self.n_ids, magic = map(int, np.frombuffer(self.file.read_at(40, size - 40), "<u8"))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        tail = self.file.read_at((blocks + 1 + docs + docs + 1) * 8, self.n_words * 8)
        self.offsets = np.frombuffer(tail, "<u8", blocks + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(tail, "<i8", docs, (blocks + 1) * 8)
        self.starts = np.frombuffer(tail, "<u8", docs + 1, (blocks + 1 + docs) * 8).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; only the blocks they lie in are read."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        lo, hi = start // BLOCK, -(-stop // BLOCK)
        raw = self.file.read_at(int(self.offsets[hi] - self.offsets[lo]) * 8, int(self.offsets[lo]) * 8)
        lengths = np.minimum(BLOCK, self.n_ids - np.arange(lo, hi) * BLOCK)
        return decode_blocks(np.frombuffer(raw, "<u8"), np.diff(self.offsets[lo : hi + 1]), lengths)[start - lo * BLOCK : stop - lo * BLOCK]

    def documents(self, step: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, reading about `step` ids at a time."""
        i = 0
        while i < len(self.doc_ids):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + step, "right")) - 1)
            ids = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                a, b = self.starts[k] - self.starts[i], self.starts[k + 1] - self.starts[i]
                yield (None if self.doc_ids[k] == _NULL_ID else int(self.doc_ids[k])), int(self.starts[k]), ids[a:b]
            i = j


class TextEncoder:
    """Ids of whole texts, with the ids of the pieces between plain single spaces remembered.

    The byte-level pre-tokenizer never joins text across a space that stands between two non-spaces, so that such pieces
    can be encoded apart; each distinct piece is encoded by the library. Texts with other white space, or with two white
    characters in a row, are only cut where both neighbours of a space are not white. A text that holds the string of an
    added token (such as an end-of-text mark, which the library reads as that token) goes to the library whole.
    """

    LIMIT = 700_000  # pieces of a generation; about 230 bytes each
    _odd = np.zeros(256, bool)
    _odd[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True  # bytes that other white space has
    _safe = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.first = Pieces(self.tokenizer, " "), Pieces(self.tokenizer, "")

    def _pieces(self, text: str, odd: bool) -> list[str]:
        if odd or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n":
            return self._safe.split(text)
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str], odd: np.ndarray) -> list[np.ndarray]:
        self.known.age()
        self.first.age()
        return [self._whole(t, o) for t, o in zip(texts, odd, strict=True)]

    def _whole(self, text: str, odd: bool) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(self._ids(self._pieces(text, odd)), "<u4")

    def _ids(self, pieces: list[str]) -> bytes:
        head = self.first[pieces[0]]
        del pieces[0]
        return b"".join([head, *map(self.known.__getitem__, pieces)])


class Pieces(dict):
    """Ids of pieces by text, learnt when first asked for. A piece has a space before it unless `space` is empty or a line feed
    begins it. Two generations: pieces that are asked for again move to the newer one."""

    def __init__(self, tokenizer, space: str):
        super().__init__()
        self.tokenizer, self.model, self.space, self.older = tokenizer, tokenizer.model, space, {}
        ids = lambda x: array("I", tokenizer.encode(x, add_special_tokens=False).ids).tobytes()
        self.feed, self.marks = ids("\n"), {c: ids(c) for c in ".,;:!?"}

    def age(self) -> None:
        if len(self) > TextEncoder.LIMIT:
            self.older = dict(self)
            self.clear()

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self._learn(key)
        self[key] = ids
        return ids

    def _learn(self, key: str) -> bytes:
        """Letters are one unit of the pre-tokenizer and a mark after them is another: such pieces go to the model at once."""
        line = key[:1] == "\n"
        letters, tail = key[1:] if line else key, b""
        if not letters.isalpha():
            tail, letters = self.marks.get(letters[-1:]), letters[:-1]
            if tail is None or not letters.isalpha():
                whole = key if line else self.space + key
                return array("I", self.tokenizer.encode(whole, add_special_tokens=False).ids).tobytes()
            if not line:
                return self[letters] + tail
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        ids = array("I", [k.id for k in self.model.tokenize("Ġ" + letters if self.space and not line else letters)]).tobytes()
        return self.feed + ids + tail if line else ids + tail


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder of a tokenizer file; its memory serves all the worker's tasks."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
        gc.freeze()  # the vocabulary and what is loaded so far need no more looking at
        gc.set_threshold(50_000)
    return _encoders[path]


def _odd_texts(column: pa.Array) -> np.ndarray:
    """Which texts may hold white space other than space and line feed."""
    data, offsets = text_buffer(column)
    out = np.zeros(len(column), bool)
    for lo in range(0, len(column), 1024):
        hi = min(lo + 1024, len(column))
        at = offsets[lo : hi + 1]
        marks = np.concatenate([[0], np.cumsum(TextEncoder._odd[data[at[0] : at[-1]]], dtype=np.int64)])
        out[lo:hi] = marks[at[1:] - at[0]] > marks[at[:-1] - at[0]]
    return out


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encodes every text, appends end_id, and writes the ids in ascending doc_id order to .s8b files in `folder`.

    Returns the manifest: file_no, file, n_docs, n_ids. Files are ranges of doc_id; a null doc_id comes first, rows that
    repeat one stand side by side, a null or empty text is end_id alone. Other columns are ignored, whatever their names.
    Every attempt of a task writes a file of its own, and the stored manifest names those of the attempts that counted;
    files of lost or repeated attempts are deleted. An empty table writes no file. The job runs when this is called.
    """
    ws = Workspace(docs.sparkSession, "token_files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, encode = TaskContext.get(), None, encoder(tokenizer).encode
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.s8b"
        end = np.array([end_id], "<u4")
        for batch in batches:
            column = batch.column(1)
            odd = _odd_texts(column)
            at = 0
            while at < len(column):
                stop = min(at + 64, len(column))
                texts = [x or "" for x in column.slice(at, stop - at).to_pylist()]
                for doc_id, ids in zip(batch.column(0).slice(at, stop - at).to_pylist(), encode(texts, odd[at:stop]), strict=True):
                    writer = writer or Writer(folder, name)
                    writer.add(doc_id, np.concatenate([ids, end]))
                at = stop
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"file_no": task.partitionId(), "file": name, "n_docs": len(writer.doc_ids), "n_ids": writer.n_ids}])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = slim.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = ws.write(ordered.mapInArrow(write, "file_no long, file string, n_docs long, n_ids long"), "manifest")
    _sweep(folder, {r.file for r in manifest.select("file").collect()})  # one row for each file
    return manifest


def _sweep(folder: str, files: set[str]) -> None:
    """Deletes the token files in the folder that are not among `files`."""
    fs, root = open_folder(folder)
    for f in fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith("part-") and f.base_name.endswith(".s8b") and f.base_name not in files:
            fs.delete_file(f.path)


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = manifest.count()
    # one row per file, so that a window over all of them is small
    starts = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(d, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, start, ids in Reader(folder, name).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.select("file", "before", "file_no").repartitionByRange(max(files, 1), "file_no").select("file", "before").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
