"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped on the way back.

A partition of the range of ids becomes one part: `<part>.tokens` (all ids, little-endian, 16 bits where the vocabulary
allows and 32 otherwise), `<part>.offsets` (signed 64-bit, one more than documents, counted within the part) and
`<part>.ids` (signed 64-bit document ids). The manifest has a row for each part; the base of a part is the prefix sum of
the tokens before it. A file's name holds its attempt, and only files named in the manifest count, so that lost and
repeated tasks leave nothing wrong behind.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.llm.common import batched, csr_take, read, shuffle_parts
from rollbook.session import new_folder, table_of

#: A worker keeps its encoder from task to task, and forgets the pieces beyond so many.
CACHE_PIECES = 500_000
#: So many new pieces are encoded as one text, with a special token between them.
JOINED = 100
#: Texts are encoded together from so many bytes on.
GROUP_BYTES = 2 << 20
#: A part holds about so many bytes of text where there are more than the session's shuffle partitions can hold.
PART_BYTES = 512 << 20
NULL_ID = -(1 << 63)
MANIFEST = "part int, file string, n_docs long, n_tokens long, bits int"


#: White space as the tokenizer's pattern has it: one byte, and the further bytes of longer characters by their first.
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
#: 1 for ASCII letters and digits, 2 for ASCII marks but the apostrophe, which contractions begin with.
_SORT = np.array([1 if chr(i).isascii() and chr(i).isalnum() else 2 if 32 < i < 127 and i != 39 else 0 for i in range(256)], np.int8)
_WIDE = {0xC2: [0x85, 0xA0], 0xE1: [0x9A80], 0xE2: [*range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F], 0xE3: [0x8080]}


def pieces(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The texts cut where byte-level BPE encodes both sides alike alone and in the text, and the pieces of each text.

    A piece is a word with the one space before it, or a run of white space up to the last character before a word; that
    character, if not a space, is a piece of its own. Words are also cut between an ASCII letter or digit and an ASCII
    mark, the apostrophe apart. The texts hold no special token.
    """
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    at = np.flatnonzero((raw[bounds[0] :] & 0xC0) != 0x80) + bounds[0]
    lead = raw[at]
    space = _SPACE[lead]
    for first, rest in _WIDE.items():
        own = np.flatnonzero(lead == first)
        if len(own):
            p = at[own]
            tail = raw[p + 1].astype(np.int64) if first < 0xE0 else raw[p + 1].astype(np.int64) << 8 | raw[p + 2]
            space[own] = np.isin(tail, rest)
    starts = np.searchsorted(at, bounds[:-1][np.diff(bounds) > 0])
    cut = np.zeros(len(at), bool)
    cut[starts] = True
    last = np.zeros(len(at), bool)  # of its text
    last[starts[1:] - 1] = True
    last[-1:] = True
    before = np.concatenate([[False], space[:-1]])
    after = np.concatenate([space[1:], [True]]) | last
    cut |= space & ~(before & after)
    cut[1:] |= ~space[1:] & space[:-1] & (lead[:-1] != 32)
    sort = _SORT[lead]
    cut[1:] |= sort[1:] + sort[:-1] == 3
    off = np.concatenate([at[cut], bounds[-1:]]).astype(np.int32)
    counts = np.diff(np.searchsorted(off[:-1], bounds))
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), data]), counts


class ChunkEncoder:
    """Encodes whole texts by the tokenizers library; with byte-level BPE, each different piece once."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok, self.end = Tokenizer.from_file(path), end_id
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.uint16 if max(self.tok.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else np.uint32
        added = self.tok.get_added_tokens_decoder()
        bare = {t.content: i for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)}
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        #: Whether pieces() holds: GPT-2's pattern, nothing normalised, and added tokens that only match as they stand.
        self.by_pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"] and len(bare) == len(added)
        self.special = dict(sorted(bare.items(), key=lambda x: -len(x[0])))
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.sep = next(((i, t.content) for i, t in added.items() if t.special and t.content in bare), None)
        self.clear()

    def clear(self) -> None:
        self.codes = {}
        # code 0 is the end of a document, then the special tokens
        self.flat = np.array([self.end, *self.special.values()], self.dtype)
        self.off = np.arange(len(self.flat) + 1, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's end id included, and the number of ids of each text. Null texts are empty."""
        texts = texts.cast(pa.string()).fill_null("")
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if not self.by_pieces:
            each = [[*e.ids, self.end] for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((x for y in each for x in y), self.dtype), np.array(list(map(len, each)), np.int64)
        parts, ends, segments = self._segments(texts)
        chunks, counts = pieces(parts)
        found = chunks.dictionary_encode()
        values = found.dictionary.to_pylist()
        if len(self.codes) > CACHE_PIECES:
            self.clear()
        new = [v for v in values if v not in self.codes]
        if new:
            self.codes.update(zip(new, range(len(self.off) - 1, len(self.off) - 1 + len(new)), strict=True))
            flat, lens = self._encode_pieces([v.decode() for v in new])
            self.flat = np.concatenate([self.flat, flat])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(lens)])
        own = np.fromiter(map(self.codes.__getitem__, values), np.int64, len(values))
        codes = np.insert(own[found.indices.to_numpy()], np.cumsum(counts), ends)
        flat, lens = csr_take(self.flat, self.off, codes)
        lens = np.add.reduceat(lens, np.cumsum(counts + 1) - counts - 1)
        return flat, np.add.reduceat(lens, np.cumsum(segments) - segments)

    def _segments(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """The texts cut at special tokens, as the library cuts them before anything else; the code that follows each segment
        (a special token's, or the document's end), and the segments of each text."""
        plain = np.ones(len(texts), bool)
        for token in self.special:
            plain &= ~pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if plain.all():
            return texts, np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64)
        code = {t: k for k, t in enumerate(self.special, 1)}
        parts, ends, counts = [], [], []
        for t, whole in zip(texts.to_pylist(), plain.tolist(), strict=True):
            own = [t] if whole else self.split.split(t)
            parts += own[::2]
            ends += [*(code[x] for x in own[1::2]), 0]
            counts.append(len(own[::2]))
        return pa.array(parts, pa.string()), np.array(ends, np.int64), np.array(counts, np.int64)

    def _encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, which hold no special token, and how many each has. A special token splits a text before
        anything else does, so that pieces joined by it are encoded as each alone."""
        flats, lens = [], []
        for at in range(0, len(new), JOINED):
            part = new[at : at + JOINED]
            if self.sep:
                ids = np.array(self.tok.encode_batch_fast([self.sep[1].join(part)], add_special_tokens=False)[0].ids, self.dtype)
                cut = ids == self.sep[0]
                ends = np.concatenate([np.flatnonzero(cut), [len(ids)]])
                flats.append(ids[~cut])
                lens.append(np.diff(ends, prepend=-1) - 1)
            else:
                each = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
                lens.append(np.fromiter(map(len, each), np.int64, len(each)))
                flats.append(np.fromiter((x for y in each for x in y), self.dtype, int(lens[-1].sum())))
        return np.concatenate(flats), np.concatenate(lens)


@lru_cache(2)
def encoder_of(path: str, end_id: int) -> ChunkEncoder:
    return ChunkEncoder(path, end_id)


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, parts: int | None = None
) -> DataFrame:
    """Writes the token files of docs in ascending order of id under path; returns the manifest, itself written there.

    Null texts are empty and have the end id alone; a very long text is encoded whole, in a group of its own. Rows of one
    id follow one another in the order of a hash of their texts, equal rows each have their own ids; null ids come first
    and are read back as null, for which the id -2^63 is kept: a row that has it raises. Other columns are ignored,
    whatever their names. No rows give an empty manifest. parts: by default the session's shuffle partitions, and more
    where a part would hold over PART_BYTES of text.
    """
    spark = docs.sparkSession
    batched(spark)
    n = parts or max(shuffle_parts(spark), -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // PART_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("_text"))
    rows = rows.repartitionByRange(n, F.col("_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ids, lens, place = None, [], [], None
        at = TaskContext.get()
        stem = f"{path.rstrip('/')}/{at.partitionId():06d}-{at.taskAttemptId()}"
        out, held, size = None, [], 0

        def write() -> None:
            texts = pa.concat_arrays([b.column(1).cast(pa.string()) for b in held])
            flat, own = encoder.encode(texts)
            out.write(flat.astype(flat.dtype.newbyteorder("<"), copy=False).tobytes())
            lens.append(own)
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                encoder, (place, stem_path) = encoder_of(tokenizer_path, end_id), _place(stem)
                place.create_dir(stem_path.rpartition("/")[0], recursive=True)
                out = place.open_output_stream(f"{stem_path}.tokens")
            if pc.any(pc.equal(b.column(0), NULL_ID)).as_py():
                raise ValueError(f"the id {NULL_ID} stands for null")
            ids.append(b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
            if held and size + b.column(1).nbytes > GROUP_BYTES:
                write()
                size = 0
            held.append(b)
            size += b.column(1).nbytes
        if held:
            write()
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype("<i8")
        for suffix, data in (("offsets", offsets), ("ids", np.concatenate(ids).astype("<i8"))):
            with place.open_output_stream(f"{stem_path}.{suffix}") as f:
                f.write(data.tobytes())
        row = [[at.partitionId()], [stem], [len(offsets) - 1], [int(offsets[-1])], [encoder.dtype().itemsize * 8]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["part", "file", "n_docs", "n_tokens", "bits"])

    return table_of(rows.select("_id", "_text").mapInArrow(run, MANIFEST), "manifest", f"{path.rstrip('/')}/manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with base: ids of all parts before. It has a row for each part, and so has the one window."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _mapped(uri: str, dtype: str, n: int) -> np.ndarray:
    """The file's numbers: memory-mapped where the shared folder is mounted, read from its store otherwise."""
    place, path = _place(uri)
    if not n:
        return np.zeros(0, dtype)
    if type(place).__name__ in ("LocalFileSystem", "PyFileSystem") or place.type_name == "local":
        return np.memmap(path, dtype, "r", shape=(n,))
    with place.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(n * np.dtype(dtype).itemsize), dtype)


def token_spans(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                tokens = _mapped(f"{r['file']}.tokens", f"<u{r['bits'] // 8}", r["n_tokens"])
                offsets = _mapped(f"{r['file']}.offsets", "<i8", r["n_docs"] + 1)
                ids = _mapped(f"{r['file']}.ids", "<i8", r["n_docs"])
                for at in range(0, len(ids), 512):
                    o = offsets[at : at + 513]
                    wide = [np.asarray(tokens[x:y], "<u4") for x, y in zip(o[:-1].tolist(), o[1:].tolist())]
                    own = np.array(ids[at : at + 512])
                    cols = [pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(o[:-1] + r["base"]), pa.array(np.diff(o)), pa.array([zlib.crc32(w.tobytes()) for w in wide], pa.int64())]
                    cols += [pa.array([w.astype(np.int64).tolist() for w in wide], pa.list_(pa.int64()))] if with_ids else []
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    rows = with_bases(manifest).repartition(shuffle_parts(manifest.sparkSession))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(read(spark, sf_dir, "documents"), new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_spans(manifest)


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}
