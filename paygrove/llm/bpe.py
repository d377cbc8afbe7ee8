"""Operator 6, BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrove.session import bucketed_table

#: Fixed values of the tokenizer's file: its special tokens.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")

#: The pattern on the settled blocks: letters, numbers and white space below U+0180 as plain sets.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
WORDS = re.compile(f"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_S}{_L}{_N}]+")

#: A chunk of documents ends at so many distinct words, or so many words.
DISTINCT, LENGTH = 800_000, 8_000_000
#: Places of words that one task packs at a time.
PACKED = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters on which the library's Unicode tables and this module's surely agree.
_ELSEWHERE = re.compile("[^\\x00-\u017f\u2010-\u2027]")


class Splitter:
    """The tokenizer's words of a text, normalised; special tokens stand for themselves.

    A text with characters outside the well-settled blocks goes through the library's own
    normaliser and pattern, whose Unicode tables may be older or newer than ours.
    """

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(path)
        pattern = json.loads(t.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.normal, self.cut = t.normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "<|" not in text:
            return self.section(text)
        out: list[str] = []
        for part in _SPECIAL.split(text):
            if part in SPECIAL:
                out.append(part)
            elif part:
                out += self.section(part)
        return out

    def section(self, text: str) -> list[str]:
        if _ELSEWHERE.search(text):
            return [w for w, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(text))]
        return WORDS.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


@lru_cache
def splitter(path: str) -> Splitter:
    return Splitter(path)


class Encoder:
    """Ids of single words, and the piece of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        t = Tokenizer.from_file(path)
        self.special = {s: t.token_to_id(s) for s in SPECIAL}
        self.pieces = [t.id_to_token(i) for i in range(t.get_vocab_size())]
        t.normalizer = normalizers.Sequence([])
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()
        self.t = t

    def __call__(self, words: list[str]) -> list[list[int]]:
        got = self.t.encode_batch(words, add_special_tokens=False)
        return [[self.special[w]] if w in self.special else e.ids for w, e in zip(words, got, strict=True)]


class _Codes(dict):
    """Number of each word of a chunk, by first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _pack(ranks: np.ndarray) -> bytes:
    """Ranks as two byte planes, those from 65,535 on as three more, compressed."""
    large = ranks >= 0xFFFF
    low = np.where(large, 0xFFFF, ranks).astype("<u2").view(np.uint8).reshape(-1, 2).T
    high = ranks[large].astype("<u4").view(np.uint8).reshape(-1, 4).T[:3]
    return zstandard.ZstdCompressor(level=1).compress(len(ranks).to_bytes(4, "little") + low.tobytes() + high.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(raw, np.uint8)
    ranks = planes[4 : 4 + n].astype(np.uint32) | planes[4 + n : 4 + 2 * n].astype(np.uint32) << 8
    high = planes[4 + 2 * n :].reshape(3, -1).astype(np.uint32)
    ranks[ranks == 0xFFFF] = high[0] | high[1] << 8 | high[2] << 16
    return ranks


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _chunked(path: str, distinct: int):
    """Chunks of documents: (chunk, i, sizes, codes, words), words by falling count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, first, made = splitter(path), TaskContext.get().partitionId() << 32, 0
        ids, codes, seen, total = [], [], _Codes(), 0

        def chunk() -> pa.RecordBatch:
            own = np.concatenate(codes)
            order = np.argsort(-np.bincount(own, minlength=len(seen)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = pa.array(list(seen), pa.string()).take(pa.array(order))
            sizes = pa.array([len(c) for c in codes], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made]), _one_list(pa.concat_arrays(ids)), _one_list(sizes), pa.array([_pack(rank[own])], pa.binary()), _one_list(words)],
                ["chunk", "i", "sizes", "codes", "words"],
            )

        for b in batches:
            i, lo = b.column("i"), 0
            for k, t in enumerate(b.column("t").to_pylist(), 1):
                codes.append(np.frombuffer(array("I", map(seen.__getitem__, split(t))), np.uint32))
                total += len(codes[-1])
                if len(seen) > distinct or total > LENGTH:
                    ids.append(i.slice(lo, k - lo))
                    yield chunk()
                    made, lo = made + 1, k
                    ids, codes, seen, total = [], [], _Codes(), 0
            ids.append(i.slice(lo))
        if codes:
            yield chunk()

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for b in batches:
            ids = pa.array(enc(b.column("w").to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("w"), ids], ["w", "ids"])

    return run


def word_table(places: DataFrame, path: str) -> DataFrame:
    """(w, ids, said): every distinct word of ``places`` (chunk, pos, w), encoded once; its ids joined to their pieces."""
    spark = places.sparkSession
    pieces = spark.createDataFrame(list(enumerate(Encoder(path).pieces)), "id int, piece string")  # a row per id of the vocabulary
    # all columns of the places go in, so the words come from the same shuffle that the join of the places reads
    words = places.groupBy("w").agg(F.min("chunk").alias("chunk"), F.min("pos").alias("pos"))
    encoded = words.mapInArrow(_encoded(path), "w string, ids array<int>").filter("w is not null").repartition("w")
    tokens = encoded.select("w", F.posexplode("ids").alias("k", "id")).join(F.broadcast(pieces), "id")
    whole = tokens.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("k", "id", "piece"))).alias("x"))
    return whole.select("w", F.col("x.id").alias("ids"), F.array_join("x.piece", " ").alias("said"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, found): ids and pieces of a task's places, packed for each chunk that has them."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PACKED:
            yield _packed(held)
            held, n = [], 0
    if n:
        yield _packed(held)


def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    # within a chunk the words stay in their own order, so neighbours share pieces
    t = t.take(pa.array(np.argsort(t.column("chunk").to_numpy(), kind="stable"))).combine_chunks()
    chunk, pos = t.column("chunk").to_numpy(), t.column("pos").to_numpy()
    ids, said = t.column("ids").chunk(0), t.column("said").chunk(0).cast(pa.binary())
    id_at, said_at = ids.offsets.to_numpy(), _offsets(said)
    values, letters = ids.values.to_numpy(), np.frombuffer(said.buffers()[2] or b"", np.uint8)
    begin = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    found = []
    for a, z in zip(begin, [*begin[1:], len(chunk)], strict=True):
        heads = [_planes(x) for x in (pos[a:z], np.diff(id_at[a : z + 1]), np.diff(said_at[a : z + 1]), values[id_at[a] : id_at[z]])]
        raw = b"".join([int(z - a).to_bytes(4, "little"), *heads, letters[said_at[a] : said_at[z]].tobytes()])
        found.append(zstandard.ZstdCompressor(level=6).compress(raw))
    return pa.RecordBatch.from_arrays([pa.array(chunk[begin]), pa.array(found, pa.binary())], ["chunk", "found"])


def _planes(x: np.ndarray) -> bytes:
    """Four byte planes, which compress better than the numbers."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]


def _table(found: list[bytes]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Row of each word of the chunk, and by row its ids and its pieces with a space after, as bytes."""
    pos, n_ids, n_said, ids, said = [], [], [], [], []
    for blob in found:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(raw[:4], "little")
        p, a, b = (_numbers(raw, n, 4 + k * 4 * n) for k in range(3))
        pos.append(p)
        n_ids.append(a)
        n_said.append(b)
        cut = 4 + 12 * n + 4 * int(a.sum())
        ids.append(_numbers(raw, int(a.sum()), 4 + 12 * n).tobytes())
        said.append(raw[cut:])
    at = np.concatenate(pos)
    row = np.empty(len(at), np.int64)
    row[at] = np.arange(len(at))
    binary = pa.binary()
    end = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    id_col = pa.Array.from_buffers(binary, len(at), [None, pa.py_buffer(end(4 * np.concatenate(n_ids))), pa.py_buffer(b"".join(ids))])
    said_col = pa.Array.from_buffers(binary, len(at), [None, pa.py_buffer(end(np.concatenate(n_said))), pa.py_buffer(b"".join(said))])
    return row, id_col, pc.binary_join_element_wise(said_col, b"", b" ")


def _finished(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield _chunk(b.column("i").slice(k, 1).flatten(), b.column("sizes")[k].values.to_numpy(), b.column("codes")[k].as_py(), b.column("found")[k].as_py(), with_ids)

    return run


def _chunk(i: pa.Array, sizes: np.ndarray, codes: bytes, found: list[bytes] | None, with_ids: bool) -> pa.RecordBatch:
    """Rows of the documents of one chunk: their words' ids and pieces laid end to end."""
    end = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    raw = said = b""
    id_end = said_end = np.zeros(len(end), np.int64)
    if end[-1]:
        row, ids, pieces = _table(found)
        rows = pa.array(row[_unpack(codes)])
        laid, text = ids.cast(pa.large_binary()).take(rows), pieces.cast(pa.large_binary()).take(rows)
        raw, said = memoryview(laid.buffers()[2]), memoryview(text.buffers()[2])
        id_end = np.frombuffer(laid.buffers()[1], np.int64)[end]
        said_end = np.frombuffer(text.buffers()[1], np.int64)[end]
    cut = [(a, z, c, max(c, d - 1)) for a, z, c, d in zip(id_end[:-1].tolist(), id_end[1:].tolist(), said_end[:-1].tolist(), said_end[1:].tolist(), strict=True)]
    cols = [i, pa.array((id_end[1:] - id_end[:-1]) // 4), pa.array([hashlib.sha256(raw[a:z]).hexdigest() for a, z, _, _ in cut], pa.string()),
            pa.array([hashlib.sha256(said[c:d]).hexdigest() for _, _, c, d in cut], pa.string())]
    names = ["i", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        cols += [pa.array([np.frombuffer(raw[a:z], "<u4").astype(np.int32) for a, z, _, _ in cut], pa.list_(pa.int32())),
                 pa.array([bytes(said[c:d]).decode() for _, _, c, d in cut], pa.string())]
        names += ["ids", "decoded"]
    return pa.RecordBatch.from_arrays(cols, names)


def encode_decode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False,
    distinct: int = DISTINCT,
) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids and decoded.

    1. One pass splits every text, once. Documents are written in chunks of about
       ``distinct`` different words: the words of the chunk, each once, and the documents
       as positions in that list. The table of chunks is bucketed by chunk.
    2. The lists' places (chunk, position, word) are shuffled by word. The distinct-word
       table is made from them: every word of the corpus is encoded once, and its ids are
       joined to the pieces, a broadcast table as large as the vocabulary.
    3. The places join the word table by the word itself, and what they find goes back to
       its chunk by (chunk, position); the buckets of chunks aren't shuffled again.
    A word has at most one place in a chunk, whatever its frequency, and a text's copies
    are spread like other texts, so no key is hot. A chunk is the largest thing a task
    holds; one document is never cut, so a chunk may exceed its bounds by one document.

    Null text is empty: no tokens. Repeated rows give repeated rows. Other columns are
    ignored. An empty table gives an empty result.
    """
    path = path or default_path()
    narrow = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = dict(narrow.dtypes)["i"]
    made = narrow.mapInArrow(_chunked(path, distinct), f"chunk bigint, i array<{kind}>, sizes array<int>, codes binary, words array<string>")
    chunks = bucketed_table(made, "chunk", "bpe-chunks")
    # in the words' order, which compresses better
    listed = F.sort_array(F.transform("words", lambda w, k: F.struct(w.alias("w"), k.alias("pos"))))
    places = chunks.select("chunk", F.inline(listed)).filter("w is not null").repartition("w")
    found = places.join(word_table(places, path), "w").select("chunk", "pos", "ids", "said")
    found = found.mapInArrow(_placed, "chunk bigint, found binary").groupBy("chunk").agg(F.collect_list("found").alias("found"))
    both = chunks.select("chunk", "i", "sizes", "codes").join(found, "chunk", "left").select("i", "sizes", "codes", "found")
    out = f"i {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return both.mapInArrow(_finished(with_ids), out).withColumnRenamed("i", id_col)
