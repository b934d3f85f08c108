"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a byte-level model: each byte is written as one
printable character (the byte-to-character table of ``byte_characters``), each token as the
string of its bytes' characters, and each token's only merge is found by splitting the token
with the ranks below its own. In a vocabulary that was trained by merging, that split has
exactly two parts, and then merging by pairs gives what merging by the ranks of joined bytes
gives; a token whose split has more parts gets every pair of tokens that joins to it.

``encode`` adds ids and offsets. Offsets are in characters of the text: a token that holds
only a part of a character's bytes has the span of the whole character. ``decode`` turns ids
back into bytes with the reversed table: a character split over tokens is whole again in
``decoded``; bytes that are no UTF-8 become U+FFFD in ``decoded_text`` only.

The rank file is read once, on the driver, and broadcast (some 1 MB, whatever the corpus); texts are
cut by the vocabulary's own pattern before anything is merged.

Before that, texts are cut where no match can span: at a blank between two characters that are
no white space, which always begins a match of its own. A slice's distinct pieces are encoded
once each (those that can follow each other as one text), and each text's ids are put together
from those of its pieces.

A null text is an empty text, with no ids; an empty table gives an empty result; null ids decode to nothing. Texts are never cut:
a batch is handled in slices of about SLICE_BYTES bytes, but always by whole texts.
Ids outside the vocabulary raise. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractlog.llm.common import small_batches

#: Text whose pieces are told apart at once, text and pieces that are encoded at once (encodings take far more memory than texts), rows that are decoded at once.
SLICE_BYTES, CODED_BYTES, PIECES, DECODE_ROWS = 1 << 20, 1 << 17, 1 << 10, 512


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where Latin-1 prints it, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def parse_ranks(body: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in body.splitlines() if line.strip())}


def rank_file(path: str | None) -> bytes:
    with open(path or default_ranks(), "rb") as f:
        return f.read()


def read_ranks(path: str) -> dict[bytes, int]:
    return parse_ranks(rank_file(path))


def split_below(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The token's parts after all merges whose rank is below the token's own."""
    parts, most = [token[k : k + 1] for k in range(len(token))], ranks[token]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[k] + parts[k + 1], most), k) for k in range(len(parts) - 1))
        if rank >= most:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def spelling(ranks: dict[bytes, int]) -> dict[str, int]:
    """The vocabulary in byte characters."""
    chars = byte_characters()
    return {"".join(chars[b] for b in token): rank for token, rank in ranks.items()}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """Merges in order of rank, in byte characters."""
    chars = byte_characters()
    spelt = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        if len(token) > 1:
            parts = split_below(token, ranks)
            pairs = [tuple(parts)] if len(parts) == 2 else [(token[:k], token[k:]) for k in range(1, len(token))]
            merges += [(spelt(a), spelt(b)) for a, b in pairs if a in ranks and b in ranks]
    return merges


@lru_cache(maxsize=4)
def tokenizer(body: bytes, pattern: str):
    """The model of a rank file, once for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core already
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = parse_ranks(body)
    # without the library's cache of words: most words here are met once
    made = Tokenizer(models.BPE(vocab=spelling(ranks), merges=merges_of(ranks), ignore_merges=True, cache_capacity=0))
    cut = pre_tokenizers.Split(Regex(pattern), "isolated")
    made.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@lru_cache(maxsize=4)
def token_bytes(body: bytes) -> pa.Array:
    """The bytes of each id, from its byte characters by the reversed table; null where there is no such id."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = spelling(parse_ranks(body))
    out: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        out[k] = bytes(back[c] for c in token)
    return pa.array(out, pa.binary())


def _slices(batch: pa.RecordBatch, col: str):
    """Parts of a batch, by whole rows, with about SLICE_BYTES of text each, and their texts."""
    at = batch.schema.get_field_index(col)
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = min(batch.num_rows, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE_BYTES)) + 1)
        part = batch.slice(start, end - start)
        yield part, pc.fill_null(part.column(at), "").take(pa.array(np.arange(end - start)))  # a copy from 0 on
        start = end


def _plain(code: np.ndarray) -> np.ndarray:
    """Bytes that are a character of their own and no white space."""
    return (code > 0x20) & (code < 0x7F)


def _begins(code: np.ndarray) -> np.ndarray:
    """Bytes that begin a character that is surely no white space."""
    return _plain(code) | ((code >= 0xC3) & (code != 0xE1) & (code != 0xE2) & (code != 0xE3))


def _pieces(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin and end, in bytes: at the texts' own bounds and at blanks that begin a match.

    What follows the blank is a plain character or the first byte of one beyond U+00BF; first
    bytes that white space has as well (of U+1680, U+2000 and on, U+3000) are left alone.
    """
    cuts = np.flatnonzero((code[1:-1] == 0x20) & _plain(code[:-2]) & _begins(code[2:])) + 1
    return np.unique(np.concatenate([offsets, cuts]))


def _encoded(model, texts: pa.Array, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, one after another; ids before each text)"""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
    data = texts.buffers()[2]
    if not offsets[-1]:
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    bounds = _pieces(np.frombuffer(data, np.uint8)[: offsets[-1]], offsets)
    pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), data).dictionary_encode()
    found = _lists(model, pieces.dictionary, length).take(pieces.indices)
    before = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(found)))])
    return np.asarray(found.flatten()), before[np.searchsorted(bounds, offsets)]


def _joinable(each: pa.Array) -> np.ndarray:
    """Whether pieces can follow each other in one text: they begin at a blank that begins a match, and end plainly."""
    bounds = np.frombuffer(each.buffers()[1], np.int32)[: len(each) + 1]
    code = np.append(np.frombuffer(each.buffers()[2], np.uint8), [0, 0]).astype(np.uint8)
    first, last = bounds[:-1], bounds[1:] - 1
    return (np.diff(bounds) > 1) & (code[first] == 0x20) & _begins(code[first + 1]) & _plain(code[np.maximum(0, last)])


def _lists(model, each: pa.Array, length: np.ndarray) -> pa.ListArray:
    """The ids of each piece."""
    joined = _joinable(each)
    row, at = each.filter(pa.array(joined)), 0
    ids, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    bounds, data = np.frombuffer(row.buffers()[1], np.int32)[: len(row) + 1] if len(row) else np.zeros(1, np.int32), row.buffers()[2]
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CODED_BYTES, "right")) - 1)
        made = np.array(model.encode_batch_fast([data[int(bounds[at]) : int(bounds[end])].to_pybytes().decode()], add_special_tokens=False)[0].ids, np.int32)
        ends = bounds[at] + np.cumsum(length[made])
        upto = np.searchsorted(ends, bounds[at + 1 : end + 1])
        if (ends[upto] != bounds[at + 1 : end + 1]).any():
            raise RuntimeError("a match spans two pieces")
        ids.append(made)
        sizes.append(np.diff(np.concatenate([[-1], upto])))
        at = end
    rest = each.filter(pa.array(~joined))
    for k in range(0, len(rest), PIECES):
        made = [e.ids for e in model.encode_batch_fast(rest.slice(k, PIECES).to_pylist(), add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, made), np.int64))
        ids.append(np.fromiter(chain.from_iterable(made), np.int32))
    place = np.empty(len(each), np.int64)
    place[joined], place[~joined] = np.arange(len(row)), len(row) + np.arange(len(rest))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))).take(pa.array(place))


def character_spans(code: np.ndarray, offsets: np.ndarray, before: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token within its text, from the tokens' lengths in bytes.

    code, offsets: the texts' bytes and bounds; before: tokens before each text. A byte belongs
    to the character that its last leading byte began, so a token with a part of a character has
    the whole character's span.
    """
    ends = np.cumsum(lengths)
    of = np.cumsum((code & 0xC0) != 0x80) - 1
    first = np.repeat(of[np.minimum(offsets[:-1], len(code) - 1)], np.diff(before)) if len(code) else np.empty(0, np.int64)
    return (of[ends - lengths] - first).astype(np.int32), (of[ends - 1] + 1 - first).astype(np.int32)


def _joined(batch: pa.RecordBatch, drop: set[str], **cols: pa.Array) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in drop]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), *cols.values()], [*(n for n, _ in kept), *cols])


def _plus(df: DataFrame, drop: set[str], *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in drop] + [T.StructField(n, t, False) for n, t in fields])


def _encoder(ranks, pattern: str, text_col: str, offsets: bool, drop: set[str]):
    def run(batches):
        model = tokenizer(ranks.value, pattern)
        length = np.asarray(pc.fill_null(pc.binary_length(token_bytes(ranks.value)), 0))
        for batch in batches:
            for part, texts in _slices(batch, text_col):
                ids, before = _encoded(model, texts, length)
                at = pa.array(before, pa.int32())
                listed = lambda values: pa.ListArray.from_arrays(at, pa.array(values, pa.int32()))  # noqa: B023, E731
                made = {"ids": listed(ids)}
                if offsets:
                    bounds = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
                    code = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: bounds[-1]]
                    spans = character_spans(code, bounds, before, length[ids])
                    made |= {"starts": listed(spans[0]), "ends": listed(spans[1])}
                yield _joined(part, drop, **made)

    return run


def encode(df: DataFrame, text_col: str = "text", ranks_path: str | None = None, offsets: bool = True, pattern: str | None = None) -> DataFrame:
    """df with ids array<int> and, with offsets, starts and ends array<int> (characters of the text)."""
    small_batches(df.sparkSession)
    ranks, ints = df.sparkSession.sparkContext.broadcast(rank_file(ranks_path)), T.ArrayType(T.IntegerType(), False)
    fields = [("ids", ints), *([("starts", ints), ("ends", ints)] if offsets else [])]
    drop = {n for n, _ in fields}
    if text_col in drop:
        raise ValueError(f"the text column can't be named {text_col}")
    return df.mapInArrow(_encoder(ranks, pattern or default_pattern(), text_col, offsets, drop), _plus(df, drop, *fields))


def _decoder(ranks, ids_col: str, text: bool, drop: set[str]):
    def run(batches):
        token = token_bytes(ranks.value)
        for batch in (b.slice(k, DECODE_ROWS) for b in batches for k in range(0, b.num_rows, DECODE_ROWS)):
            lists = pc.fill_null(batch.column(batch.schema.get_field_index(ids_col)), [])
            ids = lists.flatten()
            if ids.null_count or (len(ids) and (pc.min(ids).as_py() < 0 or pc.max(ids).as_py() >= len(token))):
                raise ValueError("an id outside the vocabulary")
            parts = token.take(ids)
            if parts.null_count:
                raise ValueError("an id outside the vocabulary")
            # the bytes of all tokens follow each other; a row's begin and end with its tokens
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(parts)).astype(np.int64))])
            ends = np.asarray(lists.offsets).astype(np.int64)
            rows = pa.array(bounds[ends - ends[0]], pa.int32())
            whole = pa.array([b"".join(parts.to_pylist())]) if parts.offset else parts
            data = whole.buffers()[2] or pa.py_buffer(b"")
            made = {"decoded": pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, rows.buffers()[1], data])}
            if text:
                made["decoded_text"] = pa.array([x.decode("utf-8", "replace") for x in made["decoded"].to_pylist()], pa.string())
            yield _joined(batch, drop, **made)

    return run


def decode(df: DataFrame, ids_col: str = "ids", ranks_path: str | None = None, text: bool = True) -> DataFrame:
    """df with decoded binary (the exact bytes) and, if asked for, decoded_text string."""
    small_batches(df.sparkSession)
    fields = [("decoded", T.BinaryType()), *([("decoded_text", T.StringType())] if text else [])]
    drop = {n for n, _ in fields}
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(ranks_path))
    return df.mapInArrow(_decoder(ranks, ids_col, text, drop), _plus(df, drop, *fields))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """The contract's row of each document, derived from encode() and decode()."""
    coded = encode(docs.select(F.col(id_col), F.col(text_col)), text_col, ranks_path)
    coded = coded.select(
        F.col(id_col), "ids", F.size("ids").cast("long").alias("n_tokens"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("last_end")
    )
    back = decode(coded, "ids", ranks_path, text=False)
    return back.select(
        F.col(id_col),
        "n_tokens",
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("last_end").cast("long").alias("chars_covered"),
    )
