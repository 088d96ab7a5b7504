"""Packing by power-of-two decomposition.

A document's tokens, closed by the id 0, are cut into pieces whose lengths are powers of two: as many of 1024 as
fit, then the binary digits of the rest from the largest down. Each piece is a sequence of its own in the bucket of
its length, so no sequence crosses documents and none is padded. Batches are drawn from one bucket at a time.

Tokens are those of the given tokenizers file without added special tokens. The byte-level vocabulary is encoded by
tiktoken from the same ranks, which gives the same ids several times faster; texts that hold the string of a special
token go through the tokenizers library itself, whose added tokens decide there.

Sequence numbers are unique: the piece's place in its partition below the partition's number. Pieces keep the
order of their document. No shuffle takes place.

Texts of more than CHUNK_BYTES characters are encoded part by part, cut where the vocabulary's pattern begins a new token in
any case, to the same ids; a text that may hold an added token is not cut.

Defined results: null and empty texts are the one token 0; null ids and repeated rows are packed like all others,
and a repeated id's pieces overlap in start; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import CHUNK_BYTES, chunks, tidy

LENGTH = 1024
END = 0
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int, ids array<int>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODERS: dict[tuple[str, str | None], Callable[[list[str]], list[list[int]]]] = {}


def encoder(vocabulary: str, ranks: str | None) -> Callable[[list[str]], list[list[int]]]:
    """Texts to ids; made once a worker."""
    if (vocabulary, ranks) in _ENCODERS:
        return _ENCODERS[vocabulary, ranks]
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    if ranks is None:
        _ENCODERS[vocabulary, ranks] = lambda texts: [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]
        return _ENCODERS[vocabulary, ranks]
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    added = [t.content for t in exact.get_added_tokens_decoder().values()]

    def ids(text: str) -> list[int] | np.ndarray:
        if len(text) <= CHUNK_BYTES:
            return fast.encode_ordinary(text)
        return np.concatenate([np.array(fast.encode_ordinary(p), np.uint32) for p in parts(text)])

    def encode(texts: list[str]) -> list[list[int]]:
        return [exact.encode(t, add_special_tokens=False).ids if any(a in t for a in added) else ids(t) for t in texts]

    _ENCODERS[vocabulary, ranks] = encode
    return encode


#: Before a single space between a character that is no white space and a letter a new token begins in any case.
_CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")


def parts(text: str, size: int = CHUNK_BYTES) -> Iterator[str]:
    """A text in parts of about size characters that are encoded one by one to the same ids; whole where no place to cut is found."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def decompose(n: int, most: int = LENGTH) -> list[int]:
    """Powers of two that add up to n, each at most most, from the largest down."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(documents: DataFrame, vocabulary: str | None = None, ranks: str | None = "", length: int = LENGTH, with_ids: bool = True, text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if asked for, ids.

    ranks is the tiktoken file of the same vocabulary; None encodes all with the tokenizers library, "" finds the
    file beside the default vocabulary.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length must be a power of two")
    if ranks == "":
        ranks = default_vocabulary().removesuffix(".json") + ".tiktoken" if vocabulary is None else None
    vocabulary = vocabulary or default_vocabulary()
    kind = documents.schema["doc_id"].dataType
    schema = PIECE if with_ids else PIECE.removesuffix(", ids array<int>")
    schema = schema.replace("doc_id bigint", f"doc_id {kind.simpleString()}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                doc, start, size, total, crc, ids = [], [], [], [], [], []
                for i, tokens in enumerate(encode(texts)):
                    all_ids = np.empty(len(tokens) + 1, "<u4")
                    all_ids[:-1], all_ids[-1] = tokens, END
                    at = 0
                    for n in decompose(len(all_ids), length):
                        piece = all_ids[at : at + n]
                        doc.append(i)
                        start.append(at)
                        size.append(n)
                        total.append(len(all_ids))
                        crc.append(zlib.crc32(piece.tobytes()))
                        if with_ids:
                            ids.append(piece)
                        at += n
                out = {"doc_id": part.column(0).take(pa.array(doc, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "bucket": pa.array([n.bit_length() - 1 for n in size], pa.int32())}
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_pydict(out)

    pieces = documents.select("doc_id", F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder for each length, for training that draws batches of one length."""
    packed.write.partitionBy("bucket").parquet(path)


def report(documents: DataFrame) -> DataFrame:
    return pack(documents, with_ids=False)
