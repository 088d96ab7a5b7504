"""Decontaminated selection to exact token quotas under a subword tokenizer.

A row of n tokens has n + 1 loss targets. Rows of a source are taken whole in hash order while they fit its quota, by a
distributed running total; only what is left at the boundary is settled row by row. A cut of a text has to encode to
the number of tokens wanted, which a subword tokenizer does not grant at every place, and its pieces are checked for
contamination again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from millrace.functions import hashing as H
from millrace.operators import contamination as C
from millrace.operators import dedup as D
from millrace.operators import ordered as W
from millrace.plans.corpus import quotas
from millrace.session import written

#: Encodes a text to token ids, and decodes ids to a text.
Codec = tuple[Callable[[str], list[int]], Callable[[list[int]], str]]


def code_points() -> Codec:
    """One token a character."""
    return (lambda t: [ord(c) for c in t]), (lambda ids: "".join(map(chr, ids)))


def tokenizer_file(path: str) -> Callable[[], Codec]:
    """The codec of a tokenizers file."""

    def load() -> Codec:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        return (lambda t: made.encode(t, add_special_tokens=False).ids), (lambda ids: made.decode(ids, skip_special_tokens=False))

    return load


def outward(middle: int, last: int) -> Iterator[int]:
    """1 to last by their distance from middle, the smaller first."""
    yield from sorted(range(1, last + 1), key=lambda k: (abs(k - middle), k))


def exact_prefix(text: str, tokens: int, codec: Codec) -> str | None:
    """The prefix of a text, cut between tokens as near to the place as can be, that encodes to just so many tokens."""
    encode, decode = codec
    ids = encode(text)
    cuts = (decode(ids[:k]) for k in outward(tokens, len(ids)))
    return next((t for t in cuts if len(encode(t)) == tokens), None) if tokens > 0 else None


def halves(text: str, codec: Codec) -> tuple[str, str] | None:
    """The text in two, as near to its middle as can be, whose tokens add up to its own: together one target more."""
    encode, decode = codec
    ids = encode(text)
    cuts = ((decode(ids[:k]), decode(ids[k:])) for k in outward(len(ids) // 2, len(ids) - 1))
    return next(((a, b) for a, b in cuts if (x := encode(a)) and (y := encode(b)) and len(x) + len(y) == len(ids)), None)


def boundary(pending: str | None, left: int, later: Iterator[str], codec: Codec, clean: Callable[[str], bool]) -> tuple[bool, list[tuple[int, int, str]]]:
    """Fills the last left targets: whether the pending row stays whole, and pieces (candidate, piece, text).

    Candidate -1 is the pending row, the last that was taken whole; others are numbered as they come. One target is too
    few for a piece, so the pending row is cut in two; if that cannot be, or a half is contaminated, it goes and a
    piece of a later candidate takes its place. A shortage is an error.
    """
    stays = True
    if left == 1 and pending is not None:
        parts = halves(pending, codec)
        if parts and all(map(clean, parts)):
            return False, [(-1, k, p) for k, p in enumerate(parts)]
        stays, left = False, left + len(codec[0](pending)) + 1
    if left > 1:
        for k, text in enumerate(later):
            if len(codec[0](text)) >= left - 1 and (piece := exact_prefix(text, left - 1, codec)) and clean(piece):
                return stays, [(k, 0, piece)]
    raise ValueError(f"the quota is short by {left}")


def remix(docs: DataFrame, weights: dict[str, float], total: int, benchmark: DataFrame, seed: str = "remix", codec: Callable[[], Codec] = code_points) -> DataFrame:
    """doc_id, source, text, targets, piece (null for whole rows): exactly total targets, by source as the weights say.

    Documents in the ledger of exclusions (exact, containment, empty text) never enter, of equal texts the first in
    order does, and what an earlier source took is barred from later ones. Sources come in the order of their names.
    """
    spark = docs.sparkSession

    @pandas_udf("bigint")
    def targets(texts: pd.Series) -> pd.Series:
        encode, _ = codec()
        return texts.map(lambda t: len(encode(t)) + 1)

    rows = docs.select("doc_id", "source", "text").join(C.ledger(docs, benchmark, []).select("doc_id").distinct(), "doc_id", "left_anti").where("text is not null")
    rows = written(rows.withColumn("targets", targets("text")).withColumn("content", H.sha256(F.col("text"))))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def clean(text: str) -> bool:
        one = spark.createDataFrame([(0, text)], "doc_id long, text string")
        return C.ledger(one, benchmark, []).isEmpty()

    out, seen = None, None
    for source, quota in sorted(quotas(weights, total).items()):
        left = rows.where(F.col("source") == source)
        left = left if seen is None else D.unseen(left, seen, ["content"])
        order = F.concat_ws(":", H.sha256(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), F.col("doc_id").cast("string"))
        left = written(W.running(D.exact_first(left.withColumn("order", order), F.col("content"), "order"), ["order"], F.col("targets")))
        whole = left.where(F.col("running_total") <= quota)
        last = whole.orderBy(F.desc("running_total")).select("order", "text", "running_total").first()
        gap = quota - (last["running_total"] if last else 0)
        pieces = []
        if gap:
            after = left.where(F.col("running_total") > quota).orderBy("order").select("doc_id", "text")
            met: list = []
            stream = (met.append(r["doc_id"]) or r["text"] for r in after.toLocalIterator())
            stays, found = boundary(last["text"] if last else None, gap, stream, codec(), clean)
            own = whole.where(F.col("order") == last["order"]).first()["doc_id"] if last else None
            pieces = [(own if k < 0 else met[k], source, t, len(codec()[0](t)) + 1, i) for k, i, t in found]
            whole = whole if stays or last is None else whole.where(F.col("order") != last["order"])
        took = whole.select("doc_id", "source", "text", "targets", F.lit(None).cast("int").alias("piece"))
        if pieces:
            took = took.unionByName(spark.createDataFrame(pieces, f"doc_id {kind}, source string, text string, targets bigint, piece int"))
        took = written(took)
        digests = took.select(H.sha256(F.col("text")).alias("content"))
        out, seen = (took, digests) if out is None else (out.unionByName(took), seen.unionByName(digests))
    return out
