"""Conversations: canonical messages, turns, packing, prompts, masks and trajectories.

The long form has one row a message (conv_id, turn, role, text); the nested form is an array of messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "function": "tool", "observation": "tool"}
MESSAGE = StructType([StructField(n, StringType()) for n in ("role", "content", "reasoning_content", "tools", "tool_calls")])
CONVERSATIONS = StructType([StructField("conversations", ArrayType(MESSAGE))])
BOS, EOS = "<|im_start|>", "<|im_end|>"


def nest(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and messages in turn order."""
    made = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return made.select(key, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def canonical(messages: Column) -> Column:
    """Roles by their usual names, contents trimmed."""
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    role = lambda m: F.lower(F.trim(m["role"]))
    return F.transform(messages, lambda m: F.struct(F.coalesce(F.try_element_at(names, role(m)), role(m)).alias("role"), F.trim(m["content"]).alias("content")))


def rejection(messages: Column) -> Column:
    """Why a conversation is not trainable, or null; the first reason counts."""
    known = F.forall(messages, lambda m: m["role"].isin("system", "user", "assistant", "tool"))
    filled = F.forall(messages, lambda m: F.coalesce(F.length(m["content"]), F.lit(0)) > 0)
    body = F.filter(messages, lambda m: m["role"] != "system")
    late_system = F.exists(F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0))), lambda m: m["role"] == "system")
    return (
        F.when(F.size(messages) == 0, "empty").when(~known, "unknown_role").when(~filled, "empty_content").when(late_system, "late_system")
        .when(F.size(body) == 0, "no_turn").when(body[0]["role"] != "user", "first_not_user").when(F.element_at(body, -1)["role"] != "assistant", "last_not_assistant")
    )


def prompt(messages: Column) -> Column:
    """All user contents, one a line."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"]), "\n")


def render(messages: Column) -> Column:
    """The chat template of plain turns."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(BOS), m["role"], F.lit("\n"), m["content"], F.lit(EOS + "\n"))), "")


def turns(df: DataFrame) -> DataFrame:
    """The long form with user_turn: how many user messages have come so far; 0 is what precedes the first."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("user_turn", F.sum((F.col("role") == "user").cast("long")).over(w))


def turn_violations(df: DataFrame) -> DataFrame:
    """conv_id, user_turn and why: a turn must go from user to assistant, and every tool call must be answered.

    calls is the number of tool calls that a message makes; 0 where the column is absent.
    """
    calls = F.coalesce(F.col("calls"), F.lit(0)) if "calls" in df.columns else F.lit(0)
    rows = turns(df).withColumn("calls__", calls)
    w = Window.partitionBy("conv_id", "user_turn").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("pending", F.sum(F.col("calls__") - (F.col("role") == "tool").cast("long")).over(w))
    per = rows.where("user_turn > 0").groupBy("conv_id", "user_turn").agg(
        F.min("pending").alias("least"), F.max_by("pending", "turn").alias("open"), F.max_by("role", "turn").alias("last"), F.sum((F.col("role") == "assistant").cast("long")).alias("replies")
    )
    why = F.when(F.col("replies") == 0, "no_reply").when(F.col("least") < 0, "tool_without_call").when(F.col("open") != 0, "open_call").when(F.col("last") != "assistant", "last_not_assistant")
    return per.select("conv_id", "user_turn", why.alias("why")).where("why is not null")


def turn_chunks(df: DataFrame, most: int, overhead: int = 0) -> DataFrame:
    """conv_id, chunk, first_turn, last_turn, chars: whole user turns packed greedily up to most characters each.

    A turn longer than most is dropped and ends the chunk before it. One pass over each conversation's turn sizes.
    """
    sizes = turns(df).where("user_turn > 0").groupBy("conv_id", "user_turn").agg(F.sum(F.length("text") + overhead).alias("n"))
    lists = sizes.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("user_turn", "n"))).alias("t"))
    kind = "struct<done:array<struct<first_turn:bigint,last_turn:bigint,chars:bigint>>,first:bigint,last:bigint,chars:bigint>"
    start = F.struct(F.array().alias("done"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("chars")).cast(kind)

    def closed(acc: Column) -> Column:
        one = F.array(F.struct(acc["first"].alias("first_turn"), acc["last"].alias("last_turn"), acc["chars"].alias("chars")))
        return F.when(acc["chars"] > 0, F.concat(acc["done"], one)).otherwise(acc["done"])

    def state(done: Column, first: Column, last: Column, chars: Column) -> Column:
        return F.struct(done.alias("done"), first.alias("first"), last.alias("last"), chars.alias("chars")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        return (
            F.when(x["n"] > most, state(closed(acc), F.lit(0), F.lit(0), F.lit(0)))
            .when((acc["chars"] > 0) & (acc["chars"] + x["n"] <= most), state(acc["done"], acc["first"], x["user_turn"], acc["chars"] + x["n"]))
            .otherwise(state(closed(acc), x["user_turn"], x["user_turn"], x["n"]))
        )

    packed = lists.select("conv_id", F.posexplode(F.aggregate("t", start, step, closed)).alias("chunk", "c"))
    return packed.select("conv_id", F.col("chunk").cast("long").alias("chunk"), "c.first_turn", "c.last_turn", "c.chars")


def choose_chunk(chunks: DataFrame, key: str, identity: Column) -> DataFrame:
    """Of each key's chunks the one with the least digest of its identity."""
    from millrace.functions.hashing import sha256

    return chunks.withColumn("d__", sha256(identity)).withColumn("k__", F.row_number().over(Window.partitionBy(key).orderBy("d__"))).where("k__ = 1").drop("d__", "k__")


def assistant_spans(rendered: Column) -> Column:
    """The supervised parts of rendered text: each assistant content with its closing mark."""
    return F.regexp_extract_all(rendered, F.lit(r"(?s)<\|im_start\|>assistant\n(.*?<\|im_end\|>\n)"), F.lit(1))


def label_mask(ids: Column, start: list[int], end: list[int], ignore: int = -100) -> Column:
    """Labels of token ids: the ids between a start marker and through its end marker, else ignore."""
    n = len(start)

    def at(i: Column, marker: list[int]) -> Column:
        return F.slice(ids, i, len(marker)) == F.array(*[F.lit(x) for x in marker])

    size = F.size(ids)
    places = F.sequence(F.lit(1), size)
    opens = F.filter(places, lambda i: at(i, start))
    spans = F.transform(opens, lambda o: F.struct((o + n).alias("lo"), F.coalesce(F.try_element_at(F.filter(places, lambda j: (j >= o + n) & at(j, end)), F.lit(1)) + (len(end) - 1), size).alias("hi")))
    return F.transform(places, lambda i: F.when(F.exists(spans, lambda s: (i >= s["lo"]) & (i <= s["hi"])), ids[i - 1]).otherwise(F.lit(ignore)))


def encode_pretrain(ids: Column, length: int, bos: int, eos: int, pad: int) -> Column:
    """begin, at most length - 2 ids, end, and padding."""
    body = F.concat(F.array(F.lit(bos)), F.slice(ids, 1, length - 2), F.array(F.lit(eos)))
    return F.concat(body, F.array_repeat(F.lit(pad), F.lit(length) - F.size(body)))


def pretrain_labels(ids: Column, pad: int, ignore: int = -100) -> Column:
    """Every id equal to the padding is ignored, wherever it stands."""
    return F.transform(ids, lambda x: F.when(x == pad, F.lit(ignore)).otherwise(x))


def shifted(ids: Column, mask: Column) -> tuple[Column, Column, Column]:
    """Inputs, targets and the targets' mask."""
    n = F.size(ids)
    return F.slice(ids, 1, n - 1), F.slice(ids, 2, n - 1), F.slice(mask, 2, n - 1)


def valid_tokens(ids: Column, labels: Column, vocabulary: int, most: int) -> Column:
    """Equal lengths, 2 to most ids, all in the vocabulary, and a supervised target."""
    inside = F.forall(ids, lambda x: x.between(0, vocabulary - 1))
    return (F.size(ids) == F.size(labels)) & F.size(ids).between(2, most) & inside & F.exists(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != -100)


def code_points(text: Column) -> Column:
    """One token a code point: the tokenizer of tests and of SQL checks."""
    return F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c)))


def without_last(messages: Column) -> Column:
    return F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))


def trajectories(df: DataFrame) -> DataFrame:
    """One row for each assistant message of nested conversations: step, the messages before it and its content."""
    rows = df.select("conv_id", "messages", F.posexplode("messages").alias("at", "m")).where("m.role = 'assistant'")
    return rows.select("conv_id", F.col("at").alias("step"), F.slice("messages", F.lit(1), F.col("at")).alias("prefix"), F.col("m.content").alias("target"))


def pad_batches(df: DataFrame, ids: str, batch: str, pad: int) -> DataFrame:
    """ids padded to the longest of each batch, and the mask."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("longest__"))
    rows = df.join(longest, batch)
    gap = F.col("longest__") - F.size(ids)
    return rows.withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap))).withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad), gap))).drop("longest__")


def best_path(nodes: DataFrame, steps: int = 31) -> DataFrame:
    """tree, depth, node of the greedy path from each root: at each step the best child of the other role.

    Children are ranked by (not reviewed, rank, synthetic, id), absent ranks last. The best child of each node and
    role is chosen in one aggregation; then each step is a join on the path's ends.
    """
    from millrace.session import written

    order = F.struct(~F.coalesce("reviewed", F.lit(False)), F.col("rank").isNull(), F.col("rank"), F.coalesce("synthetic", F.lit(False)), F.col("node"))
    best = written(nodes.where("parent is not null").groupBy(F.col("parent").alias("at"), "role").agg(F.min_by("node", order).alias("next")))
    path = written(nodes.where("parent is null").select(F.col("node").alias("tree"), F.lit(0).alias("depth"), "node", "role"))
    ends = path
    for depth in range(1, steps + 1):
        other = F.when(F.col("role") == "user", "assistant").otherwise("user")
        ends = ends.select("tree", F.col("node").alias("at"), other.alias("role")).join(best, ["at", "role"])
        ends = written(ends.select("tree", F.lit(depth).alias("depth"), F.col("next").alias("node"), "role"))
        if ends.isEmpty():
            break
        path = path.unionByName(ends)
    return path


def preference_rejection(chosen: Column, rejected: Column, most: int) -> Column:
    """Why a preference pair is not trainable, or null: context, short context, answers, length."""
    context = without_last(chosen)
    size = F.length(F.regexp_replace(prompt(chosen), r"(?U)\W", ""))
    longest = F.greatest(F.length(render(chosen)), F.length(render(rejected)))
    return (
        F.when(context != without_last(rejected), "context_differs").when(F.element_at(chosen, -1)["content"] == F.element_at(rejected, -1)["content"], "same_answer")
        .when(size < 12, "short_prompt").when(longest > most, "too_long")
    )


def prompt_response_labels(prompt_ids: Column, reply_ids: Column, eos: int, most: int, ignore: int = -100) -> tuple[Column, Column]:
    """Ids and labels of a prompt and its reply with an end; both are cut at most, and the prompt is not supervised."""
    ids = F.slice(F.concat(prompt_ids, reply_ids, F.array(F.lit(eos))), 1, most)
    labels = F.concat(F.transform(prompt_ids, lambda x: F.lit(ignore)), reply_ids, F.array(F.lit(eos)))
    return ids, F.slice(labels, 1, most)
